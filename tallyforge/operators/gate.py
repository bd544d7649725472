"""The privacy gate: nothing but numbers, fixed labels and two public addresses leaves the engine."""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import labels as L
from ..sources.prices import SOURCE_A, SOURCE_B

PUBLIC = (SOURCE_A, SOURCE_B)
KEY, VALUE = r"^[A-Za-z0-9][A-Za-z0-9_.:+~*\-]{0,79}$", r"^[A-Za-z0-9][A-Za-z0-9_.:+~*\- ]{0,79}$"
OPEN = ""
KEYS = L.Rules([("unsafe key", f"^(?!{KEY[1:]})"), *L.DENY], OPEN)
VALUES = L.Rules([(OPEN, PUBLIC), ("unsafe value", f"^(?!{VALUE[1:]})"), *L.DENY], OPEN, odd="unsupported type")


class Withheld(Exception):
    """Names the rule that was broken and the place, never the value."""


def leaves(value) -> Iterator[tuple[str, L.Rules, object]]:
    """(place, rules, leaf) of a nested value; a key is a leaf too, and comes before what is under it."""
    todo = deque([("$", value)])
    while todo:
        at, x = todo.popleft()
        if isinstance(x, dict):
            for k, v in x.items():
                yield at, KEYS, k
                todo.append((f"{at}.{k}", v))
        elif isinstance(x, (list, tuple)):
            todo.extend((f"{at}[{i}]", v) for i, v in enumerate(x))
        else:
            yield at, VALUES, x


def reason(rules: L.Rules, leaf) -> str:
    """The rule that a leaf breaks; OPEN if it may leave. Numbers may if they are finite, and so may truth values and nulls as values."""
    if rules is KEYS and not isinstance(leaf, str):
        return "unsafe key"
    if isinstance(leaf, (int, float)):
        return OPEN if math.isfinite(leaf) else "non-finite number"
    return rules.of(leaf)


def check(value):
    """The value itself if all of it may leave."""
    for at, rules, leaf in leaves(value):
        if broken := reason(rules, leaf):
            raise Withheld(f"{broken} at {at}")
    return value


def clean(text: str, allowed: tuple[str, ...] = PUBLIC) -> str:
    """Rendered text itself, if no withheld shape is in it besides the allowed addresses."""
    if broken := L.unsafe(re.sub("|".join(map(re.escape, allowed)), "", text)):
        raise Withheld(f"{broken} in rendered output")
    return text


def violations(leaves: DataFrame) -> DataFrame:
    """The rows (path, key, value) of a flattened result that check() would refuse, with the reason; a `fault` found while flattening is one."""
    found = [F.nullif(rules.column(F.col(c)), F.lit(OPEN)) for c, rules in (("key", KEYS), ("value", VALUES))]
    faults = [F.col("fault")] if "fault" in leaves.columns else []
    return leaves.withColumn("reason", F.coalesce(*faults, *found)).where("reason is not null").drop("fault")


#: Levels of nesting that are opened; what lies deeper is refused.
LEVELS = 12
MAP, ARRAY = "try_variant_get(_v, '$', 'map<string, variant>')", "try_variant_get(_v, '$', 'array<variant>')"
OPENED = f"""case when {MAP} is not null then flatten(transform(map_entries({MAP}), e -> array(struct(path, e.key as key, cast(null as variant) as _v), struct(concat(path, '.', e.key) as path, cast(null as string) as key, e.value as _v))))
  when {ARRAY} is not null then transform({ARRAY}, (x, i) -> struct(concat(path, '[', i, ']') as path, cast(null as string) as key, x as _v)) else array(struct(path, key, _v)) end"""


def flattened(results: DataFrame, column: str, levels: int = LEVELS) -> DataFrame:
    """The leaves of nested results: the other columns with (path, key, value, fault), a row for each key and each leaf, as leaves() walks them.

    The column is JSON text, a variant, or a struct, array or map. Each level opens the nested values of the one before within its row, so
    there is one scan and no shuffle. Faults: text that is not JSON, a value nested deeper than `levels`, a number that is not finite, a type
    that is neither text, number, truth value nor null. A null result and an empty object or array have no leaves."""
    kind = results.schema[column].dataType.typeName()
    nested = F.try_parse_json(column) if kind == "string" else F.col(column) if kind == "variant" else F.to_variant_object(column)
    rows = results.where(F.col(column).isNotNull()).withColumns({"path": F.lit("$"), "key": F.lit(None).cast("string"), "_v": nested})
    others = [c for c in results.columns if c != column]
    rows = rows.select(*others, "path", "key", "_v", F.col("_v").isNull().alias("_unread"))
    for _ in range(levels):
        rows = rows.select(*others, "_unread", F.explode(F.expr(OPENED)).alias("_e")).select(*others, "_unread", "_e.*")
    of = F.schema_of_variant("_v")
    number = F.expr("try_variant_get(_v, '$', 'double')")
    fault = F.when(F.col("_unread"), "not JSON").when(F.col("_v").isNull(), None).when(of.startswith("OBJECT") | of.startswith("ARRAY"), "too deep")
    fault = fault.when(of.isin("DOUBLE", "FLOAT"), F.when(F.isnan(number) | (F.abs(number) == float("inf")), "non-finite number")).when(~(of.isin("STRING", "BOOLEAN", "BIGINT", "VOID") | of.startswith("DECIMAL")), "unsupported type")
    return rows.select(*others, "path", "key", F.when(of == "STRING", F.expr("try_variant_get(_v, '$', 'string')")).alias("value"), fault.alias("fault"))


# ---- a sink behind the gate


def _named(rules: L.Rules, leaf: Column, at: Column) -> Column:
    broken = F.nullif(rules.column(leaf), F.lit(OPEN))
    return F.when(broken.isNotNull(), F.concat(broken, F.lit(" at "), at))


def _first(found: Column) -> Column:
    return F.get(F.filter(found, lambda x: x.isNotNull()), 0)


def row_reason(value: Column, kind: T.DataType, at: Column) -> Column:
    """The first rule that a value of a column breaks, with its place; null if it may leave. Names of fields are decided on the driver."""
    none = F.lit(None).cast("string")
    if isinstance(kind, T.StringType):
        return _named(VALUES, value, at)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.concat(F.lit("non-finite number at "), at))
    if isinstance(kind, (T.IntegralType, T.DecimalType, T.BooleanType, T.NullType)):
        return none
    if isinstance(kind, T.StructType):
        for name in kind.names:
            if broken := reason(KEYS, name):
                raise Withheld(f"{broken} among column names")
        return F.coalesce(none, *(row_reason(value.getField(f.name), f.dataType, F.concat(at, F.lit(f".{f.name}"))) for f in kind.fields))
    if isinstance(kind, T.ArrayType):
        return _first(F.transform(value, lambda x, i: row_reason(x, kind.elementType, F.concat(at, F.lit("["), i.cast("string"), F.lit("]")))))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        return _first(F.transform(F.map_entries(value), lambda e: F.coalesce(_named(KEYS, e["key"], at), row_reason(e["value"], kind.valueType, F.concat(at, F.lit("."), e["key"])))))
    raise Withheld(f"unsupported type {kind.typeName()}")


def sealed(rows: DataFrame) -> DataFrame:
    """rows, of which any that may not leave fails the job that reads it; the error names the rule and the place."""
    broken = row_reason(F.struct(*rows.columns), rows.schema, F.lit("$"))
    return rows.where(F.when(broken.isNotNull(), F.raise_error(F.concat(F.lit(SEAL), broken, F.lit(SEAL))).cast("boolean")).otherwise(True))


SEAL = "#withheld#"


def write_json(rows: DataFrame, path: str) -> None:
    """Writes rows as JSON lines to a new folder, on any file system that Spark writes: all of them, or none if one may not leave.

    Each row passes the gate in the pass that writes it; the commit of the job makes the files visible, and a refused row aborts it."""
    try:
        sealed(rows).write.mode("errorifexists").json(path)
    except PySparkException as e:
        if len(parts := str(e).split(SEAL)) < 3:
            raise
        broken = parts[1]
    else:
        return
    raise Withheld(broken)
