"""The break-even calculator as a temporary SQL function, and the prices that a choice of model, rewrite and length pays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.prices import SnapshotA, SnapshotB

#: Prices are in dollars for each UNIT tokens unless the caller says otherwise.
UNIT = 1_000_000
RESULT = "ratio DOUBLE, payback_calls DOUBLE, saving DOUBLE, cost DOUBLE, net DOUBLE, pays BOOLEAN, verdict STRING"


def register(spark: SparkSession, name: str = "eviction_value") -> str:
    """Makes the temporary function name(removed, suffix, calls, write_price, read_price, unit => 1e6) of this session; gives its name.

    It is one expression of built-in functions and runs inlined. Removing `removed` tokens that `calls` more calls would have read saves their
    reads and rewrites the `suffix` behind them once. A null, NaN, infinite or negative input gives the verdict 'Enter values' and nulls besides it.
    A ratio over a read price of zero is infinite, and so is the payback of removing nothing; where nothing stands behind, it pays back
    after no calls, though not if the ratio is infinite (then it is unknown: null)."""
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(removed DOUBLE, suffix DOUBLE, calls DOUBLE, write_price DOUBLE, read_price DOUBLE, unit DOUBLE DEFAULT {UNIT}.0D)
      RETURNS STRUCT<{RESULT}> RETURN
      SELECT CASE WHEN fit THEN named_struct('ratio', ratio, 'payback_calls', CASE WHEN removed <= 0 THEN double('Infinity') ELSE nanvl(suffix / removed * ratio, NULL) END,
          'saving', saving, 'cost', cost, 'net', saving - cost, 'pays', saving > cost, 'verdict', CASE WHEN saving > cost THEN 'Pays' ELSE 'Does not pay' END)
        ELSE named_struct('ratio', CAST(NULL AS DOUBLE), 'payback_calls', CAST(NULL AS DOUBLE), 'saving', CAST(NULL AS DOUBLE), 'cost', CAST(NULL AS DOUBLE), 'net', CAST(NULL AS DOUBLE), 'pays', CAST(NULL AS BOOLEAN), 'verdict', 'Enter values') END
      FROM (SELECT coalesce(removed >= 0 AND suffix >= 0 AND calls >= 0 AND write_price >= 0 AND read_price >= 0 AND removed + suffix + calls + write_price + read_price < double('Infinity'), false) AS fit,
          CASE WHEN read_price > 0 THEN (write_price - read_price) / read_price ELSE double('Infinity') END AS ratio, removed * calls * read_price / unit AS saving, suffix * (write_price - read_price) / unit AS cost)""")
    return name


def price_choices(spark: SparkSession, a: SnapshotA, b: SnapshotB) -> DataFrame:
    """(model, rewrite, long, write_price, read_price) in dollars a million tokens: what may be chosen.

    Vendor A rewrites as '5m' or '1h'; vendor B as 'input', or as 'write' where a cache-write price is listed. Models with a long-request row have it
    as long = true."""
    rows = [(m, t, False, w, r) for m, (_, w5, w1, r, _) in a.models.items() for t, w in (("5m", w5), ("1h", w1))]
    for long, models in ((False, b.models), (True, b.long)):
        rows += [(m, t, long, w, r) for m, (i, r, listed, _) in models.items() for t, w in (("input", i), ("write", listed)) if w is not None]
    return spark.createDataFrame(rows, "model string, rewrite string, long boolean, write_price double, read_price double")


def priced(scenarios: DataFrame, a: SnapshotA, b: SnapshotB) -> DataFrame:
    """scenarios (model, rewrite, long) with write_price and read_price.

    The switch to long requests works only for models that list such prices, and a rewrite that the model does not list falls back on
    vendor A's 5-minute price or vendor B's input price. An unlisted model has null prices."""
    spark = scenarios.sparkSession
    choices = price_choices(spark, a, b)
    offers = choices.groupBy(F.col("model").alias("_m")).agg(F.max("long").alias("_has_long"), F.max(F.col("rewrite") == "5m").alias("_a"), F.collect_set("rewrite").alias("_offers"))
    at = scenarios.join(F.broadcast(offers), F.col("model") == F.col("_m"), "left").drop("_m")
    plain = F.when(F.col("_a"), F.lit("5m")).otherwise(F.lit("input"))
    at = at.withColumns({"_rewrite": F.when(F.array_contains("_offers", F.col("rewrite")), F.col("rewrite")).otherwise(plain), "_long": F.coalesce(F.col("long"), F.lit(False)) & F.coalesce("_has_long", F.lit(False))})
    listed = choices.withColumnsRenamed({"model": "_m", "rewrite": "_r", "long": "_l"})
    on = (F.col("model") == F.col("_m")) & (F.col("_rewrite") == F.col("_r")) & (F.col("_long") == F.col("_l"))
    return at.join(F.broadcast(listed), on, "left").drop("_m", "_r", "_l", "_has_long", "_a", "_offers", "_rewrite", "_long")
