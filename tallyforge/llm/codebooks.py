"""Product quantisation of vectors: codebooks by integer k-means, and the codes of all vectors.

Each component becomes floor(256 x); a vector is cut into PARTS equal consecutive parts (where the dimension is no multiple of
PARTS, part k begins at floor(k d / PARTS)). The codebook of each part begins as that part of the ENTRIES smallest vec_ids.

1. In each round a kd-tree of every codebook is built on the driver and broadcast: PARTS * ENTRIES parts, whatever the table's size.
2. Tasks go through their vectors in batches. All vectors of a batch go down a tree together: at each node those whose distance
   to the node's box is at most that of their best entry so far stay, on the nearer side first. Boxes as far as the best entry are visited
   too, and of entries as far as each other the lower index stays, so the tie rule holds.
3. A task gives one row of integer sums and a count for each entry it has used; Spark adds these up. Only the sums of the
   entries come back to the driver, which takes the floors of the means.
4. A last pass gives codes and errors. Errors are added up by label; hot labels (a bounded number) are broadcast,
   the rest is joined in a shuffle, so no hot label lands in one task.

Defined results: rows whose vector is null, or holds null or non-finite components, are dropped. The dimension is that of the kept row of the
smallest vec_id. Vectors of another length, or with a component x outside of [-65536, 65536), take no part in
codebooks and have null code and error. Of rows of one vec_id the one of the smaller vector counts as the smaller; null vec_ids
are larger than all others. Fewer rows than ENTRIES give smaller codebooks; an empty table, or one without usable vectors, gives no rows or null
codes. Null labels count as equal. Extra columns are not carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import attached, shared_dir, written

PARTS, ENTRIES, ROUNDS = 16, 64, 2
LEAF = 4
#: Vectors that go down the trees together.
AT_ONCE = 8192
#: Integer components stay below this, so that squared distances of 8,192 of them fit in 63 bits.
LIMIT = 1 << 24


class Tree:
    """A kd-tree of a codebook's entries (rows of integers)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.nodes: list[tuple] = []
        self._build(np.arange(len(entries)))

    def _build(self, index: np.ndarray) -> int:
        own = self.entries[index]
        low, high = own.min(0), own.max(0)
        k = len(self.nodes)
        self.nodes.append(())
        axis = int(np.argmax(high - low)) if own.shape[1] else 0
        if len(index) <= LEAF or not own.shape[1] or low[axis] == high[axis]:
            self.nodes[k] = (low, high, np.sort(index), 0, 0, 0, 0)
            return k
        order = index[np.argsort(own[:, axis], kind="stable")]
        half = len(order) // 2
        left, right = self._build(order[:half]), self._build(order[half:])
        self.nodes[k] = (low, high, None, axis, int(self.entries[order[half], axis]), left, right)
        return k

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of the nearest entry of each row, of equally near ones the lowest, and its squared distance."""
        best = np.full(len(queries), len(self.entries), np.int64)
        error = np.full(len(queries), np.iinfo(np.int64).max)
        columns = np.ascontiguousarray(queries.T)

        def visit(k: int, rows: np.ndarray) -> None:
            low, high, leaf, axis, split, left, right = self.nodes[k]
            bound = np.zeros(len(rows), np.int64)
            for column, a, b in zip(columns, low.tolist(), high.tolist()):
                x = column[rows]
                bound += (x - np.clip(x, a, b)) ** 2
            rows = rows[bound <= error[rows]]
            if not len(rows):
                return
            if leaf is None:
                nearer = columns[axis][rows] < split
                visit(left, rows[nearer])
                visit(right, rows[~nearer])
                visit(right, rows[nearer])
                visit(left, rows[~nearer])
                return
            own = queries[rows]
            for i in leaf.tolist():
                far = ((own - self.entries[i]) ** 2).sum(1)
                closer = (far < error[rows]) | ((far == error[rows]) & (i < best[rows]))
                best[rows[closer]], error[rows[closer]] = i, far[closer]

        visit(0, np.arange(len(queries)))
        return best, error


def bounds(dimension: int, parts: int = PARTS) -> list[int]:
    return [k * dimension // parts for k in range(parts + 1)]


def finite(rows: DataFrame) -> DataFrame:
    """The rows whose vector is not null and has finite components only, as (vec_id, vector, label) with integer components, null where they
    are out of range."""
    kept = rows.where(F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    small = F.forall("embedding", lambda x: (x >= -LIMIT / 256) & (x < LIMIT / 256))
    label = F.col("label") if "label" in rows.columns else F.lit(None).cast("int").alias("label")
    return kept.select("vec_id", F.when(small, F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("int"))).alias("vector"), label)


def _matrix(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have vectors of this dimension, and these."""
    lengths = column.value_lengths().fill_null(-1).to_numpy()
    fit = lengths == dimension
    return fit, column.filter(pa.array(fit)).flatten().to_numpy().astype(np.int64).reshape(int(fit.sum()), dimension)


def assigned(vectors: np.ndarray, trees: list[Tree], cuts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The entries' indexes of each vector's parts, and the squared distances."""
    found = [tree.nearest(vectors[:, a:b]) for tree, a, b in zip(trees, cuts, cuts[1:])]
    return np.stack([x for x, _ in found], 1), np.stack([x for _, x in found], 1)


def _cut(column: pa.Array) -> Iterator[pa.Array]:
    for at in range(0, len(column), AT_ONCE):
        yield column.slice(at, AT_ONCE)


def updated(kept: DataFrame, books: list[np.ndarray], cuts: list[int]) -> list[np.ndarray]:
    """The codebooks after one round over all vectors."""
    sent = kept.sparkSession.sparkContext.broadcast([Tree(b) for b in books])
    dimension = cuts[-1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = sent.value
        total = [np.zeros_like(t.entries) for t in trees]
        count = [np.zeros(len(t.entries), np.int64) for t in trees]
        for batch in batches:
            for column in _cut(batch.column(0)):
                _, vectors = _matrix(column, dimension)
                index, _ = assigned(vectors, trees, cuts)
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    np.add.at(total[k], index[:, k], vectors[:, a:b])
                    count[k] += np.bincount(index[:, k], minlength=len(count[k]))
        rows = [(k, i, int(count[k][i]), total[k][i].tolist()) for k in range(len(trees)) for i in np.flatnonzero(count[k]).tolist()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))], ["part", "entry", "times", "sums"])

    found = kept.select("vector").mapInArrow(sums, "part int, entry int, times bigint, sums array<bigint>")
    width = max(b - a for a, b in zip(cuts, cuts[1:]))
    added = found.groupBy("part", "entry").agg(F.sum("times").alias("times"), *(F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(width)))
    out = [b.copy() for b in books]
    for r in added.collect():
        for k in range(out[r["part"]].shape[1]):
            out[r["part"]][r["entry"], k] = r[f"s{k}"] // r["times"]
    return out


def fitted(kept: DataFrame, entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS) -> tuple[list[np.ndarray], list[int]]:
    """The codebooks of all kept vectors, and where their parts are cut."""
    usable = kept.where("vector is not null")
    by_id = [F.col("vec_id").isNull(), F.col("vec_id"), F.col("vector")]
    first = usable.select("vec_id", "vector").orderBy(*by_id).limit(1).collect()
    dimension = len(first[0]["vector"]) if first else 0
    heads = usable.where(F.size("vector") == dimension).select("vec_id", "vector").orderBy(*by_id).limit(entries).collect()
    cuts = bounds(dimension, parts)
    begin = np.array([r["vector"] for r in heads], np.int64).reshape(len(heads), dimension)
    books = [begin[:, a:b].copy() for a, b in zip(cuts, cuts[1:])]
    for _ in range(rounds if len(heads) else 0):
        books = updated(kept, books, cuts)
    return books, cuts


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for e in b.tolist() for x in e).encode()).hexdigest()


def encoded(kept: DataFrame, books: list[np.ndarray], cuts: list[int]) -> DataFrame:
    """(vec_id, label, code, error) of each kept row: two hex digits for each part."""
    dimension, empty = cuts[-1], not len(books[0])
    sent = kept.sparkSession.sparkContext.broadcast([] if empty else [Tree(b) for b in books])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = [None] * batch.num_rows, [None] * batch.num_rows
            at = 0
            for column in _cut(batch.column(2)):
                fit, vectors = _matrix(column, dimension)
                if not empty and len(vectors):
                    index, error = assigned(vectors, sent.value, cuts)
                    for i, code, e in zip((np.flatnonzero(fit) + at).tolist(), index.tolist(), error.sum(1).tolist()):
                        codes[i], errors[i] = "".join(f"{x:02x}" for x in code), e
                at += len(column)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    kind = T.StructType([kept.schema["vec_id"], kept.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return kept.select("vec_id", "label", "vector").mapInArrow(run, kind)


def with_label_errors(rows: DataFrame) -> DataFrame:
    """The rows with the sum of `error` over all rows of their label."""
    sums = written(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("__times")), "label-sums")
    return attached(rows, sums, "label")


def compressed(vectors: DataFrame, entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of each row of vectors (vec_id, embedding, label) that is kept."""
    shared_dir(vectors.sparkSession)
    if not 0 < entries <= 256:
        raise ValueError("an entry's index takes two hex digits, so there are 1 to 256 entries")
    kept = finite(vectors)
    books, cuts = fitted(kept, entries, parts, rounds)
    return with_label_errors(written(encoded(kept, books, cuts), "codes")).withColumn("codebooks_sha256", F.lit(digest(books)))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


_NEAREST = """select v.part as part, v.vec_id as vec_id, v.x as x, min(struct_pack(d := list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := b.entry)) as m
  from v join {book} as b on b.part = v.part group by 1, 2, 3"""
_MEANS = """select part, e as entry, list(cast(floor_mean as bigint) order by pos) as x from (
  select part, m.e as e, pos, (sum(x[pos]) - ((sum(x[pos]) % count(*)) + count(*)) % count(*)) // count(*) as floor_mean from {near}, unnest(range(1, len(x) + 1)) as u(pos) group by 1, 2, 3) group by 1, 2"""
OP12_SQL = f"""
with kept as (select vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as c from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
v as (select vec_id, label, part, c[part * len(c) // 16 + 1:(part + 1) * len(c) // 16] as x from kept, unnest(range(16)) as t(part)),
b0 as (select part, cast(row_number() over (partition by part order by vec_id) - 1 as bigint) as entry, x from v where vec_id in (select vec_id from kept order by vec_id limit 64)),
n0 as ({_NEAREST.format(book="b0")}),
m0 as ({_MEANS.format(near="n0")}),
b1 as (select b0.part, b0.entry, coalesce(m0.x, b0.x) as x from b0 left join m0 on m0.part = b0.part and m0.entry = b0.entry),
n1 as ({_NEAREST.format(book="b1")}),
m1 as ({_MEANS.format(near="n1")}),
b2 as (select b1.part, b1.entry, coalesce(m1.x, b1.x) as x from b1 left join m1 on m1.part = b1.part and m1.entry = b1.entry),
n2 as ({_NEAREST.format(book="b2")}),
f as (select vec_id, string_agg(printf('%02x', m.e), '' order by part) as code, cast(sum(m.d) as bigint) as error from n2 group by 1),
s as (select label, cast(sum(error) as bigint) as label_error from f join kept using (vec_id) group by 1),
h as (select sha256(string_agg(array_to_string(x, ','), ',' order by part, entry)) as codebooks_sha256 from b2)
select f.vec_id, code, error, label_error, codebooks_sha256 from f join kept on kept.vec_id = f.vec_id join s on s.label is not distinct from kept.label, h
"""
