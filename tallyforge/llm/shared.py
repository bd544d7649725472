"""Tables in the folder that the whole cluster shares, and byte-level word splitting for Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: An Arrow batch is cut into pieces of about this many bytes of text, so a task's Python memory is bounded by it and by its longest text.
PIECE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a new temporary one, if one machine is all there is."""
    # A union may otherwise count as partitioned like its parts, though their partitions are coalesced apart.
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the whole cluster shares")
        found = tempfile.mkdtemp(prefix="tallyforge-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: its lineage is cut there, and a lost executor loses none of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of written() whose last reader has been written."""
    for table in tables:
        if path := getattr(table, "_written_to", None):
            jvm, context = table.sparkSession._jvm, table.sparkSession.sparkContext
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def freed(spark: SparkSession) -> None:
    """Has the driver collect its garbage, whereupon Spark deletes the shuffle files of steps whose tables are written."""
    spark.sparkContext._jvm.System.gc()


#: A filter by key may send 2**MASK_BITS numbers to every task.
MASK_BITS = 20


def narrowed(rows: DataFrame, wanted: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """The rows whose key may be among `wanted`'s (all that are, some that are not), or with left_anti those whose key is not.

    Only the low bits of the keys are sent, so the broadcast table is bounded at any scale; what is left may be joined in a shuffle."""
    low = F.col(key).bitwiseAND(F.lit((1 << MASK_BITS) - 1))
    return rows.join(F.broadcast(wanted.select(low.alias("__low")).distinct()), low == F.col("__low"), how)


#: A key that more than one of so many rows hold is a hot one.
HEAVY = 256


def attached(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows with the columns of `table`, a table of written() with one row for each key (nulls are equal) and its number of rows in `__times`.

    Hot keys, of which there are less than HEAVY, are broadcast and their rows stay where they are; the rest meets in a shuffle."""
    limit = (table.agg(F.sum("__times")).first()[0] or 0) // HEAVY
    table = table.withColumnRenamed(key, "__key")
    heavy, light = (F.broadcast(table.where(F.col("__times") > limit)), table.where(F.col("__times") <= limit))
    same = F.col(key).eqNullSafe(F.col("__key"))
    hot = rows.join(heavy, same)
    return hot.unionByName(rows.join(heavy, same, "left_anti").join(light, same)).drop("__key", "__times")


def flat_type(kind: pa.DataType) -> bool:
    return pa.types.is_large_string(kind) or pa.types.is_large_binary(kind)


def byte_rows(column: pa.Array) -> list[memoryview | bytes]:
    """The UTF-8 bytes of each value of a string or binary array; null is empty."""
    n = len(column)
    if not n:
        return []
    wide = np.int64 if flat_type(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + n + 1].tolist()
    view = memoryview(data).cast("B") if data is not None else memoryview(b"")
    rows = [view[a:b] for a, b in zip(at, at[1:])]
    if column.null_count:
        rows = [r if ok else b"" for r, ok in zip(rows, column.is_valid().to_pylist())]
    return rows


def pieces(batches: Iterable[pa.RecordBatch], text: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Each batch in slices of about `limit` bytes of column `text`, of one row at least."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum([len(r) for r in byte_rows(column)], dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def _table(separators: Iterable[int]) -> bytes:
    table = bytearray(range(256))
    table[0x41:0x5B] = bytes(range(0x61, 0x7B))
    for b in separators:
        table[b] = 0x20
    return bytes(table)


#: Words are runs of anything but ASCII white space.
SPACED = _table((0x20, *range(0x09, 0x0E)))
#: Words are runs of ASCII digits, letters and everything beyond ASCII.
ALNUM = _table((*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)))


class Words:
    """The lower-cased (A-Z) words of many rows, in order; `firsts` has the number of each row's first word, and their count."""

    def __init__(self, rows: list, table: bytes):
        self.plain = np.frombuffer((b"\n".join(rows) + b"\n").translate(table), np.uint8)
        self.inside = self.plain != 0x20
        change = np.flatnonzero(self.inside[1:] != self.inside[:-1]) + 1
        if self.inside[0]:
            change = np.concatenate(([0], change))
        self.starts, self.ends = change[::2], change[1::2]
        behind = np.cumsum([len(r) + 1 for r in rows], dtype=np.int64)
        self.firsts = np.concatenate(([0], np.searchsorted(self.starts, behind, "left"))).astype(np.int64)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.firsts)

    def owners(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.firsts) - 1), self.counts)

    def array(self) -> pa.Array:
        offsets = np.concatenate(([0], np.cumsum(self.ends - self.starts)))
        if offsets[-1] < 1 << 31:
            return pa.Array.from_buffers(pa.binary(), len(self), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(self.plain[self.inside])])
        return pa.Array.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(offsets), pa.py_buffer(self.plain[self.inside])])

    def hashes(self) -> np.ndarray:
        """64-bit hashes: a polynomial over random values of the bytes, finished; equal everywhere for equal words."""
        if not len(self):
            return np.zeros(0, np.uint64)
        return hashes(self.plain[self.inside], self.ends - self.starts)


def hashes(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte strings that lie one behind the other, none of them empty."""
    begin = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(begin, sizes)
    powers = np.cumprod(np.full(int(sizes.max()), _FACTOR, np.uint64))
    return mixed(np.add.reduceat(_BYTES[flat] * powers[place], begin) + sizes.astype(np.uint64))


_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finisher of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))

