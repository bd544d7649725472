"""SimHash fingerprints of documents, and the groups that near fingerprints link.

A fingerprint bit is set if it is set in over half of the XXH64 values (seed 42) of a document's word shingles, repeats included.
Fingerprints of at most `distance` differing bits link.

1. Documents of one fingerprint are one class; only fingerprints go on.
2. A fingerprint is embedded by the bit count (0, 1 or 2) of each of its 32 segments of two bits. The Manhattan distance of two
   embeddings is at most the number of differing bits. An embedding is kept in one number: each segment's count in unary, 00, 01 or 11,
   so that differing bits of two such numbers count their Manhattan distance.
3. The segments form distance // 2 + 1 groups. Where the whole distance is within the bound, that of one group is 0 or 1. Each
   group is a grid whose cells are its counts: a fingerprint is at home in its cell and visits the cells where one
   count is one more. So a pair meets where the larger one is at home. That range join is exact and replicates by a constant.
4. Tiles of cells compare all pairs of a home and another fingerprint, by Manhattan distance first and then bit by bit, and give a
   spanning forest of their links, never all pairs. Cells of more than TILE rows are dealt to tiles by lot twice; then
   only different components of them meet, those of a cell's largest component not with each other.
5. Components come from alternating large and small stars over the links.

Two fingerprints drawn at random meet in a tile with a chance of about one in a thousand, so the comparisons (not the rows) grow with the
square of the number of different fingerprints.

Defined results: a null text, or one without words, has fingerprint zero, and links like any other; a text of fewer words than a
shingle has one of all its words; component_id is the smallest doc_id of the component (null ids are left out unless there are
no others); repeated rows have equal results; an empty table gives no rows; other columns of docs are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ngram_join import by_lot, by_rest, components
from .shared import SPACED, Words, attached, byte_rows, dropped, pieces, shared_dir, written

SHINGLE, DISTANCE, SEED = 5, 4, 42
SEGMENTS, TILE = 32, 1024
#: Pairs that a task compares at once, and shingle values whose bits it counts at once.
AT_ONCE, COUNTED = 1 << 19, 1 << 16
_LOW = 0x5555555555555555


def fingerprint(values: np.ndarray) -> int:
    """The bits that are set in over half of these 64-bit values."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(values), COUNTED):
        ones += np.unpackbits(values[at : at + COUNTED].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view(np.uint64)[0])


def fingerprints(rows: list, size: int = SHINGLE) -> list[int]:
    """The fingerprint of each text."""
    words = Words(rows, SPACED)
    sizes = words.ends - words.starts
    # The words once more, one space between any two: a shingle is a slice.
    begins = np.cumsum(sizes + 1) - sizes - 1
    flat = np.full(int((sizes + 1).sum()), 0x20, np.uint8)
    flat[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)] = words.plain[words.inside]
    joined, behind = flat.tobytes(), begins + sizes
    out = []
    for a, b in zip(words.firsts.tolist(), words.firsts[1:].tolist()):
        m = min(size, b - a)
        if not m:
            out.append(0)
            continue
        values = [xxhash.xxh64_intdigest(joined[x:y], SEED) for x, y in zip(begins[a : b - m + 1].tolist(), behind[a + m - 1 : b].tolist())]
        out.append(fingerprint(np.array(values, np.uint64)))
    return out


def fingerprinted(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = np.array(fingerprints(byte_rows(batch.column(1)), size), np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


def unary(fp: Column) -> Column:
    """The bit counts of the segments, each in unary in the segment's place."""
    next_bit = F.shiftrightunsigned(fp, 1)
    both, either = fp.bitwiseAND(next_bit).bitwiseAND(F.lit(_LOW)), fp.bitwiseOR(next_bit).bitwiseAND(F.lit(_LOW))
    return F.shiftleft(both, 1).bitwiseOR(either)


def grid(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(tok, cell, node, home): the fingerprints of each cell (group `cell`, counts `tok`), at home or visiting."""
    groups = distance // 2 + 1
    places = []
    for g in range(groups):
        segments = range(g * SEGMENTS // groups, (g + 1) * SEGMENTS // groups)
        mask = sum(3 << 2 * k for k in segments)
        mask = F.lit(mask - (1 << 64) if mask >> 63 else mask)
        own = F.col("__u").bitwiseAND(mask)
        places.append(F.struct(own.alias("tok"), F.lit(g).alias("cell"), F.lit(True).alias("home")))
        for k in segments:
            low, high = (F.lit(b - (1 << 64) if b >> 63 else b) for b in (1 << 2 * k, 2 << 2 * k))
            more = F.when(own.bitwiseAND(low) == 0, own.bitwiseOR(low)).when(own.bitwiseAND(high) == 0, own.bitwiseOR(high))
            places.append(F.struct(more.alias("tok"), F.lit(g).alias("cell"), F.lit(False).alias("home")))
    return nodes.select("node", unary(F.col("node")).alias("__u")).select("node", F.inline(F.array(*places))).where("tok is not null").select("tok", "cell", "node", "home")


def cells_of(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The rows of grid() in cells of two fingerprints or more, one at home, with their number c."""
    rows = grid(nodes, distance)
    full = rows.groupBy("tok", "cell").agg(F.count(F.lit(1)).alias("c"), F.max("home").alias("any_home")).where("c > 1 and any_home").drop("any_home")
    return written(rows.join(full, ["tok", "cell"]), "simhash-cells")


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least place of each of n places' component, by the links i - j."""
    root = np.arange(n)
    while True:
        low, new = np.minimum(root[i], root[j]), root.copy()
        for at in (root[i], root[j], i, j):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near(rows: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) that join what is linked by rows (tile, part, cross, node, home, label) of equal tile and different label.

    Where `cross` is set, only rows of different part meet."""

    def links(table: pa.Table) -> Iterator[pa.RecordBatch]:
        tile, part, cross, node, home, label = (c.to_numpy(zero_copy_only=False) for c in table.combine_chunks().to_batches()[0].columns)
        bits = node.view(np.uint64)
        odd = bits >> np.uint64(1)
        counts = ((bits & odd & np.uint64(_LOW)) << np.uint64(1)) | ((bits | odd) & np.uint64(_LOW))
        ends = np.flatnonzero(np.append(tile[1:] != tile[:-1], True)) + 1
        end = ends[np.searchsorted(ends, np.arange(len(tile)), "right")]
        later = np.where(home, end - np.arange(len(tile)) - 1, 0)
        total = np.cumsum(later)
        at = 0
        while at < len(tile):
            stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + AT_ONCE, "right")))
            many = later[at:stop]
            i = np.repeat(np.arange(at, stop), many)
            j = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + i + 1
            at = stop
            keep = np.bitwise_count(counts[i] ^ counts[j]) <= distance
            i, j = i[keep], j[keep]
            keep = (label[i] != label[j]) & ~(cross[i] & (part[i] == part[j])) & (np.bitwise_count(bits[i] ^ bits[j]) <= distance)
            i, j = i[keep], j[keep]
            if len(i):
                used, place = np.unique(np.concatenate((i, j)), return_inverse=True)
                root = used[roots(len(used), place[: len(i)], place[len(i) :])]
                moved = root != used
                yield pa.RecordBatch.from_arrays([pa.array(node[used[moved]]), pa.array(node[root[moved]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            tile = batch.column(0).to_numpy()
            if not len(tile):
                continue
            cut = int(np.searchsorted(tile, tile[-1], "left"))  # the last tile may go on
            if cut or held and held[-1].column(0)[-1].as_py() != tile[0]:
                yield from links(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held.clear()
            held.append(batch.slice(cut))
        if held:
            yield from links(pa.Table.from_batches(held))

    dealt = rows.select("tile", "part", "cross", "node", "home", "label").repartition("tile").sortWithinPartitions("tile", F.desc("home"), "node")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def linked_fingerprints(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame | None:
    """(node, label): the component of each fingerprint that has links, of distinct ones in column `node`; None if there are no links."""
    cells = cells_of(nodes, distance)
    crowded = cells.where(F.col("c") > TILE)
    links: list[DataFrame] = []
    labels = None

    def joined(rows: DataFrame) -> None:
        nonlocal labels
        found = written(near(rows, distance), "simhash-links")
        if found.isEmpty():
            dropped(found)
            return
        links.append(found)
        if labels is not None:
            dropped(labels)
        every = links[0]
        for more in links[1:]:
            every = every.union(more)
        labels = components(every)

    joined(by_lot(cells, None, 0, TILE))
    if not crowded.isEmpty():
        joined(by_lot(crowded, labels, 1, TILE))
        joined(by_rest(crowded, labels, TILE))
    dropped(cells, *links)
    return labels


def near_duplicates(docs: DataFrame, size: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) of each row of docs."""
    shared_dir(docs.sparkSession)
    rows = written(fingerprinted(docs, size), "simhash-rows")
    last = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    classes = written(rows.groupBy("fp").agg(F.min(last).alias("least"), F.count(F.lit(1)).alias("__times")), "simhash-classes")
    labels = linked_fingerprints(classes.select(F.col("fp").alias("node")), distance)
    named = classes.withColumn("label", F.col("fp"))
    if labels is not None:
        named = classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    tops = named.groupBy("label").agg(F.min("least").alias("top"))
    named = written(named.join(tops, "label").select("fp", F.col("top.id").alias("component_id"), "__times"), "simhash-named")
    dropped(classes, *([] if labels is None else [labels]))
    return attached(rows, named, "fp")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
