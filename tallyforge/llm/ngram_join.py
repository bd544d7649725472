"""An exact n-gram Jaccard join, and the groups of documents that it links.

A document's set holds the hashes of its distinct word shingles. Two documents link when 100 * overlap >= PERCENT * union.

1. Equal sets are one class; only one document of a class goes on.
2. A fixed-size table of how many documents have the shingles of each hash bucket orders all shingles, rare buckets first.
   Any such order is exact: the first common shingle of sets that link is one of the first n - ceil(PERCENT n / 100) + 1 of
   the larger set and one of the still fewer of the smaller one from which an overlap of two sets of its size has room.
3. Sets meet by shingle and size band, each set in its own band and as a visitor in the band below. A cell (shingle, band)
   is cut into tiles of about TILE sets. Within a tile, the places of the common shingle bound the overlap, and then hashed
   bitmaps do by bit counts: a bit that only one set has stands for a shingle that the other lacks.
4. In ROUNDS rounds a cell's sets are dealt to its tiles by lot, and each set is tested against one partner, that of the
   largest overlap by the bitmaps' estimate: the sorted sets are intersected. What links is one component. Then only cells
   of several components go on, and all pairs of different components that the bounds let pass are tested; the sets of a
   cell's largest component don't meet each other, so a cell costs rows in proportion to it and to what is left of it.
5. Components come from alternating large and small stars over the links.

Defined results: a null text, or one without words, has an empty set, links with nothing and is its own component; a
text of fewer words than a shingle has one of all its words; component_id is the smallest doc_id of the component (null
ids are left out unless there are no others); repeated rows have equal results; an empty table gives no rows; further
columns stay, and helper columns are named with two underscores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import SPACED, Words, byte_rows, dropped, freed, mixed, narrowed, pieces, shared_dir, written

#: Words of a shingle and similarity in percent, unless the caller says otherwise.
SHINGLE, PERCENT = 5, 80
BUCKET_BITS, BLOCKS = 20, 128
TILE, GROUP, SALTS = 256, 256, 16
ROUNDS = 2
#: The prefix shingles meet in so many runs, one hash share after the other, so that only a share of them lies in shuffle files at once.
RUNS = 4
LEAST_BITS, MOST_BITS = 128, 32768
#: Pairs that a tile's arrays hold at once.
AT_ONCE = 1 << 18
KEY = "__row_key"
_P = np.uint64(0x9FB21C651E98DF25)


def shingle_sets(rows: list, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(rows, SPACED)
    h, firsts = words.hashes(), words.firsts
    whole = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for j in range(size):
        whole = whole * _P + h[j : j + len(whole)]
    whole = mixed(whole)
    out = []
    for a, b in zip(firsts.tolist(), firsts[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(whole[a : b - size + 1]))
        elif b > a:
            value = np.array([b - a], np.uint64)
            for k in range(a, b):
                value = mixed(value * _P + h[k : k + 1])
            out.append(value)
        else:
            out.append(h[:0])
    return out


def needed(a, b, percent: int = PERCENT):
    """The least overlap with which sets of sizes a and b link."""
    return (percent * (a + b) + 99 + percent) // (100 + percent)


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - (percent * n + 99) // 100 + 1


def bitmap(values: np.ndarray) -> bytes:
    """Bits of the values' low ends, two to four for each value; widths are powers of two, so a wider one can be folded on a narrower."""
    width = min(MOST_BITS, max(LEAST_BITS, 2 << int(len(values)).bit_length()))
    bits = np.zeros(width, bool)
    bits[(values & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Rows of bytes folded to `width` bytes."""
    while bits.shape[-1] > width:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


def most_overlap(na, a: np.ndarray, nb, b: np.ndarray) -> np.ndarray:
    """Upper bounds of the overlaps of sets, from their sizes and equally wide bitmaps (arrays of bytes in the last axis)."""
    only_a = np.bitwise_count(a & ~b).sum(-1, dtype=np.int64)
    only_b = np.bitwise_count(b & ~a).sum(-1, dtype=np.int64)
    return np.minimum(na - only_a, nb - only_b)


def estimated_overlap(na, a: np.ndarray, nb, b: np.ndarray) -> np.ndarray:
    """Estimates of the overlaps: what only one set has is more than the bits that only it has, as others hide in the other's bits."""
    width = 64 * a.shape[-1]
    free_a, free_b = (np.maximum(1, width - np.bitwise_count(x).sum(-1, dtype=np.int64)) / width for x in (a, b))
    only_a = np.bitwise_count(a & ~b).sum(-1, dtype=np.int64) / free_b
    only_b = np.bitwise_count(b & ~a).sum(-1, dtype=np.int64) / free_a
    return ((na - only_a) + (nb - only_b)) / 2


def bucket_levels(docs: DataFrame, size: int = SHINGLE) -> np.ndarray:
    """For each hash bucket the logarithm of how many documents' shingles fall in it; a fixed number of bytes at any scale."""
    wide = (1 << BUCKET_BITS) // BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in pieces(batches, "text"):
            found = shingle_sets(byte_rows(batch.column(0)), size)
            if found:
                total += np.bincount((np.concatenate(found) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=1 << BUCKET_BITS)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([total[k * wide : (k + 1) * wide].astype("<u4").tobytes() for k in range(BLOCKS)], pa.binary())], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), byte_rows(batch.column(1))):
                held[block] = held.get(block, 0) + np.frombuffer(raw, "<u4").astype(np.int64)
        if held:
            levels = [np.minimum(255, np.floor(6 * np.log2(v + 1))).astype(np.uint8).tobytes() for v in held.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(levels, pa.binary())], ["block", "levels"])

    rows = docs.select("text").mapInArrow(count, "block int, counts binary").repartition(BLOCKS, "block").mapInArrow(add, "block int, levels binary").collect()
    levels = np.zeros(1 << BUCKET_BITS, np.uint8)
    for r in rows:
        levels[r["block"] * wide : (r["block"] + 1) * wide] = np.frombuffer(r["levels"], np.uint8)
    return levels


ROWS = "doc_id bigint, key bigint, n bigint, s1 bigint, s2 bigint, bits binary, prefix array<bigint>"


def set_rows(docs: DataFrame, levels: np.ndarray, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """For each document the size, a 128-bit signature, the bitmap and the prefix of its set."""
    sent = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = sent.value
        for batch in pieces(batches, "text"):
            n, s1, s2, bits, prefix = [], [], [], [], []
            for values in shingle_sets(byte_rows(batch.column(2)), size):
                n.append(len(values))
                s1.append(int(mixed(values ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
                s2.append(int((mixed(values + np.uint64(0x14057B7EF767814F)) * np.uint64(3)).sum(dtype=np.uint64).view(np.int64)))
                bits.append(bitmap(values) if len(values) else None)
                order = np.argsort(levels[(values >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)], kind="stable")[: prefix_size(len(values), percent) if len(values) else 0]
                prefix.append(values[order].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(bits, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))], ["doc_id", "key", "n", "s1", "s2", "bits", "prefix"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(KEY).alias("key"), "text").mapInArrow(run, ROWS)


def exact_links(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) that link: the sets of all b of an a stream past that of a, in groups of about GROUP."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("salts"))
    members = pairs.join(salts, "a").select(F.col("b").alias("node"), "a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("ord"))
    heads = salts.select(F.col("a").alias("node"), "a", F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"), F.lit(0).alias("ord"))
    wanted = written(members.unionByName(heads).join(nodes.select("node", F.col("key").alias(KEY)), "node"), "jaccard-wanted")
    texts = narrowed(docs.select(KEY, "text"), wanted, KEY).join(wanted.hint("merge"), KEY).select("a", "salt", "ord", "node", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 20):
            found = shingle_sets(byte_rows(batch.column(4)), size)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([x.tobytes() for x in found], pa.binary())], ["a", "salt", "ord", "node", "values"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own = None, None
        for batch in batches:
            out_a, out_b = [], []
            for a, salt, order, node, raw in zip(*(batch.column(k).to_pylist() for k in range(4)), byte_rows(batch.column(4))):
                values = np.frombuffer(bytes(raw), np.uint64)
                if not order:
                    head, own = (a, salt), values
                    continue
                if head != (a, salt):
                    raise ValueError("a group without its head")
                together = np.concatenate((own, values))
                together.sort()
                if int((together[1:] == together[:-1]).sum()) >= needed(len(own), len(values), percent):
                    out_a.append(a)
                    out_b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    rows = texts.mapInArrow(sets, "a bigint, salt int, ord int, node bigint, values binary")
    links = written(rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "ord").mapInArrow(meet, "a bigint, b bigint").distinct(), "jaccard-links")
    dropped(wanted)
    return links


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each node's component, by alternating large and small stars."""
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "stars")
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("v", "m").where("v <> m").union(least.select("u", "m")).toDF("u", "v").distinct()
        small = written(small, "stars")
        done = small.exceptAll(edges).isEmpty() and small.count() == edges.count()
        dropped(edges, large)
        if done:
            labels = written(small.select(F.col("u").alias("node"), F.col("v").alias("label")).union(small.select("v", "v").distinct()), "jaccard-labels")
            dropped(small)
            return labels
        edges = small


def cells_of(nodes: DataFrame, percent: int = PERCENT) -> list[DataFrame]:
    """(tok, cell, node, n, p, home): the sets of each cell (prefix shingle, size band) in which a pair may meet, as RUNS tables.

    Sets that link lie in one band or in neighbouring ones; a set is at home in its own and visits the band below. A cell
    lies in one table whole."""
    found = []
    for run in range(RUNS):
        tokens = nodes.select("node", "n", F.posexplode("prefix").alias("p", "tok")).where(F.pmod("tok", F.lit(RUNS)) == run)
        found.append(_cells(tokens, percent))
        freed(nodes.sparkSession)
    return found


def _cells(tokens: DataFrame, percent: int) -> DataFrame:
    # The smaller set of a pair, and so a home set, has the first common shingle in the room that an equal set would leave.
    inside = F.col("p") <= F.col("n") - F.floor((2 * percent * F.col("n") + 99 + percent) / (100 + percent))
    common = tokens.groupBy("tok").agg(F.count(F.lit(1)).alias("c"), F.max(inside).alias("inside")).where("c > 1 and inside").select("tok")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.02 / percent))).cast("int")  # a little wide, against rounding
    if percent >= 100:
        band = F.col("n").cast("int")
    rows = tokens.join(common, "tok", "left_semi").withColumn("band", band)
    places = F.array(F.struct(F.col("band").alias("cell"), F.lit(True).alias("home")), F.struct((F.col("band") - 1).alias("cell"), F.lit(False).alias("home")))
    rows = written(rows.select("tok", "node", "n", "p", F.inline(places)), "jaccard-places")
    freed(tokens.sparkSession)
    full = rows.groupBy("tok", "cell").agg(F.count(F.lit(1)).alias("c"), F.max(F.col("home") & inside).alias("inside")).where("c > 1 and inside").select("tok", "cell", "c")
    cells = written(rows.join(full, ["tok", "cell"]), "jaccard-cells")
    dropped(rows)
    return cells


def met(rows: DataFrame, nodes: DataFrame, best: bool, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b, slack) of rows (tile, part, cross, node, n, p, home, label) of equal tile and other label that the bounds let pass.

    Where `cross` is set, only rows of different part meet. `slack` is by how much, in units of 2**-16 of their size, the estimated
    overlap is more than the needed one. With `best`, only the partner of most slack is given for each set of a tile."""
    dealt = rows.join(nodes.select("node", "bits"), "node").select("tile", "part", "cross", "node", "n", "p", "home", "label", "bits")

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        batch = table.combine_chunks()
        tile, part, cross, node, n, p, home, label = (batch.column(k).chunk(0).to_numpy(zero_copy_only=False) for k in range(8))
        raw = batch.column(8).chunk(0)
        offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
        data = np.frombuffer(raw.buffers()[2], np.uint8)
        wide = np.diff(offsets)
        inside = home & (p <= n - needed(n, n, percent))
        ends = np.flatnonzero(np.append(tile[1:] != tile[:-1], True)) + 1
        end = ends[np.searchsorted(ends, np.arange(len(tile)), "right")]
        later = np.where(inside, end - np.arange(len(tile)) - 1, 0)
        total = np.cumsum(later)
        at = 0
        while at < len(tile):
            stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + AT_ONCE, "right")))
            many = later[at:stop]
            i = np.repeat(np.arange(at, stop), many)
            j = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + i + 1
            at = stop
            keep = (label[i] != label[j]) & (100 * n[i] >= percent * n[j]) & ~(cross[i] & (part[i] == part[j]))
            i, j = i[keep], j[keep]
            need = needed(n[i], n[j], percent)
            keep = np.minimum(n[i] - p[i], n[j] - p[j]) >= need
            i, j, need = i[keep], j[keep], need[keep]
            width = np.minimum(wide[i], wide[j])
            good, slack = np.zeros(len(i), bool), np.zeros(len(i), np.int64)
            for w in np.unique(width).tolist():
                mine = np.flatnonzero(width == w)
                used, place = np.unique(np.concatenate((i[mine], j[mine])), return_inverse=True)
                bits = np.empty((len(used), w), np.uint8)
                for own in np.unique(wide[used]).tolist():
                    these = np.flatnonzero(wide[used] == own)
                    bits[these] = folded(data[offsets[used[these]][:, None] + np.arange(own)], w)
                bits = bits.view(np.uint64)
                step = max(1, (2 << 20) // w)
                for k in range(0, len(mine), step):
                    m = mine[k : k + step]
                    x, y = bits[place[k : k + len(m)]], bits[place[len(mine) + k : len(mine) + k + len(m)]]
                    good[m] = most_overlap(n[i[m]], x, n[j[m]], y) >= need[m]
                    slack[m] = (estimated_overlap(n[i[m]], x, n[j[m]], y) - need[m]) * 65536 / n[j[m]]
            i, j, slack = i[good], j[good], slack[good]
            a, b = node[i], node[j]
            if best:
                a, b, slack = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((slack, slack))
                order = np.lexsort((b, -slack, a))
                order = order[np.append(True, a[order][1:] != a[order][:-1])] if len(a) else order
                a, b, slack = a[order], b[order], slack[order]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(slack)], ["a", "b", "slack"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            tile = batch.column(0).to_numpy()
            if not len(tile):
                continue
            cut = int(np.searchsorted(tile, tile[-1], "left"))  # the last tile may go on
            if held and (cut or held[-1].column(0)[-1].as_py() != tile[0]):
                yield from pairs(pa.Table.from_batches([*held, *([batch.slice(0, cut)] if cut else [])]))
                held.clear()
            elif cut:
                yield from pairs(pa.Table.from_batches([batch.slice(0, cut)]))
            held.append(batch.slice(cut))
        if held:
            yield from pairs(pa.Table.from_batches(held))

    return dealt.repartition("tile").sortWithinPartitions("tile", "n", "node").mapInArrow(run, "a bigint, b bigint, slack bigint")


def labelled(cells: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The cells with the component of each set (that of a set without links is itself)."""
    if labels is None:
        return cells.withColumn("label", F.col("node"))
    return cells.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def by_lot(cells: DataFrame, labels: DataFrame | None, lots: int, tile: int = TILE) -> DataFrame:
    """Tiles to which the nodes of each cell of several components are dealt by lot; further columns of the cells stay."""
    held = [c for c in cells.columns if c not in ("tok", "cell", "c", "node")]
    rows = labelled(cells, labels)
    if labels is not None:
        mixed_cells = rows.groupBy("tok", "cell").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("tok", "cell")
        rows = rows.join(mixed_cells, ["tok", "cell"], "left_semi")
    lot = F.pmod(F.xxhash64("node", "tok", F.lit(lots)), F.ceil(F.col("c") / tile))
    return rows.select(F.xxhash64("tok", "cell", lot).alias("tile"), F.lit(0).alias("part"), F.lit(False).alias("cross"), "node", *held, "label")


def by_rest(cells: DataFrame, labels: DataFrame | None, tile: int = TILE) -> DataFrame:
    """Tiles in which all nodes of different components meet: the blocks of a cell's largest component with those of the rest, and these with each other."""
    held = [c for c in cells.columns if c not in ("tok", "cell", "c", "node")]
    rows = labelled(cells, labels)
    sizes = rows.groupBy("tok", "cell", "label").agg(F.count(F.lit(1)).alias("c"))
    tops = sizes.groupBy("tok", "cell").agg(F.max_by("label", F.struct("c", "label")).alias("top"), F.max("c").alias("most"), (F.sum("c") - F.max("c")).alias("rest")).where("rest > 0")
    rows = rows.drop("c").join(tops, ["tok", "cell"])
    rows = rows.withColumns({"tops": F.ceil(F.col("most") / tile).cast("int"), "rests": F.ceil(F.col("rest") / tile).cast("int"), "large": F.col("label") == F.col("top")})
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node", "tok"), F.when(F.col("large"), F.col("tops")).otherwise(F.col("rests"))).cast("int"))
    # x: a block of the largest component, y: one of the rest; kind 1: two blocks of the rest.
    large = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda y: F.struct(F.lit(0).alias("kind"), F.col("own").alias("x"), y.alias("y"), F.lit(0).alias("part")))
    small = F.transform(F.sequence(F.lit(0), F.col("tops") - 1), lambda x: F.struct(F.lit(0).alias("kind"), x.alias("x"), F.col("own").alias("y"), F.lit(1).alias("part")))
    others = F.filter(F.sequence(F.lit(0), F.col("rests") - 1), lambda y: y != F.col("own"))
    among = F.transform(others, lambda y: F.struct(F.lit(1).alias("kind"), F.least(y, F.col("own")).alias("x"), F.greatest(y, F.col("own")).alias("y"), (y < F.col("own")).cast("int").alias("part")))
    rows = rows.select("tok", "cell", "node", *held, "label", F.inline(F.when(F.col("large"), large).otherwise(F.concat(small, among))))
    # The sets of one block of the rest meet each other where the first block of the largest component comes.
    cross = (F.col("kind") == 1) | (F.col("x") > 0)
    return rows.select(F.xxhash64("tok", "cell", "kind", "x", "y").alias("tile"), "part", cross.alias("cross"), "node", *held, "label")


def linked(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(row, doc_id, key, n, component_id, head): head is true for one row of each component."""
    shared_dir(docs.sparkSession)
    docs = docs.select("doc_id", "text").withColumn(KEY, F.xxhash64(F.col("doc_id").cast("string"), "text"))
    whole = written(set_rows(docs, bucket_levels(docs, size), size, percent).withColumn("row", F.monotonically_increasing_id()), "jaccard-sets")
    full = whole.where("n > 0")
    last = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    classes = written(full.groupBy("s1", "s2").agg(F.min("row").alias("node"), F.min(last).alias("least"), F.count(F.lit(1)).alias("times")), "jaccard-classes")
    nodes = written(full.join(classes.select("node"), F.col("row") == F.col("node"), "left_semi").select(F.col("row").alias("node"), "key", "n", "bits", "prefix"), "jaccard-nodes")
    rows = written(whole.select("row", "doc_id", "key", "n", "s1", "s2"), "jaccard-rows")
    dropped(whole)
    freed(docs.sparkSession)
    runs = cells_of(nodes, percent)
    cells = _union(runs)
    links: list[DataFrame] = []
    labels = None
    for k in range(ROUNDS):
        best = met(by_lot(cells, labels, k), nodes, True, percent).groupBy("a").agg(F.max_by("b", F.struct("slack", "b")).alias("b"))
        labels = _joined(best, nodes, docs, size, percent, links, labels)
    labels = _joined(met(by_rest(cells, labels), nodes, False, percent), nodes, docs, size, percent, links, labels)
    grouped = classes
    if labels is None:
        grouped = grouped.withColumn("label", F.col("node"))
    else:
        grouped = grouped.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    tops = grouped.groupBy("label").agg(F.min("least").alias("top"), F.sum("times").alias("members"))
    named = grouped.join(tops, "label").where("members > 1").select("s1", "s2", "top")
    named = written(named, "jaccard-named")
    freed(docs.sparkSession)
    dropped(nodes, *runs, classes, *links, *([] if labels is None else [labels]))
    salted = named.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    light = rows.withColumn("salt", F.when(F.col("n") > 0, F.pmod("row", F.lit(SALTS)).cast("int")).otherwise(-1 - F.pmod("row", F.lit(SALTS)).cast("int")))
    done = light.join(salted, ["s1", "s2", "salt"], "left")
    return done.select("row", "doc_id", "key", "n", F.when(F.col("top").isNull(), F.col("doc_id")).otherwise(F.col("top.id")).alias("component_id"), (F.col("top").isNull() | (F.col("top.row") == F.col("row"))).alias("head"))


def _joined(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int, links: list[DataFrame], labels: DataFrame | None) -> DataFrame | None:
    """The components with the links among these pairs, which are added to `links`."""
    pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "jaccard-pairs")
    found = None if pairs.isEmpty() else exact_links(pairs, nodes, docs, size, percent)
    dropped(pairs)
    freed(nodes.sparkSession)
    if found is None or found.isEmpty():
        return labels
    links.append(found)
    more = components(_union(links))
    if labels is not None:
        dropped(labels)
    return more


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def one_of_each(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs less all but one (of the smallest doc_id) of each component; of equal rows one stays."""
    found = linked(docs, size, percent).groupBy("key").agg(F.sum(F.col("head").cast("int")).alias("__heads"), F.any_value("n").alias("__n"), F.count(F.lit(1)).alias("__times"))
    found = written(found.where("__heads > 0").withColumnRenamed("key", KEY), "jaccard-heads")
    keyed = docs.withColumn(KEY, F.xxhash64(F.col("doc_id").cast("string"), "text"))
    single = keyed.join(found.where("__times = 1 or __n = 0"), KEY, "left_semi").select(*docs.columns)
    equal = keyed.join(found.where("__times > 1 and __n > 0"), KEY, "left_semi")
    first = equal.withColumn("__r", F.row_number().over(Window.partitionBy(KEY).orderBy(F.lit(1)))).where("__r = 1")
    return single.unionByName(first.select(*docs.columns))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linked(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4, 85)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


OP4_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, array_to_string(ws[i:i + 3], ' ') as g from w, unnest(range(1, greatest(1, len(ws) - 3) + 1)) as t(i) where len(ws) > 0),
c as (select doc_id, count(*) as n from s group by 1),
p as (select x.doc_id as a, y.doc_id as b, count(*) as k from s as x join s as y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2),
e as (select a, b from p join c as ca on ca.doc_id = a join c as cb on cb.doc_id = b where 100 * k >= 85 * (ca.n + cb.n - k)),
r as (select a, b from e union select r.a, e.b from r join e on r.b = e.a)
select w.doc_id, cast(coalesce(c.n, 0) as bigint) as n_shingles, cast(least(w.doc_id, coalesce(min(r.b), w.doc_id)) as bigint) as component_id
from w left join c on c.doc_id = w.doc_id left join r on r.a = w.doc_id group by w.doc_id, c.n
"""
