"""Near-duplicate lines across documents by a deletion-neighbourhood join.

A line is the sequence of its lower-cased words. A line goes if an earlier one (by doc_id, then by its place in the
text) has the same words, or, for lines of NEAR_WORDS words or more, is within one word edit: a word put in, left out
or replaced. The earliest stays. Lines of fewer than MIN_WORDS words always stay.

1. Every line gives its hashes; equal lines meet by them, and the earliest of each is kept.
2. Two lines within one edit share their first or last words (a quarter of them at least, in lengths fixed by powers of
   two): lines that share neither with another line need no variants.
3. The others emit their deletion neighbourhood: the hash of the line without word i, with i (replacement) and as a whole
   line of one word less (insertion and deletion), and that of the line itself. Each line is paired with the earliest
   of those whose equal variant proves one edit: replaced against replaced, or less a word against the whole line. Two
   lines less a word each may be two edits apart and are not paired. The pair's edit distance is verified on their words.

Groups are aggregated before they are joined and no pair of two later lines is made, so a line or variant that a third
of all rows share costs rows in proportion.

Defined results: null and empty texts have no lines to remove and stay as they are; rows that are equal in doc_id and
text are one document with one outcome; a null doc_id comes after all others; an empty table gives no rows; further
columns stay, and helper columns never clash as only a hash of the row travels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ALNUM, Words, byte_rows, dropped, freed, mixed, narrowed, pieces, written

MIN_WORDS, NEAR_WORDS, EDITS = 3, 8, 1
SALTS = 16

_P = np.uint64(0xD6E8FEB86659FD93)
_P_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_Q = np.uint64(0xA0761D6478BD642F)
LAST = (1 << 63) - 1
KEY, ORD = "__row_key", "__row_ord"
#: Kinds of variants.
REPLACED, LESS, WHOLE = 0, 1, 2


class LineWords(Words):
    """Words with the line that each stands in; the lines of all rows count on, an empty row has one line."""

    def __init__(self, rows: list):
        super().__init__(rows, ALNUM)
        raw = np.frombuffer(b"\n".join(rows) + b"\n", np.uint8)
        self.breaks = np.flatnonzero(raw == 0x0A)  # one ends each line
        self.line_firsts = np.concatenate(([0], np.searchsorted(self.starts, self.breaks, "left")))
        behind = np.cumsum([len(r) + 1 for r in rows], dtype=np.int64)
        self.row_lines = np.concatenate(([0], np.searchsorted(self.breaks, behind, "left")))


def _powers(factor: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(max(0, n), factor, np.uint64))))


def sums(words: np.ndarray, firsts: np.ndarray, factor: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of word times factor**(place in its line), 0 in front, and the powers."""
    sizes = np.diff(firsts)
    place = np.arange(len(words)) - np.repeat(firsts[:-1], sizes)
    powers = _powers(factor, int(sizes.max()) if len(sizes) else 0)
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * powers[place], dtype=np.uint64))), powers


def _inverse_powers(n: int, factor: np.uint64) -> np.ndarray:
    return _powers(np.uint64(pow(int(factor), -1, 1 << 64)), n)


LINES = "ord bigint, key bigint, line int, n int, h1 bigint, h2 bigint, halves array<bigint>"


def line_rows(docs: DataFrame) -> DataFrame:
    """A row for each line of MIN_WORDS words or more; `halves` has the hashes of its first and last words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            lw = LineWords(byte_rows(batch.column(2)))
            words, firsts = lw.hashes(), lw.line_firsts
            sizes = np.diff(firsts)
            if not len(words):
                continue
            total, powers = sums(words, firsts, _P)
            other, _ = sums(words, firsts, _Q)
            inverse = _inverse_powers(int(sizes.max()), _P)
            keep = np.flatnonzero(sizes >= MIN_WORDS)
            a, n = firsts[:-1][keep], sizes[keep]
            h1, h2 = total[a + n] - total[a], other[a + n] - other[a]
            near = np.flatnonzero(n >= NEAR_WORDS)
            level = np.log2(np.maximum(n, 1) / NEAR_WORDS + 1e-9).astype(np.int64)
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for who, lev in ((near, level[near]), (near[(level[near] > 0) & (n[near] == NEAR_WORDS << level[near])], None)):
                lev = level[who] - 1 if lev is None else lev
                size = (NEAR_WORDS // 2) << lev
                front = total[a[who] + size] - total[a[who]]
                start = a[who] + n[who] - size
                back = (total[a[who] + n[who]] - total[start]) * inverse[n[who] - size]
                tag = size.astype(np.uint64) * np.uint64(2)
                found += [(who, mixed(front ^ mixed(tag))), (who, mixed(back ^ mixed(tag + np.uint64(1))))]
            who, value = np.concatenate([w for w, _ in found]), np.concatenate([v for _, v in found])
            order = np.argsort(who, kind="stable")
            cuts = np.searchsorted(who[order], np.arange(len(keep) + 1)).astype(np.int32)
            row = np.searchsorted(lw.row_lines[1:], keep, "right")
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array((keep - lw.row_lines[row]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(mixed(h1 + n.astype(np.uint64)).view(np.int64)), pa.array(mixed(h2).view(np.int64)), pa.ListArray.from_arrays(cuts, pa.array(value[order].view(np.int64)))],
                ["ord", "key", "line", "n", "h1", "h2", "halves"],
            )

    return docs.select(F.col(ORD).alias("ord"), F.col(KEY).alias("key"), "text").mapInArrow(run, LINES)


def word_rows(docs: DataFrame) -> DataFrame:
    """The word hashes of the lines that the column `lines` of each document names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            lw = LineWords(byte_rows(batch.column(2)))
            words = lw.hashes()
            named = batch.column(3)
            row = np.repeat(np.arange(batch.num_rows), np.diff(named.offsets.to_numpy()))
            line = named.flatten().to_numpy()
            at = lw.row_lines[row] + line
            a, b = lw.line_firsts[at].tolist(), lw.line_firsts[at + 1].tolist()
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(line, pa.int32()), pa.array([words[x:y].tobytes() for x, y in zip(a, b)], pa.binary())], ["ord", "key", "line", "words"])

    return docs.select(F.col(ORD).alias("ord"), F.col(KEY).alias("key"), "text", "lines").mapInArrow(run, "ord bigint, key bigint, line int, words binary")


def variant_rows(lines: DataFrame) -> DataFrame:
    """The deletion neighbourhood of each line as hashed keys, each of a kind: a word replaced, a word less, the line itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "words", 1 << 20):
            rows = byte_rows(batch.column(1))
            words = np.frombuffer(b"".join(rows), np.uint64)
            sizes = np.array([len(r) // 8 for r in rows], np.int64)
            firsts = np.concatenate(([0], np.cumsum(sizes)))
            total, _ = sums(words, firsts, _P)
            line = np.repeat(np.arange(len(rows)), sizes)
            a, b = firsts[:-1][line], firsts[1:][line]
            i = np.arange(len(words))
            without = total[i] - total[a] + (total[b] - total[i + 1]) * _P_INVERSE
            n = sizes[line].astype(np.uint64)
            replaced = mixed(without ^ mixed(n << np.uint64(32) | (i - a).astype(np.uint64)))
            shorter = mixed(without + mixed(~(n - np.uint64(1))))
            itself = mixed(total[firsts[1:]] - total[firsts[:-1]] + mixed(~sizes.astype(np.uint64)))
            which = np.concatenate((line, line, np.arange(len(rows))))
            kind = np.repeat(np.array([REPLACED, LESS, WHOLE], np.int8), [len(line), len(line), len(rows)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((replaced, shorter, itself)).view(np.int64)), pa.array(kind), batch.column(0).take(pa.array(which))], ["k", "kind", "lid"])

    return lines.select("lid", "words").mapInArrow(run, "k bigint, kind tinyint, lid bigint")


def within(a: np.ndarray, b: np.ndarray, edits: int = EDITS) -> bool:
    """Whether the edit distance of two sequences is at most `edits`."""
    if abs(len(a) - len(b)) > edits:
        return False
    m = min(len(a), len(b))
    differ = np.flatnonzero(a[:m] != b[:m])
    if not differ.size:
        return True
    a, b = a[differ[0] :], b[differ[0] :]
    m = min(len(a), len(b))
    differ = np.flatnonzero(a[::-1][:m] != b[::-1][:m])
    same = int(differ[0]) if differ.size else m
    a, b = a[: len(a) - same], b[: len(b) - same]
    if edits == 1:
        return max(len(a), len(b)) <= 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1] <= edits


def verified(pairs: DataFrame) -> DataFrame:
    """The pairs whose words are within the bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [within(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in zip(byte_rows(batch.column(3)), byte_rows(batch.column(4)))]
            yield batch.select([0, 1, 2]).filter(pa.array(good, pa.bool_()))

    return pairs.mapInArrow(run, "ord bigint, key bigint, line int")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({KEY: F.xxhash64(F.col("doc_id").cast("string"), "text"), ORD: F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST))})


def removed_lines(docs: DataFrame) -> DataFrame:
    """For each document (row key) that loses lines: their numbers, and how many of them are near, not exact, copies."""
    docs = keyed(docs.select("doc_id", "text").where("length(text) > 0"))
    lines = written(line_rows(docs), "lines")
    first = F.min(F.struct("ord", "key", "line"))
    kinds = lines.groupBy("h1", "h2").agg(first.alias("first"), F.count(F.lit(1)).alias("times"), F.any_value("n").alias("n"), F.any_value("halves").alias("halves"))
    kinds = written(kinds.select("h1", "h2", "first.*", "times", "halves"), "line-kinds")
    freed(docs.sparkSession)
    halves = kinds.select("ord", "key", "line", F.explode("halves").alias("k"))
    shared = halves.groupBy("k").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("k")
    chosen = halves.join(shared, "k", "left_semi").groupBy("key").agg(F.sort_array(F.collect_set("line")).alias("lines"))
    chosen = written(chosen.withColumnRenamed("key", KEY), "line-chosen")
    words = written(word_rows(narrowed(docs, chosen, KEY).join(chosen.hint("merge"), KEY)), "line-words")
    dropped(chosen)
    # Numbers that follow the order of (ord, key, line): the earliest line of a group has the least.
    unnumbered = words
    words = written(words.dropDuplicates(["key", "line"]).orderBy("ord", "key", "line").withColumn("lid", F.monotonically_increasing_id()), "line-words")
    dropped(unnumbered)
    freed(docs.sparkSession)
    variants = variant_rows(words)
    # m: the earliest line of a word replaced, or of a word less; whole: the line that has the key's words itself.
    groups = variants.groupBy("k").agg(
        F.min(F.when(F.col("kind") != WHOLE, F.col("lid"))).alias("m"), F.min(F.when(F.col("kind") == WHOLE, F.col("lid"))).alias("whole"), F.max(F.when(F.col("kind") == REPLACED, F.col("lid"))).alias("x")
    )
    groups = groups.where("m < x or m != whole").select("k", "m", "whole")
    partner = F.when(F.col("kind") == LESS, F.col("whole")).otherwise(F.col("m"))
    later = variants.join(groups, "k").withColumn("m", partner).where("lid > m").groupBy("lid").agg(F.min("m").alias("m"))
    pairs = later.join(words, "lid").join(words.select(F.col("lid").alias("m"), F.col("words").alias("other")), "m")
    near = written(verified(pairs.select("ord", "key", "line", "words", "other")).withColumn("near", F.lit(True)), "line-near")
    dropped(words)
    freed(docs.sparkSession)
    judged = kinds.join(near, ["ord", "key", "line"], "left").where("times > 1 or near")
    judged = judged.select("h1", "h2", F.struct("ord", "key", "line").alias("first"), F.coalesce("near", F.lit(False)).alias("near"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    all_lines = lines.select("h1", "h2", "ord", "key", "line", F.pmod("key", F.lit(SALTS)).cast("int").alias("salt"))
    gone = all_lines.join(judged, ["h1", "h2", "salt"]).where(F.col("near") | (F.struct("ord", "key", "line") != F.col("first")))
    gone = written(gone.groupBy(F.col("key").alias(KEY)).agg(F.sort_array(F.collect_set("line")).alias("__gone"), F.count_distinct(F.when(F.col("near"), F.col("line"))).alias("__near")), "line-gone")
    dropped(lines, kinds, near)
    freed(docs.sparkSession)
    return gone


def deduplicated(docs: DataFrame) -> DataFrame:
    """All rows: their columns with the text less its removed lines, and n_lines, n_removed and n_near (which replace such columns)."""
    docs = docs.drop("n_lines", "n_removed", "n_near")
    columns, at = docs.columns, docs.columns.index("text")
    gone, rows = removed_lines(docs), keyed(docs)
    # Only documents that may lose lines are shuffled.
    found = narrowed(rows, gone, KEY).join(gone.hint("merge"), KEY, "left").select(*columns, "__gone", "__near")
    found = found.union(narrowed(rows, gone, KEY, "left_anti").select(*columns, F.lit(None).cast("array<int>").alias("__gone"), F.lit(None).cast("bigint").alias("__near")))
    k = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            texts, counts, lost = [], [], []
            for text, gone in zip(batch.column(at).to_pylist(), batch.column(k).to_pylist()):
                parts = text.split("\n") if text else []
                counts.append(len(parts))
                lost.append(len(gone or ()))
                if gone:
                    gone = set(gone)
                    text = "\n".join(x for i, x in enumerate(parts) if i not in gone)
                texts.append(text)
            near = [x or 0 for x in batch.column(k + 1).to_pylist()]
            out = [*batch.columns[:k], pa.array(counts, pa.int64()), pa.array(lost, pa.int64()), pa.array(near, pa.int64())]
            out[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(out, [*columns, "n_lines", "n_removed", "n_near"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return found.mapInArrow(run, f"{kinds}, n_lines bigint, n_removed bigint, n_near bigint")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return deduplicated(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "n_near", "text")
