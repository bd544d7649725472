"""Benchmark decontamination with an FM-index for each shard of the training text.

A shard is a run of whole documents of about SHARD_BYTES. Its words become numbers (words that no phrase has share one),
a full suffix array is sorted by prefix doubling, and the Burrows-Wheeler transform of the shard is kept in a wavelet
matrix with bit-vector ranks. All test phrases (windows of WINDOW words; a shorter item is one window) are searched
backwards at once; the occurrences found are located by walking to the next sampled suffix position, and each
document's hit words are merged into removal spans.

The phrases travel to every task in blocks of at most MOST_PHRASE_BYTES of item text: a small benchmark is one block, a
larger one is searched block by block over the same rows.

Defined results: null or wordless texts have no words and no hits; items without words match nothing; an item whose id is
null counts for hits and spans, but is not listed; equal item ids are listed once; repeated rows stay repeated; an empty
benchmark or an empty table gives no hits or no rows; columns of the documents stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ALNUM, Words, byte_rows, pieces

WINDOW = 10
SHARD_BYTES = 4 << 20
SAMPLE = 32
MOST_PHRASE_BYTES = 32 << 20


def suffix_array(seq: np.ndarray, sigma: int) -> np.ndarray:
    """Sorted suffixes of numbers below sigma. 0 ends a document, also the last; earlier ends sort before later ones."""
    n = len(seq)
    bits, place = max(1, (sigma - 1).bit_length()), max(1, (n - 1).bit_length())
    wide = max(1, (63 - place) // bits)
    key, alive = np.zeros(n, np.int64), np.ones(n, bool)
    for j in range(wide):
        key <<= bits
        key[: n - j] |= seq[j:] * alive[: n - j]
        alive[: n - j] &= seq[j:] != 0
        alive[n - j :] = False
    key <<= place
    key |= np.arange(n)
    key.sort()
    sa = key & ((1 << place) - 1)
    key >>= place
    new = np.concatenate(([True], key[1:] != key[:-1]))
    tied = ~new
    tied[:-1] |= ~new[1:]
    tied &= alive[sa]  # a window that ends with its document is in its place already
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = np.where(tied, first, np.arange(n))
    open_, step = np.flatnonzero(tied), wide
    while open_.size:
        at = sa[open_]
        major, minor = rank[at], rank[at + step]
        order = np.argsort(major << 31 | minor, kind="stable") if n < 1 << 31 else np.lexsort((minor, major))
        at, major, minor = at[order], major[order], minor[order]
        sa[open_] = at
        new = np.concatenate(([True], (major[1:] != major[:-1]) | (minor[1:] != minor[:-1])))
        rank[at] = np.maximum.accumulate(np.where(new, open_, 0))
        tied = ~new
        tied[:-1] |= ~new[1:]
        open_ = open_[tied]
        step *= 2
    return sa


class Ranks:
    """A bit vector with the number of ones before each place."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.zeros((n // 64 + 1) * 8, np.uint8)
        small = np.packbits(bits, bitorder="little")
        packed[: len(small)] = small
        self.words = packed.view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]))

    def at(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    """Ranks of any number in a sequence of numbers below sigma."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.bits = max(1, (sigma - 1).bit_length())
        self.levels: list[tuple[Ranks, int]] = []
        values = values.astype(np.uint16 if sigma <= 1 << 16 else np.uint32)
        for level in reversed(range(self.bits)):
            bit = (values >> level & 1).astype(bool)
            self.levels.append((Ranks(bit), int(len(bit) - bit.sum())))
            values = np.concatenate((values[~bit], values[bit]))
        self.starts = self._down(np.arange(sigma), np.zeros(sigma, np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, (ranks, zeros) in enumerate(self.levels):
            ones = ranks.at(i)
            i = np.where(symbol >> (self.bits - 1 - k) & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before place i."""
        return self._down(symbol, i) - self.starts[symbol]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at place i, and how often it stands before."""
        symbol = np.zeros(len(i), np.int64)
        for ranks, zeros in self.levels:
            bit, ones = ranks.get(i), ranks.at(i)
            symbol = symbol << 1 | bit
            i = np.where(bit, zeros + ones, i - ones)
        return symbol, i - self.starts[symbol]


class FMIndex:
    """Counts and places of phrases in a sequence in which 0 ends each document, also the last."""

    def __init__(self, seq: np.ndarray, sigma: int, sample: int = SAMPLE):
        sa = suffix_array(seq, sigma)
        bwt = seq[sa - 1]  # before the first place stands the last document's end
        self.n = len(seq)
        self.wavelet = WaveletMatrix(bwt, sigma)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=sigma))))[:sigma]
        marked = (sa % sample == 0) | (bwt == 0)  # a document's first place is sampled, so no walk crosses an end
        self.marked, self.samples = Ranks(marked), sa[marked]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [low, high) of the suffixes that begin with each phrase (a row of numbers, none of them 0)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for column in phrases.T[::-1]:
            symbol = column[live]
            low[live] = self.before[symbol] + self.wavelet.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.wavelet.rank(symbol, high[live])
            live = live[low[live] < high[live]]
            if not live.size:
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places of the suffixes in these rows."""
        out = np.empty(len(rows), np.int64)
        left, steps = np.arange(len(rows)), 0
        while left.size:
            found = self.marked.get(rows)
            out[left[found]] = self.samples[self.marked.at(rows[found])] + steps
            left, rows = left[~found], rows[~found]
            symbol, rank = self.wavelet.access(rows)
            rows = self.before[symbol] + rank
            steps += 1
        return out


class Phrases:
    """The windows of some items as numbers, and the items that each window comes from."""

    def __init__(self, items: list[tuple[object, bytes]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        number: dict[tuple[int, ...], int] = {}
        owners: list[set[int]] = []
        self.names: list[str | None] = []
        for item, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in Words([text], ALNUM).array().to_pylist()]
            self.names.append(None if item is None else str(item))
            for k in range(max(1, len(words) - window + 1) if words else 0):
                w = tuple(words[k : k + window])
                if w not in number:
                    number[w] = len(owners)
                    owners.append(set())
                owners[number[w]].add(len(self.names) - 1)
        self.sigma = len(self.vocabulary) + 2
        self.count = np.array([len(o) for o in owners], np.int64)
        self.owners = np.array([x for o in owners for x in sorted(o)], np.int64)
        self.groups: list[tuple[np.ndarray, np.ndarray]] = []
        for size in sorted({len(w) for w in number}):
            own = [(w, k) for w, k in number.items() if len(w) == size]
            self.groups.append((np.array([k for _, k in own], np.int64), np.array([w for w, _ in own], np.int64)))

    def numbers(self, words: Words) -> np.ndarray:
        found = words.array()
        place = pc.index_in(found, value_set=pa.array(list(self.vocabulary), found.type))
        return pc.add(pc.fill_null(place, -1), 2).to_numpy(zero_copy_only=False)

    def hits(self, words: Words) -> tuple[np.ndarray, list[set[int]]]:
        """For each word of the documents whether it is hit, and for each document the items found in it."""
        firsts = words.firsts
        docs = len(firsts) - 1
        found: list[set[int]] = [set() for _ in range(docs)]
        seq = np.zeros(len(words) + docs, np.int32)
        seq[np.arange(len(words)) + words.owners()] = self.numbers(words)
        index = FMIndex(seq, self.sigma)
        change = np.zeros(len(words) + 1, np.int64)
        for which, phrases in self.groups:
            low, high = index.search(phrases)
            times = high - low
            here = np.flatnonzero(times)
            if not here.size:
                continue
            many = times[here]
            rows = np.repeat(low[here] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
            at = index.locate(rows)
            doc = np.searchsorted(firsts[1:] + np.arange(1, docs + 1), at, "right")
            at -= doc
            np.add.at(change, at, 1)
            np.add.at(change, at + phrases.shape[1], -1)
            window = np.repeat(which[here], many)
            for d, w in np.unique(np.stack((doc, window), 1), axis=0).tolist():
                begin = int(self.starts[w])
                found[d].update(self.owners[begin : begin + int(self.count[w])].tolist())
        return np.cumsum(change[:-1]) > 0, found

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.count) - self.count


def spans(hit: np.ndarray) -> list[tuple[int, int]]:
    """Runs of hit words as [first, behind the last)."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


SPANS = pa.list_(pa.struct([("first", pa.int64()), ("behind", pa.int64())]))


def located(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_bytes: int = MOST_PHRASE_BYTES) -> DataFrame:
    """All columns of docs, and hit_words (long), hit_spans (merged word ranges), hit_items (sorted item ids as strings) and all_words."""
    docs = docs.drop("all_words", "hit_spans", "hit_items", "hit_words")
    columns, at = docs.columns, docs.columns.index("text")
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // most_bytes))
    found = docs.withColumns({"all_words": F.lit(0).cast("bigint"), "hit_spans": F.expr("cast(array() as array<struct<first:bigint,behind:bigint>>)"), "hit_items": F.expr("cast(array() as array<string>)")})
    for block in range(blocks):
        items = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else benchmark
        phrases = Phrases([(r["item_id"], (r["text"] or "").encode()) for r in items.select("item_id", "text").distinct().collect()], window)
        found = _search(found, phrases, columns, at)
    return found.withColumn("hit_words", F.expr("aggregate(hit_spans, 0L, (a, s) -> a + s.behind - s.first)"))


def _search(docs: DataFrame, phrases: Phrases, columns: list[str], at: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(phrases)
    k = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = sent.value
        for batch in pieces(batches, "text", SHARD_BYTES):
            words = Words(byte_rows(batch.column(at)), ALNUM)
            firsts = words.firsts
            hit, items = phrases.hits(words) if phrases.groups else (np.zeros(len(words), bool), [set() for _ in firsts[1:]])
            old_spans, old_items = batch.column(k + 1).to_pylist(), batch.column(k + 2).to_pylist()
            new_spans, new_items = [], []
            for i, (a, b) in enumerate(zip(firsts.tolist(), firsts[1:].tolist())):
                own = hit[a:b]
                if old_spans[i]:
                    own = own.copy()
                    for s in old_spans[i]:
                        own[s["first"] : s["behind"]] = True
                new_spans.append([{"first": x, "behind": y} for x, y in spans(own)])
                new_items.append(sorted({*old_items[i], *(phrases.names[x] for x in items[i] if phrases.names[x] is not None)}))
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(np.diff(firsts)), pa.array(new_spans, SPANS), pa.array(new_items, pa.list_(pa.string()))], [*columns, "all_words", "hit_spans", "hit_items"])

    return docs.mapInArrow(run, docs.schema)


def without_spans(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text without the words of these ranges, and without what stands between them."""
    import re

    where = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    out, at = [], 0
    for first, behind in ranges:
        out.append(text[at : where[first][0]])
        at = where[behind - 1][1]
    return "".join([*out, text[at:]])


def cleaned(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """All rows and columns of docs, their texts without the merged spans of words that stand in a benchmark window."""
    names = docs.columns
    found = located(docs.select(F.struct(*(f"`{c}`" for c in names)).alias("own"), "text"), benchmark, window).select("own", "text", "hit_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            texts = [without_spans(t, [(s["first"], s["behind"]) for s in hit]) if hit else t for t, hit in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["own", "text"])

    kind = found.schema["own"].dataType.simpleString()
    rest = found.mapInArrow(run, f"own {kind}, text string")
    return rest.select(*(F.col("text") if c == "text" else F.col(f"own.`{c}`").alias(c) for c in names))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = located(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        F.col("all_words").alias("n_words"),
        F.col("hit_words").alias("n_hit"),
        F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("hit_words") > 0).alias("contaminated"),
    )


OP5_SQL = r"""
with w as (
  select 'd' as k, doc_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents
  union all
  select 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
b as (select id as item_id, ws, least(10, len(ws)) as m from w where k = 'b' and len(ws) > 0),
win as (select distinct item_id, m, array_to_string(ws[i:i + m - 1], ' ') as p from b, unnest(range(1, len(ws) - m + 2)) as t(i)),
d as (select id as doc_id, ws from w where k = 'd'),
place as (select doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') as p from d, (select distinct m from win) as l, unnest(range(1, len(ws) - m + 2)) as t(i)),
found as (select doc_id, item_id, m, i from place join win using (m, p)),
hit as (select doc_id, count(distinct j) as n_hit from found, unnest(range(i, i + m)) as t(j) group by 1),
items as (select doc_id, count(*) as n_items, string_agg(x, ',' order by x) as s from (select distinct doc_id, cast(item_id as varchar) as x from found) group by 1)
select d.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join items using (doc_id)
"""
