"""All runs of word sequences, in linear time over an ordered alphabet, and texts collapsed to one period of each run.

A run is a stretch with smallest period q, at least `times` periods and `least` words long, that cannot be extended.

1. The words of a text are symbols of an ordered alphabet, named by their rank. Nothing but comparisons of symbols follows:
   no suffix array or tree, and no fingerprints.
2. `factors` goes through the places r from left to right. Place r is compared with the places that still wait for a smaller
   suffix: first r - 1, then the previous smaller suffix of that, and so on. A place whose suffix is larger has found its next
   smaller suffix, r, so it begins a longest Lyndon word that ends before r; the first smaller one is the previous smaller suffix of r.
3. A comparison never reads again what an earlier one has matched. If two places match up to `reach`, what stands before `reach`
   is a copy, `shift` places behind: where the copied pair is one that has been compared, its extension is reused, unless it ends at
   `reach`; else the pair matches up to `reach` at least, and reading goes on there. Pairs of one chain take over the extension
   so far: with p, the match of the last place l with its own previous smaller suffix, and m, that of l with r, the next
   pair matches min(p, m) places, and more only if p = m. So each equal comparison moves `reach` on, and all take linear time.
4. A run of four periods holds Lyndon words that match on for two of their lengths or more. The first one of a run, in the order
   of symbols or in the reversed one, gives its end; the start lies less than a period before, and is read backwards. That reading
   costs the period of each run found (their sum is n log n at the very most, if runs of four periods nest).

Defined results: a null or empty text has no words and no runs; a null doc_id has the checksum 0 and a text without
planted periods; repeated rows have equal results each; an empty table gives no rows; columns of docs other than doc_id and
text are not read, so their names can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import byte_rows, pieces

TIMES, LEAST = 4, 6


def factors(symbols: list[int], times: int = 2) -> list[tuple[int, int, int]]:
    """(l, r, m): r is the next smaller suffix of l, the suffixes match in m symbols, and m >= times * (r - l), times being 1 or more. Symbols are not negative."""
    n = len(symbols)
    w = [*symbols, -1]  # behind the last symbol, and as w[-1] before the first, stands what is smaller than all
    before, before_match = [-1] * n, [0] * n  # previous smaller suffix
    after, after_match = [n] * n, [0] * n  # next smaller suffix
    found = []
    reach = shift = 0
    for r in range(1, n):
        c, l = w[r], r - 1
        if r >= reach:
            while w[l] > c:
                after[l] = r
                l = before[l]
            if w[l] < c:
                before[r] = l
                continue
            m, known = 1, False
        else:
            a = l - shift
            m = after_match[a] if after[a] == r - shift else before_match[r - shift]
            known = r + m < reach
            if not known:
                m = reach - r
        while True:
            if not known:
                while w[l + m] == w[r + m]:
                    m += 1
                if r + m > reach:
                    reach, shift = r + m, r - l
            if w[l + m] < w[r + m]:
                before[r], before_match[r] = l, m
                break
            after[l], after_match[l] = r, m
            if m >= times * (r - l):
                found.append((l, r, m))
            p, l = before_match[l], before[l]
            if l < 0:
                break
            if p < m:
                before[r], before_match[r] = l, p
                break
            known = p > m
            if p == m and r + m < reach:
                a, b = l - shift, r - shift
                m = after_match[a] if after[a] == b else before_match[b] if before[b] == a else n
                known = r + m < reach
                if not known:
                    m = reach - r
    return found


def runs(symbols: list[int], times: int = TIMES, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least `least` symbols and `times` periods (3 or more), by start, then period."""
    top = max(symbols, default=0)
    found = set()
    for w in (symbols, [top - x for x in symbols]):
        first: dict[tuple[int, int], int] = {}
        for l, r, m in factors(w, times - 2):
            first.setdefault((r - l, r + m), l)
        for (period, end), l in first.items():
            start = l
            while start and l - start < period and w[start - 1] == w[start - 1 + period]:
                start -= 1
            if end - start >= max(least, times * period):
                found.add((start, end - start, period))
    return sorted(found, key=lambda x: (x[0], x[2]))


def ranked(words: list[bytes]) -> list[int]:
    """The rank of each word among the distinct ones."""
    rank = {w: k for k, w in enumerate(sorted(set(words)))}
    return [rank[w] for w in words]


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that stand in no run behind its first period."""
    change = [0] * (len(words) + 1)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    out, depth = [], 0
    for w, c in zip(words, change):
        depth += c
        if not depth:
            out.append(w)
    return out


def planted(words: list[bytes], h: int) -> list[bytes]:
    """The words, for a tenth of the checksums h with a period from some place on."""
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def found_runs(docs: DataFrame, plant: bool = False, times: int = TIMES, least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of each row: all runs by start, then period, and the words that no run repeats, joined by a space.

    With `plant`, some documents get periods first, by the checksum of their doc_id. Rows are worked on one by one, where they are."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            sizes, every, rest = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), byte_rows(batch.column(1))):
                words = bytes(text).split()  # at ASCII white space alone
                if plant and i is not None:
                    words = planted(words, zlib.crc32(str(i).encode()))
                here = runs(ranked(words), times, least)
                sizes.append(len(words))
                every.append([{"start": s, "length": n, "period": p} for s, n, p in here])
                rest.append(b" ".join(collapsed(words, here) if here else words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(every, kind), pa.array(rest, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, f"doc_id bigint, n_words bigint, runs {RUNS}, collapsed string")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = found_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), plant=True)
    # Of the longest the first, of these the one of the least period.
    longest = F.expr("array_max(transform(runs, x -> struct(x.length, -x.start as back, -x.period as short)))")
    listed = F.expr("array_join(transform(runs, x -> concat_ws(',', x.start, x.length, x.period) || '\n'), '')")
    return found.withColumn("__top", longest).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.expr("-__top.back").alias("start"),
        F.col("__top.length").alias("length"),
        F.expr("-__top.short").alias("period"),
        F.expr("1000 * __top.length div -__top.short").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


OP11_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws,
    xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(cast(doc_id as varchar), ''), lambda x: [cast(ascii(x) as bigint), 0, 0, 0, 0, 0, 0, 0]))),
      lambda s, x: xor(xor(s, x) >> 1, (xor(s, x) & 1) * 3988292384)), 4294967295) as h from documents),
k as (select doc_id, ws, len(ws) as n, h, case when h % 10 = 0 then (h // 10) % greatest(len(ws), 1) else len(ws) end as a from d),
g as (select *, 1 + (n - a) // (3 + (h // 10) % 8) as p from k),
t as (select doc_id, n, i, ws[1 + case when i < a then i else a + (i - a) % p end] as w from g, unnest(range(n)) as u(i)),
e as (select x.doc_id, y.i - x.i as q, x.i as i from t as x join t as y on x.doc_id = y.doc_id and x.w = y.w and y.i > x.i and 4 * (y.i - x.i) <= x.n),
z as (select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) as part from e),
s as (select doc_id, q, min(i) as s, count(*) + q as k from z group by doc_id, q, part having count(*) + q >= greatest(6, 4 * q)),
r as (select * from s where not exists (select 1 from s as o where o.doc_id = s.doc_id and o.q < s.q and o.s <= s.s and o.s + o.k >= s.s + s.k)),
gone as (select distinct doc_id, i from r, unnest(range(s + q, s + k)) as u(i)),
rest as (select t.doc_id, string_agg(w, ' ' order by i) as kept from t anti join gone on gone.doc_id = t.doc_id and gone.i = t.i group by 1),
top as (select doc_id, count(*) as c, string_agg(concat_ws(',', s, k, q) || chr(10), '' order by s, q) as listed, arg_min(struct_pack(s, k, q), struct_pack(a := -k, b := s, c := q)) as m from r group by 1)
select d.doc_id, cast(coalesce(c, 0) as bigint) as n_runs, cast(m.s as bigint) as start, cast(m.k as bigint) as length, cast(m.q as bigint) as period, cast(1000 * m.k // m.q as bigint) as exponent_milli,
  sha256(coalesce(listed, '')) as runs_sha256, sha256(coalesce(kept, '')) as collapsed_sha256
from d left join rest on rest.doc_id = d.doc_id left join top on top.doc_id = d.doc_id
"""
