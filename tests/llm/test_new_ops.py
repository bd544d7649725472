"""Periodic runs, vector codes and fingerprints against brute-force versions."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyforge.llm import codebooks, html_text, periodic_runs, simhash, warc
from tests.llm.test_ops import DOCS, corpus, words

# ---- 1


def test_records_of_two_archives_have_ids_of_their_own(spark):
    """Both archives in one table: each identifier names one record, and is looked up as that."""
    pages = [(k, f"http://a/{k % 3}", "x" * (900 + 50 * (k % 4))) for k in range(24)]
    one = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(2)
    two = one.withColumn("html", F.concat("html", F.lit("!")))
    both = warc.archive(one, min_revisit=1000).unionAll(warc.archive(two, min_revisit=1000)).unionAll(warc.archive(one, archive_id="fixed", min_revisit=1000))
    ids = [r["record_id"] for r in both.select(F.inline("records")).collect()]
    assert len(ids) == len(set(ids)) == 72
    found = warc.looked_up(both, ids[5:40:7]).collect()
    assert sorted(r["record_id"] for r in found) == sorted(ids[5:40:7])
    records = warc.read_back(both)
    assert records.count() == 72 and records.where("record_type = 'revisit'").count() == 30


# ---- 10

PAGES = [
    ('<p title="a hidden b">seen</p>', "seen"), ('<p style="color:red" data-style="display:none">seen</p>', "seen"), ("<p data-hidden>seen<p class=hidden>too", "seen\n\ntoo"),
    ("<div style='visibility:hidden'>no<p>no<b style='visibility: visible'>yes</b></p></div>end", "yes\n\nend"), ("<div style='visibility:hidden'><div style='visibility:inherit'>no</div></div>a", "a"),
    ("<ul style='visibility:hidden'><li>no<li style='visibility:visible'>yes</ul>", "- yes"), ("<ol><li style='visibility:hidden'>no<li>b</ol>", "2. b"),
    ("<div style='display:none'><p style='display:block'>no</p></div>a", "a"), ("<p hidden style='display:block'>yes", "yes"), ("<p style='display:block;DISPLAY : none'>no<p>a", "a"),
    ("<p style='display:none!important;display:block'>no<p>a", "a"), ("<p style='background:url(display:none;x)'>yes", "yes"), ("<p style='/*display:none*/color:red'>yes", "yes"), ("<p style=display:none>no<p>a", "a"), ("<p HIDDEN=''>no<p>a", "a"),
    ("<details>no<summary>sum</summary><p>no</details>a", "sum\na"), ("<details open><summary>s</summary>body</details>", "s\nbody"), ("<details data-open><p>no</details>a", "a"), ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"), ("<table><tr><td>x<td rowspan=0>a<td>b<tr><td>y<td>c<tr><td>z<td>d</table>", "x  a  b\ny     c\nz     d"),
    ("<table><tbody><tr><td rowspan=9>a<td>b<tbody><tr><td>c<td>d</table>", "a  b\nc  d"), ("<table><tr><td rowspan=2 colspan=2>w<td>b<tr><td>c<tr><td>p<td>q<td>r</table>", "w     b\n      c\np  q  r"),
    ("<table><tr><td data-rowspan=2>a<td>b<tr><td>c</table>", "a  b\nc"), ("<ol data-start=5><li>x</ol>", "1. x"), ("<p title='&quot; hidden'>yes", "yes"),
    ("<div>" * 250 + "<div style='visibility:hidden'>no<b style='visibility:visible'>in</b></div>" + "</div>" * 250, "in"), ("<div>" * 220 + "<details>no<i>no</i></details>in", "in"),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_visibility_and_spans(page, text):
    assert html_text.visible_text(page) == text


def test_pages_with_columns_of_the_same_names(spark):
    rows = spark.createDataFrame([(1, "<p>a", "own", "x")], "page_id bigint, html string, visible_text string, text string")
    assert [tuple(r) for r in html_text.extracted(rows, "html", ["page_id"]).collect()] == [(1, "a")]


# ---- 11


def brute_runs(w, times=4, least=6):
    found = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.append((i, j + q - i, q))
            i = j + 1
    return sorted((f for f in found if not any(g[2] < f[2] and g[0] <= f[0] and g[0] + g[1] >= f[0] + f[1] for g in found)), key=lambda x: (x[0], x[2]))


def nested(draw, depth):
    if not depth:
        return [draw.randrange(3) for _ in range(draw.randrange(1, 4))]
    x = nested(draw, depth - 1)
    return x * draw.randrange(1, 6) + (nested(draw, depth - 1) if draw.random() < 0.5 else x[: draw.randrange(len(x) + 1)])


def test_runs_of_random_sequences():
    draw = random.Random(7)
    for k in range(3000):
        w = nested(draw, draw.randrange(1, 4))[:150] if k % 3 else [draw.randrange(draw.randrange(1, 4)) for _ in range(draw.randrange(40))]
        assert periodic_runs.runs(w) == brute_runs(w)
        assert periodic_runs.runs(w, 3, 1) == brute_runs(w, 3, 1)


def test_factors_of_random_sequences():
    draw = random.Random(8)
    for k in range(1500):
        w = nested(draw, 3)[:60] if k % 2 else [draw.randrange(2) for _ in range(draw.randrange(30))]
        want = []
        for i in range(len(w)):
            j = next((j for j in range(i + 1, len(w)) if w[j:] < w[i:]), None)
            if j is not None:
                m = next((m for m in range(len(w) - j) if w[i + m] != w[j + m]), len(w) - j)
                want += [(i, j, m)] * (m >= j - i)
        assert sorted(periodic_runs.factors(w, 1)) == want


class Counted(int):
    compared = 0

    def __eq__(self, other):
        Counted.compared += 1
        return int(self) == int(other)

    __hash__ = int.__hash__


@pytest.mark.parametrize("w", [[0] * 3000, [0, 1] * 1500, [0, 1, 1] * 1000, ([0, 1] * 20 + [2]) * 70])
def test_each_match_is_read_once(w):
    Counted.compared = 0
    periodic_runs.factors([Counted(x) for x in w])
    assert Counted.compared <= 4 * len(w)


def test_periodic_runs(spark):
    rows = corpus() + [(1000 + k, " ".join(f"w{x}" for x in range(50 + k)), None, None, None) for k in range(40)] + [(-7, "a b " * 9 + "c " * 7, None, None, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], DOCS + ", runs string").repartition(3)
    got = {}
    for r in periodic_runs.found_runs(docs, plant=True).collect():
        got.setdefault(r["doc_id"], []).append((r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]))
    want = {}
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            a, g = (h // 10) % len(w), h // 10
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[x] if x < a else w[a + (x - a) % p] for x in range(len(w))]
        names = {x: k for k, x in enumerate(w)}
        short = len(w) < 2000  # the brute force is quadratic; the longer text is one word
        found = brute_runs([names[x] for x in w]) if short else [(0, len(w), 1)]
        gone = {x for s, n, q in found for x in range(s + q, s + n)}
        want.setdefault(i, []).append((len(w), found, b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert periodic_runs.found_runs(docs.limit(0)).count() == 0


# ---- 12


def brute_codes(rows, entries=64, parts=16, rounds=2):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    small = [r for r in kept if all(abs(x) < 1 << 24 for x in r[1])]
    order = sorted(small, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = len(order[0][1])
    use = [r for r in small if len(r[1]) == d]
    cuts = [k * d // parts for k in range(parts + 1)]
    cut = lambda v, k: v[cuts[k] : cuts[k + 1]]
    books = [[cut(v, k) for _, v, _ in [r for r in order if len(r[1]) == d][:entries]] for k in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v, k: min((far(cut(v, k), e), i) for i, e in enumerate(books[k]))
    for _ in range(rounds):
        new = []
        for k in range(parts):
            own = {}
            for _, v, _ in use:
                own.setdefault(nearest(v, k)[1], []).append(cut(v, k))
            new.append([[sum(c) // len(own[i]) for c in zip(*own[i])] if i in own else e for i, e in enumerate(books[k])])
        books = new
    out, labels = [], {}
    for i, v, label in kept:
        found = [nearest(v, k) for k in range(parts)] if len(v) == d and all(abs(x) < 1 << 24 for x in v) else None
        error = sum(e for e, _ in found) if found else None
        out.append((i, label, "".join(f"{x:02x}" for _, x in found) if found else None, error))
        if error is not None:
            labels[label] = labels.get(label, 0) + error
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((repr((*r, labels.get(r[1]), sha)) for r in out))


@pytest.mark.parametrize("d, entries, count", [(8, 8, 300), (5, 64, 40), (32, 16, 200)])
def test_vector_codes(spark, d, entries, count):
    draw = random.Random(d)
    rows = [(i, [draw.choice((-1.0, 0.0, 0.5, draw.gauss(0, 1))) for _ in range(d)], draw.choice((None, 1, 1, 1, 2, 3))) for i in range(count)]
    rows += [(3, rows[3][1], 1), (3, rows[5][1], None), (None, rows[7][1], 2), (900, None, 1), (901, [], 1), (902, [1.0, None] * d, 1), (903, [float("nan")] * d, 1), (904, [float("-inf")] * d, 9), (905, [70000.0] * d, 1), (906, [0.25] * (d + 1), 4)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<double>, label int, code string, error int").repartition(3)
    got = sorted(repr(tuple(r)) for r in codebooks.compressed(table, entries).select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256").collect())
    assert got == brute_codes(rows, entries)
    assert codebooks.compressed(table.limit(0)).count() == 0
    assert [r["code"] for r in codebooks.compressed(table.where("vec_id = 905")).collect()] == [None]


def test_tree_keeps_lower_indexes_of_ties():
    draw = np.random.Generator(np.random.PCG64(5))
    for entries in (1, 4, 5, 64, 200):
        book = draw.integers(-3, 4, (entries, 3))
        queries = draw.integers(-5, 6, (500, 3))
        index, error = codebooks.Tree(book).nearest(queries)
        far = ((queries[:, None] - book[None]) ** 2).sum(2)
        assert (index == far.argmin(1)).all() and (error == far.min(1)).all()


# ---- 13


def brute_components(n, links):
    """The least place of each of n places' component."""
    top = list(range(n))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    return [find(x) for x in range(n)]


def brute_fingerprint(text, size=4):
    w = words(text)
    if not w:
        return 0
    m = min(size, len(w))
    values = [xxhash.xxh64_intdigest(" ".join(w[k : k + m]).encode(), 42) for k in range(len(w) - m + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def test_simhash(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x") for r in rows], DOCS + ", fp string").repartition(3)
    got = sorted((repr(r["doc_id"]), r["fp"] % (1 << 64), repr(r["component_id"])) for r in simhash.near_duplicates(docs, 4).collect())
    prints = [brute_fingerprint(t) for _, t, *_ in rows]
    group = brute_components(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4])
    least = {}
    for (i, *_), g in zip(rows, group):
        least[g] = min((x for x in (least.get(g), i) if x is not None), default=None)
    assert got == sorted((repr(i), f, repr(least[g])) for (i, *_), f, g in zip(rows, prints, group))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("tile, distance", [(1024, 4), (16, 4), (16, 3), (32, 0), (1024, 7)])
def test_linked_fingerprints(spark, monkeypatch, tile, distance):
    """Chains, dense balls and single fingerprints; small tiles make crowded cells."""
    monkeypatch.setattr(simhash, "TILE", tile)
    draw = random.Random(tile + distance)
    found = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(6):
        center = draw.getrandbits(64)
        for _ in range(60):
            x = center
            for _ in range(draw.randrange(0, 9)):
                x ^= 1 << draw.randrange(64)
            found.add(x)
        for _ in range(20):
            center ^= draw.getrandbits(64) & draw.getrandbits(64) & draw.getrandbits(64) & draw.getrandbits(64)
            found.add(center)
    every = sorted(found)
    group = brute_components(len(every), [(a, b) for a in range(len(every)) for b in range(a) if (every[a] ^ every[b]).bit_count() <= distance])
    signed = [x - (1 << 64) if x >> 63 else x for x in every]
    nodes = spark.createDataFrame([(x,) for x in signed], "node bigint")
    labels = simhash.linked_fingerprints(nodes, distance)
    named = {} if labels is None else {r["node"]: r["label"] for r in labels.collect()}
    got = [named.get(x, x) for x in signed]
    pairs = {(g, h) for g, h in zip(group, got)}
    assert len(pairs) == len(set(group)) == len(set(got))
