"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties and repeated rows."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import decontaminate, flac, html_text, langid, licenses, line_dedup, lm, ngram_join, pieces_bpe, shared, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SPACED, ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def words(t, pattern=SPACED):
    return re.findall(pattern, lower(t or ""))


def sentence(draw, n):
    return " ".join(draw.choice("the of and river stone Lamp été naïve blue run 42 deep x.y wind-mill zwölf".split()) + draw.choice(["", "s", "ing", str(draw.randrange(40))]) for _ in range(n))


def corpus():
    """Random texts, exact and near copies, shared lines, nulls, empty, blank and long texts, repeated rows and ids."""
    draw = random.Random(3)
    rows = []
    shared_line = sentence(draw, 14)
    for i in range(60):
        lines = [sentence(draw, draw.randrange(1, 30)) for _ in range(draw.randrange(1, 6))]
        if i % 4 == 0:
            lines.insert(draw.randrange(len(lines) + 1), shared_line)
        if i % 9 == 0:
            lines.append(shared_line.replace("the", "THE") + " extra")
        rows.append([i, "\n".join(lines)])
    long = sentence(draw, 400).split()
    for i in range(60, 90):
        w = list(long)
        for _ in range(draw.randrange(0, 14)):
            w[draw.randrange(len(w))] = f"swap{draw.randrange(1000)}"
        rows.append([i, " ".join(w)])
    rows += [[90, None], [91, ""], [92, " \n\t "], [93, "one"], [94, "one"], [95, "One two three"], [96, rows[3][1]], [97, rows[3][1]], [3, rows[3][1]], [None, rows[5][1]], [None, None]]
    rows += [[98, "word " * 20000], [99, "\n".join(["same line of several words here now again and more"] * 50)], [100, "日本語 テキスト ▁ \x00 end\r\nnext"], [101, "x" * 70000]]
    return [(i, t, "en" if i is None or i % 3 else None, "s", len(t or "")) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---- shared


def test_words_match_the_patterns():
    rows = [(t or "").encode() for _, t, *_ in corpus()] + [b"\x00 a\x0bb", "É É".encode()]
    for table, pattern in ((shared.SPACED, SPACED), (shared.ALNUM, ALNUM)):
        w = shared.Words(rows, table)
        found = [x.decode() for x in w.array().to_pylist()]
        for r, a, b in zip(rows, w.firsts, w.firsts[1:]):
            assert found[a:b] == words(r.decode(), pattern)
        h = w.hashes()
        by_word = dict(zip(found, h.tolist()))
        assert all(by_word[x] == y for x, y in zip(found, h.tolist())) and len(set(by_word.values())) == len(by_word)


# ---- 1


def test_warc_round_trip(spark):
    big = "<p>" + "é" * 900 + "</p>"
    rows = [(1, "http://a/\n x", big), (2, None, big), (3, "http://c", "small"), (4, "http://d", "small"), (5, "u", None), (6, "u", ""), (None, "v", big), (2, "again", big), (9, "w", "y" * 400_000), (10, "w", "z" * 999), (11, "w", "z" * 999), (12, "w", "q" * 1000), (13, "w", "q" * 1000)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, digest string, salt int").repartition(2)
    bundles = warc.archive(pages, min_revisit=1000)
    got = sorted((r["page_id"] or -1, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_back(bundles).collect())
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        same = [j for j, _, g in rows if (g or "").encode() == p]
        top = max((j for j in same if j is not None), default=None) if len(p) >= 1000 else None
        want.append((i or -1, len(p), hashlib.sha1(p).hexdigest(), "revisit" if top is not None and i != top else "response", top if top is not None and i != top else None))
    assert got == sorted(want)
    every = [e["record_id"] for b in bundles.collect() for e in b["records"]]
    assert len(set(every)) == len(rows)  # also of rows whose page_id repeats or is null
    found = warc.looked_up(bundles, every[:3]).collect()
    assert sorted(r["record_id"] for r in found) == sorted(every[:3]) and all(r["headers"]["warc-record-id"] == f"<{r['record_id']}>" for r in found)
    responses = {f"<{e['record_id']}>" for b in bundles.collect() for e in b["records"] if warc.read_one(bytes(b["bundle"]), e["frame"], e["offset"])[0]["warc-type"] == "response"}
    for b in bundles.collect():
        for e in b["records"]:
            to = warc.read_one(bytes(b["bundle"]), e["frame"], e["offset"])[0].get("warc-refers-to")
            assert to is None or to in responses
            heads, _ = warc.read_one(bytes(b["bundle"]), e["frame"], e["offset"])
            assert heads["warc-record-id"] == f"<{e['record_id']}>"
            assert len(base64.b32decode(heads["warc-payload-digest"][5:])) == 20
    assert warc.read_back(warc.archive(pages.limit(0))).count() == 0


# ---- 2


def near_lines(rows):
    """The rule itself: equal words, or one word edit in lines of 8 words or more, to any earlier line."""

    def one_edit(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        if len(a) > len(b):
            a, b = b, a
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    order = sorted({(i is None, i or 0, t) for i, t, *_ in rows if t})
    seen, kinds, out = [], {}, {}
    for none, i, t in order:
        kept = []
        for line in t.split("\n"):
            w = tuple(words(line, ALNUM))
            if len(w) >= 3:
                if w in kinds:
                    continue
                near = len(w) >= 8 and any(len(x) >= 8 and one_edit(w, x) for x in seen)
                kinds[w] = near
                seen.append(w)
                if near:
                    continue
            kept.append(line)
        out[none, i, t] = "\n".join(kept)
    return out


def test_line_dedup(docs, empty):
    clash = docs.withColumns({"key": F.lit(1), "line": F.lit("x"), "lines": F.lit(2), "n_near": F.lit(7)})
    got = [(r["doc_id"] is None, r["doc_id"] or 0, r["before"], r["text"]) for r in line_dedup.deduplicated(clash.withColumn("before", F.col("text"))).collect()]
    rows = corpus()
    want = near_lines(rows)
    # rows of equal doc_id and text are one document; lines that repeat between documents of one id go by the order of a hash
    ids = Counter(i for i, *_ in rows)
    assert len(got) == len(rows)
    for none, i, before, after in got:
        if not before:
            assert after == before
        elif ids[None if none else i] == 1:
            assert after == want[none, i, before], i
    assert line_dedup.deduplicated(empty).count() == 0


def test_line_dedup_hot_group(spark):
    """An early line two edits from a hot group, which shares a key of one word less with it, displaces no true partner."""
    eight = " ".join(f"w{k}" for k in range(1, 9))
    lines = [f"x {eight}", f"q {eight}", *(f"{eight} {k}" for k in range(40)), f"{eight} 7 more", f"a b {eight}"]
    rows = [(i, t) for i, t in enumerate(lines)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: t for (_, i, _), t in near_lines(rows).items()}
    assert [i for i, t in got.items() if t] and not any(got[i] for i in range(3, 42))


def test_edit_distance_bound():
    for a, b, near in (([1, 2, 3], [1, 2, 3], 1), ([1, 2, 3], [1, 9, 3], 1), ([1, 2, 3], [1, 3], 1), ([1, 2], [2, 1], 0), ([1, 1, 2], [1, 2, 2], 1), ([], [1], 1), ([1, 2, 3, 4], [2, 3, 4, 5], 0)):
        assert line_dedup.within(np.array(a), np.array(b)) == bool(near)


# ---- 3


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.9])
def test_pieces_decode_losslessly(docs, dropout):
    encoder = pieces_bpe.Encoder(dropout=dropout)
    clash = docs.withColumns({"token_ids": F.lit("x"), "lossless": F.lit(1)})
    rows = pieces_bpe.decoded(pieces_bpe.encoded(clash, encoder), encoder).collect()
    assert sorted(map(repr, pieces_bpe.round_trip(clash, encoder).collect())) == sorted(map(repr, rows))
    assert pieces_bpe.round_trip(docs.limit(0), encoder).count() == 0
    assert len(rows) == len(corpus()) and all(r["lossless"] for r in rows)
    assert all((r["n_tokens"] == 0) == (not r["text"]) for r in rows)


def test_pieces_without_dropout_are_the_models(docs):
    import sentencepiece

    model, encoder = sentencepiece.SentencePieceProcessor(model_file=pieces_bpe.MODEL), pieces_bpe.Encoder(dropout=0.0)
    texts = [t for _, t, *_ in corpus() if t and "▁" not in t and "\x00" not in t]
    ids, firsts = encoder.encode_rows([t.encode() for t in texts])
    for t, a, b in zip(texts, firsts, firsts[1:]):
        assert ids[a:b].tolist() == model.encode(t)


def test_merges_in_step_equal_the_agenda():
    encoder = pieces_bpe.Encoder(dropout=0.3)
    units = sorted({w.encode() for _, t, *_ in corpus() for w in (" " + (t or "")[:300]).split("\n") for w in re.findall(r" ?\S{1,25}", w) if 0 < len(w.encode()) <= 32})[:400]
    pairs = [(u, v) for u in units for v in range(4)]
    assert encoder._together([u for u, _ in pairs], np.array([v for _, v in pairs]), 32) == [np.array(encoder.agenda(u, v), np.int32).tobytes() for u, v in pairs]
    assert encoder._small("▁windmills", 5) == encoder._large("▁windmills", 5)
    assert len({encoder.agenda(b" interesting", v).__repr__() for v in range(4)}) > 1
    other = pieces_bpe.Encoder(dropout=0.3, seed=2)
    assert any(other.agenda(u, 0) != encoder.agenda(u, 0) for u in units)


# ---- 4


def brute_components(rows, size, percent):
    sets = []
    for _, t, *_ in rows:
        w = words(t)
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                top[find(a)] = find(b)
    ids = {}
    for k, (i, *_) in enumerate(rows):
        ids.setdefault(find(k), []).append(i)
    return [(i, len(sets[k]), min((x for x in ids[find(k)] if x is not None), default=None)) for k, (i, *_) in enumerate(rows)]


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80)])
def test_ngram_components(docs, size, percent):
    clash = docs.withColumns({"node": F.lit(1), "n": F.lit("x"), "label": F.lit(2)})
    got = [(r["doc_id"], r["n"], r["component_id"]) for r in ngram_join.linked(clash, size, percent).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(brute_components(corpus(), size, percent), key=key)


@pytest.mark.parametrize("rounds", [0, 1])
def test_ngram_tiles_and_bounds(spark, monkeypatch, rounds):
    """Without the rounds that test one partner each, the tiles alone find all links, also of groups of several tiles."""
    monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
    monkeypatch.setattr(ngram_join, "TILE", 4)
    monkeypatch.setattr(ngram_join, "GROUP", 3)
    rows = [r for r in corpus() if r[1] and len(r[1]) < 5000][:110]
    got = ngram_join.linked(spark.createDataFrame(rows, DOCS), 4, 85).select("doc_id", "component_id").collect()
    want = {(i, c) for i, _, c in brute_components(rows, 4, 85)}
    assert {tuple(r) for r in got} == want
    draw = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(draw.integers(0, 400, draw.integers(1, 300)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        x, y = (np.frombuffer(ngram_join.bitmap(v), np.uint8) for v in (a, b))
        wide = min(len(x), len(y))
        assert ngram_join.most_overlap(len(a), ngram_join.folded(x, wide), len(b), ngram_join.folded(y, wide)) >= len(np.intersect1d(a, b))


def test_one_of_each(docs, empty):
    kept = [r["doc_id"] for r in ngram_join.one_of_each(docs, 4, 85).select("doc_id").collect()]
    want = Counter({c for _, n, c in brute_components(corpus(), 4, 85) if n} | {i for i, n, _ in brute_components(corpus(), 4, 85) if not n})
    assert Counter(kept) == want
    assert ngram_join.linked(empty).count() == 0


# ---- 5


def test_fm_index_equals_search():
    draw = np.random.default_rng(2)
    for _ in range(15):
        docs_ = [draw.integers(1, 5, draw.integers(0, 60)) for _ in range(12)]
        docs_ += [docs_[0], docs_[0]]
        seq = np.concatenate([np.append(d, 0) for d in docs_]).astype(np.int32)
        index = decontaminate.FMIndex(seq, 5, sample=7)
        phrases = draw.integers(1, 5, (40, 3))
        low, high = index.search(phrases)
        for p, a, b in zip(phrases, low, high):
            want = [k for k in range(len(seq) - 2) if (seq[k : k + 3] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_decontamination(spark, docs, empty):
    rows = corpus()
    w = rows[70][1].split()
    items = [(1, " ".join(w[5:30])), (2, "One TWO three"), (2, "one"), (3, None), (4, "---"), (None, " ".join(w[100:115])), (5, "nowhere to be found at all in these texts my dear friend"), (1, " ".join(w[5:30]))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for most in (decontaminate.MOST_PHRASE_BYTES, 60):
        got = decontaminate.located(docs.withColumn("hit_words", F.lit("clash")), bench, most_bytes=most).collect()
        assert len(got) == len(rows)
        for r in got:
            own = words(r["text"], ALNUM)
            hit, found = set(), set()
            for i, t in items:
                iw = words(t, ALNUM)
                for k in range(max(1, len(iw) - 9) if iw else 0):
                    win = iw[k : k + 10]
                    for j in range(len(own) - len(win) + 1):
                        if own[j : j + len(win)] == win:
                            hit |= set(range(j, j + len(win)))
                            found.add(i)
            assert (r["all_words"], r["hit_words"], r["hit_items"]) == (len(own), len(hit), sorted(str(x) for x in found if x is not None))
            assert sum(s["behind"] - s["first"] for s in r["hit_spans"]) == len(hit)
            if hit:
                rest = decontaminate.without_spans(r["text"], [(s["first"], s["behind"]) for s in r["hit_spans"]])
                assert words(rest, ALNUM) == [x for k, x in enumerate(own) if k not in hit]
    clean = {(r["doc_id"], r["before"], r["hit_spans"]): r["text"] for r in decontaminate.cleaned(docs.withColumns({"before": F.col("text"), "hit_spans": F.lit("own")}), bench).collect()}
    for r in got:
        want = decontaminate.without_spans(r["text"], [(s["first"], s["behind"]) for s in r["hit_spans"]]) if r["hit_spans"] else r["text"]
        assert clean[r["doc_id"], r["text"], "own"] == want
    assert decontaminate.located(empty, bench).count() == 0
    assert not decontaminate.located(docs, bench.limit(0)).where("hit_words > 0").count()


# ---- 6


def test_language_id(spark, docs, empty):
    found = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.train(found)
    rows = langid.predicted(found, model).where(~langid.learnable(F.col("doc_id"))).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows) > 20
    odd = langid.predicted(docs.withColumn("score", F.lit("clash")), model).collect()
    for r in odd:
        none = not any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == none and 0 <= r["score"] <= 1 and (not none or r["score"] == 0)
    assert langid.predicted(empty, model).count() == 0
    assert {r["lang_pred"] for r in langid.predicted(docs, langid.train(empty)).collect()} == {"und"}
    single = langid.train(docs)
    assert {r["lang_pred"] for r in langid.predicted(docs, single).collect()} == {"und", "en"}


def test_codewords_differ():
    for n in (2, 3, 4, 6, 7, 30):
        code = langid.codewords(n)
        assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= (1 if n == 2 else 2)


# ---- 7


def test_licenses(spark, empty):
    texts = ["Under the MIT License. MIT license!", "x\ngnu General\nPublic license", "Licensed under CC BY-NC 4.0.", None, "", "released under the mit licence", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "cc by cc by", "apache license " * 5000,
             "x " * 45 + "\n# Permission is hereby granted, free of charge, to any person obtaining\n#   a copy of this software and associated\n * documentation files" + " y" * 70, "this program\n\nis free " + "z " * 40 + "software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"]
    rows = {r["doc_id"]: r for r in licenses.scanned(spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)], "doc_id bigint, text string, held string")).collect()}
    for i, t in enumerate(texts):
        w = words(t, ALNUM)
        at = [(k, label) for p, label in licenses.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = rows[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(at))
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in at}))
        more = {label for label, x in licenses.TEMPLATES for k in range(0, len(w), 32) if 100 * len(set(x.split()) & set(w[k : k + 64])) >= 90 * len(set(x.split()))}
        assert r["labels"] == ",".join(sorted({label for _, label in at} | more))
    assert rows[9]["labels"] == "mit" and rows[9]["score"] > 0.99  # a notice wrapped over commented lines
    again = licenses.scanned(spark.createDataFrame([(1, texts[9]), (1, texts[9]), (None, texts[9])], "doc_id bigint, text string")).collect()
    assert [r["labels"] for r in again] == ["mit"] * 3
    assert licenses.scanned(empty).count() == 0


# ---- 8


def test_flac_round_trip(docs, empty):
    rows = flac.summaries(flac.encode_column(docs, "text", ["doc_id"])).collect()
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows)
    want = []
    for i, t, *_ in corpus():
        p = flac.payload((t or "").encode())
        assert len(p) % 576 == 0 and p.startswith((t or "").encode())
        want.append((i is None, i or 0, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert got == sorted(want)
    assert flac.encode_column(empty, "text", ["doc_id"]).count() == 0


def test_flac_streams():
    draw = np.random.default_rng(4)
    smooth = (100 * np.sin(np.arange(576 * 6) / 9) + draw.normal(0, 3, 576 * 6)).astype(np.int8)
    loads = [(smooth.view(np.uint8) ^ 0x80).tobytes(), bytes(576), draw.integers(0, 256, 576 * 300, np.uint8).tobytes(), (b"abc " * 144) * 2]
    streams = flac.encode_payloads(loads)
    assert len(streams[0]) < 0.8 * len(loads[0]) and {s[4 + 4 + 34] >> 7 for s in streams} == {1}
    for s, p in zip(streams, loads):
        at, size = 4 + 38, int.from_bytes(s[43:46], "big")
        bare = s[:4] + bytes((s[4] | 0x80,)) + s[5:at] + s[at + 4 + size :]  # the same stream without seek points
        for stream in (s, bare):
            ((rate, bits, x, blocks),) = flac.decode_streams([stream])
            assert (rate, bits, len(blocks)) == (8000, 8, len(p) // 576)
            assert (x.astype(np.int8).view(np.uint8) ^ 0x80).tobytes() == p
    broken = bytearray(streams[0])
    broken[-40] ^= 4
    with pytest.raises(ValueError, match="differ|past|reserved|frame"):
        flac.decode_streams([bytes(broken)])


def test_flac_seeks_and_misleading_samples():
    """Any span of samples is read from its seek point on; samples that look like the next frame's header mislead nothing."""
    draw = np.random.default_rng(6)
    load = bytearray(draw.integers(0, 256, 576 * 50, np.uint8).tobytes())
    for k in (2, 20, 40):
        load[576 * k + 100 : 576 * k + 100 + len(flac.frame_header(k + 1))] = bytes(b ^ 0x80 for b in flac.frame_header(k + 1))
    plain = (np.arange(576 * 40) % 97).astype(np.uint8).tobytes()
    streams = flac.encode_payloads([bytes(load), plain, b"\xff" * 576])
    assert [int.from_bytes(s[43:46], "big") // 18 for s in streams] == [4, 3, 1]
    for s, p, got in zip(streams, (bytes(load), plain, b"\xff" * 576), flac.decode_streams(streams)):
        want = np.frombuffer(p, np.uint8).astype(np.int64) - 128
        assert (got[2] == want).all() and [f for f, _ in got[3]] == list(range(0, len(p), 576))
        for first, count in ((0, 1), (575, 2), (9216, 576), (12_000, 5000), (len(p) - 1, 10), (len(p), 4), (0, len(p))):
            assert flac.samples_at(s, first, count).tolist() == want[first : first + count].tolist()


def bits_of(*fields):
    out = "".join(format(v & (1 << n) - 1, f"0{n}b") if n else "" for v, n in fields)
    return bytes(int(out[k : k + 8].ljust(8, "0"), 2) for k in range(0, len(out), 8))


def stream_of(bodies, size, bits):
    frames = []
    for k, body in enumerate(bodies):
        code = {8: 1, 12: 2, 16: 4}[bits]
        head = bytes((0xFF, 0xF8, 0x70, code << 1)) + flac.coded_number(k) + (size - 1).to_bytes(2, "big")
        frame = head + bytes((flac.crc8(head),)) + body
        frames.append(frame + int(flac.crc16_rows([frame])[0]).to_bytes(2, "big"))
    about = size.to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | (bits - 1) << 36 | size * len(bodies)).to_bytes(8, "big") + bytes(16)
    return b"fLaC" + b"\x80" + (34).to_bytes(3, "big") + about + b"".join(frames)


def test_flac_decodes_other_encoders_frames():
    """Hand-made frames: wasted bits, a predictor of order 2, Rice partitions, an escaped partition, a long run of zeros."""
    zig = lambda r: r << 1 if r >= 0 else -(r << 1) - 1
    rice = lambda r, k: [(0, zig(r) >> k), (1, 1), (zig(r) & (1 << k) - 1, k)]
    verbatim = bits_of((1 << 1, 8), *((v, 16) for v in (5, -6, 700, -800, 9, 10, -11, 12)))
    wasted = bits_of((1 << 1 | 1, 8), (1, 2), *((v, 14) for v in (1, -2, 3, -4, 5, -6, 7, -8)))
    x = [10, 20, 31, 41, 50, 61, 500, -30]
    r = [x[i] - (2 * x[i - 1] - x[i - 2]) for i in range(2, 8)]
    parts = [(0, 2), (1, 4), (1, 4), *sum((rice(v, 1) for v in r[:2]), []), (15, 4), (11, 5), *((v, 11) for v in r[2:])]
    fixed = bits_of((10 << 1, 8), (x[0], 16), (x[1], 16), *parts)
    lpc_r = [x[i] - (((3 * x[i - 1] + -1 * x[i - 2])) >> 1) for i in range(2, 8)]
    lpc = bits_of((33 << 1, 8), (x[0], 16), (x[1], 16), (3, 4), (1, 5), (3, 4), (-1, 4), (1, 2), (0, 4), (2, 5), *sum((rice(v, 2) for v in lpc_r), []))
    ((_, bits, got, blocks),) = flac.decode_streams([stream_of([verbatim, wasted, fixed, lpc], 8, 16)])
    assert bits == 16 and [f for f, _ in blocks] == [0, 8, 16, 24]
    assert got.tolist() == [5, -6, 700, -800, 9, 10, -11, 12, 4, -8, 12, -16, 20, -24, 28, -32, *x, *x]


def test_pcm_blocks(docs):
    media = flac.encode_column(docs.where("doc_id = 98"), "text", ["doc_id"])
    rows = flac.pcm_blocks(media, "media", ["doc_id"]).orderBy("sample_offset").collect()
    assert [r["sample_offset"] for r in rows] == [576 * k for k in range(len(rows))]
    raw = b"".join(bytes(r["pcm"]) for r in rows)
    assert bytes(b ^ 0x80 for b in raw) == flac.payload(("word " * 20000).encode())


# ---- 9


def test_lm_scores(docs, empty):
    rows = corpus()
    learn = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 != 1
    counts = Counter()
    for i, t, *_ in rows:
        if learn(i):
            counts.update(words(t))
            counts["\0end"] += 1
    n, v = sum(counts.values()), len(counts)
    for heavy in (lm.HEAVY, 30):
        got = lm.scored(docs, lm.bucket(F.col("doc_id"), 5) != 1, heavy=heavy).collect()
        want = []
        for i, t, *_ in rows:
            w = [*words(t), "\0end"]
            want.append((i is None, i or 0, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 4)))
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == sorted(want)
        assert all(r["score"] < 0 for r in got)
    assert lm.scored(empty, F.lit(True)).count() == 0
    assert {r["base_score"] for r in lm.scored(docs.where("doc_id = 93"), F.lit(False)).collect()} == {0.0}


def test_lm_probabilities_sum_to_one():
    draw = np.random.default_rng(0)
    model = lm.train([bytes(draw.integers(2, 12, 60).astype(np.uint8)) for _ in range(20)], 12)
    for one in range(3):
        logs = [model.scores(np.array([one + 2, k], np.uint8), np.array([0, 2]))[1] for k in range(12)]
        assert sum(10**x for x in logs) == pytest.approx(1, abs=1e-5)


def test_lm_fits_on_all_documents(spark):
    """The model's evidence has every training document's transitions, far more documents than any sample would hold."""
    texts = [None, "", *(f"a b w{i % 7} a" for i in range(4000))]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    lex = lm.lexicon(lm.word_counts(docs.fillna("")), len(texts))
    assert len(lex.hashes) == 9
    got = {r["code"]: r["c"] for r in lm.transitions(docs, lex).collect()}
    want = Counter()
    for t in texts:
        w = [lm.END, lm.END, *(int(lex.classed(shared.Words([x.encode()], shared.SPACED).hashes())[0][0]) for x in words(t)), lm.END]
        want.update(w[k - 1] << 16 | w[k - 2] << 8 | w[k] for k in range(2, len(w)))
    assert got == want and sum(got.values()) == 5 * 4000 + 2
    found = lm.fit(np.array(list(got)), np.array(list(got.values())), lm.FIRST + lm.OWN + lm.BINS)
    a, b = (int(lex.classed(shared.Words([x], shared.SPACED).hashes())[0][0]) for x in (b"a", b"b"))
    assert 10 ** found.scores(np.array([a, b], np.uint8), np.array([0, 2]))[1] > 0.9


# ---- 10


CASES = [
    ("", ""), ("plain  text", "plain text"), ("<p>a<p>b", "a\n\nb"), ("a<br>b<br/>c", "a\nb\nc"), ("<ul><li>a<li>b<ul><li>c</ul></ul>", "- a\n- b\n  - c"),
    ("<ol start=3><li>x</li><li value=9>y<li>z</ol>", "3. x\n9. y\n10. z"), ("<table><tr><th>k<th>v<tr><td>long key<td>1</table>", "k         v\nlong key  1"),
    ("<script>x<y</script>seen<style>p{}</style><!-- no --><noscript>no</noscript>", "seen"), ("<div hidden>no</div><div>yes</div><p style='display:none'>no", "yes"),
    ("<span style=\"visibility: hidden\">no</span>a &amp; b&nbsp;c", "a & b\xa0c"), ("<pre> x\n  y </pre>", " x\n  y"), ("<h1>T</h1>text<h2>U</h2>", "T\n\ntext\n\nU"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"), ("<b>bo</b>ld <i>it</i>", "bold it"), ("<title>no</title><body>yes", "yes"), ("<a href='x>y'>link</a>", "link"), ("a < b", "a < b"),
    ("<table><tr><td colspan=2>wide<tr><td>a<td>b</table>", "wide\na  b"), ("<select><option>o<option>p</select>", "o\np"), ("unclosed <b>x", "unclosed x"), ("<!-- open", ""),
    ("a <svg><title>t</title><defs><text>no</text></defs><text>chart label</text><path d='M0'/><text>two</text></svg> b", "a chart label two b"),
    ("<p><math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math>", "x=2"), ("<svg/>after<p>b", "after\n\nb"),
    ("<div>" * 250 + "in<div hidden>no<b>no</b></div>out" + "</div>" * 250 + "end", "inout\nend"), ("<div>" * 190 + "<div hidden>" + "<div>" * 30 + "no</div></div>no" + "</div>" * 219 + "yes", "yes"),
]


@pytest.mark.parametrize(("page", "text"), CASES)
def test_html(page, text):
    assert html_text.visible_text(page) == text


@pytest.mark.parametrize("quote", ['"', "'"])
def test_html_long_quotes(quote):
    state = "a > b " * 9000
    assert html_text.visible_text(f"<div data-x={quote}{state}{quote} hidden>no</div><p>yes") == "yes"
    assert html_text.visible_text(f"<div title={quote}{state}>yes") == ("a > b " * 8999 + "a > b >yes").split(">", 1)[1].strip()


def test_html_deep_and_long(spark):
    deep = "<div>" * 3000 + "core" + "</div>" * 3000
    rows = spark.createDataFrame([(1, deep), (2, None), (3, "<p>" + "w " * 50000), (3, "<p>x")], "page_id bigint, html string")
    got = sorted((r["page_id"], len(r["visible_text"]), r["visible_text"][:4]) for r in html_text.extracted(rows, "html", ["page_id"]).collect())
    assert got == [(1, 4, "core"), (2, 0, ""), (3, 1, "x"), (3, 99999, "w w ")]


def test_html_keeps_all_words(spark):
    """Every word of the markup's own text comes out, once and in order, for tags that hide and move nothing."""
    draw = random.Random(1)
    for _ in range(200):
        parts, want = [], []
        for _ in range(draw.randrange(1, 30)):
            kind = draw.choice(["p", "b", "ul", "div", "br", "text", "table", "/"])
            if kind == "text":
                w = f"w{draw.randrange(1000)}"
                parts.append(f" {w} ")
                want.append(w)
            elif kind == "table":
                a, b = f"c{draw.randrange(1000)}", f"d{draw.randrange(1000)}"
                parts.append(f"<table><tr><td>{a}<td>{b}</table>")
                want += [a, b]
            elif kind == "ul":
                a = f"l{draw.randrange(1000)}"
                parts.append(f"<ul><li>{a}</ul>")
                want.append(a)
            else:
                parts.append(f"<{kind}>" if kind != "/" else draw.choice(["</p>", "</b>", "</div>"]))
        found = [w for w in html_text.visible_text("".join(parts)).split() if w != "-"]
        assert found == want
