"""Each stage of the pipeline against a brute-force version, on its predecessor's output."""

import re

import pytest

import corpus_pipeline
from tallyforge.llm import langid, pieces_bpe
from tests.llm.test_ops import ALNUM, brute_components, near_lines, words

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    from tallyforge.llm.shared import written

    extra = [(10**6, "12 34 !!", "en", "s", 8), (10**6 + 1, None, None, "s", 0), (10**6 + 2, "", "en", "s", 0)]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*COLUMNS).union(spark.createDataFrame(extra, "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF), name))
    return [[r.asDict() for r in d.collect()] for d in out]


def by_id(rows):
    return {r["doc_id"]: r["text"] for r in rows}


def test_language_stage(stages):
    before, after = by_id(stages[0]), by_id(stages[1])
    assert all(re.search(r"[^\W\d_]", t or "") for t in after.values())
    lost = {i for i in before if i not in after and before[i] and re.search(r"[^\W\d_]", before[i])}
    assert len(lost) <= 0.01 * len(before) and all(before[i] == t for i, t in after.items())
    assert langid.MIN_SCORE == 0.5 and 10**6 in before and 10**6 not in after


def test_line_stage(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[1]]
    want = {i: t for (_, i, before), t in near_lines(rows).items() if t.strip() or t == before}
    assert by_id(stages[2]) == want
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2])


def test_jaccard_stage(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[2]]
    want = {i for i, n, c in brute_components(rows, 5, 80) if not n or i == c}
    assert set(by_id(stages[3])) == want and len(stages[3]) == len(want)


def test_decontamination_stage(spark, stages):
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r["text"], ALNUM)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9) if w else 0)}
    sizes = {len(w) for w in windows}

    def hit(text):
        w = words(text, ALNUM)
        return any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))

    assert set(by_id(stages[4])) == {r["doc_id"] for r in stages[3] if not hit(r["text"])}


def test_pieces_stage(stages):
    assert set(by_id(stages[5])) == set(by_id(stages[4])) and len(stages[5]) == len(stages[4])
    encoder = pieces_bpe.Encoder()
    for r in stages[5]:
        assert r["lossless"] and encoder.decode(r["token_ids"]).decode() == r["text"] and r["n_tokens"] == len(r["token_ids"])


def test_columns_keep_their_values(spark):
    """Columns named like those that operators make, null ids, repeated rows and a long text pass the stages unchanged."""
    draw = "the river ran deep and the stone was blue in the light of an old lamp that nobody had seen for years".split()
    texts = [" ".join(draw[(i * k) % len(draw)] + str(i * k % 7) for k in range(60 + i)) for i in range(12)]
    rows = [(i, t, "en", float(-i), i + 1, f"h{i}", [f"x{i}"]) for i, t in enumerate(texts)]
    rows += [(None, texts[2] + " more of it", "en", -50.0, 99, None, None), rows[3], rows[3], (50, " ".join(f"long{k}" for k in range(60000)), None, None, 7, "h", None), (51, None, "en", 1.0, 2, "n", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score double, n_lines bigint, hit_words string, hit_items array<string>").repartition(3)
    want = {(r[0], *r[3:6], tuple(r[6] or ())) for r in rows}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF)
        found = [(r["doc_id"], r["score"], r["n_lines"], r["hit_words"], tuple(r["hit_items"] or ())) for r in docs.collect()]
        assert found and set(found) <= want and docs.columns == ["doc_id", "text", "lang", "score", "n_lines", "hit_words", "hit_items"], name
        assert (50, None, 7, "h", ()) in found


def test_columns_and_empty(spark, stages):
    for rows in stages[:5]:
        assert not rows or list(rows[0]) == COLUMNS
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
