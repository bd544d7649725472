"""Language identification by error-correcting output codes.

Each language has a codeword of +1 and -1; for every bit a binary logistic classifier over hashed byte trigrams of the
lower-cased letters predicts its sign. A text takes the language whose codeword loses least: the sum over bits of
log(1 + exp(-sign * margin)). The score is the softmax of the negative losses; a text is ambiguous where that is under
MIN_SCORE or where the signs lie further from the codeword than the code can correct.

The classifiers are fitted on a bounded sample: at most PER_LANGUAGE whole texts of each language (MOST_ROWS in all), those with
the smallest hashes of doc_id, from a share of the labelled rows that follows from exact counts over all of them.

Defined results: a null text, or one without a letter, is `und` with score 0; where no labelled row can be learned
from, every text is `und`; a single learned language is predicted with score 1; ties go to the smaller language name;
rows whose doc_id is null are predicted but not learned from; repeated rows stay repeated; further columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import byte_rows, pieces

DIMS = 4096
PER_LANGUAGE, MOST_ROWS = 500, 4000
MIN_SCORE = 0.5
STEPS, RATE, DECAY = 300, 2.0, 1e-4
UNKNOWN = "und"

_PLAIN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_ASCII_LETTER = regex.compile(rb"[A-Za-z]")
_LETTER = regex.compile(r"\p{L}")


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or bool(_LETTER.search(bytes(text).decode("utf-8", "replace")))


def trigrams(text: bytes) -> np.ndarray:
    """Counts of the hashed byte trigrams of the whole text; digits and signs count as blanks, runs of blanks as none."""
    b = np.frombuffer(b" " + bytes(text).translate(_PLAIN) + b" ", np.uint8).astype(np.uint32)
    key = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
    key = (key * np.uint32(2654435761)) >> np.uint32(32 - 12)
    counts = np.bincount(key, minlength=DIMS)
    counts[_BLANK] = 0
    return counts


_BLANK = int((np.uint32(0x202020) * np.uint64(2654435761) & np.uint64(0xFFFFFFFF)) >> np.uint64(20))


def features(rows: list) -> np.ndarray:
    """Square roots of the counts, of length one, for each text."""
    x = np.zeros((len(rows), DIMS), np.float32)
    for i, r in enumerate(rows):
        x[i] = trigrams(r)
    np.sqrt(x, out=x)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of signs: the exhaustive code for up to 6 languages, else the best-spread of 100 seeded random codes."""
    if n == 1:
        return np.ones((1, 1), np.float32)
    if n <= 6:
        bits = np.array([[1 if c >> i & 1 else -1 for c in range(1, 1 << (n - 1))] for i in range(n)], np.float32)
        return bits
    draw, best, most = np.random.default_rng(seed), None, -1
    wide = 10 * int(np.ceil(np.log2(n)))
    for _ in range(100):
        code = draw.choice(np.array([-1, 1], np.float32), (n, wide))
        if (np.abs(code.sum(0)) == n).any():
            continue
        apart = (wide - (code @ code.T - 2 * wide * np.eye(n))) / 2
        if (least := apart.min()) > most:
            best, most = code, least
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def predict(self, rows: list) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores and whether each is ambiguous."""
        known = np.array([has_letter(r) for r in rows], bool)
        if not self.languages or not len(rows):
            return [UNKNOWN] * len(rows), np.zeros(len(rows)), np.ones(len(rows), bool)
        margins = features(rows) @ self.weights + self.bias
        loss = np.stack([np.logaddexp(0, -margins * word).sum(1) for word in self.code], 1).astype(np.float64)
        pick = loss.argmin(1)
        odds = np.exp(loss.min(1, keepdims=True) - loss)
        score = np.round(odds.max(1) / odds.sum(1), 6)
        wrong = (np.sign(margins) != self.code[pick]).sum(1)
        reach = (min((a != b).sum() for i, a in enumerate(self.code) for b in self.code[:i]) - 1) // 2 if len(self.code) > 1 else self.code.shape[1]
        ambiguous = (score < MIN_SCORE) | (wrong > reach)
        return [self.languages[p] if k else UNKNOWN for p, k in zip(pick.tolist(), known.tolist())], np.where(known, score, 0.0), ambiguous | ~known


def learnable(doc_id: Column) -> Column:
    """Whether a row may be learned from: crc32 of its doc_id as text, modulo 4, is not 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(False))


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, most_rows: int = MOST_ROWS) -> tuple[list[str], list[bytes]]:
    """(language, sparse trigram counts) of the bounded training sample."""
    rows = docs.where(learnable(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_rows).collect()}
    if not counts:
        return [], []
    each = max(1, min(per_language, most_rows // len(counts)))
    share = F.create_map(*(F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, (1.5 * each + 20) / n))))
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(11)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    chosen = rows.select("lang", "text", place.alias("place"), share[F.col("lang")].alias("share")).where("place < share").select("lang", "text", "place")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            packed = []
            for r in byte_rows(batch.column(1)):
                c = trigrams(r)
                at = np.flatnonzero(c)
                packed.append(at.astype("<u2").tobytes() + np.minimum(c[at], 65535).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(packed, pa.binary())], ["lang", "place", "counts"])

    found = chosen.mapInArrow(count, "lang string, place double, counts binary").orderBy("place", "lang").limit(2 * most_rows + 40 * len(counts)).collect()
    taken: dict[str, int] = {}
    kept = [r for r in found if (taken.update({r["lang"]: taken.get(r["lang"], 0) + 1}) or taken[r["lang"]] <= each)]
    return [r["lang"] for r in kept], [bytes(r["counts"]) for r in kept]


def fit(langs: list[str], counts: list[bytes]) -> Model:
    names = sorted(set(langs))
    code = codewords(len(names)) if names else np.zeros((0, 0), np.float32)
    if len(names) < 2:
        return Model(names, code, np.zeros((DIMS, code.shape[1]), np.float32), np.full(code.shape[1], 30, np.float32))
    x = np.zeros((len(langs), DIMS), np.float32)
    for i, packed in enumerate(counts):
        at, n = np.frombuffer(packed, "<u2").reshape(2, -1)
        x[i, at] = np.sqrt(n)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)
    number = {name: k for k, name in enumerate(names)}
    which = np.array([number[x] for x in langs])
    signs = code[which]
    weight = (1 / np.bincount(which)[which]).astype(np.float32)[:, None]
    weight /= weight.sum()
    w, b = np.zeros((DIMS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb = w.copy(), b.copy()
    for _ in range(STEPS):  # Nesterov's accelerated descent of the mean logistic loss
        ahead, ahead_b = w + 0.9 * vw, b + 0.9 * vb
        pull = -signs * weight / (1 + np.exp(np.clip(signs * (x @ ahead + ahead_b), -30, 30)))
        vw = 0.9 * vw - RATE * (x.T @ pull + DECAY * ahead)
        vb = 0.9 * vb - RATE * pull.sum(0)
        w, b = w + vw, b + vb
    return Model(names, code, w, b)


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs, with lang_pred, score and ambiguous (they replace columns of those names)."""
    docs = docs.drop("lang_pred", "score", "ambiguous")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            langs, scores, flags = model.predict(byte_rows(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(flags, pa.bool_())], [*batch.schema.names, "lang_pred", "score", "ambiguous"])

    return docs.mapInArrow(run, schema_with(docs, "lang_pred string, score double, ambiguous boolean"))


def schema_with(docs: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes), more])


def train(docs: DataFrame, **bounds) -> Model:
    return fit(*sample(docs, **bounds))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predicted(docs.select("doc_id", "text"), train(docs))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")
