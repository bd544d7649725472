"""A log-bilinear language model, trained in numpy by noise-contrastive estimation, and its scores of all texts.

Counts of all words come from every training document. The words seen most (at most HEAVY of them) travel to the tasks;
all others meet their counts in a shuffle join, so the tables in memory are bounded and the result exact.

A token's probability is that of its class given the two classes before it, times that of the token in its class. The
most frequent OWN words are classes of their own, the further heavy words fall into BINS classes of equal weight, all
rarer and unseen words share one, and the end of a text is one. The class model predicts the next class's vector as the
sum of its context's vectors, each times a matrix of its place (log-bilinear); batched matrix products over all
classes normalise it. In a class, a word has its share of the training tokens, smoothed by one half in the rare class, where
one share is kept for what was never seen: the probabilities of all tokens sum to one.

The class model is fitted on how often each class follows each two classes, counted over all training documents: each
task counts its own, sums meet by a shuffle, and the driver gets at most a row for each of 256**3 triples.

Defined results: a null text is empty and has its end as only token; rows whose doc_id is null are scored, not learned
from; with nothing to learn from, the base score is 0; repeated rows stay repeated; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SPACED, Words, byte_rows, pieces, written

HEAVY = 200_000
OWN, BINS = 190, 64
END, RARE, FIRST = 0, 1, 2
WIDTH, NOISE, BATCH, EPOCHS, RATE = 24, 10, 2048, 3, 0.15
#: Steps of a fit at least, of BATCH contexts each.
STEPS = 600
#: Words that a task holds before it passes their counts on.
HELD = 1_000_000


def bucket(doc_id: Column, modulus: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def word_counts(texts: DataFrame) -> DataFrame:
    """(h, c): the hash of each word and how often it occurs in the column `text`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            h, c = np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held])
            words, place = np.unique(h, return_inverse=True)
            sums = np.bincount(place, c).astype(np.int64)
            held[:] = [(words, sums)]
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(sums)], ["h", "c"])

        for batch in pieces(batches, "text"):
            held.append(np.unique(Words(byte_rows(batch.column(0)), SPACED).hashes(), return_counts=True))
            size += len(held[-1][0])
            if size > 2 * HELD:
                table = out()
                size = table.num_rows
                if size > HELD:
                    yield table
                    held.clear()
                    size = 0
        if held:
            yield out()

    return texts.select("text").mapInArrow(run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


@dataclass
class Lexicon:
    """The heavy words: sorted hashes, classes, logarithms (base 10) of shares in their classes, and counts."""

    hashes: np.ndarray
    classes: np.ndarray
    inside: np.ndarray
    counts: np.ndarray
    tokens: int
    distinct: int
    docs: int
    rare_tokens: int
    rare_distinct: int
    below: int

    def classed(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class of each hash, and its place among the heavy words (-1: none)."""
        if not len(self.hashes):
            return np.full(len(h), RARE, np.uint8), np.full(len(h), -1, np.int64)
        place = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        place = np.where(self.hashes[place] == h, place, -1)
        return np.where(place >= 0, self.classes[place], RARE).astype(np.uint8), place

    @property
    def base(self) -> float:
        return float(np.log10(self.tokens + 0.5 * (self.distinct + 1)))

    @property
    def rare(self) -> float:
        return float(np.log10(self.rare_tokens + 0.5 * (self.rare_distinct + 1)))


def lexicon(counts: DataFrame, docs: int, heavy: int = HEAVY) -> Lexicon:
    """Words are heavy from the least count on at which at most `heavy` words are."""
    step = F.floor(F.log2("c") * 4).cast("int")
    bins = sorted(((r["b"], r["n"], r["least"]) for r in counts.groupBy(step.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least")).collect()), reverse=True)
    below, taken = 1 << 62, 0
    for _, n, least in bins:
        if taken + n > heavy:
            break
        below, taken = least, taken + n
    total = counts.agg(F.sum("c").alias("t"), F.count(F.lit(1)).alias("v")).first()
    table = counts.where(F.col("c") >= below).toArrow() if taken else pa.table({"h": pa.array([], pa.int64()), "c": pa.array([], pa.int64())})
    h, c = table["h"].to_numpy().astype(np.int64).view(np.uint64), table["c"].to_numpy().astype(np.int64)
    order = np.lexsort((h, -c))
    h, c = h[order], c[order]
    classes = np.arange(len(h)) + FIRST
    rest = c[OWN:]
    if len(rest):
        before = np.cumsum(rest) - rest
        classes[OWN:] = FIRST + OWN + np.minimum(before * BINS // rest.sum(), BINS - 1)
    sums = np.bincount(classes, c, minlength=1)
    inside = np.log10(c / sums[classes]) if len(c) else np.zeros(0)
    by_hash = np.argsort(h)
    tokens, distinct = int(total["t"] or 0), int(total["v"])
    return Lexicon(h[by_hash], classes[by_hash].astype(np.uint8), inside[by_hash], c[by_hash], tokens + docs, distinct + (docs > 0), docs, tokens - int(c.sum()), distinct - len(c), below)


def with_ends(classes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes with an END behind each text, and where each text begins (one more at the end)."""
    n = len(firsts) - 1
    out = np.full(len(classes) + n, END, np.uint8)
    out[np.arange(len(classes)) + np.repeat(np.arange(n), np.diff(firsts))] = classes
    return out, firsts + np.arange(n + 1)


def contexts(classes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class before, and the one before that; END stands before a text's first."""
    one = np.concatenate(([END], classes[:-1])) if len(classes) else classes
    two = np.concatenate(([END, END], classes[:-2]))[: len(classes)]
    second = starts[:-1] + 1
    two = two.copy()
    two[second[second < len(classes)]] = END
    two[starts[:-1][starts[:-1] < len(classes)]] = END
    return one, two


@dataclass
class LogBilinear:
    near: np.ndarray  # the context vectors times their place's matrix
    far: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def scores(self, classes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """log10 of each class's normalised probability in its context."""
        one, two = contexts(classes, starts)
        codes, place = np.unique(one.astype(np.int32) << 8 | two, return_inverse=True)
        guess = self.near[codes >> 8] + self.far[codes & 255]
        whole = np.empty(len(codes), np.float64)
        for k in range(0, len(codes), 8192):
            logits = guess[k : k + 8192] @ self.out.T + self.bias
            top = logits.max(1, keepdims=True)
            whole[k : k + 8192] = np.log(np.exp(logits - top).sum(1, dtype=np.float64)) + top[:, 0]
        raw = np.einsum("ij,ij->i", guess[place], self.out[classes]) + self.bias[classes]
        return (raw - whole[place]) / np.log(10)


def fit(codes: np.ndarray, times: np.ndarray, size: int, seed: int = 5) -> LogBilinear:
    """Noise-contrastive estimation by Adagrad on how often (`times`) each class stands in each context.

    A code is (class before, class before that, class), 8 bits each. The NOISE draws for each token are taken in
    expectation over the classes' frequencies instead of by lot, so a step covers all tokens of its contexts.
    """
    draw = np.random.default_rng(seed)
    order = np.argsort(codes, kind="stable")
    codes, times = codes[order], times[order].astype(np.float64)
    seen = np.bincount(codes & 255, times, minlength=size) + 0.5
    noise = seen / seen.sum()
    p = {"r": draw.normal(0, 0.1, (size, WIDTH)), "q": draw.normal(0, 0.1, (size, WIDTH)), "b": np.log(noise), "c1": np.eye(WIDTH) * 0.7, "c2": np.eye(WIDTH) * 0.3}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    if len(codes):
        places, firsts = np.unique(codes >> 8, return_index=True)
        cuts = np.append(firsts, len(codes))
        log_noise, k_noise = np.log(NOISE * noise).astype(np.float32), (NOISE * noise).astype(np.float32)
        square = {k: np.full_like(v, 1e-3) for k, v in p.items()}
        steps = -(-len(places) // BATCH)
        for _ in range(max(EPOCHS, -(-STEPS // steps))):
            shuffled = draw.permutation(len(places))
            for at in range(0, len(places), BATCH):
                pick = shuffled[at : at + BATCH]
                a, b, n = places[pick] >> 8, places[pick] & 255, cuts[pick + 1] - cuts[pick]
                row = np.repeat(np.arange(len(pick)), n)
                cell = np.arange(len(row)) + np.repeat(cuts[pick] - (np.cumsum(n) - n), n)
                held = np.zeros((len(pick), size), np.float32)
                held[row, codes[cell] & 255] = times[cell]
                tokens = held.sum(1, keepdims=True)
                guess = p["r"][a] @ p["c1"] + p["r"][b] @ p["c2"]
                raw = guess @ p["q"].T + p["b"] - log_noise
                pull = ((held + tokens * k_noise) / (1 + np.exp(-np.clip(raw, -30, 30))) - held) / tokens.sum()
                d_guess = pull @ p["q"]
                grads = {"q": pull.T @ guess, "b": pull.sum(0), "c1": p["r"][a].T @ d_guess, "c2": p["r"][b].T @ d_guess}
                d_r = np.zeros_like(p["r"])
                np.add.at(d_r, a, d_guess @ p["c1"].T)
                np.add.at(d_r, b, d_guess @ p["c2"].T)
                grads["r"] = d_r
                for k, g in grads.items():
                    square[k] += g * g
                    p[k] -= RATE * g / np.sqrt(square[k])
    return LogBilinear(p["r"] @ p["c1"], p["r"] @ p["c2"], p["q"], p["b"])


def coded(classes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The code of each token and end: its context and its class."""
    ended, starts = with_ends(classes, firsts)
    one, two = contexts(ended, starts)
    return one.astype(np.int32) << 16 | two.astype(np.int32) << 8 | ended


def train(sequences: list[bytes], size: int, seed: int = 5) -> LogBilinear:
    """The model fitted on whole class sequences."""
    firsts = np.concatenate(([0], np.cumsum([len(s) for s in sequences]))).astype(np.int64)
    return fit(*np.unique(coded(np.frombuffer(b"".join(sequences), np.uint8), firsts), return_counts=True), size, seed)


def transitions(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """(code, c): how often each class stands in each context, over all of `docs`."""
    sent = docs.sparkSession.sparkContext.broadcast(lex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, counts = sent.value, None
        for batch in pieces(batches, "text"):
            words = Words(byte_rows(batch.column(0)), SPACED)
            counts = np.zeros(1 << 24, np.int64) if counts is None else counts
            np.add.at(counts, coded(lex.classed(words.hashes())[0], words.firsts), 1)
        for low in range(0, 0 if counts is None else len(counts), HELD):
            found = np.flatnonzero(counts[low : low + HELD])
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array((found + low).astype(np.int32)), pa.array(counts[low : low + HELD][found])], ["code", "c"])

    return docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "code int, c bigint").groupBy("code").agg(F.sum("c").alias("c"))


def scored(docs: DataFrame, learn: Column, heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row; `learn` says which rows are learned from."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    training = docs.where("learn")
    counts = written(word_counts(training), "lm-counts")
    lex = lexicon(counts, training.count(), heavy)
    found = transitions(training, lex).toArrow()  # at most a row for each of 256**3 codes
    model = fit(found["code"].to_numpy().astype(np.int32), found["c"].to_numpy().astype(np.int64), FIRST + OWN + BINS)
    sent = spark.sparkContext.broadcast((lex, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, model = sent.value
        heavy_base = np.log10(lex.counts + 0.5) - lex.base
        end_base = float(np.log10(lex.docs + 0.5) - lex.base)
        for batch in pieces(batches, "text"):
            words = Words(byte_rows(batch.column(1)), SPACED)
            h = words.hashes()
            classes, place = lex.classed(h)
            known = place >= 0
            owner, n = words.owners(), batch.num_rows
            ended, starts = with_ends(classes, words.firsts)
            model_score = np.add.reduceat(model.scores(ended, starts), starts[:-1])
            inside = np.where(known, lex.inside[place] if len(lex.inside) else 0.0, 0.0)
            base = np.where(known, heavy_base[place] if len(lex.inside) else 0.0, 0.0)
            rare = np.flatnonzero(~known)
            pair = np.stack((owner[rare].astype(np.uint64), h[rare]), 1)
            order = np.lexsort((pair[:, 1], pair[:, 0]))
            pair = pair[order]
            new = np.flatnonzero(np.concatenate(([True], (pair[1:] != pair[:-1]).any(1)))) if len(pair) else np.zeros(0, np.int64)
            times = np.diff(np.concatenate((new, [len(pair)])))
            cuts = np.searchsorted(pair[new, 0], np.arange(n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(words.counts + 1), pa.array(np.bincount(owner[known], minlength=n) + (lex.docs > 0)), pa.array(np.bincount(owner[rare], minlength=n)),
                    pa.array(np.bincount(owner, base, n) + end_base), pa.array(model_score + np.bincount(owner, inside, n)),
                    pa.ListArray.from_arrays(cuts, pa.array(pair[new, 1].view(np.int64))), pa.ListArray.from_arrays(cuts, pa.array(times.astype(np.int64))),
                ],
                ["doc_id", "n_tokens", "known", "rare", "base", "model", "rare_h", "rare_n"],
            )

    id_type = dict(docs.dtypes)["doc_id"]
    parts = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_tokens bigint, known bigint, rare bigint, base double, model double, rare_h array<bigint>, rare_n array<bigint>")
    parts = written(parts.withColumn("row", F.monotonically_increasing_id()), "lm-parts")
    rare = parts.select("row", F.explode(F.arrays_zip("rare_h", "rare_n")).alias("x")).select("row", F.col("x.rare_h").alias("h"), F.col("x.rare_n").alias("n"))
    rare = rare.join(counts.where(F.col("c") < lex.below), "h", "left").groupBy("row").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("logs"), F.sum(F.when(F.col("c") > 0, F.col("n"))).alias("more"))
    whole = parts.drop("rare_h", "rare_n").join(rare, "row", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return whole.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(lex.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + logs - F.col("rare") * lex.base).alias("base_score"),
        (F.col("model") + logs - F.col("rare") * lex.rare).alias("score"),
    )


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scored(docs, bucket(F.col("doc_id"), 5) != 1)
    return found.select("doc_id", F.coalesce(bucket(F.col("doc_id"), 5) == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
