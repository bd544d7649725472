"""A corpus pipeline: each stage takes what its predecessor kept, as it was written, and all but the last return documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import decontaminate, langid, line_dedup, ngram_join, pieces_bpe
from tallyforge.llm.shared import dropped, written


def _apart(docs: DataFrame, *made: str) -> tuple[DataFrame, list[Column]]:
    """docs with those columns renamed that an operator would replace by its own, and how to select all columns as they were."""
    names = {c: f"__own_{c}" for c in docs.columns if c in made}
    return docs.withColumnsRenamed(names), [F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language: not those without a letter (null and empty texts among them), nor those that fit no
    language's codeword. Equal texts share their outcome; rows of a null doc_id are judged, not learned from."""
    docs, columns = _apart(docs, "lang_pred", "score", "ambiguous")
    found = langid.predicted(docs, langid.train(docs))
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= langid.MIN_SCORE)).select(*columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that repeat earlier ones; a document of which no word is left goes, one that lost no line stays.

    n_chars, where there is one, is the length of what is left. A null doc_id comes after all others; rows that are equal
    in doc_id and text share their outcome."""
    docs, columns = _apart(docs, "n_lines", "n_removed", "n_near")
    found = line_dedup.deduplicated(docs)
    kept = found.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return kept.select(*columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest doc_id (a null one is the last), of each group of near-duplicates; of equal rows
    one stays. Documents without words are in no group and all stay."""
    return ngram_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold a window of a benchmark item; those without words, or with a null doc_id, are judged alike."""
    docs, columns = _apart(docs, "all_words", "hit_spans", "hit_items", "hit_words")
    found = decontaminate.located(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.col("hit_words") == 0).select(*columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the tokens of each text (none for a null or empty one), and whether they decode to it, in columns that replace such
    of the same names; all rows stay."""
    encoder = pieces_bpe.Encoder()
    return pieces_bpe.round_trip(docs, encoder)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: The first stage is a trained classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        dropped(before)
    return docs
