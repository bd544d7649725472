"""License scans by an exact set-similarity join, in DataFrame functions only.

Base: every place where the words of a license's name stand consecutively. The method: the whole text is laid out in
blocks of BLOCK_WORDS words, a new one after every BLOCK_WORDS / 2, so that each run of words up to the longest template's
length lies whole in a block, however its lines are wrapped and its comment signs drawn; a template (a notice's set of words)
is found in a block that holds at least PERCENT of its words. Template words are
ordered by how many blocks hold them, rarest first. A block that meets the threshold holds one of the template's
first m - need + 1 words (prefix filter); it has `need` template words in all (length filter); and the places of the
first shared word in both orders leave room for `need` common words (positional filter). What is left is
verified by intersection. Words of no template play no part, so blocks keep template words only.

The templates are a fixed list of this module's size, so what the join broadcasts does not grow with the data.

Defined results: a null or empty text has no words, blocks or labels, and score 0; a text with a base place has score 1,
else the largest containment found; repeated rows stay repeated; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

PERCENT = 90
BLOCK_WORDS = 64

# The names to be found, and public license notices.
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
TEMPLATES = [
    ("agpl", "gnu affero general public license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("epl", "made available under the terms of the eclipse public license"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of lower-cased text."""
    return F.array_remove(F.split(text, BETWEEN), "")


def strings(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def places(words: Column, phrase: str) -> Column:
    """Where the phrase's words stand consecutively; looked for only in texts that hold it."""
    own = phrase.split()
    every = F.filter(F.sequence(F.lit(0), F.size(words) - F.lit(len(own))), lambda i: reduce(lambda a, b: a & b, (F.get(words, i + k) == w for k, w in enumerate(own))))
    return F.when(F.array_contains(words, own[0]) & F.array_contains(words, own[-1]) & (F.size(words) >= len(own)), every).otherwise(F.array().cast("array<int>"))


def based(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """A row for each document: its base columns, and `blocks`: the template words of each block that has some."""
    longest = max(len(t.split()) for _, t in templates)
    if 2 * longest > BLOCK_WORDS:
        raise ValueError("a template is longer than half a block")
    vocabulary = strings(sorted({w for _, t in templates for w in t.split()}))
    low = docs.select("doc_id", F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER).alias("low"))
    low = low.select("doc_id", words_of(F.col("low")).alias("words"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - 1), F.lit(BLOCK_WORDS // 2))
    blocks = F.transform(starts, lambda i: F.struct(i.alias("block"), F.array_intersect(F.slice("words", i + 1, F.lit(BLOCK_WORDS)), vocabulary).alias("held")))
    low = low.select("doc_id", "words", F.when(F.arrays_overlap("words", vocabulary), blocks).otherwise(F.array().cast("array<struct<block:int,held:array<string>>>")).alias("all_blocks"))
    each = [places(F.col("words"), phrase) for phrase, _ in BASE]
    found = low.select("doc_id", F.size("words").cast("bigint").alias("n_words"), *(p.alias(f"p{k}") for k, p in enumerate(each)), F.filter("all_blocks", lambda x: F.size(x["held"]) > 0).alias("blocks"))
    columns = [F.col(f"p{k}") for k in range(len(BASE))]
    every = F.concat(*columns)
    named = F.array_compact(F.array(*(F.when(F.size(p) > 0, F.lit(label)) for p, (_, label) in zip(columns, BASE))))
    return found.select("doc_id", "n_words", F.size(every).cast("bigint").alias("n_base"), F.array_min(every).cast("bigint").alias("first_word"), F.array_max(every).cast("bigint").alias("last_word"), named.alias("base"), "blocks")


def matches(blocks: DataFrame, templates=TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """(row, block, label, containment) of every block of (row, block, held) that meets a template's threshold."""
    spark = blocks.sparkSession
    seen = {r["w"]: r["n"] for r in blocks.select(F.explode("held").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most the templates' words
    ordered = sorted({w for _, t in templates for w in t.split()}, key=lambda w: (seen.get(w, 0), w))
    rank = {w: k for k, w in enumerate(ordered)}
    rows = []
    for k, (label, text) in enumerate(templates):
        own = sorted(set(text.split()), key=rank.__getitem__)
        need = -(-percent * len(own) // 100)
        rows.append((k, label, own, need, own[: len(own) - need + 1]))
    table = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(k).alias("t"), F.lit(label).alias("label"), strings(own).alias("own"), F.lit(need).alias("need"), strings(prefix).alias("prefix")) for k, label, own, need, prefix in rows))))
    prefixes = table.select("*", F.posexplode("prefix").alias("p", "w"))
    least = min(need for *_, need, _ in rows)
    first = strings(sorted({w for *_, prefix in rows for w in prefix}, key=rank.__getitem__))
    sorted_blocks = blocks.where(F.size("held") >= least).select("row", "block", F.array_intersect(strings(ordered), "held").alias("held"))
    probes = sorted_blocks.where(F.arrays_overlap("held", first)).select("row", "block", "held", F.posexplode("held").alias("q", "w"))
    met = probes.join(F.broadcast(prefixes), "w")
    room = F.least("p", "q") + F.least(F.size("own") - F.col("p"), F.size("held") - F.col("q"))
    met = met.where((F.size("held") >= F.col("need")) & (room >= F.col("need")) & (F.get(F.array_intersect("prefix", "held"), F.lit(0)) == F.col("w")))
    overlap = F.size(F.array_intersect("own", "held"))
    return met.where(overlap >= F.col("need")).select("row", "block", "label", (overlap / F.size("own")).alias("containment"))


def scanned(docs: DataFrame, templates=TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row."""
    rows = written(based(docs, templates).withColumn("row", F.monotonically_increasing_id()), "licenses")
    found = matches(rows.select("row", F.inline("blocks")), templates, percent)
    found = found.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("most"))
    whole = rows.drop("blocks").join(found, "row", "left")
    labels = F.sort_array(F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))))
    return whole.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.sort_array(F.array_distinct("base")), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("most", F.lit(0.0))).alias("score"),
    )


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    """The base by word lists, the method by counting each block's distinct template words against all templates."""
    values = ", ".join(f"({k}, '{label}', '{text}')" for k, (label, text) in enumerate(TEMPLATES))
    phrases = ", ".join(f"('{p}', '{label}')" for p, label in BASE)
    low = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    return f"""
with d as (select row_number() over () as r, doc_id, {low} as low from documents),
w as (select r, doc_id, low, regexp_extract_all(low, {word}) as ws from d),
ph as (select p, label, string_split(p, ' ') as pw from (values {phrases}) as v(p, label)),
hit as (select r, label, i - 1 as i from w, ph, unnest(range(1, len(ws) - len(pw) + 2)) as t(i) where list_contains(ws, pw[1]) and ws[i:i + len(pw) - 1] = pw),
b as (select r, count(*) as n, min(i) as f, max(i) as l, list_sort(list_distinct(list(label))) as labels from hit group by 1),
tp as (select k, label, list_distinct(string_split(x, ' ')) as tw from (values {values}) as v(k, label, x)),
ln as (select r, ws[i + 1:i + {BLOCK_WORDS}] as lw from w, unnest(range(0, len(ws), {BLOCK_WORDS // 2})) as t(i)),
m as (select r, label, len(list_intersect(tw, lw)) / len(tw) as c from ln, tp where len(list_intersect(tw, lw)) * 100 >= {PERCENT} * len(tw)),
g as (select r, list(label) as more, max(c) as most from m group by 1)
select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n, 0) as bigint) as n_base, cast(f as bigint) as first_word, cast(l as bigint) as last_word,
  coalesce(array_to_string(labels, ','), '') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(labels, []), coalesce(more, [])))), ',') as labels,
  cast(case when n > 0 then 1.0 else coalesce(most, 0.0) end as double) as score
from w left join b using (r) left join g using (r)
"""


OP7_SQL = _oracle()
