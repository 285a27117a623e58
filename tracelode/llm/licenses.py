"""License scans: an exact set-similarity join of text blocks with license templates, in DataFrame functions only.

A text is a row of words; its tokens are pairs of neighbouring words. Blocks are windows of 2 * STRIDE
words, one every STRIDE words, so that every run of up to STRIDE words (all of a template with a
quarter of foreign words in it) lies whole in a block. A block matches a template if it holds at
least PERCENT of the template's distinct tokens.

The join: tokens of templates are ordered by how often they stand in all texts, rare ones first; a
template with n tokens that must share a of them meets a block only by one of its first n - a + 1
tokens, which must be among the first m - a + 1 of the block's m tokens (other tokens of the block
can't be shared, so they don't count); blocks with m < a are left out by length, and pairs whose
places of the first shared token leave too few tokens behind them by position. What is left is
verified by intersecting the two sets. Only tokens of templates leave the scan of a text.

The base finds phrases as words that stand consecutively. A document's labels are those of its
phrases and of its matches; its score is 1 with a phrase, else the largest share of a template
that it holds in one block, if PERCENT or more, else 0.

Defined results: a null text is empty and has no words; ASCII letters count in lower case, other
characters beyond ASCII are part of words; a place counts once for each phrase; a template with one
word is found by that word; equal templates with several labels give each label; repeated rows, also with equal
or null ids, are documents of their own; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
PERCENT = 80
# Phrases and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
# Notices of well-known licenses and their labels.
TEMPLATES = (
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("Licensed under the Apache License, Version 2.0", "apache-2"),
    ("GNU General Public License", "gpl"),
    ("GNU Lesser General Public License", "lgpl"),
    ("GNU Affero General Public License", "agpl"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License", "mpl"),
    ("Licensed under the Creative Commons Attribution", "cc-by"),
    ("Creative Commons Attribution-NonCommercial", "cc-by-nc"),
    ("This is free and unencumbered software released into the public domain", "unlicense"),
    ("All rights reserved", "all-rights-reserved"),
)


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(F.make_valid_utf8(text.cast("string")), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: str) -> list[str]:
    """The words of a template or phrase, which are ASCII."""
    return "".join(c.lower() if c.isalnum() else " " for c in text).split()


def tokens_of(text: str) -> list[str]:
    """Distinct tokens of a template: pairs of neighbouring words, or its only word."""
    words = words_of(text)
    return list(dict.fromkeys(words if len(words) == 1 else [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]))


def stride_of(templates: tuple[tuple[str, str], ...]) -> int:
    """Words that a template takes at most, with a quarter of foreign words between its own."""
    return max(32, *(ceil(1.25 * len(words_of(text))) for text, _ in templates))


def scanned(df: DataFrame, phrases, templates, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, n_words, n_base, first_word, last_word, base_labels array, hits array of (pos, token)) as a written table; row tells rows apart."""
    tokens = sorted({t for text, _ in templates for t in tokens_of(text)})
    starts = {words_of(phrase)[0] for phrase, _ in phrases}
    words = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.regexp_extract_all(lowered(F.col(text_col)), F.lit(WORD), F.lit(0)).alias("words"))
    # One pass over the words: kept are places where a phrase or a template may begin, or a token of a template stands.
    pairs = words.select("doc_id", "words", F.zip_with("words", F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b)).alias("pairs"))
    spots = F.filter(F.transform("pairs", lambda p, i: F.when(p.isin(tokens) | F.get("words", i).isin([*starts, *tokens]), i)), lambda i: i.isNotNull())
    found = pairs.select("doc_id", "words", "pairs", spots.alias("spots"))
    hits = F.filter(F.transform("spots", lambda i: F.when(F.get("pairs", i).isin(tokens), F.struct(i.alias("pos"), F.get("pairs", i).alias("token"))).otherwise(F.when(F.get("words", i).isin(tokens), F.struct(i.alias("pos"), F.get("words", i).alias("token"))))), lambda h: h.isNotNull())

    def places(phrase: str) -> Column:
        want = words_of(phrase)

        def stands(i: Column) -> Column:
            out = F.get("words", i) == want[0]
            for k, w in enumerate(want[1:], 1):
                out = out & F.coalesce(F.get("words", i + k) == w, F.lit(False))
            return out

        return F.filter("spots", stands)

    base = found.select("doc_id", F.size("words").cast("bigint").alias("n_words"), hits.alias("hits"), *[places(p).alias(f"base{k}") for k, (p, _) in enumerate(phrases)])
    every = [F.col(f"base{k}") for k in range(len(phrases))]
    labels = F.array_compact(F.array(*[F.when(F.size(c) > 0, label) for c, (_, label) in zip(every, phrases, strict=True)]))
    places_all = F.concat(*every)
    out = base.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", sum((F.size(c) for c in every), F.lit(0)).cast("bigint").alias("n_base"), F.array_min(places_all).cast("bigint").alias("first_word"), F.array_max(places_all).cast("bigint").alias("last_word"), F.array_sort(F.array_distinct(labels)).alias("base_labels"), "hits")
    return written(out, "licenses")


def matches(scan: DataFrame, templates, percent: int = PERCENT, stride: int | None = None) -> DataFrame:
    """(row, block, label, template, shared, share): every block of scan (row, hits) that holds percent of a template's tokens. A block spans 2 * stride words from word block * stride."""
    stride = stride or stride_of(templates)
    spark = scan.sparkSession
    sets = [(k, label, t) for k, (text, label) in enumerate(templates) for t in tokens_of(text)]
    vocabulary = spark.createDataFrame(sets, "template int, label string, token string")  # as many rows as the templates have tokens
    hits = scan.filter(F.size("hits") > 0).select("row", F.explode("hits").alias("hit")).select("row", "hit.pos", "hit.token")
    # Global order: how often a token stands in all texts, counted before the shuffle; the window is over the tokens of the templates.
    often = vocabulary.select("token").distinct().join(hits.groupBy("token").agg(F.count("*").alias("n")), "token", "left")
    ranks = written(often.select("token", F.row_number().over(Window.orderBy(F.coalesce("n", F.lit(0)), "token")).alias("rank")), "ranks")
    sides = vocabulary.join(F.broadcast(ranks), "token").groupBy("template", "label").agg(F.sort_array(F.collect_set("rank")).alias("known"))
    sides = sides.withColumn("least", F.ceil(F.size("known") * percent / 100.0).cast("int"))
    prefix = sides.select("template", "label", "known", "least", F.posexplode(F.slice("known", 1, F.size("known") - F.col("least") + 1)).alias("i", "rank"))
    first = F.floor(F.col("pos") / stride).cast("bigint")
    blocks = hits.join(F.broadcast(ranks), "token").select("row", "rank", F.explode(F.array_distinct(F.array(first, F.greatest(first - 1, F.lit(0))))).alias("block"))
    blocks = blocks.groupBy("row", "block").agg(F.sort_array(F.collect_set("rank")).alias("held"))  # tokens of at most 2 * stride words
    probes = blocks.select("row", "block", "held", F.posexplode("held").alias("j", "rank"))
    size = F.size("held")
    pairs = probes.join(F.broadcast(prefix), "rank").filter((size >= F.col("least")) & (F.col("j") <= size - F.col("least")) & (F.least(F.size("known") - F.col("i"), size - F.col("j")) >= F.col("least")))
    shared = F.size(F.array_intersect("held", "known"))
    sure = pairs.select("row", "block", "label", "template", "least", shared.alias("shared"), F.size("known").alias("of")).filter(F.col("shared") >= F.col("least"))
    return sure.groupBy("row", "block", "label", "template").agg(F.max("shared").alias("shared"), F.max("of").alias("of")).select("row", "block", "label", "template", "shared", (F.col("shared") / F.col("of")).alias("share"))


def scan(df: DataFrame, phrases=PHRASES, templates=TEMPLATES, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rows = scanned(df, phrases, templates, id_col, text_col)
    found = matches(rows.select("row", "hits"), templates, percent).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    both = rows.drop("hits").join(found, "row", "left")
    labels = F.array_sort(F.array_union("base_labels", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.size("base_labels") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0)))
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


def scan_sql(phrases=PHRASES, templates=TEMPLATES, percent: int = PERCENT) -> str:
    """The same as scan(documents), for DuckDB, by counting every template in every block; doc_id must be unique."""
    stride = stride_of(templates)
    tokens = ", ".join(f"({k}, '{label}', '{t}')" for k, (text, label) in enumerate(templates) for t in tokens_of(text))
    base = " UNION ALL ".join(f"SELECT doc_id, i - 1 AS pos, '{label}' AS label FROM w, unnest(range(1, len(words) + 1)) AS u(i) WHERE " + " AND ".join(f"words[i + {j}] = '{v}'" for j, v in enumerate(words_of(p))) for p, label in phrases)
    return f"""WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words FROM documents),
t AS (SELECT * FROM (VALUES {tokens}) AS v(template, label, token)),
p AS ({base}),
b AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS base_labels FROM p GROUP BY doc_id),
k AS (SELECT doc_id, i - 1 AS pos, unnest([words[i], words[i] || ' ' || words[i + 1]]) AS token FROM w, unnest(range(1, len(words) + 1)) AS u(i)),
h AS (SELECT DISTINCT doc_id, unnest(list_distinct([pos // {stride}, greatest(pos // {stride} - 1, 0)])) AS block, template, label, t.token FROM k JOIN t ON k.token = t.token),
m AS (SELECT doc_id, label, count(*) / any_value(n) AS share FROM h JOIN (SELECT template AS of, count(*) AS n FROM t GROUP BY template) s ON h.template = s.of
  GROUP BY doc_id, block, template, label HAVING 100 * count(*) >= {percent} * any_value(n)),
f AS (SELECT doc_id, list(DISTINCT label) AS more, max(share) AS share FROM m GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(base_labels), ','), '') AS base_labels, coalesce(array_to_string(list_sort(list_distinct(list_concat(base_labels, more))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN b ON w.doc_id = b.doc_id LEFT JOIN f ON w.doc_id = f.doc_id"""
