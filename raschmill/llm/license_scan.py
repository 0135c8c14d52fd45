"""License texts found by phrases and by an exact set-similarity join; DataFrame functions only.

Blocks are the lines of a text, as sets of words (A-Z lower-cased; digits, letters, non-ASCII). A
template is contained in a block if at least THRESHOLD of its distinct words are in it.

The join. The words of all templates are ordered by the number of blocks of the whole corpus that
have them, rarest first. With n words and a threshold of ``need`` common ones, a contained template
shares one of its first n - need + 1 words with the block: these prefixes are joined with the
blocks' template words on the word. Before the words are compared, a pair must pass the length
filter (the block has ``need`` words) and the positional filter (1 + the fewer of the words that
follow the joined word on either side reach ``need``). What passes is verified by intersection.

The template side is a fixed list in the code, so its size is bounded and it is joined by broadcast;
the corpus is read twice (counts, then blocks) and never shuffled with its text: per document only
blocks that can pass the length filter are kept, as their template words.

Defined results: a null text is empty; without places first_word and last_word are null; labels are
distinct, sorted and joined by commas, empty if none; repeated rows are scanned each; null ids are
kept; other columns do not matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

THRESHOLD = 0.8

# Phrases with their labels, and template sentences with theirs.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "creative commons attribution 4 0 international license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "copyright all rights reserved"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def needed(n: int, threshold: float = THRESHOLD) -> int:
    """Common words for containment; guarded against 0.8 * 5 = 4.000...1."""
    return max(1, -int(-(threshold * n - 1e-9) // 1))


def _spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def _phrase_columns(line: Column, phrases: list[tuple[str, str]]) -> dict[str, Column]:
    """Places of the phrases in a text whose words stand between single spaces, two between words: ' a  b '."""
    n_words = (_spaces(line) / 2).cast("long")
    places, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases:
        words = phrase.split()
        key = " " + "  ".join(words) + " "
        has = F.contains(line, F.lit(key))
        parts = F.split(line, key)
        places.append(F.when(has, F.size(parts) - 1).otherwise(0).cast("long"))
        firsts.append(F.when(has, (_spaces(F.element_at(parts, 1)) / 2).cast("long")))
        lasts.append(F.when(has, n_words - (_spaces(F.element_at(parts, -1)) / 2).cast("long") - len(words)))
        labels.append(F.when(has, F.lit(label)))
    pick = lambda f, cols: f(*cols) if len(cols) > 1 else cols[0]
    return {
        "n_words": n_words,
        "n_base": reduce(lambda a, b: a + b, places),
        "first_word": pick(F.least, firsts),
        "last_word": pick(F.greatest, lasts),
        "base": F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))),
    }


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base (labels of phrases), found (labels of templates), score."""
    spark = docs.sparkSession
    sets = [(i, label, sorted(set(t.split()))) for i, (label, t) in enumerate(templates)]
    least = min(needed(len(w), threshold) for _, _, w in sets)
    vocabulary = sorted({w for _, _, ws in sets for w in ws})

    d = docs.select(F.col(doc_id).alias("id"), F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER).alias("low"))
    words_of = lambda block, kept: F.array_intersect(F.array(*[F.lit(w) for w in kept]), F.split(block, _SEPARATORS))
    blocks = d.select(F.explode(F.split("low", "\n")).alias("block"))
    counted = blocks.select(F.explode(words_of(F.col("block"), vocabulary)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    frequency = {r["word"]: r["n"] for r in counted.collect()}  # at most one row for each template word
    order = sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}

    line = F.concat(F.lit(" "), F.trim(F.regexp_replace("low", _SEPARATORS, "  ")), F.lit(" "))
    line = F.when(F.length(line) > 2, line).otherwise(F.lit(""))
    possible = F.filter(F.transform(F.split("low", "\n"), lambda b: words_of(b, order)), lambda ws: F.size(ws) >= least)
    one = d.select("id", F.xxhash64("low").alias("text_hash"), line.alias("line"), possible.alias("blocks"))
    seen = written(one.select("id", "text_hash", *[c.alias(k) for k, c in _phrase_columns(F.col("line"), phrases).items()], "blocks"))

    prefix = []
    for i, label, ws in sets:
        own = sorted(ws, key=rank.__getitem__)
        need = needed(len(own), threshold)
        prefix += [(w, at, i, label, own, len(own), need) for at, w in enumerate(own[: len(own) - need + 1])]
    side = F.broadcast(spark.createDataFrame(prefix, "word string, at int, template int, label string, words array<string>, n int, need int"))
    shown = seen.where(F.size("blocks") > 0).select("id", "text_hash", F.posexplode("blocks").alias("block", "own")).distinct()
    pairs = shown.select("id", "text_hash", "block", "own", F.posexplode("own").alias("place", "word")).join(side, "word")
    pairs = pairs.where((F.size("own") >= F.col("need")) & (1 + F.least(F.col("n") - F.col("at") - 1, F.size("own") - F.col("place") - 1) >= F.col("need")))
    pairs = pairs.withColumn("common", F.size(F.array_intersect("own", "words"))).where("common >= need")
    found = pairs.groupBy("id", "text_hash").agg(F.array_sort(F.collect_set("label")).alias("found"), F.max(F.col("common") / F.col("n")).alias("best"))

    joined = seen.alias("s").join(found.alias("f"), F.col("s.id").eqNullSafe(F.col("f.id")) & (F.col("s.text_hash") == F.col("f.text_hash")), "left")
    none = F.array().cast("array<string>")
    return joined.select(
        F.col("s.id").alias("id"),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        "base",
        F.coalesce("found", none).alias("found"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
