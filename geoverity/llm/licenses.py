"""License scans by diagonal voting.

Every rolling word k-gram of every document is hashed and joined to the k-gram
positions of the license templates. A hit votes for its diagonal (document
position minus template position). Votes are aggregated by document, template
and diagonal, neighbouring diagonals (insertions and deletions) are merged, and
each merged span is verified word by word against its template. Built-in
functions only; the templates are a fixed parameter, so their side is broadcast.

A label needs a share of its template's words. The gram length follows from that by
pigeonhole (``gram_size``): with so many words edited at most, a run of 4 words stays
intact, or in a shorter template enough pairs of words do. A template of one word
has no pair and is refused (that is what phrases are for).

Fixed phrases are looked up beside that; their labels stay, the templates' labels
are added. Null or empty text: no words, no labels, score 0. Repeated rows get the
same result each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: Fixed phrases of the contract and their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

#: Fixed wordings of public license notices: (label, text).
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                   "except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
]

K, K_SHORT = 4, 2  # words of a gram, and of one of a short template
SLACK = 3  # diagonals so near are one span
MIN_MATCH = 0.8  # share of a template's words found on the span's diagonals
BROADCAST_GRAMS = 200_000  # beyond so many template grams they are joined by shuffle

_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def license_words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _NOT_WORD), lambda w: w != F.lit(""))


def template_words(text: str) -> list[str]:
    lower = "".join(c.lower() if c.isascii() else c for c in text)
    return [w for w in re.split(_NOT_WORD, lower) if w]


def gram_size(n: int, min_match: float = MIN_MATCH) -> tuple[int, int]:
    """(words of a gram, fewest votes of a span) for a template of n words.

    Up to e words may be edited, so e + 1 runs hold the others and one of them has at least (n - e) / (e + 1)
    words. Where that is less than K, pairs are looked up: of the n - 1 pairs an edit touches at most two. Three
    votes at most are asked for, as many as an intact run of K words gives."""
    e = n - math.ceil(round(n * min_match, 9))
    if n - e > (K - 1) * (e + 1):
        return K, 1
    if n < K_SHORT or n - 1 - 2 * e < 1:
        raise ValueError(f"a template of {n} words cannot be found at a share of {min_match}")
    return K_SHORT, min(K - 1, n - 1 - 2 * e)


def grams(words: Column, k: int) -> Column:
    """[(position from 0, hash)] of all rolling k-grams."""
    made = F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.struct(
        (i - 1).alias("pos"), F.xxhash64(*[F.element_at(words, i + j) for j in range(k)]).alias("gram")))
    return F.when(F.size(words) >= k, made).otherwise(F.array().cast("array<struct<pos:int,gram:bigint>>"))


def _templates(spark: SparkSession, templates, min_match: float) -> DataFrame:
    cells = []
    for i, (label, text) in enumerate(templates):
        words = template_words(text)
        k, least = gram_size(len(words), min_match)
        cells.append(F.struct(F.lit(i).alias("t_id"), F.lit(label).alias("label"), F.lit(k).alias("k"),
                              F.lit(least).alias("least"), F.array(*[F.lit(w) for w in words]).alias("t_words")))
    return spark.range(1).select(F.explode(F.array(*cells)).alias("t")).select("t.*")


def spans(docs: DataFrame, templates=TEMPLATES, min_match: float = MIN_MATCH) -> DataFrame:
    """(_id, _th, t_id, label, t_words, lo, hi, votes): merged diagonals of each document and template."""
    spark = docs.sparkSession
    known = _templates(spark, templates, min_match)
    sizes = sorted({gram_size(len(template_words(t)), min_match)[0] for _, t in templates})
    t_grams = F.when(F.col("k") == K, grams(F.col("t_words"), K)).otherwise(grams(F.col("t_words"), K_SHORT))
    places = known.select("t_id", F.explode(t_grams).alias("g")) \
        .select("t_id", F.col("g.pos").alias("t_pos"), F.col("g.gram").alias("gram"))
    small = sum(len(template_words(t)) for _, t in templates) <= BROADCAST_GRAMS
    places, known = (F.broadcast(places), F.broadcast(known)) if small else (places, known)
    hits = (docs.withColumn("words", license_words(F.col("_text")))
            .select("_id", "_th", F.explode(F.concat(*[grams(F.col("words"), k) for k in sizes])).alias("g"))
            .select("_id", "_th", F.col("g.pos").alias("pos"), F.col("g.gram").alias("gram"))
            .join(places, "gram"))
    votes = (hits.groupBy("_id", "_th", "t_id", (F.col("pos") - F.col("t_pos")).alias("diagonal"))
             .agg(F.count("*").alias("votes")))
    # neighbouring diagonals of one document and template
    order = Window.partitionBy("_id", "_th", "t_id").orderBy("diagonal")
    opens = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > SLACK).cast("int"), F.lit(1))
    return (votes.withColumn("opens", opens).withColumn("part", F.sum("opens").over(order))
            .groupBy("_id", "_th", "t_id", "part")
            .agg(F.min("diagonal").alias("lo"), F.max("diagonal").alias("hi"), F.sum("votes").alias("votes"))
            .join(known, "t_id").where("votes >= least"))


def _phrase_places(words: Column, phrase: list[str]) -> Column:
    """Starts (from 0) of the phrase's words standing consecutively."""
    n = len(phrase)
    none = F.array().cast("array<int>")
    here = F.filter(F.sequence(F.lit(0), F.size(words) - n),
                    lambda i: _all([F.element_at(words, i + 1 + j) == F.lit(w) for j, w in enumerate(phrase)]))
    return F.when((F.size(words) >= n) & F.array_contains(words, phrase[0]), here).otherwise(none)


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=PHRASES,
         min_match: float = MIN_MATCH) -> DataFrame:
    """One row per document: key, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``,
    ``labels``, ``score`` (best verified share), ``spans`` (label, first word, end word, share)."""
    docs = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")) \
        .withColumn("_th", F.xxhash64(F.coalesce("_text", F.lit(""))))
    found = (spans(docs, templates, min_match).groupBy(F.col("_id").alias("s_id"), F.col("_th").alias("s_th"))
             .agg(F.collect_list(F.struct("label", "t_words", "lo", "hi")).alias("found")))
    out = docs.join(found, F.col("_id").eqNullSafe(F.col("s_id")) & (F.col("_th") == F.col("s_th")), "left")
    out = out.withColumn("words", license_words(F.col("_text"))).drop("_text")
    out = out.withColumns({f"p{i}": _phrase_places(F.col("words"), template_words(p)) for i, (p, _) in enumerate(phrases)})
    out = out.withColumn("n_all", F.size("words"))

    def share(c: Column) -> Column:
        """Share of the template's words that stand on one of the span's diagonals."""
        matched = F.filter(
            F.sequence(F.lit(1), F.size(c["t_words"])),
            lambda i: F.exists(F.sequence(c["lo"], c["hi"]), lambda d: F.when(
                (i + d >= 1) & (i + d <= F.col("n_all")),
                F.element_at("words", F.greatest(i + d, F.lit(1))) == F.element_at(c["t_words"], i)).otherwise(False)))
        return F.size(matched) / F.size(c["t_words"])

    verified = F.when(F.col("found").isNotNull(), F.transform("found", lambda c: F.struct(
        c["label"].alias("label"), F.greatest(c["lo"], F.lit(0)).alias("first"),
        F.least(c["hi"] + F.size(c["t_words"]), F.col("n_all")).alias("end"), share(c).alias("share"))))
    out = out.withColumn("spans", F.coalesce(verified, F.array().cast(
        "array<struct<label:string,first:int,end:int,share:double>>")))
    places = F.concat(*[F.col(f"p{i}") for i in range(len(phrases))])
    base = F.array_compact(F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(phrases)]))
    own = F.transform(F.filter("spans", lambda s: s["share"] >= min_match), lambda s: s["label"])
    return out.select(
        F.col("_id").alias(id_col), F.col("n_all").cast("long").alias("n_words"),
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)).alias("score"),
        F.sort_array("spans").alias("spans"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of every whole text of ``documents``."""
    return scan(table(spark, sf_dir, "documents")).drop("spans")
