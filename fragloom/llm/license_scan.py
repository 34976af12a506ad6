"""License notices by diagonal voting: word k-grams of all documents are joined to their places in templates.

A gram at place p of a document and place t of a template votes for the diagonal p - t.  The votes of a
diagonal, then of neighbouring diagonals (a word more or less inside the notice), cover a share of the
template's words; a span that covers enough of it carries the template's label.  A phrase is a template
whose every gram must vote on one diagonal.  Columns only: no Python worker takes part.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.lineage import materialise, remove
from .rows import kept_columns, named

GRAM = 3
#: Diagonals at most this far apart belong to one copy of a template.
NEIGHBOURS = 4
#: A span needs this share of its template's words, in not more than this many times the template's length.
COVERED, STRETCH = 0.8, 1.5
#: Characters of templates that go to the tasks in one pass over the documents.
BLOCK_CHARS = 1 << 20

# --- fixed values: phrases that name a license by themselves ---
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
# --- fixed values: notices as the licenses' publishers word them ---
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation"
            " files (the \"Software\"), to deal in the Software without restriction"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with"
                 " the License. You may obtain a copy of the License at"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following"
            " conditions are met"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"
            " as published by the Free Software Foundation"),
    ("gpl", "licensed under the GNU General Public License"),
    ("lgpl", "under the terms of the GNU Lesser General Public License"),
    ("agpl", "under the terms of the GNU Affero General Public License"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

_UPPER, _LOWER = (bytes(range(a, a + 26)).decode() for a in (0x41, 0x61))
_BETWEEN = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def words(text: Column) -> Column:
    """Maximal runs of a-z, digits and non-ASCII letters, A-Z lower-cased; none in NULL."""
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER + _BETWEEN, _LOWER + " " * len(_BETWEEN))
    return F.array_remove(F.split(plain, " +"), "")


def templates(spark: SparkSession, rows: list, first: int = 0) -> DataFrame:
    """(template, label, exact, n_words, tpos, gram): every k-gram of (label, text, exact) rows."""
    listed = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(text).alias("text"), F.lit(exact).alias("exact"))
                       for i, (label, text, exact) in enumerate(rows, first)])
    known = spark.range(1).select(F.inline(listed))
    known = known.select("template", "label", "exact", words(F.col("text")).alias("w"))
    placed = known.select("template", "label", "exact", F.size("w").alias("n_words"), "w", F.posexplode("w").alias("tpos", "_"))
    return placed.where(F.col("tpos") <= F.size("w") - GRAM).withColumn("gram", _gram(F.col("w"), F.col("tpos"))).drop("w", "_")


def _gram(w: Column, at: Column) -> Column:
    return F.concat_ws(" ", *[F.get(w, at + i) for i in range(GRAM)])


def _hash(w: Column, at: Column) -> Column:
    return F.xxhash64(*[F.get(w, at + i) for i in range(GRAM)])


def _blocks(rows: list) -> list:
    """Templates in blocks of at most BLOCK_CHARS characters, each with the number of its first one."""
    blocks, size = [], 0
    for i, row in enumerate(rows):
        if not blocks or size + len(row[1]) > BLOCK_CHARS:
            blocks, size = [*blocks, (i, [])], 0
        blocks[-1][1].append(row)
        size += len(row[1])
    return blocks


def votes(docs: DataFrame, rows: list, column: str = "text", keep: list = ()) -> tuple:
    """(documents, hits), each written once.

    documents: (text_key, kept, n_words), one row for each row of `docs`.  hits: (text_key, pos, template,
    tpos), a gram of the text and its place in a template, compared word by word.  Equal texts
    share a key, so what is found in them is looked at once.
    """
    spark = docs.sparkSession
    text = named(column)
    kept = F.struct(*[named(c) for c in keep]) if keep else F.struct(F.lit(None).alias("none"))
    # the empty word after the last one carries the row itself, so the texts are split once
    spread = docs.select(F.struct(F.xxhash64(text), F.xxhash64(F.lit(GRAM), text)).alias("text_key"), kept.alias("kept"),
                         F.array_append(words(text), F.lit("")).alias("w"))
    spread = spread.select("text_key", "kept", "w", F.posexplode("w").alias("pos", "word"))
    passes = []
    for first, block in _blocks(rows):
        grams = templates(spark, block, first)
        grams = grams.select(F.xxhash64(*[F.get(F.split("gram", " "), F.lit(i)) for i in range(GRAM)]).alias("h"), "template", "tpos", "gram")
        own = F.col("word") == ""
        found = spread.withColumn("h", F.when(F.col("pos") + GRAM < F.size("w"), _hash(F.col("w"), F.col("pos")))).join(
            F.broadcast(grams), "h", "left")
        wanted = F.col("template").isNotNull() & (F.col("gram") == _gram(F.col("w"), F.col("pos")))
        found = found.where(wanted if first else (wanted | own))
        passes.append(found.select("text_key", F.when(own, F.col("kept")).alias("kept"), "pos", "template", "tpos"))
    table = materialise(reduce(lambda a, b: a.unionByName(b), passes))
    own = F.col("template").isNull()
    return (table.where(own).select("text_key", "kept", F.col("pos").cast("bigint").alias("n_words")),
            table.where(~own).select("text_key", "pos", "template", "tpos"), table)


def spans(hits: DataFrame, known: DataFrame, covered: float = COVERED) -> DataFrame:
    """(text_key, label, exact, start, end, score) of every span; places are words, `end` is exclusive.

    known: (template, label, exact, n_words), one row a template.  score: share of the template's words
    in the span.  An exact template counts only whole; other spans count from `covered` on
    (`verified`), and weaker ones are kept for their score.
    """
    known = F.broadcast(known)
    diagonals = (hits.groupBy("text_key", "template", (F.col("pos") - F.col("tpos")).alias("diagonal"))
                 .agg(F.collect_set("tpos").alias("places")).join(known, "template"))
    whole = diagonals.where(F.col("exact") & (F.size("places") == F.col("n_words") - GRAM + 1)).select(
        "text_key", "label", "exact", F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("n_words")).alias("end"),
        F.lit(1.0).alias("score"), F.lit(True).alias("verified"))
    down = Window.partitionBy("text_key", "template").orderBy("diagonal")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(down) > NEIGHBOURS, F.lit(True))
    joined = (diagonals.where(~F.col("exact")).withColumn("new", far.cast("int")).withColumn("copy", F.sum("new").over(down))
              .groupBy("text_key", "template", "copy", "label", "exact", "n_words")
              .agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"),
                   F.min(F.col("diagonal") + F.array_min("places")).alias("start"),
                   F.max(F.col("diagonal") + F.array_max("places") + GRAM).alias("end")))
    of_template = F.size(F.array_distinct(F.flatten(F.transform("places", lambda t: F.sequence(t, t + GRAM - 1)))))
    score = of_template / F.col("n_words")
    fits = (score >= covered) & (F.col("end") - F.col("start") <= F.col("n_words") * STRETCH)
    return whole.unionByName(joined.select("text_key", "label", "exact", "start", "end", score.alias("score"), fits.alias("verified")))


def scan(docs: DataFrame, column: str = "text", keep: list = None, phrases: list = PHRASES, notices: list = NOTICES) -> DataFrame:
    """Each row with n_words, n_base, first_word, last_word, base_labels, labels, score and license_spans.

    n_base, first_word, last_word, base_labels: places of the `phrases` (label, text), their least and
    greatest start (words from 0, NULL without one), their labels; labels: those and the labels of
    verified spans of the `notices`; both sorted, different, comma-joined, '' if none.
    score: the largest share of a template found in one span, 0 without any gram.
    license_spans: array of (label, start, end, score) of phrases and verified spans, in order.

    Every row stays, repeated rows too; equal texts are scanned as often as they come but voted on once,
    so a group of copies costs one text's votes.  NULL and empty texts have no words and no spans.
    Texts are scanned whole.  An empty table gives no rows.  A column of the input named like a
    result is replaced by it.  A template of fewer words than a gram raises ValueError.
    """
    rows = [(a, b, True) for a, b in phrases] + [(a, b, False) for a, b in notices]
    fields = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "license_spans"]
    keep = kept_columns(docs, fields, keep)
    known = reduce(lambda a, b: a.unionByName(b), [templates(docs.sparkSession, block, first) for first, block in _blocks(rows)])
    known = known.select("template", "label", "exact", "n_words").distinct()
    if known.count() < len(rows):
        raise ValueError(f"a template needs {GRAM} words at least")
    documents, hits, _ = votes(docs, rows, column, keep)
    found = materialise(spans(hits, known).groupBy("text_key").agg(
        F.count_if("exact").alias("n_base"),
        F.min(F.when(F.col("exact"), F.col("start"))).alias("first_word"), F.max(F.when(F.col("exact"), F.col("start"))).alias("last_word"),
        F.collect_set(F.when(F.col("exact"), F.col("label"))).alias("base_labels"),
        F.collect_set(F.when(F.col("verified"), F.col("label"))).alias("labels"), F.max("score").alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("verified"), F.struct("start", "end", "label", "score")))).alias("license_spans")))

    def joined(labels):
        return F.coalesce(F.array_join(F.array_sort(labels), ","), F.lit(""))

    return documents.join(found, "text_key", "left").select(
        *[F.col("kept")[c].alias(c) for c in keep], "n_words", F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"),
        F.col("first_word").cast("bigint").alias("first_word"), F.col("last_word").cast("bigint").alias("last_word"),
        joined("base_labels").alias("base_labels"), joined("labels").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce(F.transform("license_spans", lambda s: F.struct(s["label"].alias("label"), s["start"].alias("start"),
                                                                   s["end"].alias("end"), s["score"].alias("score"))),
                   F.array().cast("array<struct<label:string,start:int,end:int,score:double>>")).alias("license_spans"))
