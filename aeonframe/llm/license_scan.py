"""License scans by diagonal voting.

All rolling word k-grams of a text are hashed and joined to the positions of the same hashes in license templates. A
match at word p of the text and word q of a template votes for the diagonal p - q. Votes are counted by diagonal,
diagonals close to each other are merged (a word put in or left out moves the rest of a template to the next one),
and a merged span is kept if it covers enough of the template's words. A phrase is a template of word pairs whose
diagonal must hold all of them: that is, its words stand consecutively.

The main path is DataFrame functions only. Templates are constants of this module, so their table is broadcast.

Defined results: a null text counts as empty; a text without words has n_words 0, no places and null positions;
rows with a null doc_id are scanned like others; repeated rows are repeated, never counted twice; labels are distinct
and sorted ('' if there are none); score is the largest share of a template that a span covers, 1 for a phrase.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import constants, text_or_empty

#: fixed values: phrases whose places are counted
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

#: fixed values: opening sentences of license notices
TEMPLATES = [
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("released under the mit license", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]

GRAM, NEAR, LEAST = 4, 3, 0.6


def words(text: Column) -> Column:
    """Runs of ASCII letters, digits and non-ASCII characters; letters A to Z in lower case.

    lower() agrees with that on ASCII but for two letters beyond it that it maps into it; these are made another
    letter beyond ASCII first, which no template has.
    """
    kept = F.replace(F.replace(text, F.lit("\u212a"), F.lit("\u00e9")), F.lit("\u0130"), F.lit("\u00e9"))
    return F.array_remove(F.split(F.lower(kept), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _gram(at, of: Column, n: int) -> Column:
    return F.xxhash64(F.lit(n), *[F.get(of, at + k) for k in range(n)])


def _grams(of: Column, n: int) -> Column:
    """(pos, gram) of each rolling n-gram."""
    places = F.when(F.size(of) >= n, F.sequence(F.lit(0), F.size(of) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(i.alias("pos"), _gram(i, of, n).alias("gram")))


def template_positions(spark) -> DataFrame:
    """tmpl, label, base, n_grams, n_words, gram, tpos."""
    rows = [(i, t, label, base) for i, (t, label, base) in enumerate([(t, l, True) for t, l in PHRASES] + [(t, l, False) for t, l in TEMPLATES])]
    made = constants(spark, rows, "tmpl, body, label, base").withColumn("w", F.split("body", " "))
    parts = [made.where(F.col("base") == base).select("tmpl", "label", "base", F.size("w").alias("t_words"), F.inline(_grams(F.col("w"), n))) for base, n in ((True, 2), (False, GRAM))]
    return parts[0].union(parts[1]).withColumnRenamed("pos", "tpos")


def scan(docs: DataFrame, near: int = NEAR, least: float = LEAST) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each row of docs (doc_id, text)."""
    text = text_or_empty(docs)
    # a row is known by its id and a hash of its text
    rows = docs.select("doc_id", F.xxhash64(text).alias("key"), words(text).alias("w"))
    grams = rows.select("doc_id", "key", F.explode(F.concat(_grams(F.col("w"), 2), _grams(F.col("w"), GRAM))).alias("g")).select("doc_id", "key", "g.pos", "g.gram")
    hits = grams.join(F.broadcast(template_positions(docs.sparkSession)), "gram").select("doc_id", "key", "tmpl", "label", "base", "t_words", "pos", "tpos").distinct()
    own = ["doc_id", "key", "tmpl", "label", "base", "t_words"]
    diagonals = hits.groupBy(*own, (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.count("*").alias("votes"), F.collect_set("tpos").alias("tposs"))
    order = W.partitionBy(*own).orderBy("diagonal")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > near, F.lit(True))
    # base phrases keep each diagonal to itself
    spans = diagonals.withColumn("span", F.sum((far | F.col("base")).cast("int")).over(order))
    gram = F.when(F.col("base"), 2).otherwise(GRAM)
    covered = F.size(F.array_distinct(F.flatten(F.transform(F.array_distinct(F.flatten(F.collect_list("tposs"))), lambda q: F.sequence(q, q + F.first(gram) - 1)))))
    merged = spans.groupBy(*own, "span").agg(F.min("diagonal").alias("start"), covered.alias("covered"))
    share = F.col("covered") / F.col("t_words")
    kept = merged.withColumn("share", share).where(F.when(F.col("base"), F.col("share") == 1).otherwise(F.col("share") >= least))
    base = lambda x: F.when(F.col("base"), x)
    by_doc = kept.groupBy(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).agg(
        F.count(base(F.lit(1))).alias("n_base"),
        F.min(base(F.col("start"))).cast("long").alias("first_word"),
        F.max(base(F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(base(F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"),
    )
    every = docs.select("doc_id", F.xxhash64(text).alias("key"), F.size(words(text)).cast("long").alias("n_words"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key"))
    return every.join(by_doc, same, "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
