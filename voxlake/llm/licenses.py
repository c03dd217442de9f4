"""License scan by diagonal voting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_ANY_CASE, table, words

#: Words of a hashed k-gram: of a phrase, of a template.
PHRASE_K, TEMPLATE_K = 2, 4
#: Diagonals this near are one hit: so many words may be put in or left out at one place.
NEAR = 12
#: Words on either side of a template's place that a span may reach into.
MARGIN = 32
#: Least share of a template's k-grams found, and of its words that stand in the span in order.
VOTES, VERIFIED = 0.5, 0.75

# Phrases that name a license by themselves, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Sentences of public license notices, and their labels.
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction": "mit",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of "
    "the software": "mit",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache",
    "distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the "
    "license": "apache",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an "
    "as is basis": "apache",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the "
    "warranties of merchantability fitness for a particular purpose and noninfringement": "mit",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied "
    "warranty of merchantability or fitness for a particular purpose": "gpl",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following "
    "disclaimer": "bsd",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties": "bsd",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
    "license as published by the free software foundation": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
    "granted": "isc",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this "
    "work": "cc0",
    "this is free and unencumbered software released into the public domain": "unlicense",
}


def _index(spark: SparkSession) -> DataFrame:
    """(k, hash, tid, at, len, label, base, want): a row per k-gram place of the fixed texts above."""
    rows = [(i, p.split(), label, True, PHRASE_K) for i, (p, label) in enumerate(PHRASES.items())]
    rows += [(len(rows) + i, p.split(), label, False, TEMPLATE_K) for i, (p, label) in enumerate(TEMPLATES.items())]
    df = spark.createDataFrame(rows, "tid int, want array<string>, label string, base boolean, k int")
    df = df.select("*", F.explode(F.sequence(F.lit(0), F.size("want") - F.col("k"))).alias("at"))
    return df.select(
        "k", F.xxhash64(F.concat_ws(" ", F.slice("want", F.col("at") + 1, F.col("k")))).alias("hash"),
        "tid", "at", F.size("want").alias("len"), "label", "base", "want",
    )


def license_hits(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, label, base, start, end, score): places of phrases and of templates.

    Every rolling k-gram hash of a text is joined to the places of the fixed
    texts (a list in this file, hence broadcast); equal offsets vote for one
    diagonal, and neighbouring diagonals of a template are merged. The span that
    voted is then compared with the wanted words in order: word for word for a
    phrase; by edit distance for a template, of whose words VERIFIED must stand
    there (words between them don't count against it). Very long texts cost their
    length; a span is cut MARGIN words beyond the template's place on either side.
    """
    spark = docs.sparkSession
    text = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))

    def at(k):
        n = F.size("w")
        gram = lambda i: F.struct(
            F.lit(k).alias("k"), i.alias("p"), F.xxhash64(F.concat_ws(" ", *[F.get("w", i + j) for j in range(k)])).alias("hash")
        )
        none = F.array().cast("array<struct<k:int,p:int,hash:bigint>>")
        return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), gram)).otherwise(none)

    text = text.select("doc_id", "text_hash", "w", F.concat(at(PHRASE_K), at(TEMPLATE_K)).alias("g"))
    rows = text.select("doc_id", "text_hash", "w", F.explode_outer("g").alias("g")).select("doc_id", "text_hash", "w", "g.*")
    met = rows.join(F.broadcast(_index(spark)), ["k", "hash"])
    first = F.col("p") - F.col("at")
    edge = F.when(F.col("base"), F.greatest(first, F.lit(0))).otherwise(F.greatest(first - MARGIN, F.lit(0)))
    wide = F.when(F.col("base"), F.col("len")).otherwise(F.col("len") + 2 * MARGIN)
    met = met.select(
        "doc_id", "text_hash", "tid", "at", "p", "len", "label", "base", "want", "k", first.alias("diag"),
        edge.alias("edge"), F.slice("w", edge + 1, wide).alias("near"),
    )
    key = ["doc_id", "text_hash", "tid", "label", "base", "len", "k", "want"]
    votes = met.groupBy(*key, "diag").agg(
        F.collect_set("at").alias("ats"), F.max("near").alias("near"), F.min("edge").alias("edge"), F.min("p").alias("low"), F.max("p").alias("high")
    )
    # neighbouring diagonals of a template are merged; a phrase's stay apart
    by = Window.partitionBy("doc_id", "text_hash", "tid").orderBy("diag")
    new = F.col("base") | (F.col("diag") - F.lag("diag").over(by) > NEAR)
    votes = votes.select("*", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(by).alias("band"))
    hits = votes.groupBy(*key, "band").agg(
        F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"),
        F.min("diag").alias("diag"),
        F.min_by("near", "diag").alias("near"),
        F.min("edge").alias("edge"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )
    share = F.size("ats") / (F.col("len") - F.col("k") + 1)
    exact = F.col("near") == F.col("want")
    span = F.slice("near", F.greatest(F.col("low") - F.col("edge"), F.lit(0)) + 1, F.col("high") + F.col("k") - F.col("low"))
    hits = hits.withColumn("span", F.when(~F.col("base"), span))
    # a character for each different word, so that the built-in distance compares words
    known = F.array_distinct(F.concat("want", "span"))
    letter = lambda w: F.decode(F.unhex(F.hex(F.array_position(known, w) + 0x4E00)), "UTF-16BE")
    coded = lambda words_: F.array_join(F.transform(words_, letter), "")
    apart = F.levenshtein(coded("want"), coded("span"))
    inside = 1 - (apart - F.greatest(F.size("span") - F.size("want"), F.lit(0))) / F.size("want")
    hits = hits.withColumn("inside", F.when(~F.col("base"), inside))
    hits = hits.where(F.when(F.col("base"), (share == 1) & exact).otherwise((share >= VOTES) & (F.col("inside") >= VERIFIED)))
    start = F.when(F.col("base"), F.greatest("diag", F.lit(0))).otherwise(F.col("low")).cast("long")
    end = F.when(F.col("base"), start + F.col("len")).otherwise(F.col("high") + F.col("k")).cast("long")
    return hits.select(
        "doc_id", "text_hash", "label", "base", start.alias("start"), end.alias("end"),
        F.when(F.col("base"), 1.0).otherwise(F.least(share, "inside")).alias("score"),
    )


def licenses(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null or empty text: no words, no labels, score 0. Repeated rows of equal
    doc_id and text each give a row. Only doc_id and text are read. score is the
    best share of a license text found, 1 for a phrase. Licenses that tie for a
    place all count. An empty table gives no rows.
    """
    hits = license_hits(docs).distinct()
    n = hits.groupBy("doc_id", "text_hash").agg(
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("score").alias("score"),
    ).withColumnsRenamed({"doc_id": "_d", "text_hash": "_h"})
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.regexp_count("text", F.lit(WORD_ANY_CASE)).alias("n"))
    out = base.join(n, base.doc_id.eqNullSafe(n._d) & (base.text_hash == n._h), "left")
    return out.select(
        "doc_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_words"),
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))
