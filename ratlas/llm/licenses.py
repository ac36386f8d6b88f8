"""License scans by diagonal voting, on built-in functions only.

Every run of k words of a text is hashed and joined with the runs of the templates. A hit lies on the diagonal of its
place in the text less its place in the template: text that follows a template keeps to one diagonal, or to neighbouring
ones where words were put in or left out. Votes are summed by diagonal, neighbours are merged, and a span counts if it
covers enough of its template.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Runs of words that vote.
RUN = 4
#: Diagonals so far apart at most are neighbours; a span counts from this share of its template's words on.
GAP, COVER = 4, 0.8
#: Phrases that name a license by themselves, and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Words of well-known notices, and the labels that they give.
TEMPLATES = (
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit-notice", "released under the mit license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
#: Fixed value: what separates words, as characters and as a class.
BREAKS = "".join(map(chr, [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Letters, digits and characters past ASCII as words, A-Z in lower case; null or none: an empty array."""
    inner = F.btrim(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(BREAKS))
    return F.when(inner == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(inner, BREAK))


def run_hash(ws: Column, at: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(ws, at + i) for i in range(k)])


def template_runs(spark: SparkSession, templates=TEMPLATES, k: int = RUN) -> DataFrame:
    """hash, template (its number), label, size (words), tat (place), run (its words): one row a run. A template of fewer
    than k words raises ValueError."""
    for number, (_, text) in enumerate(templates):
        if len(text.split()) < k:
            raise ValueError(f"template {number} has fewer than {k} words")
    each = [F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.split(F.lit(text), " +").alias("ws")) for i, (label, text) in enumerate(templates)]
    df = spark.range(1).select(F.inline(F.array(*each))).select("*", F.size("ws").alias("size"))
    df = df.select("*", F.explode(F.sequence(F.lit(0), F.col("size") - k)).alias("tat"))
    return df.select(run_hash(F.col("ws"), F.col("tat"), k).alias("hash"), "template", "label", "size", "tat", F.slice("ws", F.col("tat") + 1, k).alias("run"))


def _stands(ws: Column, parts: list[str]):
    return lambda i: reduce(and_, [F.coalesce(F.get(ws, i + j) == w, F.lit(False)) for j, w in enumerate(parts)])


def _labelled(label: str):
    return lambda i: F.struct(i.alias("at"), F.lit(label).alias("label"))


def phrase_places(ws: Column, text: Column, phrases=PHRASES) -> Column:
    """array<struct<at, label>>: every place where a phrase's words stand, by place. Texts are first searched as they are;
    only those that hold a phrase are looked through word by word."""
    held = F.coalesce(text, F.lit("")).rlike("(?i)" + "|".join(BREAK.join(map(re.escape, p.split())) for p, _ in phrases))
    found = [F.transform(F.filter(F.sequence(F.lit(0), F.size(ws) - 1), _stands(ws, phrase.split())), _labelled(label)) for phrase, label in phrases]
    none = F.expr("cast(array() as array<struct<at:int,label:string>>)")
    return F.when(held & (F.size(ws) > 0), F.array_sort(F.flatten(F.array(*found)))).otherwise(none)


def votes(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, k: int = RUN) -> DataFrame:
    """One row for each document (template null) and one for each of its runs that a template holds: row (a number of the
    document's row), doc_id, n_words, places, template, label, size, tat, at.

    All runs of all texts are joined with the templates' as one stream of hashes, in which each document has one more
    entry that stands for itself; so texts are read once, and documents without a hit stay. The templates are a fixed list
    of some hundred runs, which go to every task. A hit's words are compared too.
    """
    spark = docs.sparkSession
    df = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", words(F.col("text")).alias("ws"))
    # behind a generator of one row, so that words aren't taken anew for all that uses them
    df = df.select("row", "doc_id", "text", F.explode(F.array("ws")).alias("ws"))
    none = F.expr("cast(array() as array<bigint>)")
    hashes = F.when(F.size("ws") >= k, F.transform(F.sequence(F.lit(0), F.size("ws") - k), lambda i: run_hash(F.col("ws"), i, k))).otherwise(none)
    stream = F.concat(hashes, F.array(F.lit(None).cast("long")))
    df = df.select("row", "doc_id", "ws", F.size("ws").cast("long").alias("n_words"), phrase_places(F.col("ws"), F.col("text"), phrases).alias("places"), stream.alias("stream"))
    df = df.select("row", "doc_id", "ws", "n_words", "places", F.posexplode_outer("stream").alias("at", "key"))  # outer: a plain one would take all hashes twice, for a filter on their number
    runs = template_runs(spark, templates, k)
    known = runs.unionByName(spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in runs.schema]))
    same = F.col("hash").isNull() | (F.slice("ws", F.col("at") + 1, k) == F.col("run"))
    hit = df.join(F.broadcast(known), F.col("key").eqNullSafe(F.col("hash")) & same)
    return hit.select("row", "doc_id", "n_words", "places", "template", "label", "size", "tat", "at")


def spans(hits: DataFrame, k: int = RUN, gap: int = GAP) -> DataFrame:
    """votes, with each template's hits in a document summed to spans: row, doc_id, n_words, places, template, label, first,
    last (words of the text), cover (the share of the template's words that the span holds) and best (that of one diagonal).

    Votes are summed by diagonal before they travel. Then a document's diagonals with a template are put in order, and
    neighbours up to gap apart become one span.
    """
    per = hits.groupBy("row", "template", (F.col("at") - F.col("tat")).alias("diagonal")).agg(
        *[F.first(c, True).alias(c) for c in ("doc_id", "n_words", "places", "label", "size")], F.min("at").alias("first"), (F.max("at") + k - 1).alias("last"), F.collect_set("tat").alias("tats")
    )  # a diagonal holds each place of its template once at most
    per = per.repartition("row")
    own = Window.partitionBy("row", "template").orderBy("diagonal")
    per = per.withColumn("apart", F.coalesce(F.col("diagonal") - F.lag("diagonal").over(own) > gap, F.lit(True)))
    per = per.withColumn("span", F.count_if("apart").over(own))
    per = per.withColumn("held", F.array_distinct(F.flatten(F.transform("tats", lambda t: F.sequence(t, t + (k - 1))))))
    # of a span each word of the template counts once, however many diagonals hold it
    each = per.select("*", F.explode_outer("held").alias("word"))
    out = each.groupBy("row", "template", "span").agg(
        *[F.first(c, True).alias(c) for c in ("doc_id", "n_words", "places", "label", "size")], F.min("first").alias("first"), F.max("last").alias("last"), F.size(F.collect_set("word")).alias("words"), F.max(F.size("held")).alias("most")
    )
    share = lambda c: F.col(c) / F.col("size")
    return out.select("row", "doc_id", "n_words", "places", "template", "label", "first", "last", share("words").alias("cover"), share("most").alias("best"), "size")


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, k: int = RUN, gap: int = GAP, cover: float = COVER) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word (long), base_labels, labels, score of every row of docs.

    n_base counts the places of the phrases, of which first_word and last_word are the first and the last (null without
    any); base_labels are their labels. labels adds those of templates of which a span covers at least the share cover,
    on one diagonal or, if the span is no longer than twice the template, on neighbouring ones. score is the largest share
    of a template that a span covers, and 1 where a phrase stands.

    Null, empty and blank texts have no words, no labels and score 0. Repeated rows and rows that share a doc_id are
    scanned as rows of their own; an empty table gives no rows. A text of any length is one row until its hits are taken.
    """
    found = spans(votes(docs, templates, phrases, k), k, gap)
    good = (F.col("best") >= cover) | ((F.col("cover") >= cover) & (F.col("last") - F.col("first") < 2 * F.col("size")))
    per = found.groupBy("row").agg(
        F.first("doc_id", True).alias("doc_id"), F.first("n_words", True).alias("n_words"), F.max("places").alias("places"), F.collect_set(F.when(good, F.col("label"))).alias("more"), F.max("cover").alias("cover")
    )
    text = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    at, own = F.col("places.at"), F.col("places.label")
    return per.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"),
        text(own).alias("base_labels"), text(F.concat(own, F.col("more"))).alias("labels"), F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.col("cover"), F.lit(0.0))).alias("score"),
    )
