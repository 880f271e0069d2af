"""License notices by an exact set-similarity join of text blocks and templates, with DataFrame functions only.

A block is a window of consecutive words of the whole text, across its lines; it matches a template if it holds at least
``percent`` % of the template's different words. The length filter bounds blocks from both sides: fewer words than the
threshold asks for cannot match, and a block has at most 100 / percent times as many words as the template, so that a long text does
not match by words that merely occur somewhere in it. The longest such window holds all that shorter ones hold, so only
those of full length count, or the whole text where it is shorter.

Template words are ordered by their frequency in all documents, rarest first. Every matching block is found by the rarest
template word that it holds, which lies in the template's prefix: blocks are joined to templates by the places of
prefix words only. The words from there on in that order (positional filter) bound what a block around the place can hold,
and what is left is verified. Templates are a parameter: their words, not the documents', bound what is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farol.llm.common import Stages, ready

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of the prefix table that are still broadcast (a row has the words of its template as numbers); more are shuffled.
MOST_BROADCAST = 20_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Words that stand consecutively -> label.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Short public notices, (label, notice).
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, UPPER.lower())


def spaced(text: Column) -> Column:
    """Words with single spaces between, before and after them."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(text, SEPARATORS, " ")), F.lit(" "))


def _places(words: Column, phrase: str) -> Column:
    """Word numbers at which the phrase starts.

    The words are held against one word of the phrase after another, shifted by its place; no lambda reads the whole
    array, as it would be built anew for every word.
    """
    first, *others = phrase.split()

    def followed(part: str):
        return lambda before, word: before & F.coalesce(word == part, F.lit(False))

    here = F.transform(words, lambda w: w == first)
    for k, part in enumerate(others, 1):
        here = F.zip_with(here, F.slice(words, k + 1, F.size(words)), followed(part))
    numbers = F.transform(here, lambda a, i: F.when(a, i))
    return F.filter(numbers, lambda i: i.isNotNull())


def needed(words: int, percent: int) -> int:
    """Template words that a block must hold."""
    return -(-words * percent // 100)


def scanned(docs: DataFrame, phrases: dict[str, str], templates, percent: int) -> DataFrame:
    """Words, phrase places and template words of every document, with the places of the latter where a template is possible at all."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"),
                       spaced(lowered(F.col("text"))).alias("words"))
    rows = rows.withColumn("n_words", F.when(F.col("words") == "  ", 0).otherwise(
        F.length("words") - F.length(F.replace("words", F.lit(" "), F.lit(""))) - 1).cast("long"))
    listed = F.split(F.trim("words"), " ")
    found = F.array(*[
        F.when(F.contains("words", F.lit(f" {phrase} ")), F.struct(F.lit(label).alias("label"), _places(listed, phrase).alias("places")))
        for phrase, label in phrases.items()])
    vocabulary = sorted({w for _, notice in templates for w in notice.split()})
    rows = rows.select("*", F.array_compact(found).alias("found"), F.array_intersect(listed, F.array(*[F.lit(w) for w in vocabulary])).alias("known"))
    possible = F.lit(False)
    for _, notice in templates:
        own = sorted(set(notice.split()))
        possible = possible | (F.size(F.array_intersect("known", F.array(*[F.lit(w) for w in own]))) >= needed(len(own), percent))
    places = F.filter(F.transform(listed, lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda h: h["word"].isin(vocabulary))
    return rows.select("doc_id", "text_hash", "n_words", "found", "known", F.when(possible, places).alias("held"))


def matched(base: DataFrame, frequency: dict[str, int], templates, percent: int) -> DataFrame:
    """(doc_id, text_hash, label, containment) of blocks that meet the threshold, at least the best of each label and document."""
    spark = base.sparkSession
    rank = {w: i for i, w in enumerate(sorted(frequency, key=lambda w: (frequency[w], w)))}
    prefixes, longest = [], 1
    for label, notice in templates:
        ranks = sorted({rank[w] for w in notice.split()})
        need, length = needed(len(ranks), percent), len(ranks) * 100 // percent
        longest = max(longest, length)
        prefixes += [(r, label, ranks, need, length) for r in ranks[:len(ranks) - need + 1]]
    firsts = sorted({p[0] for p in prefixes})
    table = spark.createDataFrame(prefixes, "rank int, label string, ranks array<int>, need int, length int")
    if len(prefixes) <= MOST_BROADCAST:
        table = F.broadcast(table)

    ordered = F.map_from_arrays(F.array(*[F.lit(w) for w in rank]), F.array(*[F.lit(i) for i in rank.values()]))
    rows = base.where("held IS NOT NULL").select("doc_id", "text_hash", F.transform("held", lambda h: F.struct(
        h["at"].alias("at"), F.element_at(ordered, h["word"]).alias("rank"))).alias("held"))
    # words at most ``longest`` places away are at most so many entries away
    around = F.transform("held", lambda h, i: F.when(h["rank"].isin(firsts), F.struct(
        h["at"].alias("at"), h["rank"].alias("rank"), F.slice("held", F.greatest(i + 1 - longest, F.lit(1)), F.lit(2 * longest + 1)).alias("near"))))
    places = rows.select("doc_id", "text_hash", F.explode(F.filter(around, lambda a: a.isNotNull())).alias("place")).select("doc_id", "text_hash", "place.*")
    pairs = places.join(table, "rank")
    # template words around the place that are not rarer than its own
    inside = F.filter("near", lambda x: (x["rank"] >= F.col("rank")) & F.array_contains("ranks", x["rank"])
                      & (x["at"] > F.col("at") - F.col("length")) & (x["at"] < F.col("at") + F.col("length")))
    pairs = pairs.select("doc_id", "text_hash", "at", "label", "need", "length", F.size("ranks").alias("words"), inside.alias("inside"))
    pairs = pairs.where(F.size(F.array_distinct(F.transform("inside", lambda x: x["rank"]))) >= F.col("need"))

    def held_from(start):
        return F.size(F.array_distinct(F.transform(F.filter("inside", lambda x: (x["at"] >= start["at"]) & (x["at"] < start["at"] + F.col("length"))), lambda x: x["rank"])))

    shared = F.array_max(F.transform(F.filter("inside", lambda s: s["at"] <= F.col("at")), held_from))
    return pairs.select("doc_id", "text_hash", "label", "need", "words", shared.alias("shared")).where("shared >= need").select(
        "doc_id", "text_hash", "label", (F.col("shared") / F.col("words")).alias("containment"))


def license_scan(docs: DataFrame, percent: int = 80, templates=TEMPLATES, phrases: dict[str, str] | None = None) -> DataFrame:
    """documents -> one row per row: n_words, n_base, first_word, last_word, base_labels, labels, score.

    A notice is found across line breaks, wrapped in any way; a long line counts by its windows like any other text. Very long
    texts are scanned whole, and what is compared of them are the surroundings of rare template words.
    ``n_base`` counts the places of the phrases, ``first_word`` and ``last_word`` are the smallest and largest word number
    of them, null without any. ``labels`` adds the templates' labels. ``score`` is 1 if there is a phrase, else the largest
    containment of a template that meets the threshold, else 0. Null and empty texts have no words and no labels (empty text).
    Repeated rows get equal results; a null doc_id does not matter. An empty table gives an empty result.
    """
    spark = ready(docs.sparkSession)
    stages, phrases = Stages(spark), PHRASES if phrases is None else phrases
    vocabulary = sorted({w for _, notice in templates for w in notice.split()})
    base = stages.put("licenses-base", scanned(docs, phrases, templates, percent))
    counted = base.select(F.explode("known").alias("word")).groupBy("word").count()  # one row per template word
    frequency = dict.fromkeys(vocabulary, 0) | {r["word"]: r["count"] for r in counted.collect()}
    hits = matched(base, frequency, templates, percent).groupBy("doc_id", "text_hash").agg(
        F.collect_set("label").alias("more"), F.max("containment").alias("best")).select(
        F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "more", "best")

    def joined(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    places, none = F.flatten(F.col("found.places")), F.array().cast("array<string>")
    return base.join(hits, base["doc_id"].eqNullSafe(hits["id"]) & (base["text_hash"] == hits["hash"]), "left").select(
        "doc_id", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"), joined(F.col("found.label")).alias("base_labels"),
        joined(F.concat(F.col("found.label"), F.coalesce("more", none))).alias("labels"),
        F.when(F.size("found") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))
