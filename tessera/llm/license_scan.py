"""License scan by diagonal voting.

Every rolling word k-gram of a text is hashed and joined to the same hashes of
the license templates.  A hit votes for a diagonal, its place in the text minus
its place in the template; hits of one copy share a diagonal, or a neighbouring
one where a few words were put in or left out.  Votes are aggregated by
diagonal, and each diagonal is merged with those above it, up to a total drift
of 40 % of the template's words.  A merged span is verified on its hits in
order: the longest chain that rises in text and template must hold 60 % of the
template's k-grams, its equal words must be 60 % of the longer of span and
template, and it must hold the template's key phrase if there is one.  Of
spans of a template that overlap, the one with the most equal words stays.

Texts are grouped by content, so copies vote once for all of them together: a
text's key is a 128-bit hash, and votes are sets of template places, which are
bounded by the template.  Templates are few and sent to every task below the
size limit; beyond it the join shuffles k-grams.

The base phrases are found in the same words by position.

Words: A-Z lower-cased, runs of anything but ASCII space, punctuation and
control characters.

Defined cases: null texts are like empty ones, without words, labels or spans,
score 0; repeated rows each get the result of their text; an empty table gives
no rows; extra columns are left out; templates and keys of fewer than k words
and phrases without a word could never match and are refused.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import if_small, lower_ascii, stage

BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
K = 3
#: Neighbouring hits of one copy lie on diagonals at most so far apart.
SLACK = 3
#: Least share of the template's k-grams, and of the words in order; the rest may be drift.
COVERAGE = 0.6


class Template(NamedTuple):
    label: str
    text: str
    key: str = ""  # k words that must be among the hits


#: The phrases of the contract and their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

#: Customary notices, by SPDX-like labels.
TEMPLATES = [
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", "apache license version"),
    Template("apache-2.0", "you may not use this file except in compliance with the License. "
                           "You may obtain a copy of the License at"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, "
                    "are permitted provided that the following conditions are met"),
    Template("cc-by-4.0", "Licensed under CC BY 4.0", "cc by 4"),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", "cc by nc"),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", "cc by sa"),
    Template("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0", "by nc sa"),
    Template("cc0-1.0", "dedicated to the public domain under CC0 1.0 Universal", "under cc0 1"),
    Template("gpl-2.0", "licensed under the GNU General Public License, version 2", "license version 2"),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3", "license version 3"),
    Template("lgpl", "licensed under the GNU Lesser General Public License", "lesser general public"),
    Template("agpl", "licensed under the GNU Affero General Public License", "affero general public"),
    Template("mit", "Released under the MIT License", "the mit license"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
                    "software and associated documentation files"),
    Template("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0",
             "mozilla public license"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
]


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BREAK, -1), "")


def grams(word_array: Column, k: int) -> Column:
    """Hash of every run of k words; null where there are fewer."""
    return F.when(F.size(word_array) >= k, F.transform(
        F.sequence(F.lit(1), F.size(word_array) - (k - 1)),
        lambda i: F.xxhash64(F.slice(word_array, i, k))))


def word_count(text: str) -> int:
    return sum(map(bool, re.split(BREAK, text)))


def template_grams(spark, templates: list[Template], k: int) -> DataFrame:
    """(template, label, n_grams, key_place, h, place), hashed as texts are."""
    for t in templates:
        for part in (t.text, *([t.key] if t.key else [])):
            if word_count(part) < k:
                raise ValueError(f"template {t.label}: fewer than {k} words in {part!r}")
    listed = spark.createDataFrame(
        [(i, *t) for i, t in enumerate(templates)],
        T.StructType([T.StructField("template", T.IntegerType()), T.StructField("label", T.StringType()),
                      T.StructField("text", T.StringType()), T.StructField("key", T.StringType())]))
    return (listed.withColumn("words", words(F.col("text")))
                  .withColumn("grams", grams(F.col("words"), k))
                  .withColumn("key_place", F.when(F.col("key") != "", F.array_position(
                      "grams", F.get(grams(words(F.col("key")), k), F.lit(0))) - 1).cast("int"))
                  .select("template", "label", F.size("grams").alias("n_grams"), "key_place",
                          F.posexplode("grams").alias("place", "h")))


def _text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("license"), text).alias("k2")]


def find_spans(texts: DataFrame, templates: list[Template], k: int = K) -> DataFrame:
    """Verified spans of ``texts(text)`` by text key: k1, k2, label, ``template``,
    ``first`` and ``last`` (words, inclusive), ``coverage``."""
    spark = texts.sparkSession
    known = template_grams(spark, templates, k)
    size = 40 * sum(len(t.text) for t in templates)
    hits = (texts.select(*_text_key(F.col("text")), words(F.col("text")).alias("words"))
                 .select("k1", "k2", F.posexplode(grams(F.col("words"), k)).alias("at", "h"))
                 .join(if_small(known, size), "h"))
    diagonals = (hits.groupBy("k1", "k2", "template", "label", "n_grams", "key_place",
                              (F.col("at") - F.col("place")).alias("diagonal"))
                     .agg(F.collect_set("place").alias("places")))
    drift = F.greatest(F.lit(1), F.floor((1 - COVERAGE) * (F.col("n_grams") + (k - 1))).cast("int"))
    widest = max([1, *(int((1 - COVERAGE) * word_count(t.text)) for t in templates)])
    one = Window.partitionBy("k1", "k2", "template").orderBy("diagonal")
    merged = (diagonals
              .withColumn("near", F.collect_list(F.struct("diagonal", "places")).over(one.rangeBetween(0, widest)))
              .withColumn("near", F.filter("near", lambda x: x["diagonal"] <= F.col("diagonal") + drift))
              .filter(F.size(F.array_distinct(F.flatten("near.places"))) >= COVERAGE * F.col("n_grams")))
    verified = (merged.withColumn("best", best_chain(F.col("near"), F.col("key_place"), k))
                      .select("k1", "k2", "label", "template", "diagonal", "best.*", "n_grams",
                              (F.col("best.grams") / F.col("n_grams")).alias("coverage"))
                      .withColumn("longest", F.greatest(F.col("n_grams") + (k - 1), F.col("last") - F.col("first") + 1))
                      .filter(F.col("keyed") & (F.col("coverage") >= COVERAGE) &
                              (F.col("words") >= COVERAGE * F.col("longest")))
                      .withColumn("rank", F.struct("words", (-F.col("first")).alias("f"), (-F.col("last")).alias("l"),
                                                   (-F.col("diagonal")).alias("d"))))
    # the same copy seen from several diagonals: the best of those that overlap stays
    others = F.collect_list(F.struct("rank", "first", "last")).over(one.rangeBetween(-widest, widest))
    beaten = F.exists("others", lambda x: (x["rank"] > F.col("rank")) & (x["first"] <= F.col("last")) &
                      (x["last"] >= F.col("first")))
    return (verified.withColumn("others", others).filter(~beaten)
                    .select("k1", "k2", "label", "template", "first", "last", "coverage"))


def best_chain(near: Column, key_place: Column, k: int) -> Column:
    """The words of a span against the template's in their order: the longest chain of hits.

    ``near`` holds diagonals with the template places hit on them.  Places in text and template
    rise along a chain, and neighbours drift by at most ``SLACK``.  A struct of ``keyed`` (the key
    phrase is in the chain, or there is none), ``words`` (equal words in order), ``first`` and
    ``last`` word and ``grams`` of the chain.
    """
    hits = F.array_sort(F.flatten(F.transform(near, lambda n: F.transform(
        n["places"], lambda p: F.struct((n["diagonal"] + p).alias("at"), p.alias("place"))))))
    kind = "array<struct<keyed:boolean,words:int,back:int,grams:int,at:int,place:int>>"

    def state(keyed, n_words, back, n_grams, x):
        return F.struct(keyed.alias("keyed"), n_words.cast("int").alias("words"), back.cast("int").alias("back"),
                        n_grams.cast("int").alias("grams"), x["at"].cast("int").alias("at"),
                        x["place"].cast("int").alias("place"))

    def extend(chains, x):
        here = F.coalesce(x["place"] == key_place, key_place.isNull())
        before = F.filter(chains, lambda c: (c["at"] < x["at"]) & (c["place"] < x["place"]) & (
            F.abs((x["at"] - c["at"]) - (x["place"] - c["place"])) <= SLACK))
        longer = F.transform(before, lambda c: state(
            c["keyed"] | here, c["words"] + F.least(F.lit(k), x["at"] - c["at"], x["place"] - c["place"]),
            c["back"], c["grams"] + 1, x))
        alone = F.array(state(here, F.lit(k), -x["at"], F.lit(1), x))
        return F.concat(chains, F.array(F.array_max(F.concat(longer, alone))))

    best = F.array_max(F.aggregate(hits, F.array().cast(kind), extend))
    return F.struct(best["keyed"].alias("keyed"), best["words"].alias("words"), (-best["back"]).alias("first"),
                    (best["at"] + (k - 1)).alias("last"), best["grams"].alias("grams"))


def phrase_places(word_array: Column, text: Column, phrase: str) -> Column:
    """Starts of a phrase in the words; texts without its letters are passed over."""
    parts = phrase.split()
    if not parts:
        raise ValueError("a phrase without words")

    def here(i):
        same = F.get(word_array, i) == parts[0]
        for j, w in enumerate(parts[1:], 1):
            same = same & (F.get(word_array, i + j) == w)
        return F.coalesce(same, F.lit(False))

    near = text.contains(parts[0])
    for w in parts[1:]:
        near = near & text.contains(w)
    none = F.array().cast("array<int>")
    return F.when(near & (F.size(word_array) > 0), F.filter(
        F.sequence(F.lit(0), F.size(word_array) - 1), here)).otherwise(none)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         templates: list[Template] = TEMPLATES, phrases=PHRASES) -> DataFrame:
    """Per row: id, ``n_words``, ``places`` (phrase starts by label), ``base_labels`` and ``labels``
    (sorted arrays, the latter with the templates'), ``spans`` and ``score`` (best coverage,
    1 for a base phrase, else 0)."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    # staged, so that the join of a much repeated text is a plain one, whose skew can be split
    spans = stage(find_spans(rows.select("text"), templates)
                  .groupBy("k1", "k2")
                  .agg(F.sort_array(F.collect_list(F.struct("first", "last", "label", "coverage"))).alias("spans"),
                       F.max("coverage").alias("best")), "license-spans")
    base = (rows.select("id", *_text_key(F.col("text")), lower_ascii(F.col("text")).alias("low"),
                        words(F.col("text")).alias("words"))
                .select("id", "k1", "k2", F.size("words").cast("long").alias("n_words"),
                        F.create_map(*[x for phrase, label in phrases for x in (
                            F.lit(label), phrase_places(F.col("words"), F.col("low"), phrase))]).alias("places")))
    labels = F.array_sort(F.filter(F.map_keys("places"), lambda x: F.size(F.col("places")[x]) > 0))
    return (base.join(spans, ["k1", "k2"], "left")
                .withColumn("base_labels", labels)
                .withColumn("spans", F.coalesce("spans", F.array().cast(
                    "array<struct<first:int,last:int,label:string,coverage:double>>")))
                .select(F.col("id").alias(id_col), "n_words", "places", "base_labels",
                        F.array_sort(F.array_distinct(F.concat("base_labels", F.col("spans.label")))).alias("labels"),
                        "spans", F.when(F.size("base_labels") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score")))
