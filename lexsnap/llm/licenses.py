"""License scan by a positional index of rare licence words, in native functions only.

Each template is looked up by the rarest word of its own key phrase. The phrase must stand
whole wherever the template is found, so its word finds every such place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexsnap.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Base phrases and labels, as the query's contract has them.
BASE_PHRASES = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}

# Templates: label, wording, and the key phrase that must stand in its place.
TEMPLATES = (
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("apache-2", "you may not use this file except in compliance with the license", "except in compliance with the license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("cc-by", "creative commons attribution 4 0 international license", "creative commons attribution 4"),
    ("gpl", "this work is licensed under the gnu general public license", "gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
)
# Words too frequent in any prose to look a template up by.
STOP_WORDS = frozenset("0 2 4 a and any are as by can except for forms in into is it may not of or person purpose terms the this to under use v with without you".split())

LEAST_SHARE = 0.6  # of a template's weight that must stand in place

VOCABULARY = sorted({w for _, text, _ in TEMPLATES for w in text.split()} | {w for p in BASE_PHRASES.values() for w in p.split()})
INDEXED = [w for w in VOCABULARY if w not in STOP_WORDS]
RARE_WORDS = len(INDEXED)  # of a document that may lead to a template: all of them


def words_of(text: Column) -> Column:
    plain = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD, " ")
    plain = F.trim(plain)
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " ", -1))


def licence_words(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, words)``; ``words`` is empty where no indexed word occurs.

    Nothing can match there, as every template and base phrase has an indexed word.
    """
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("words"))
    some = F.exists("words", lambda w: w.isin(INDEXED))
    return words.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.when(some, F.col("words")).otherwise(F.array().cast("array<string>")).alias("words"),
    )


def inverse_frequencies(scanned: DataFrame) -> dict[str, float]:
    """IDF of each indexed word over all documents; at most len(INDEXED) rows are fetched."""
    count = scanned.count()
    words = scanned.select(F.explode(F.array_distinct("words")).alias("word"))
    rows = words.where(F.col("word").isin(INDEXED)).groupBy("word").agg(F.count("*").alias("docs")).collect()
    held = {r.word: r.docs for r in rows}
    return {w: math.log((1 + count) / (1 + held.get(w, 0))) + 1 for w in INDEXED}


def _stands(phrase: list[str], start: Column) -> Column:
    """Do the phrase's words stand from word ``start`` on?"""
    condition = F.lit(True)
    for k, word in enumerate(phrase):
        condition = condition & F.get("words", start + k).eqNullSafe(word)
    return condition


def _base_hits(label: str) -> Column:
    """Places where the base phrase of a label starts."""
    phrase = BASE_PHRASES[label].split()
    anchor = next(w for w in phrase if w in INDEXED)
    shift = phrase.index(anchor)
    starts = F.transform(F.filter("found", lambda x: x.word == anchor), lambda x: x["at"] - shift)
    return F.filter(starts, lambda s: _stands(phrase, s))


def _key_place(number: int) -> int:
    """Word of the template at which its key phrase starts."""
    _, text, key = TEMPLATES[number]
    return len(f" {text} "[: f" {text} ".index(f" {key} ")].split())


def _anchor(number: int, idf: dict[str, float]) -> tuple[str, int]:
    """Indexed word of the key phrase of highest IDF (ties: in order of spelling), and its place in the template."""
    key = TEMPLATES[number][2].split()
    word = min((w for w in key if w in INDEXED), key=lambda w: (-idf[w], w))
    return word, _key_place(number) + key.index(word)


def _candidates(idf: dict[str, float]) -> Column:
    """``(template, start)`` of every place of the word that a template is looked up by."""
    postings: dict[str, list[tuple[int, int]]] = {}
    for number in range(len(TEMPLATES)):
        word, q = _anchor(number, idf)
        postings.setdefault(word, []).append((number, q))
    index = F.create_map(
        *(
            x
            for word, entries in postings.items()
            for x in (F.lit(word), F.array(*(F.struct(F.lit(t).alias("t"), F.lit(q).alias("q")) for t, q in entries)))
        )
    )
    rare = F.filter("found", lambda x: x.word.isin(list(postings)))
    return F.flatten(
        F.transform(rare, lambda x: F.transform(F.element_at(index, x.word), lambda p: F.struct(p.t.alias("t"), (x["at"] - p.q).alias("start"))))
    )


def _weight_in_place(number: int, idf: dict[str, float], start: Column) -> Column:
    """Share of the template's weight whose words stand in place."""
    words = TEMPLATES[number][1].split()
    weights = [idf.get(w, 0.25) for w in words]
    held = F.lit(0.0)
    for k, (word, weight) in enumerate(zip(words, weights)):
        in_place = F.get("words", start + k).eqNullSafe(word)
        held = held + F.when(in_place, F.lit(weight)).otherwise(F.lit(0.0))
    return F.round(held / F.lit(sum(weights)), 9)


def _judged(idf: dict[str, float]) -> Column:
    """``(label, share)`` of each candidate whose key phrase is verified."""

    def judge(c: Column) -> Column:
        result = F.struct(F.lit("").alias("label"), F.lit(0.0).alias("share"))
        for number, (label, _, key) in enumerate(TEMPLATES):
            verified = _stands(key.split(), c.start + _key_place(number))
            share = F.when(verified, _weight_in_place(number, idf, c.start)).otherwise(F.lit(0.0))
            result = F.when(c.t == number, F.struct(F.lit(label).alias("label"), share.alias("share"))).otherwise(result)
        return result

    return F.filter(F.transform("candidates", judge), lambda x: x.share >= LEAST_SHARE)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Which licences do the whole texts of ``(doc_id, text, …)`` name?

    One row per row given: ``(doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score, matches)``. Base labels stand for a base phrase word for
    word; the index adds those of templates of which LEAST_SHARE of the IDF weight
    stands in place, with the key phrase whole. ``score`` is the largest such share, 1
    where a base phrase stands, else 0.

    Two passes: the words, with the document frequencies of indexed ones over all
    documents, then lookups within each row that has any. Nothing is joined or shuffled but the
    counts of a few words. Null text is empty; repeated rows, null doc_ids and other
    columns (not read) make no difference.
    """
    scanned = materialize(licence_words(docs), "licence-words")
    idf = inverse_frequencies(scanned)
    places = F.transform("words", lambda w, i: F.struct(i.alias("at"), w.alias("word")))
    rows = scanned.withColumn("found", F.filter(places, lambda x: x.word.isin(INDEXED)))
    bases = (F.struct(F.lit(label).alias("label"), _base_hits(label).alias("hits")) for label in BASE_PHRASES)
    rows = rows.withColumn("base", F.array(*bases))
    rows = rows.withColumn("candidates", _candidates(idf)).withColumn("judged", _judged(idf))
    starts = F.flatten("base.hits")
    base_labels = F.filter("base", lambda b: F.size(b.hits) > 0)["label"]
    every = F.array_sort(F.array_distinct(F.concat(base_labels, F.col("judged.label"))))
    best = F.coalesce(F.array_max("judged.share"), F.lit(0.0))
    return rows.select(
        "doc_id",
        "n_words",
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.size(starts) > 0, 1.0).otherwise(best).alias("score"),
        F.array_sort("judged").alias("matches"),
    )
