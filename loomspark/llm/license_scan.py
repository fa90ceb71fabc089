"""Operator 9, license scans, in DataFrame operations only.

An exact set-similarity join between text blocks and license templates: a template's label
holds where at least CONTAINMENT of its distinct words occur in one block. A block is a line,
or the words around a line break, on each side as many as the longest template has less one,
so that a wrapped notice lies in one block wherever its lines break. Words are
ordered by their frequency in the whole corpus, rarest first. A block that meets the threshold
shares a word with the template's prefix (prefix filter), holds enough template words (length
filter), and from the first shared word on both sides have enough words left (positional
filter); what passes is counted exactly. A base pass finds fixed phrases word by word.

Defined results: null and empty texts have no words and no labels; rows equal in doc_id and
text get equal results; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import broadcast_if_small, doc_hash, materialize

CONTAINMENT = 0.9
#: Separators of words in a text whose A-Z are lower-cased.
SEP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Short public license notices and their labels.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mit", "Released under the MIT License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
)


def lower_az(text: Column) -> Column:
    """Lower-cased so that ASCII words equal those of a text with only A-Z lower-cased: the
    Kelvin sign is the one other character whose lower case is ASCII on its own."""
    return F.lower(F.replace(text, F.lit("\u212a"), F.lit("\ufffd")))


def template_words(text: str) -> list[str]:
    """Distinct ASCII words of a template, in order."""
    kept = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower())
    return list(dict.fromkeys(kept.split()))


def around_breaks(lines: Column, reach: int) -> Column:
    """For each line break between words, the at most reach words on each side of it; lines: an
    array of arrays of words, empty ones included. One-element transforms bind what is used
    more than once."""
    tokens = F.array_remove(F.flatten(F.transform(lines, lambda x: F.concat(x, F.array(F.lit("\n"))))), "")

    def cut(t: Column) -> Column:
        breaks = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: F.get(t, i) == "\n")
        # a break's place less the breaks before it: the number of words before it
        at = F.array_distinct(F.transform(breaks, lambda p, i: p - i))
        side = lambda w, c: F.slice(w, F.greatest(c - reach, F.lit(0)) + 1, F.least(c, F.lit(reach)) + reach)
        each = lambda w: F.transform(F.filter(at, lambda c: (c > 0) & (c < F.size(w))), lambda c: side(w, c))
        return F.transform(F.array(F.array_remove(t, "\n")), each)[0]

    return F.transform(F.array(tokens), cut)[0]


def scan(docs: DataFrame, phrases: Sequence[tuple[str, str]], vocabulary: Sequence[str], reach: int) -> DataFrame:
    """One pass over the texts: doc_id, h, n_words, n_base, first_word, last_word, base (sorted
    distinct labels), and blocks: for each line with words of the vocabulary, its number and
    those words, distinct; line breaks with reach words on each side likewise, numbered from -1
    down. Words of lines serve the count, the phrases and the blocks."""
    rough = "|".join(p.replace(" ", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+") for p, _ in phrases)
    known = sorted(vocabulary)
    lines = F.transform(F.split(lower_az(F.coalesce("text", F.lit(""))), "\n"), lambda x: F.split(x, SEP))
    words = F.array_remove(F.flatten(lines), "")
    block = lambda x, number: F.struct(number.alias("block"), F.array_distinct(F.filter(x, lambda w: w.isin(known))).alias("words"))
    blocks = F.concat(F.transform(lines, block), F.transform(around_breaks(lines, reach), lambda x, i: block(x, -1 - i)))
    d = docs.select(
        "doc_id",
        doc_hash().alias("h"),
        F.size(words).cast("long").alias("n_words"),
        F.when(F.col("text").rlike(f"(?i)(?:{rough})"), words).alias("words"),
        F.filter(blocks, lambda b: F.size(b["words"]) > 0).alias("blocks"),
    )

    def places(phrase: str) -> Column:
        want = phrase.split()
        n = F.size("words") - len(want)
        fits = lambda i: F.array(*[F.get("words", (i + k).cast("int")) for k in range(len(want))]) == F.array(*map(F.lit, want))
        found = F.when(F.col("words").isNotNull() & (n >= 0), F.filter(F.sequence(F.lit(0), n), fits))
        return F.coalesce(found, F.array().cast("array<int>"))

    for k, (phrase, _) in enumerate(phrases):
        d = d.withColumn(f"at{k}", places(phrase))
    ats = [f"at{k}" for k in range(len(phrases))]
    every = F.concat(*ats)
    labels = F.array(*[F.when(F.size(a) > 0, label) for a, (_, label) in zip(ats, phrases, strict=True)])
    return d.select(
        "doc_id",
        "h",
        "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.filter(labels, lambda x: x.isNotNull()))).alias("base"),
        "blocks",
    )


def containment_join(blocks: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = CONTAINMENT) -> DataFrame:
    """blocks: doc_id, h, block, words (distinct template words of a block). Every block and
    template at or above the threshold: doc_id, h, block, template, label, containment."""
    spark = blocks.sparkSession
    sets = [template_words(t) for _, t in templates]
    vocabulary = {w for s in sets for w in s}
    # One row a template word: bounded by the templates, whatever the corpus.
    counted = dict(blocks.select(F.explode("words").alias("w")).groupBy("w").count().collect())
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counted.get(w, 0), w)))}
    ordered = [sorted(s, key=rank.get) for s in sets]
    index: list[tuple] = []
    for k, ((label, _), s) in enumerate(zip(templates, ordered, strict=True)):
        need = math.ceil(threshold * len(s) - 1e-9)
        index += [(w, k, label, i, len(s), need, s) for i, w in enumerate(s[: len(s) - need + 1])]
    probe_words = sorted({row[0] for row in index})
    schema = "word string, template int, label string, at int, n int, need int, template_words array<string>"
    index = materialize(spark.createDataFrame(index, schema), "license-index")
    in_order = F.array(*map(F.lit, sorted(vocabulary, key=rank.get)))
    hits = blocks.filter(F.arrays_overlap("words", F.array(*map(F.lit, probe_words))))
    # Block words in corpus order: a probe word's place follows from it.
    hits = hits.withColumn("words", F.array_intersect(in_order, F.col("words")))
    probes = hits.select("doc_id", "h", "block", "words", F.size("words").alias("m"), F.posexplode("words").alias("j", "word"))
    pairs = probes.join(broadcast_if_small(index), "word")
    room = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("j"))
    shared = F.array_intersect("words", "template_words")
    first = F.element_at(shared, 1) == F.col("word")  # a pair counts once, at its first shared word
    pairs = pairs.filter((F.col("m") >= F.col("need")) & (room >= F.col("need")) & first & (F.size(shared) >= F.col("need")))
    return pairs.select("doc_id", "h", "block", "template", "label", (F.size(shared) / F.col("n")).alias("containment"))


def license_scan(
    docs: DataFrame,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    threshold: float = CONTAINMENT,
) -> DataFrame:
    """One row per row of docs: n_words, the phrase places, base and all labels, and score: 1
    for a phrase, else the largest containment, else 0."""
    docs = docs.select("doc_id", "text")
    vocabulary = {w for _, t in templates for w in template_words(t)}
    longest = max((len(re.findall("[a-z0-9]+", t.lower())) for _, t in templates), default=1)
    base = materialize(scan(docs, phrases, sorted(vocabulary), longest - 1), "license-scan")
    blocks = base.select("doc_id", "h", F.explode("blocks").alias("b")).select("doc_id", "h", "b.block", "b.words")
    found = containment_join(blocks, templates, threshold)
    found = found.groupBy(F.col("doc_id").alias("f_id"), F.col("h").alias("f_h")).agg(F.collect_set("label").alias("more"), F.max("containment").alias("most"))
    out = base.join(found, F.col("doc_id").eqNullSafe(F.col("f_id")) & F.col("h").eqNullSafe(F.col("f_h")), "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("most", F.lit(0.0)))
    return out.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        score.alias("score"),
    )
