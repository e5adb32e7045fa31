"""License scans: an exact set-similarity join of license templates and text blocks.

A block is a stretch of words. Its set of words contains a template if it holds at least
``threshold`` of the template's distinct words. Candidates come from an index of template
prefixes: with a template's words from the globally rarest to the commonest, a block that
reaches the threshold holds one of the first |T| - needed + 1. Length and position then bound
the possible overlap, and what is left is counted exactly.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelkit.llm.common import ascii_lower, fresh, let, strings, words

#: Words of lower-cased text: ASCII letters and digits, and whatever is not ASCII.
LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"),
           ("cc-by-nc", "cc by nc"))

TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
            "and associated documentation files"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the "
              "GNU General Public License as published by the Free Software Foundation"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "Licensed under a Creative Commons Attribution-NonCommercial International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)

MOST_TEMPLATE_WORDS = 20_000


def _split(text: str) -> list[str]:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(LICENSE_WORD, lowered)


def license_words(text: Column) -> Column:
    return words(ascii_lower(text), LICENSE_WORD)


def _blocks(ws: Column, stride: int) -> Column:
    """Overlapping stretches of ``2 * stride`` words, one at every ``stride`` words: any
    ``stride`` consecutive words lie together in one of them."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(ws) - stride - 1, F.lit(0)), F.lit(stride))
    return F.transform(starts, lambda i: F.slice(ws, i + 1, 2 * stride))


def word_counts(docs: DataFrame, vocabulary: Sequence[str], text: str = "text") -> dict[str, int]:
    """In how many documents each word of the templates stands: one row per template word."""
    found = docs.select(F.explode(F.array_intersect(
        license_words(F.col(text)), strings(vocabulary))).alias("word"))
    counts = dict.fromkeys(vocabulary, 0)
    # at most one row per word of the templates, whose number is checked
    counts.update({r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()})
    return counts


def _places(ws_text: Column, phrase: str) -> Column:
    """Numbers of the words at which the phrase starts. ``ws_text``: words, each between blanks."""
    parts = F.split(ws_text, f" {phrase}(?= )", -1)
    first = len(phrase.split(" "))
    before = F.transform(parts, lambda p: F.length(p) - F.length(F.replace(p, F.lit(" "), F.lit(""))))
    return F.when(F.contains(ws_text, F.lit(f" {phrase} ")), let(before, lambda n: F.transform(
        F.sequence(F.lit(1), F.size(n) - 1), lambda k: F.aggregate(
            F.slice(n, 1, k), F.lit(0), lambda a, x: a + x) + (k - 1) * first))).otherwise(
        F.array().cast("array<int>"))


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES,
                  phrases: Sequence[tuple[str, str]] = PHRASES, threshold: float = 0.9,
                  text: str = "text", prefix: str = "") -> DataFrame:
    """Documents with the licenses named in them.

    Adds (names after ``prefix``) ``n_words, n_base`` (all places of the phrases), ``first_word,
    last_word``, ``base_labels, labels`` (sorted arrays), ``score`` (highest share of a template, or 1
    for a phrase; 0 without labels) and ``blocks``: ``label, first_word, score`` of every
    block and template that meets the threshold.

    Null texts are empty and carry no label; texts of any length are read whole; repeated
    rows are judged alike; an empty table gives an empty table; columns of the new names
    are replaced. Templates may hold 20,000 words in all, so that their index can be a
    literal in each task: documents are not shuffled.
    """
    sets = [(label, list(dict.fromkeys(_split(body)))) for label, body in templates]
    vocabulary = sorted({w for _, s in sets for w in s})
    if sum(len(s) for _, s in sets) > MOST_TEMPLATE_WORDS:
        raise ValueError(f"templates hold more than {MOST_TEMPLATE_WORDS} words")
    counts = word_counts(docs, vocabulary, text)
    rank = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (counts[w], w)))}
    ordered = [(label, sorted(s, key=rank.get)) for label, s in sets]
    needed = [math.ceil(threshold * len(s) - 1e-9) for _, s in ordered]
    index: dict[str, list[tuple[int, int]]] = {}
    for t, (_, s) in enumerate(ordered):
        for place, word in enumerate(s[:len(s) - needed[t] + 1]):
            index.setdefault(word, []).append((t, place))
    stride = max((len(_split(body)) for _, body in templates), default=1)
    by_rank = strings(sorted(vocabulary, key=rank.get))

    shape = "struct<label:string,first_word:bigint,score:double>"
    prefix_words = strings(sorted(index, key=rank.get))

    def matches(block: Column, number: Column) -> Column:
        # the block's template words from rarest to commonest
        known = F.array_intersect(by_rank, block)

        def of(held: Column) -> Column:
            first = F.array_intersect(prefix_words, held)

            def against(t: int) -> Column:
                label, s = ordered[t]
                # positional filter: the rarest common prefix word bounds what can still agree
                bound = F.coalesce(*[F.when(
                    F.array_contains(first, w), F.least(
                        F.lit(len(s) - place), F.size(held) - F.array_position(held, w).cast("int") + 1))
                    for place, w in enumerate(s[:len(s) - needed[t] + 1])], F.lit(0))
                common = F.size(F.array_intersect(strings(s), held))
                return F.when((F.size(held) >= needed[t]) & (bound >= needed[t]) & (common >= needed[t]),
                              F.struct(F.lit(label).alias("label"), (number * stride).cast("bigint").alias("first_word"),
                                       (common / float(len(s))).alias("score")))

            return F.when(F.size(first) > 0, F.filter(
                F.array(*[against(t) for t in range(len(ordered))]), lambda m: m.isNotNull()))

        return let(known, of)

    def blocks_of(ws: Column) -> Column:
        if not ordered:
            return F.array().cast(f"array<{shape}>")
        # blocks without a prefix word of any template are no candidates
        near = F.filter(F.transform(_blocks(ws, stride), lambda b, i: F.struct(b.alias("b"), i.alias("i"))),
                        lambda x: F.arrays_overlap(x["b"], prefix_words))
        return F.flatten(F.filter(F.transform(near, lambda x: matches(x["b"], x["i"])),
                                  lambda m: m.isNotNull()))

    def facts(ws: Column) -> Column:
        joined = F.concat(F.lit(" "), F.array_join(ws, " "), F.lit(" "))
        return F.struct(
            F.size(ws).cast("bigint").alias("n"), blocks_of(ws).alias("blocks"),
            let(joined, lambda j: F.array(*[F.struct(F.lit(label).alias("label"), _places(j, p).alias("places"))
                                            for label, p in phrases])).alias("base"))

    facts_name, = fresh(docs, "facts")
    f = F.col(facts_name)
    at = F.flatten(F.transform(f["base"], lambda b: b["places"]))
    base_labels = F.array_sort(F.array_distinct(F.transform(
        F.filter(f["base"], lambda b: F.size(b["places"]) > 0), lambda b: b["label"])))
    labels = F.array_sort(F.array_union(base_labels, F.transform(f["blocks"], lambda b: b["label"])))
    score = F.when(F.size(at) > 0, F.lit(1.0)).otherwise(
        F.coalesce(F.array_max(F.transform(f["blocks"], lambda b: b["score"])), F.lit(0.0)))
    return (docs.withColumn(facts_name, let(license_words(F.coalesce(F.col(text), F.lit(""))), facts))
            .withColumns({prefix + "n_words": f["n"], prefix + "n_base": F.size(at).cast("bigint"),
                          prefix + "first_word": F.array_min(at).cast("bigint"),
                          prefix + "last_word": F.array_max(at).cast("bigint"),
                          prefix + "base_labels": base_labels, prefix + "labels": labels,
                          prefix + "score": score, prefix + "blocks": f["blocks"]})
            .drop(facts_name))
