"""License scan: exact set-similarity join of text blocks with license templates, in built-in functions only.

Blocks are the lines of a text and, so that a line break inside a notice hides nothing, for every template all runs of
consecutive words of the text that are 1 / threshold times as long as the template. A block matches a template when it
holds at least ``threshold`` of the template's distinct words. Template words are ordered by the number of texts that
hold them, rarest first. A matching block must hold a word of the template's prefix (its rarest |T| - need + 1 words), so
only blocks with a prefix word are joined; length and position filters cut the rest before the exact overlap is computed.
A block holds no word that its text lacks, so the same filters first decide which texts are cut into blocks at all; runs
are looked for in overlapping pieces of these. Only the templates (a fixed list) are broadcast, and only their words'
frequencies are collected.

Defined cases: null and empty texts have no words, no labels and score 0; blocks without words match nothing;
repeated rows get the same labels each; a null doc_id is kept; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The phrases of the contract.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Public license notices, by label.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]
THRESHOLD = 0.9
#: Words from the start of one piece of a text to the start of the next.
PIECE = 200


def template_words(text: str) -> list[str]:
    return sorted({w for w in re.split(SEPARATORS, text.lower()) if w})


def run_words(text: str, threshold: float) -> int:
    """Length of the runs that are held against a template."""
    return math.ceil(sum(1 for w in re.split(SEPARATORS, text.lower()) if w) / threshold - 1e-9)


def lower_az(text: Column) -> Column:
    """A-Z lower-cased. lower() gives the same words here: it turns no other letter into an ASCII one but the two
    for which translate() is used."""
    odd = F.contains(text, F.lit("\u212a")) | F.contains(text, F.lit("\u0130"))
    return F.when(odd, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def normalised(text: Column) -> Column:
    """Lower-case words joined by single spaces, without outer spaces."""
    return F.trim(F.regexp_replace(lower_az(F.coalesce(text, F.lit(""))), SEPARATORS, " "))


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def phrase_places(words: Column, phrase: str) -> tuple[Column, Column, Column]:
    """Number of places, first and last start of a phrase in normalised words; 0 and nulls when it is absent."""
    framed, mark = F.concat(F.lit(" "), words, F.lit(" ")), f" {phrase} "
    doubled, wide = F.replace(framed, F.lit(" "), F.lit("  ")), f" {phrase.replace(' ', '  ')} "
    count = ((F.length(doubled) - F.length(F.replace(doubled, F.lit(wide), F.lit("")))) / len(wide)).cast("bigint")
    first = spaces(F.substring(framed, F.lit(1), F.instr(framed, mark))) - 1
    behind = F.length(framed) - F.instr(F.reverse(framed), mark[::-1]) - len(mark) + 2
    last = spaces(F.substring(framed, F.lit(1), behind)) - 1
    there = F.contains(framed, F.lit(mark))
    return F.when(there, count).otherwise(F.lit(0).cast("bigint")), F.when(there, first.cast("bigint")), F.when(there, last.cast("bigint"))


def held_words(words: Column, vocabulary: list[str]) -> Column:
    """Template words of normalised words, in vocabulary order."""
    return F.array_intersect(F.array(*map(F.lit, vocabulary)), F.split(words, " "))


def computed(df: DataFrame, name: str, column: Column) -> DataFrame:
    """df with a column that is computed once: a filter on it is not pushed below a generator, which would repeat the
    column's expression in every place that the filter names it."""
    return df.select("*", F.inline(F.array(F.struct(column.alias(name)))))


def vocabulary_of(templates: list[tuple[str, str]]) -> list[str]:
    return sorted({w for _, t in templates for w in template_words(t)})


def needed_words(text: str, threshold: float) -> int:
    return math.ceil(threshold * len(template_words(text)) - 1e-9)


def frequency_order(held: DataFrame, templates: list[tuple[str, str]]) -> list[str]:
    """All template words, rarest over the texts' ``held`` words first (ties by word); one row per word is collected."""
    counts = {r["word"]: r["n"] for r in held.select(F.explode("held").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(vocabulary_of(templates), key=lambda w: (counts.get(w, 0), w))


def likely_texts(docs: DataFrame, order: list[str], templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """The texts that hold enough words of a template: doc_id, text_hash, text, and their words in order."""
    words = computed(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), "words", normalised(F.col("text")))
    words = computed(words, "held", held_words(F.col("words"), order)).where(F.size("held") >= min(needed_words(t, threshold) for _, t in templates))
    enough = [F.size(F.array_intersect("held", F.array(*map(F.lit, template_words(t))))) >= needed_words(t, threshold) for _, t in templates]
    return words.where(reduce(lambda x, y: x | y, enough)).drop("held")


def block_words(texts: DataFrame, order: list[str]) -> DataFrame:
    """One row per line with a template word: doc_id, text_hash, and its template words in order."""
    lines = texts.select("doc_id", "text_hash", F.explode(F.split("text", "\n")).alias("line"))
    return computed(lines, "held", held_words(normalised(F.col("line")), order)).drop("line").where(F.size("held") > 0)


def piece_words(texts: DataFrame, order: list[str], longest: int) -> DataFrame:
    """As block_words, for pieces of texts with more than one line; ``piece`` holds the piece's words in order. Pieces
    overlap so that every run of up to ``longest`` words lies in one."""
    words = texts.where(F.contains("text", F.lit("\n"))).withColumn("words", F.split("words", " "))
    starts = F.sequence(F.lit(1), F.size("words"), F.lit(PIECE))
    pieces = words.select("doc_id", "text_hash", F.explode(F.transform(starts, lambda i: F.slice("words", i, PIECE + longest - 1))).alias("piece"))
    return computed(pieces, "held", F.array_intersect(F.array(*map(F.lit, order)), F.col("piece")))


def prefix_index(docs: DataFrame, order: list[str], templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """One row per template and prefix word: word, t_pos, template, label, need, t_words (in order), t_run."""
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for k, (label, text) in enumerate(templates):
        words = sorted(template_words(text), key=rank.__getitem__)
        need = needed_words(text, threshold)
        listed = ", ".join(f"'{w}'" for w in words)
        rows += [f"('{w}', {i}, {k}, '{label}', {need}, array({listed}), {run_words(text, threshold)})" for i, w in enumerate(words[: len(words) - need + 1])]
    return docs.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(word, t_pos, template, label, need, t_words, t_run)")


def match_blocks(docs: DataFrame, held: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``docs(doc_id, text)`` to doc_id, text_hash, template, label, containment of every matching block; ``held`` are the
    template words of every text."""
    order = frequency_order(held, templates)
    index = prefix_index(docs, order, templates, threshold)
    least = min(needed_words(t, threshold) for _, t in templates)
    t_size = F.size("t_words")

    def candidates(blocks: DataFrame, *kept: str) -> DataFrame:
        words = blocks.where(F.size("held") >= least).select("doc_id", "text_hash", *kept, "held", F.posexplode("held").alias("b_pos", "word"))
        size = F.size("held")
        room = F.col("t_pos") + 1 + F.least(t_size - F.col("t_pos") - 1, size - F.col("b_pos") - 1)
        near = words.join(F.broadcast(index), "word").where((size >= F.col("need")) & (room >= F.col("need")))
        return near.withColumn("overlap", F.size(F.array_intersect("held", "t_words"))).where(F.col("overlap") >= F.col("need"))

    texts = materialise(likely_texts(docs, order, templates, threshold), "license-texts")  # lines and pieces read them
    lines = candidates(block_words(texts, order))
    longest = max(run_words(t, threshold) for _, t in templates)
    runs = F.sequence(F.lit(1), F.greatest(F.size("piece") - F.col("t_run") + 1, F.lit(1)))
    best = F.array_max(F.transform(runs, lambda i: F.size(F.array_intersect("t_words", F.slice("piece", i, F.col("t_run"))))))
    wrapped = candidates(piece_words(texts, order, longest), "piece").withColumn("overlap", best).where(F.col("overlap") >= F.col("need"))
    columns = ("doc_id", "text_hash", "template", "label", (F.col("overlap") / t_size).alias("containment"))
    return lines.select(*columns).union(wrapped.select(*columns))


def license_report(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """The columns of the license contract: base phrases, and the labels of the matching blocks beside them."""
    docs = docs.select("doc_id", "text")
    words = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), normalised(F.col("text")).alias("words"))
    places = {p: phrase_places(F.col("words"), p) for p in PHRASES}
    base = words.select(
        "doc_id",
        "text_hash",
        F.when(F.col("words") == "", 0).otherwise(spaces(F.col("words")) + 1).cast("bigint").alias("n_words"),
        sum((n for n, _, _ in places.values()), F.lit(0).cast("bigint")).alias("n_base"),
        F.least(*(a for _, a, _ in places.values())).alias("first_word"),
        F.greatest(*(b for _, _, b in places.values())).alias("last_word"),
        F.array_compact(F.array(*(F.when(a.isNotNull(), F.lit(PHRASES[p])) for p, (_, a, _) in places.items()))).alias("base"),
        held_words(F.col("words"), vocabulary_of(templates)).alias("held"),
    )
    base = materialise(base, "license-words")
    found = match_blocks(docs, base, templates, threshold).groupBy("doc_id", "text_hash").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    found = found.select(F.col("doc_id").alias("f_id"), F.col("text_hash").alias("f_hash"), "more", "best")
    joined = base.join(found, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("text_hash") == F.col("f_hash")), "left")
    none = F.array().cast("array<string>")
    return joined.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", none)))), ",").alias("labels"),
        F.greatest(F.when(F.col("n_base") > 0, 1.0).otherwise(0.0), F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def oracle_sql() -> str:
    """The same result in DuckDB SQL, by comparing every line, and every run of words of the texts that hold enough of a
    template's words, with the templates."""
    rows = ", ".join(f"('{label}', [{', '.join(repr(w) for w in template_words(t))}], {needed_words(t, THRESHOLD)}, {run_words(t, THRESHOLD)})" for label, t in TEMPLATES)
    cut = "list_filter(regexp_split_to_array(translate({0}, '" + UPPER + "', '" + LOWER + r"'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    place = "list_filter(range(0, len(w)), lambda i: {0})"
    tests = {p: " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p.split())) for p in PHRASES}
    starts = ", ".join(f"{place.format(t)} AS p{k}" for k, t in enumerate(tests.values()))
    marks = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, label in enumerate(PHRASES.values()))
    return f"""
WITH templates(label, words, need, k) AS (VALUES {rows}),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
word AS (SELECT r, doc_id, {cut.format('text')} AS w FROM docs),
place AS (SELECT r, doc_id, w, {starts} FROM word),
base AS (SELECT r, doc_id, len(w) AS n_words, p0 || p1 || p2 AS p, list_filter([{marks}], lambda x: x IS NOT NULL) AS base FROM place),
line AS (SELECT r, list_distinct({cut.format('l')}) AS w FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM docs)),
likely AS (SELECT r, w, label, words, need, k FROM word JOIN docs USING (r), templates WHERE contains(text, chr(10)) AND len(list_intersect(list_distinct(w), words)) >= need),
run AS (SELECT r, label, words, need, list_distinct(w[s:s + k - 1]) AS w FROM (SELECT *, unnest(range(1, greatest(len(w) - k + 1, 1) + 1)) AS s FROM likely)),
block AS (SELECT r, w, label, words, need FROM line, templates UNION ALL SELECT r, w, label, words, need FROM run),
hit AS (SELECT r, label, len(list_intersect(w, words)) / len(words) AS c FROM block WHERE len(list_intersect(w, words)) >= need),
found AS (SELECT r, list(DISTINCT label) AS more, max(c) AS best FROM hit GROUP BY r)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(p) AS BIGINT) AS n_base,
  CAST(list_min(p) AS BIGINT) AS first_word, CAST(list_max(p) AS BIGINT) AS last_word,
  array_to_string(list_sort(list_distinct(base)), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(base || coalesce(more, []))), ',') AS labels,
  CAST(greatest(CASE WHEN len(p) > 0 THEN 1.0 ELSE 0.0 END, coalesce(best, 0.0)) AS DOUBLE) AS score
FROM base LEFT JOIN found USING (r)"""
