"""License scan: phrases at their places, and an exact set-similarity join of text blocks with license templates.

Words are maximal runs of digits, letters a-z (A-Z folded) and characters beyond ASCII.
A base phrase stands wherever its words follow each other.

The join finds every block that holds at least `percent` of a template's distinct words. A
template of n words is held against blocks of its own scale: windows of 2w words at every
w-th word, where w is the least power of two from n on, so any stretch of w words lies whole in
one block, however the text is broken into lines.

1. Of the words that templates have, Spark counts the documents that hold them, over all
   documents. This is the global order, the rarest first, the word itself for ties.
2. Prefix filter: a block with `need` of a template's t words has one of the template's first
   t - need + 1 words in that order. Texts with none of these words have no such block. Of a block,
   words that no template has are left out; its own first size - need + 1 words are its prefix.
   Prefixes meet in an equi-join on scale and word.
3. Length filter: a block has `need` such words at least. Positional filter: with the first
   shared word at two places, what can still be shared is the shorter rest.
4. Pairs that pass are verified on whole sets. The filters are necessary conditions, so the
   join loses nothing.

All of it is Spark's own functions. Texts are read twice and never shuffled: what moves are the
places of template words in suspects, grouped by document and block, whose sets are bounded by
the templates. Templates are a stated list; their tables are broadcast if they have
BROADCAST_WORDS rows at most, else joined by a shuffle.

Defined results: a null or empty text has no words, no labels and score 0. Repeated rows are
judged each on its own, also without a doc_id. An empty table gives no rows. Labels are distinct
and sorted. Extra columns are kept by `scan`; those with names of its own (NEW) are dropped.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, counted_at_most, save, table, unused

#: Base phrases and their labels.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
#: Templates (label, text), notices and the openings of license texts.
TEMPLATES = [
    ("agpl-3.0", "GNU Affero General Public License, version 3"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("proprietary", "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NEW = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
#: Rows of a word and a few numbers.
BROADCAST_WORDS = 100_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def plain_words(text: str) -> list[str]:
    """The words of a template, as `words_of` cuts them."""
    return [w for w in re.split(GAP, text.translate({k: k + 32 for k in range(65, 91)})) if w]


def template_rows(templates: list[tuple[str, str]], percent: int) -> list[tuple[int, str, int, int, list[str]]]:
    """(number, label, scale, need, distinct words) of each template with a word."""
    out = []
    for k, (label, text) in enumerate(templates):
        if ws := plain_words(text):
            out.append((k, label, 1 << (len(ws) - 1).bit_length(), -(-percent * len(set(ws)) // 100), sorted(set(ws))))
    return out


def places(ws: Column, phrase: list[str]) -> Column:
    """Where the words of a phrase follow each other in the array `ws` (from 0)."""
    stands = lambda i: reduce(lambda a, b: a & b, [F.get(ws, i + k) == w for k, w in enumerate(phrase)])
    found = F.filter(F.sequence(F.lit(0), F.size(ws) - len(phrase)), stands)
    # Few texts have all the words; only those are gone through.
    has = reduce(lambda a, b: a & b, [F.array_contains(ws, w) for w in sorted(set(phrase))])
    return F.when(has & (F.size(ws) >= len(phrase)), found).otherwise(F.array().cast("array<int>"))


def _matches(rows: DataFrame, rid: str, placed: str, templates: list[tuple[int, str, int, int, list[str]]], rank: dict[str, int]) -> DataFrame:
    """rows (rid, placed: template words and their places) -> one row a block and template that meet: rid, label, scale, block, n_shared, containment."""
    spark = rows.sparkSession
    ordered = [(k, label, scale, need, sorted(rank[w] for w in ws)) for k, label, scale, need, ws in templates]
    small = sum(len(r) for *_, r in ordered) <= BROADCAST_WORDS
    side = lambda data, schema: F.broadcast(spark.createDataFrame(data, schema)) if small else spark.createDataFrame(data, schema)
    numbers = side([(w, r) for w, r in rank.items()], "w string, r int")
    prefixes = side([(scale, r, k, at, len(own), need) for k, _, scale, need, own in ordered for at, r in enumerate(own[: len(own) - need + 1])], "scale int, r int, t int, t_at int, t_size int, need int")
    whole = side([(k, label, need, own) for k, label, _, need, own in ordered], "t int, label string, t_need int, own array<int>")
    least: dict[int, int] = {}
    for _, _, scale, need, _ in ordered:
        least[scale] = min(need, least.get(scale, need))

    at = F.explode(F.col(placed)).alias("p")
    words = rows.where(F.col(placed).isNotNull()).select(F.col(rid).alias("rid"), at).select("rid", F.col("p.w").alias("w"), F.col("p.i").alias("i")).join(numbers, "w")
    block = lambda s, back: F.struct(F.lit(s).alias("scale"), (F.floor(F.col("i") / s).cast("int") - back).alias("block"))
    words = words.select("rid", "r", F.explode(F.array(*[block(s, back) for s in least for back in (0, 1)])).alias("b")).select("rid", "r", "b.*").where("block >= 0")
    blocks = words.groupBy("rid", "scale", "block").agg(F.sort_array(F.collect_set("r")).alias("own_b"))
    size, need = F.size("own_b"), reduce(lambda c, s: c.when(F.col("scale") == s, least[s]), least, F.when(F.lit(False), 0))
    blocks = blocks.where(size >= need)
    entries = blocks.select("rid", "scale", "block", "own_b", F.posexplode(F.slice("own_b", 1, size - need + 1)).alias("b_at", "r"))
    shorter_rest = F.least(F.col("t_size") - F.col("t_at"), size - F.col("b_at"))
    pairs = entries.join(prefixes, ["scale", "r"]).where((size >= F.col("need")) & (F.col("b_at") <= size - F.col("need")) & (shorter_rest >= F.col("need")))
    pairs = pairs.groupBy("rid", "scale", "block", "t").agg(F.first("own_b").alias("own_b")).join(whole, "t")
    shared = F.size(F.array_intersect("own_b", "own"))
    pairs = pairs.select("rid", "label", "scale", "block", shared.alias("n_shared"), F.size("own").alias("t_size"), "t_need").where("n_shared >= t_need")
    return pairs.select("rid", "label", "scale", "block", "n_shared", (F.col("n_shared") / F.col("t_size")).alias("containment"))


def scan(docs: DataFrame, base: list[tuple[str, str]] = BASE, templates: list[tuple[str, str]] = TEMPLATES, percent: int = 90, keep: list[str] | None = None) -> DataFrame:
    """docs (text) with n_words, n_base, first_word, last_word, base_labels, labels, score and matches.

    score: the greatest containment of a template, 1 where a base phrase stands, else 0. matches:
    for each label the words of the first block that meets one of its templates (label, start, words).
    keep: the columns of docs that go on (all); they are written once on the way.
    """
    known = template_rows(templates, percent)
    vocabulary = sorted({w for *_, ws in known for w in ws})
    kept = [c for c in keep or docs.columns if c.lower() not in NEW]
    rid, ws, placed = (unused(kept, c) for c in ("_rid", "_ws", "_placed"))
    texts = docs.select(*kept, words_of(F.col("text")).alias(ws))

    # The global order: a row a word of the templates comes to the driver.
    held = docs.select(F.explode(F.array_distinct(F.filter(words_of(F.col("text")), lambda w: w.isin(vocabulary)))).alias("w")).groupBy("w").count()
    counts = {r["w"]: r["count"] for r in held.collect()}
    rank = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    first = sorted({w for _, _, _, need, own in known for w in sorted(own, key=rank.get)[: len(own) - need + 1]})

    suspect = F.exists(ws, lambda w: w.isin(first))
    with_place = F.filter(F.transform(ws, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(vocabulary))
    starts = {label: places(F.col(ws), plain_words(phrase)) for phrase, label in base}
    found = [unused(kept, f"_base{k}") for k in range(len(base))]
    rows = texts.select(*kept, F.size(ws).cast("long").alias("n_words"), F.when(suspect, with_place).alias(placed), *[p.alias(c) for p, c in zip(starts.values(), found, strict=True)])
    all_starts, labels = F.flatten(F.array(*found)), F.array(*[F.when(F.size(c) > 0, label) for c, (_, label) in zip(found, base, strict=True)])
    rows = rows.select(
        *kept, "n_words", placed, F.size(all_starts).cast("long").alias("n_base"), F.array_min(all_starts).cast("long").alias("first_word"),
        F.array_max(all_starts).cast("long").alias("last_word"), F.array_sort(F.array_distinct(F.array_compact(labels))).alias("base_labels"),
    )
    rows = save(rows.withColumn(rid, F.monotonically_increasing_id()), "places")
    block = F.struct("label", (F.col("block") * F.col("scale")).cast("long").alias("start"), (2 * F.col("scale")).cast("long").alias("words"))
    own = _matches(rows.select(rid, placed), rid, placed, known, rank).groupBy("rid", "label").agg(F.min(block).alias("m"), F.max("containment").alias("c"))
    own = own.groupBy("rid").agg(F.sort_array(F.collect_list("m")).alias("matches"), F.max("c").alias("c"))  # a row a label
    out = rows.join(own.withColumnsRenamed({"rid": "_r", "matches": "_m", "c": "_c"}), F.col(rid) == F.col("_r"), "left")
    matches = F.coalesce("_m", F.array().cast("array<struct<label:string,start:bigint,words:bigint>>"))
    labels = F.array_sort(F.array_union("base_labels", F.transform(matches, lambda m: m["label"])))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("_c", F.lit(0.0)))
    return out.select(*kept, "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), score.alias("score"), matches.alias("matches"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_places(phrase: str) -> str:
    return "list_filter(range(1, len(ws) + 1), lambda k: " + " AND ".join(f"ws[k + {k}] = {_sql_text(w)}" for k, w in enumerate(plain_words(phrase))) + ")"


OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{GAP}'), lambda s: s <> '') AS ws FROM documents),
     b AS (SELECT r, doc_id, len(ws) AS n_words, {", ".join(f"{_sql_places(p)} AS p{k}" for k, (p, _) in enumerate(BASE))} FROM d),
     t(t, label, scale, need, size, w) AS (VALUES {", ".join(f"({k}, {_sql_text(label)}, {scale}, {need}, {len(ws)}, {_sql_text(w)})" for k, label, scale, need, ws in template_rows(TEMPLATES, 90) for w in ws)}),
     p AS (SELECT r, w, i FROM (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d) WHERE w IN (SELECT w FROM t)),
     h AS (SELECT r, label, count(DISTINCT w) / size::DOUBLE AS c FROM (SELECT r, i, t.*, i // scale - back AS block FROM p JOIN t USING (w), (VALUES (0), (1)) v(back)) WHERE block >= 0 GROUP BY r, t, label, need, size, block HAVING count(DISTINCT w) >= need),
     m AS (SELECT r, list(DISTINCT label) AS found, max(c) AS c FROM h GROUP BY r),
     x AS (SELECT b.*, list_concat({", ".join(f"p{k}" for k in range(len(BASE)))}) AS places, list_filter([{", ".join(f"CASE WHEN len(p{k}) > 0 THEN {_sql_text(label)} END" for k, (_, label) in enumerate(BASE))}], lambda s: s IS NOT NULL) AS own, found, c FROM b LEFT JOIN m ON b.r = m.r)
SELECT doc_id, n_words, len(places)::BIGINT AS n_base, list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word, array_to_string(list_sort(own), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(own, coalesce(found, [])))), ',') AS labels, CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0)::DOUBLE END AS score FROM x
"""
