"""Operator 8: licence scans with DataFrame functions only.

Words (lower case, letters and digits) give five-word shingles, hashed. Templates are a
table of any length, notices and whole licence texts alike. Each shingle of a text is
joined with the templates' shingles by its hash, so no shingle is missed. A template of
m shingles cuts a text into pieces (of STRIDE shingles up to STRIDE + 1, of 1.25 m above);
two adjoining pieces are a region, and a template is found where at least ``containment``
of its distinct shingles lie in one. A run of a piece's length and one lies whole in a
region, so a text with a quarter of foreign words between a template's own is still found.

A notice's shingles with a word that starts with a digit must all be there: they hold its
version. Whole texts of near versions are both found, each with its containment. A
template of k < 5 words is one shingle of k words, searched among the texts' runs of k
words. SPDX lines give the identifiers that they name, whatever the templates.

Null and empty texts match nothing; a text of fewer than five words is one shingle of all
its words. Rows that share a doc_id are searched one by one and answered together.
"""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.session import materialize

STRIDE, SHINGLE = 16, 5
SLACK = 1.25  # a long template's piece, by its number of shingles
BROADCAST_ROWS = 2_000_000  # template shingles that are broadcast; more are left to the planner
TEXTS = Path(__file__).parent / "licence_texts"  # whole licence texts, a file for each licence

# fixed values: notices by licence
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("MPL-2.0", "subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("ISC", "Released under the ISC License."),
    ("ISC", "Licensed under the ISC License."),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-2.0", "GNU General Public License v2"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("GPL-3.0", "GNU General Public License v3"),
    ("LGPL", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("LGPL", "under the terms of the GNU Library General Public License as published by the Free Software Foundation"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("AGPL", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    *((f"CC-BY{x}-4.0", f"Licensed under CC BY{x} 4.0.") for x in ("", "-SA", "-ND", "-NC-SA", "-NC-ND")),
    *((f"CC-BY{short}-{v}", f"Creative Commons Attribution{long} {v} {port}") for v, port in (("4.0", "International"), ("3.0", "Unported"))
      for short, long in (("", ""), ("-SA", "-ShareAlike"), ("-NC", "-NonCommercial"), ("-ND", "-NoDerivatives"),
                          ("-NC-SA", "-NonCommercial-ShareAlike"), ("-NC-ND", "-NonCommercial-NoDerivatives"))),
]
SPDX = r"(?i:SPDX-License-Identifier):[ \t]*+(\(*+[A-Za-z0-9][A-Za-z0-9.+-]*+\)*+(?:[ \t]++(?:AND|OR|WITH)[ \t]++\(*+[A-Za-z0-9][A-Za-z0-9.+-]*+\)*+)*+)"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _shingles(text: Column, k: int, item) -> Column:
    """``item`` of each run of k words (a function that gives the word at an offset), in order."""
    def of(w: Column) -> Column:
        n = F.size(w)
        starts = F.sequence(F.lit(0), F.greatest(n - k, F.lit(0)))
        return F.when(n > 0, F.transform(starts, lambda i: item([F.get(w, i + j) for j in range(k)])))

    return F.element_at(F.transform(F.array(words(text)), of), 1)  # the words are made once


def shingles(text: Column, k: int = SHINGLE) -> Column:
    """The hashes of a text's shingles, in order; null for a text without words."""
    return _shingles(text, k, lambda w: F.xxhash64(*w))


def whole_texts() -> list[tuple[str, str]]:
    return [(f.stem, f.read_text(encoding="utf-8")) for f in sorted(TEXTS.glob("*.txt"))]


def template_shingles(templates: DataFrame) -> DataFrame:
    """``h, template, licence, piece, n, n_key, key``: a row for each distinct shingle of each template; ``key`` ones must be there."""
    one = _shingles(F.col("text"), SHINGLE, lambda w: F.struct(F.xxhash64(*w).alias("h"), F.concat_ws(" ", *w).rlike("(^| )[0-9]").cast("int").alias("key")))
    rows = templates.select("licence", F.xxhash64("licence", "text").alias("template"), F.explode(one).alias("x"))
    rows = materialize(rows.groupBy("licence", "template", "x.h").agg(F.max("x.key").alias("key"), F.count("*").alias("times")), "licences")
    short = F.sum("times") <= STRIDE + 1
    whole = rows.groupBy("template").agg(F.when(short, STRIDE).otherwise(F.ceil(F.sum("times") * SLACK)).cast("int").alias("piece"),
                                         F.count("*").alias("n"), F.when(short, F.sum("key")).otherwise(0).alias("n_key"))
    key = F.when(F.col("n_key") > 0, F.col("key")).otherwise(0)
    return materialize(rows.join(whole, "template").select("h", "template", "licence", "piece", "n", "n_key", key.alias("key")), "licences")


def spdx(docs: DataFrame) -> DataFrame:
    """``doc_id, licence, containment`` of the identifiers in SPDX lines (those after WITH are exceptions, no licences)."""
    line = F.explode(F.regexp_extract_all("text", F.lit(SPDX), F.lit(1))).alias("x")
    named = docs.filter(F.lower("text").contains("spdx-license-identifier:")).select("doc_id", line)
    names = F.split(F.regexp_replace(F.regexp_replace("x", r"\s+WITH\s+\S+", ""), r"[()]", ""), r"\s+(?:AND|OR)\s+")
    named = named.select("doc_id", F.explode(names).alias("licence")).select("doc_id", F.regexp_replace("licence", r"[.-]+$", "").alias("licence"))
    return named.select("doc_id", "licence", F.lit(1.0).alias("containment"))


def licences(docs: DataFrame, templates: DataFrame | list[tuple[str, str]] | None = None, containment: float = 0.8) -> DataFrame:
    """``doc_id, licence, containment``: each licence found, with the largest containment of any of its
    templates (rows ``licence, text``; the notices and whole texts given here if None)."""
    given = TEMPLATES + whole_texts() if templates is None else templates
    if not isinstance(given, DataFrame):
        given = docs.sparkSession.createDataFrame(given, "licence string, text string")
    given = given.select(F.col("licence").cast("string").alias("licence"), F.col("text").cast("string").alias("text"))
    known = template_shingles(given)
    sizes = given.select(F.size(words(F.col("text"))).alias("k")).groupBy(F.least("k", F.lit(SHINGLE)).alias("k")).count().collect()  # five rows at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", F.xxhash64("text"))
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    said = []
    for k in sorted({r["k"] for r in sizes if r["k"]} | {SHINGLE}):
        said.append(rows.select("doc_id", "row", F.posexplode(shingles(F.col("text"), k)).alias("at", "h")))
    hits = reduce(DataFrame.unionAll, said).join(known, "h")
    place = F.floor(F.col("at") / F.col("piece")).cast("int")
    hits = hits.select("doc_id", "row", "template", "licence", "n", "n_key", "key", "h", F.explode(F.array(place, place - 1)).alias("region"))
    once = hits.groupBy("doc_id", "row", "template", "licence", "n", "n_key", "region", "h").agg(F.max("key").alias("key"))
    regions = once.groupBy("doc_id", "row", "template", "licence", "n", "n_key", "region").agg(F.count("*").alias("held"), F.sum("key").alias("held_key"))
    scored = regions.filter("held_key = n_key").select("doc_id", "licence", (F.col("held") / F.col("n")).alias("containment")).filter(F.col("containment") >= containment)
    return scored.unionAll(spdx(rows)).groupBy("doc_id", "licence").agg(F.max("containment").alias("containment"))
