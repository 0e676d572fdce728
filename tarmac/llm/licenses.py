"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

A file's text is cut into statements (lines, and sentences in them). Each statement, and the whole of a licence file, is a sparse vector of term counts times inverse document frequency, and is compared with the templates' vectors by cosine. The frequencies of the templates' terms are counted over all texts; a term that no template has weighs as much as a template's term does on average, so that text around a licence's words lowers the cosine.

Statements that cannot reach the threshold are not compared: the terms a statement must have at least one of are found from the templates' own weights (without those terms even a perfect match of all others stays below it), and only texts having one are cut up.

A file named as a licence is also compared as a whole with the full texts of licences (``license_texts``): terms weigh by 1 + ln of their count and by their rarity among these texts, lines that name a copyright holder are left out, and at ``whole`` or more the nearest text is the file's licence, whatever its single statements say (such as a title without a version). Files with fewer different terms than any match needs are not compared.

A directory has the licence of its best licence file, matches of whole texts first. A file without a statement of its own inherits from the nearest ancestor directory that has one; ancestors are worked out for each directory once, and joined by path.

All steps are DataFrame functions. Only the templates' weights are broadcast; their number is fixed. Texts are never shuffled.

Defined cases: a null or empty text states nothing and may inherit; a null path has no directory and inherits nothing; rows of one path are one file, of which the best statement counts, and each is returned; among equal cosines the licence first in the alphabet wins, among equal licence files the first path; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import cache
from importlib.resources import files as resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm.common import apart, documents, written

# Usual licence statements, by SPDX identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work (CC0 1.0)."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
LICENSE_FILE = r"^(?i:licen[cs]e|copying|unlicense|notice)([.\-_].*)?$"
_STATEMENT = r"[\n\r]+|(?<=[.!?])[ \t]+(?=[A-Z])"
_TERM = "[^a-z0-9]+"
#: A line that names a copyright holder; read alike by Java and (as ASCII) by Python.
_HOLDER = r"(?im)^\W*copyright\W+(c\b|[0-9]).*$"


def terms(text: str) -> dict[str, int]:
    found: dict[str, int] = {}
    for t in re.split(_TERM, text.lower()):
        if t:
            found[t] = found.get(t, 0) + 1
    return found


@dataclass
class Weights:
    """idf by term, and the unit vector of each template."""

    idf: dict[str, float]
    other: float
    vectors: list[dict[str, float]]

    @classmethod
    def of(cls, templates: tuple[tuple[str, str], ...], frequency: dict[str, int], texts: int) -> Weights:
        counts = [terms(t) for _, t in templates]
        names = sorted(set().union(*counts))
        idf = {t: math.log((1 + texts) / (1 + frequency.get(t, 0))) + 1 for t in names}
        vectors = []
        for c in counts:
            norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
            vectors.append({t: n * idf[t] / norm for t, n in c.items()})
        return cls(idf, sum(idf.values()) / max(1, len(idf)), vectors)

    def needed(self, threshold: float) -> list[str]:
        """Terms of which any statement that reaches ``threshold`` has one: without them, what is left of each template's unit vector is shorter than that."""
        found: set[str] = set()
        for v in self.vectors:
            # most selective first: the fewer texts have a term, the better
            left = sum(w * w for t, w in v.items() if t not in found)
            for t in sorted((t for t in v if t not in found), key=lambda t: (-self.idf[t], t)):
                if left < (threshold - 1e-9) ** 2:
                    break
                found.add(t)
                left -= v[t] ** 2
        return sorted(found)


def damped(text: str, idf: dict[str, float], other: float) -> dict[str, float]:
    """The vector of a whole text."""
    return {t: (1 + math.log(n)) * idf.get(t, other) for t, n in terms(re.sub(_HOLDER, " ", text, flags=re.ASCII)).items()}


@cache
def full_texts() -> tuple[tuple[tuple[str, str], ...], Weights]:
    """(licence, full text) in order, and their weights."""
    texts = tuple(sorted((f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")) for f in resources("tarmac.llm").joinpath("license_texts").iterdir() if f.name.endswith(".txt")))
    counts = [terms(re.sub(_HOLDER, " ", t, flags=re.ASCII)) for _, t in texts]
    idf = {t: math.log((1 + len(texts)) / (1 + sum(t in c for c in counts))) + 1 for t in sorted(set().union(*counts))}
    other = sum(idf.values()) / len(idf)
    vectors = []
    for _, t in texts:
        v = damped(t, idf, other)
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({t: x / norm for t, x in v.items()})
    return texts, Weights(idf, other, vectors)


def fewest_terms(vectors: list[dict[str, float]], threshold: float) -> int:
    """A text with fewer different terms reaches ``threshold`` with no vector: the heaviest terms of a unit vector, so many of them, are shorter than that."""
    least = []
    for v in vectors:
        left, n = (threshold - 1e-6) ** 2, 0
        for w in sorted(v.values(), reverse=True):
            if left <= 0:
                break
            left, n = left - w * w, n + 1
        least.append(n)
    return min(least)


def _words(text: Column) -> Column:
    return F.split(F.lower(text), _TERM)


def weights_of(texts: DataFrame, templates: tuple[tuple[str, str], ...], text: str = "text") -> Weights:
    names = sorted(set().union(*(terms(t) for _, t in templates)))
    known = F.array(*[F.lit(t) for t in names])
    counted = texts.select(F.explode(F.array_intersect(_words(F.col(text)), known)).alias("term")).groupBy("term").count()
    # one row for each term of the templates
    return Weights.of(templates, {r["term"]: r["count"] for r in counted.collect()}, texts.count())


def stated(files: DataFrame, weights: Weights, templates: tuple[tuple[str, str], ...], threshold: float, path: str = "path", text: str = "text") -> DataFrame:
    """of_path, license, similarity: the best statement of each file that has one of at least ``threshold``."""
    spark = files.sparkSession
    rows = [(i, t, w) for i, v in enumerate(weights.vectors) for t, w in v.items()]
    vectors = F.broadcast(spark.createDataFrame(rows, "template int, vector_term string, weight double"))
    idf = F.broadcast(spark.createDataFrame(list(weights.idf.items()), "known_term string, idf double"))
    needed = weights.needed(threshold)
    some = lambda c: F.lower(c).rlike("(^|[^a-z0-9])(" + "|".join(needed) + ")([^a-z0-9]|$)")
    body = F.coalesce(F.col(text), F.lit(""))
    whole = F.when(F.regexp_extract(F.col(path), "([^/]*)$", 1).rlike(LICENSE_FILE), F.array(body)).otherwise(F.array().cast("array<string>"))
    part = files.filter(some(body)).select(F.col(path).alias("of_path"), F.explode(F.array_distinct(F.concat(F.split(body, _STATEMENT), whole))).alias("part")).filter(some(F.col("part")))
    counted = (
        part.withColumn("id", F.sha2("part", 256)).select("of_path", "id", F.explode(_words(F.col("part"))).alias("term")).filter("term <> ''")
        .groupBy("of_path", "id", "term").agg(F.count(F.lit(1)).alias("n"))
    )
    # both the lengths and the products are taken from it, and few texts have any; so texts are cut up once
    rated = written(counted, "licenses-terms").join(idf, F.col("term") == F.col("known_term"), "left").withColumn("value", F.col("n") * F.coalesce("idf", F.lit(weights.other)))
    norm = rated.groupBy("of_path", "id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm")).toDF("norm_path", "norm_id", "norm")
    dot = rated.join(vectors, F.col("term") == F.col("vector_term")).groupBy("of_path", "id", "template").agg(F.sum(F.col("value") * F.col("weight")).alias("dot"))
    names = F.array(*[F.lit(k) for k, _ in templates])
    near = dot.join(norm, F.col("of_path").eqNullSafe(F.col("norm_path")) & (F.col("id") == F.col("norm_id")))
    near = near.select("of_path", F.element_at(names, F.col("template") + 1).alias("license"), F.round(F.col("dot") / F.col("norm"), 6).alias("similarity")).filter(F.col("similarity") >= threshold)
    best = near.groupBy("of_path", "license").agg(F.max("similarity").alias("similarity"))
    return best.groupBy("of_path").agg(F.min(F.struct((-F.col("similarity")).alias("order"), "license", "similarity")).alias("best")).select("of_path", "best.license", "best.similarity")


def matched(files: DataFrame, threshold: float, path: str = "path", text: str = "text") -> DataFrame:
    """of_path, license, similarity: the nearest full text of each file named as a licence that matches one as a whole."""
    spark = files.sparkSession
    texts, weights = full_texts()
    vectors = F.broadcast(spark.createDataFrame([(i, t, w) for i, v in enumerate(weights.vectors) for t, w in v.items()], "template int, vector_term string, weight double"))
    idf = F.broadcast(spark.createDataFrame(list(weights.idf.items()), "known_term string, idf double"))
    names = F.array(*[F.lit(k) for k, _ in texts])
    named = files.filter(F.regexp_extract(F.col(path), "([^/]*)$", 1).rlike(LICENSE_FILE)).select(F.col(path).alias("of_path"), F.regexp_replace(text, _HOLDER, " ").alias("body"))
    terms_of = named.select("of_path", F.sha2("body", 256).alias("id"), _words(F.col("body")).alias("words")).filter(F.size(F.array_distinct("words")) >= fewest_terms(weights.vectors, threshold))
    one = terms_of.groupBy("of_path", "id").agg(F.first("words").alias("words")).select("of_path", "id", F.explode("words").alias("term")).filter("term <> ''")
    counted = written(one.groupBy("of_path", "id", "term").agg(F.count(F.lit(1)).alias("n")), "licenses-whole")
    rated = counted.join(idf, F.col("term") == F.col("known_term"), "left").withColumn("value", (F.log("n") + 1) * F.coalesce("idf", F.lit(weights.other)))
    norm = rated.groupBy("of_path", "id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm")).toDF("norm_path", "norm_id", "norm")
    dot = rated.join(vectors, F.col("term") == F.col("vector_term")).groupBy("of_path", "id", "template").agg(F.sum(F.col("value") * F.col("weight")).alias("dot"))
    near = dot.join(norm, (F.col("of_path") == F.col("norm_path")) & (F.col("id") == F.col("norm_id")))
    near = near.select("of_path", F.element_at(names, F.col("template") + 1).alias("license"), F.round(F.col("dot") / F.col("norm"), 6).alias("similarity")).filter(F.col("similarity") >= threshold)
    return near.groupBy("of_path").agg(F.min(F.struct((-F.col("similarity")).alias("order"), "license", "similarity")).alias("best")).select("of_path", "best.license", "best.similarity")


def scanned(files: DataFrame, threshold: float = 0.6, templates: tuple[tuple[str, str], ...] = TEMPLATES, key: str = "doc_id", path: str = "path", text: str = "text", whole: float = 0.9) -> DataFrame:
    """key, path, license, similarity, origin ("stated", "inherited" or null) and inherited_from (the directory) for every row."""
    weights = weights_of(files, templates, text)
    found = matched(files, whole, path, text).withColumn("part", F.lit(0)).unionByName(stated(files, weights, templates, threshold, path, text).withColumn("part", F.lit(1)))
    best = found.groupBy("of_path").agg(F.min(F.struct("part", "license", "similarity")).alias("best"))
    own = written(best.select("of_path", "best.part", "best.license", "best.similarity"), "licenses-stated")
    folder = lambda c: F.regexp_replace(c, "/?[^/]*$", "")
    held = (
        own.filter(F.regexp_extract("of_path", "([^/]*)$", 1).rlike(LICENSE_FILE))
        .groupBy(folder(F.col("of_path")).alias("held_in"))
        .agg(F.min(F.struct("part", (-F.col("similarity")).alias("order"), "of_path", "license", "similarity")).alias("best"))
        .select("held_in", F.col("best.license").alias("held_license"), F.col("best.similarity").alias("held_similarity"))
    )
    rows = files.select(F.col(key).alias("own_key"), F.col(path).alias("own_path"), folder(F.col(path)).alias("own_folder"))
    # every ancestor of each different directory, itself included: a, a/b, a/b/c and the root
    step = F.split("own_folder", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(step)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(step, F.lit(1), n), "/").alias("ancestor")))
    up = F.when(F.col("own_folder") == "", F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("ancestor")))).otherwise(up)
    folders = rows.filter("own_folder IS NOT NULL").select("own_folder").distinct().select("own_folder", F.explode(up).alias("up"))
    nearest = (
        folders.join(held, F.col("up.ancestor") == F.col("held_in"))
        .groupBy("own_folder")
        .agg(F.max(F.struct("up.depth", "held_in", "held_license", "held_similarity")).alias("near"))
        .select(apart(F.col("own_folder"), text=True).alias("near_folder"), "near")  # a folder may have very many files
    )
    joined = rows.join(own, F.col("own_path") == F.col("of_path"), "left").join(nearest, F.col("own_folder") == F.col("near_folder"), "left")
    got, inherits = F.col("license").isNotNull(), F.col("near").isNotNull()
    return joined.select(
        F.col("own_key").alias(key), F.col("own_path").alias(path),
        F.coalesce("license", "near.held_license").alias("license"), F.coalesce("similarity", "near.held_similarity").alias("similarity"),
        F.when(got, "stated").when(inherits, "inherited").alias("origin"), F.when(~got, F.col("near.held_in")).alias("inherited_from"),
    )


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document. Documents have no paths, so each is put in source/lang under its id; texts of up to 400 characters count as notices of their directory (named LICENSE.id)."""
    name = F.when(F.length("text") <= 400, F.concat(F.lit("LICENSE."), F.col("doc_id").cast("string"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    files = documents(spark, sf_dir).select("doc_id", "text", F.concat_ws("/", "source", "lang", name).alias("path"))
    return scanned(files)
