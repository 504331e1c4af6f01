"""License scan by MinHash bands over overlapping text windows, in DataFrame operations only.

Texts are cut into lower-case words; a shingle is ``SHINGLE`` words in a row. A window's set are its shingles that
occur in some template: all others are in no template and could only lower a similarity, so windows
without such a shingle, nearly all, are never built.

Retrieval. Templates of like size (within a factor ``STEP``) share a window length. Windows overlap by half, and half a
window holds a whole copy, slack included, so each copy lies in some window whole. A window's sketch are ``BANDS``
minima, each a band of one row; a band that a window shares with a template of its length retrieves the template. A
window with a copy that counts has a similarity of at least :func:`least_similarity`, however many other
templates' shingles fill its rest, so it is retrieved with probability :func:`collision` of that, over 0.9999.

Verification. Each shingle of a retrieved template in the window suggests the place of a copy. The share of the
template's distinct shingles that the text has there, a few words more on either side (:func:`slack`), must reach
``CONTAINED``. A shingle that lies a whole copy away from its place in the template belongs to a neighbour copy and
does not count. Places of a template nearer than most of a copy are one copy: the one contained most, then the best
aligned, counts, then the best of those that are left. Of several templates found from the same word on, the one
contained most, then the longest, counts.

Rows: null and empty texts have no matches. Matches are found per distinct text (by a 128-bit digest) and given to each
of its rows, so repeated rows and null ids are kept, each with its matches. Extra columns are not read. Templates are a
bounded, given table of a few hundred rows at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from jobtide.session import cut

SHINGLE, CONTAINED, SLACK = 3, 0.8, 4
BANDS, STEP = 48, 1.25
WORDS = r"[^a-z0-9.+-]+"

# Notices and passages of public licenses.
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                         "compliance with the License. You may obtain a copy of the License at "
                         "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
                         "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
                         "CONDITIONS OF ANY KIND, either express or implied.",
    "MIT line": "Released under the MIT License.",
    "MIT permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                      "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
                      "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
                      "the Software, and to permit persons to whom the Software is furnished to do so",
    "BSD redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                          "that the following conditions are met",
    "BSD-3-Clause line": "Licensed under the BSD 3-Clause License.",
    "ISC permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
                      "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-3.0 line": "This file is distributed under the GNU General Public License, version 3.",
    "GPL-3.0 short": "under the GNU General Public License, version 3.",
    "GPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                      "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                      "option) any later version.",
    "GPL-2.0 short": "under the GNU General Public License, version 2.",
    "LGPL short": "under the GNU Lesser General Public License.",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0 line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0 line": "Licensed under CC BY-ND 4.0.",
    "CC0 line": "Released under CC0 1.0 Universal.",
    "All rights reserved": "All rights reserved. No part of this publication may be reproduced",
}


def slack(size: int) -> int:
    """Words on either side of a template of ``size`` shingles in which its shingles still count."""
    return min(SLACK, size // 4)


def half_window(size: int) -> int:
    """Half the window length, in shingles, for templates of ``size`` shingles."""
    largest = max(size, math.floor(STEP ** math.ceil(round(math.log(size, STEP), 9))))
    return largest + 2 * slack(largest)


def least_similarity(size: int) -> float:
    """Of a window that holds a copy and has template shingles in every other place."""
    held = math.ceil(CONTAINED * size - 1e-9)
    return held / (size + 2 * half_window(size) - held)


def collision(similarity: float) -> float:
    """Probability that sketches of ``BANDS`` minima share one."""
    return 1 - (1 - similarity) ** BANDS


def words_of(text: Column) -> Column:
    """Lower-case words; a full stop or hyphen counts only inside one."""
    cleaned = F.regexp_replace(F.lower(text), r"[.+-]+(?![a-z0-9])|(?<![a-z0-9])[.+-]+", " ")
    return F.filter(F.split(cleaned, WORDS), lambda w: w != "")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once a row, also where the optimizer repeats or inlines."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shingles_of(text: Column) -> Column:
    """64-bit hashes of the shingles of a text by position."""
    def hashed(words: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(words) - SHINGLE)
        return F.when(F.size(words) >= SHINGLE, F.transform(places, lambda i: F.xxhash64(
            *[F.get(words, i + n) for n in range(SHINGLE)]))).otherwise(F.array().cast("array<bigint>"))

    return let(words_of(text), hashed)


def template_table(spark: SparkSession, templates: dict[str, str] | None = None) -> DataFrame:
    rows = sorted((TEMPLATES if templates is None else templates).items())
    return spark.createDataFrame(rows, "license string, template string")


def template_places(templates: DataFrame) -> DataFrame:
    """(license, size, distinct, slack, half, h, pos): each shingle of each template at each of its positions."""
    known = cut(templates.select("license", shingles_of(F.col("template")).alias("ordered")).where(F.size("ordered") > 0)
                .withColumn("size", F.size("ordered")), "license-templates")
    sizes = [r[0] for r in known.select("size").distinct().collect()]  # of the given templates
    def by_size(rule) -> Column:
        return F.create_map(*[F.lit(x) for n in sizes for x in (n, rule(n))])[F.col("size")] if sizes else F.lit(0)

    return known.select("license", "size", F.size(F.array_distinct("ordered")).alias("distinct"), by_size(slack).alias("slack"),
                        by_size(half_window).alias("half"), F.posexplode("ordered").alias("pos", "h"))


def in_windows(marks: DataFrame) -> DataFrame:
    """``marks`` (at, half, ...) once for each of the two windows that a position is in."""
    here = F.floor(F.col("at") / F.col("half"))
    return marks.withColumn("window", F.explode(F.array(here, here - 1))).where(F.col("window") >= 0)


def sketches(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, band, least): the minima of each group's shingles ``h``."""
    found = rows.groupBy(*keys).agg(*[F.min(F.xxhash64(F.lit(n), "h")).alias(f"band_{n}") for n in range(BANDS)])
    return found.select(*keys, F.posexplode(F.array(*[F.col(f"band_{n}") for n in range(BANDS)])).alias("band", "least"))


def retrieved(marks: DataFrame, known: DataFrame, halves: list[int]) -> DataFrame:
    """(text_id, half, window, license): templates that share a band with a window. ``marks`` are (text_id, at, h)."""
    windows = in_windows(marks.withColumn("half", F.explode(F.array(*[F.lit(n) for n in halves]))))
    return (sketches(windows, "text_id", "half", "window").join(sketches(known, "license", "half"), ["half", "band", "least"])
            .select("text_id", "half", "window", "license").distinct())


def match_texts(docs: DataFrame, templates: DataFrame, text_col: str = "text") -> DataFrame:
    """(text_id, license, first_word, last_word, contained): verified matches of distinct texts."""
    known = cut(template_places(templates), "license-places")
    # the templates are given and few, so their shingles and window lengths fit into the plan as literals
    every = [r[0] for r in known.select("h").distinct().orderBy("h").collect()]
    halves = [r[0] for r in known.select("half").distinct().orderBy("half").collect()]
    if not every:
        return docs.sparkSession.createDataFrame([], "text_id string, license string, first_word int, last_word int, contained double")
    placed = F.filter(F.transform(F.col("hashes"), lambda h, i: F.struct(i.alias("at"), h.alias("h"))), lambda s: s["h"].isin(every))
    texts = docs.where(F.length(text_col) > 0).select(text_id(F.col(text_col)).alias("text_id"),
                                                      shingles_of(F.col(text_col)).alias("hashes"))
    texts = cut(texts.select("text_id", placed.alias("placed")).dropDuplicates(["text_id"]), "license-marks")
    marks = texts.select("text_id", F.explode("placed").alias("s")).select("text_id", "s.at", "s.h")
    asked = cut(retrieved(marks, known, halves), "license-retrieved")
    own = (in_windows(marks.join(known, "h")).join(asked, ["text_id", "license", "half", "window"], "left_semi")
           .drop("window", "half").distinct())
    own = cut(own, "license-own")
    width = F.col("size") + 2 * F.col("slack")  # of the stretch that a place covers: it meets two buckets at most
    held = own.withColumn("bucket", F.floor(F.col("at") / width))
    ends = F.array(F.floor((F.col("origin") - F.col("slack")) / width), F.floor((F.col("origin") + F.col("size") + F.col("slack") - 1) / width))
    places = (own.select("text_id", "license", "size", "slack", (F.col("at") - F.col("pos")).alias("origin")).distinct()
              .select("text_id", "license", "origin", F.explode(F.array_distinct(ends)).alias("bucket")))
    moved = F.abs(F.col("at") - F.col("pos") - F.col("origin"))
    spans = (places.join(held, ["text_id", "license", "bucket"])
             .where((F.col("at") >= F.col("origin") - F.col("slack")) & (F.col("at") < F.col("origin") + F.col("size") + F.col("slack"))
                    & (moved < F.col("size") + SHINGLE - 1))
             .groupBy("text_id", "license", "origin", "size", "distinct")
             .agg(F.size(F.collect_set("h")).alias("held"), F.size(F.collect_set(F.when(moved == 0, F.col("h")))).alias("aligned"),
                  F.min("at").alias("first_word"), (F.max("at") + SHINGLE - 1).alias("last_word"))
             .withColumn("contained", F.col("held") / F.col("distinct")).where(F.col("contained") >= CONTAINED))
    best = F.max(F.struct("contained", "size", "license", "last_word")).alias("best")
    return one_of_each_copy(spans).groupBy("text_id", "first_word").agg(best).select(
        "text_id", "best.license", "first_word", "best.last_word", "best.contained")


def one_of_each_copy(spans: DataFrame) -> DataFrame:
    """Of places of a license nearer than ``CONTAINED`` of a copy the best, then the best of what is left, and so on.

    In each round the places that are best among those near them stay and those near them go; equal ones are in a
    random order of their own, so rounds are few. A round sorts the places by text and license, and copies are never put
    into one list.
    """
    left = cut(spans.withColumn("rank", F.struct("contained", "aligned", F.xxhash64("text_id", "origin").alias("tie"), "origin"))
               .withColumn("scaled", F.floor(F.col("origin").cast("bigint") * 10_000 / (F.col("size") + SHINGLE - 1))), "license-spans")
    reach = round(CONTAINED * 10_000)
    near = W.partitionBy("text_id", "license").orderBy("scaled").rangeBetween(-reach, reach)
    kept = None
    while True:
        judged = cut(left.withColumn("stays", F.col("rank") == F.max("rank").over(near))
                     .withColumn("done", F.max("stays").over(near)), "license-judged")
        stay = judged.where("stays").drop("stays", "done", "scaled", "rank")
        kept = stay if kept is None else kept.unionByName(stay)
        left = judged.where(~F.col("done")).drop("stays", "done")
        if left.isEmpty():
            return kept


def text_id(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def scan(docs: DataFrame, templates: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, first_word, last_word, contained) of every verified match; words count from 0."""
    templates = template_table(docs.sparkSession) if templates is None else templates
    found = cut(match_texts(docs, templates, text_col), "license-matches")
    ids = docs.where(F.length(text_col) > 0).select(F.col(id_col), text_id(F.col(text_col)).alias("own_text_id"))
    return (ids.join(found, F.col("own_text_id") == F.col("text_id"))
            .select(id_col, "license", "first_word", "last_word", "contained"))
