"""License scan, in DataFrame functions only: MinHash bands over overlapping windows, then exact containment.

Templates are notices of public licenses. They fall into length classes; for a class of c words, texts are cut into
windows of 2c words every c words, so each occurrence of its templates lies wholly in some window. Windows without
a single shingle of any template are left out first, which loses nothing, since containment asks for shared
shingles. For the rest, one-row bands of MinHash values retrieve templates; the number of bands follows from the
fewest shingles that a template of the class has, and so from the least resemblance that a verified match can have:
a match is missed with probability 1e-6 at most, whatever templates are given. What is
retrieved is verified by the exact share of the template's shingles that the window has, 0.8 or more; of templates
of one family (versions of a license) the window's best stays.

Defined results: null and empty texts match nothing; rows of equal doc_id count as one document, null included;
repeated notices count as one row with the number of windows that hold them; templates of one family that a window
holds equally well stay all, and repeated templates of one name count once; a template of fewer than three words has
no shingle and is refused; an empty table, or no templates, give no rows; texts of any length are searched whole; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seine.llm import common
from seine.session import table

SHINGLE = 3
CONTAINED = 0.8
MISSED = 1e-6
WORD = r"[\p{L}\p{N}]+"
#: Shingles of templates up to which a plan holds them as literals and leaves out windows without any. Beyond, as with
#: whole license texts, all windows are compared: more work, the same result.
LITERALS = 20_000

# Notices by which public licenses are recognised, as (id, family, text).
TEMPLATES = (
    ("MIT-line", "mit", "Released under the MIT License."),
    ("MIT-licensed-line", "mit", "Licensed under the MIT License."),
    ("MIT-grant", "mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0-line", "apache", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-header", "apache-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0-disclaimer", "apache-header", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-3.0-line", "gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-line", "gpl", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0-line", "gpl", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-line", "gpl", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("GPL-3.0-header", "gpl-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-header", "gpl-header", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("BSD-redistribution", "bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause-line", "bsd-line", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0-header", "mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("ISC-grant", "isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0-line", "cc", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0-line", "cc", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0-line", "cc", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0-line", "cc", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0-international", "cc-long", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0-international", "cc-long", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0-international", "cc-long", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def shingles(tokens: Column) -> Column:
    """Hashes of the runs of SHINGLE words, by place; tokens should be a column or bound by ``once``."""
    starts = F.when(F.size(tokens) < SHINGLE, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.size(tokens) - SHINGLE))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(tokens, i + j) for j in range(SHINGLE)]))


def bands(length: int, fewest: int) -> int:
    """Bands of one row for a class whose templates have `fewest` shingles or more: a window that matches shares the
    needed part of the template's shingles, and the fewer these are the less it resembles the template."""
    window = 2 * length - SHINGLE + 1
    shared = math.ceil(CONTAINED * fewest)
    j = shared / (fewest + max(window, shared) - shared)
    return 1 if j >= 1 else math.ceil(math.log(MISSED) / math.log(1 - j))


def signature(hashes: Column, n: Column) -> Column:
    """n MinHash values of an array of shingle hashes."""
    return F.transform(F.sequence(F.lit(1), n), lambda k: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, k))))


def template_frame(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(license, family, class, wanted): the shingles of each template. class: the least power of two, from four on, that
    holds its words."""
    made = spark.createDataFrame([tuple(t) for t in templates], "license string, family string, text string").select("license", "family", words(F.col("text")).alias("tokens"))
    length = F.greatest(F.lit(4), F.pow(F.lit(2), F.ceil(F.log2(F.size("tokens")))).cast("int"))
    return made.select("license", "family", length.alias("class"), F.array_distinct(shingles(F.col("tokens"))).alias("wanted"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """(key, license, containment, n_windows, first_word) of each license that a document holds."""
    spark = docs.sparkSession
    known = template_frame(spark, templates)
    facts = known.collect()  # the caller's list of templates, not data
    if short := [r.license for r in facts if not r.wanted]:
        raise ValueError(f"templates of fewer than {SHINGLE} words: {', '.join(short)}")
    wanted = sorted({h for r in facts for h in r.wanted})
    needed = {c: bands(c, min(len(r.wanted) for r in facts if r["class"] == c)) for c in sorted({r["class"] for r in facts})}
    literal = F.array(*[F.lit(h) for h in wanted]) if wanted else F.array().cast("array<bigint>")
    shares = (lambda hashes: F.arrays_overlap(hashes, literal)) if len(wanted) <= LITERALS else (lambda hashes: F.size(hashes) > 0)
    made = common.fenced(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "hashes", common.once(words(F.col("text")), shingles)).drop("text")
    made = made.withColumn("any", shares(F.col("hashes")))
    kind = "array<struct<class:int,bands:int>>"
    cuts = F.array(*[F.struct(F.lit(c).alias("class"), F.lit(n).alias("bands")) for c, n in needed.items()]).cast(kind)
    by_class = made.select("key", F.when(F.col("any"), F.col("hashes")).alias("hashes"), F.explode_outer(F.when(F.col("any"), cuts)).alias("c")).filter("c is not null")
    starts = F.sequence(F.lit(0), F.greatest(F.size("hashes") - 1, F.lit(0)), F.col("c.class"))
    cut = by_class.select("key", "hashes", "c", F.explode_outer(starts).alias("start"))
    width = F.col("c.class") * 2 - (SHINGLE - 1)
    cut = cut.select("key", F.col("c.class").alias("class"), F.col("c.bands").alias("bands"), "start", F.slice("hashes", F.col("start") + 1, width).alias("window"))
    cut = cut.filter(shares(F.col("window")))
    signed = cut.withColumn("id", F.struct("key", "start")).select("id", "class", "window", F.posexplode_outer(signature(F.col("window"), F.col("bands"))).alias("band", "value"))
    sizes = spark.createDataFrame(list(needed.items()), "class int, bands int")
    # as large as the caller's list of templates, which the driver holds
    asked = known.join(F.broadcast(sizes), "class").select("license", "family", "class", "wanted", F.posexplode(signature(F.col("wanted"), F.col("bands"))).alias("band", "value"))
    share = F.size(F.array_intersect("wanted", "window")) / F.size("wanted")
    found = signed.join(F.broadcast(asked), ["class", "band", "value"]).select("id.key", "id.start", "class", "license", "family", F.round(share, 6).alias("containment")).filter(F.col("containment") >= contained).distinct()
    best = Window.partitionBy("key", "family", "class", "start").orderBy(F.desc("containment"))
    kept = found.withColumn("place", F.rank().over(best)).filter("place = 1")
    return kept.groupBy(F.col("key").alias(key), "license").agg(F.max("containment").alias("containment"), F.count("*").alias("n_windows"), F.min("start").cast("long").alias("first_word"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and license notice that it holds."""
    return scan(table(spark, sf_dir, "documents"))


def _template_rows() -> str:
    quoted = [(i, f, t.replace("'", "''")) for i, f, t in TEMPLATES]
    return ", ".join(f"('{i}', '{f}', '{t}')" for i, f, t in quoted)


ORACLE_SQL = f"""
WITH t0 AS (SELECT license, family, regexp_extract_all(lower(body), '{WORD}') AS w FROM (VALUES {_template_rows()}) t(license, family, body)),
t AS MATERIALIZED (SELECT license, family, CASE WHEN len(w) <= 4 THEN 4 WHEN len(w) <= 8 THEN 8 WHEN len(w) <= 16 THEN 16 WHEN len(w) <= 32 THEN 32 WHEN len(w) <= 64 THEN 64 ELSE 128 END AS c,
  list_distinct(list_transform(range(len(w) - {SHINGLE - 1}), lambda i: list_aggregate(w[i + 1:i + {SHINGLE}], 'string_agg', ' '))) AS wanted FROM t0),
d0 AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD}') AS w FROM documents),
s AS MATERIALIZED (SELECT rid, doc_id, len(w) - {SHINGLE - 1} AS n, unnest(range(len(w) - {SHINGLE - 1})) AS pos, unnest(list_transform(range(len(w) - {SHINGLE - 1}), lambda i: w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) AS sh FROM d0 WHERE len(w) >= {SHINGLE}),
u AS (SELECT license, family, c, len(wanted) AS total, unnest(wanted) AS sh FROM t),
m AS MATERIALIZED (SELECT rid, doc_id, n, pos, sh, license, family, c, total FROM s JOIN u USING (sh)),
wd AS (SELECT m.*, unnest([(pos // c) * c, (pos // c) * c - c]) AS start FROM m),
g AS (SELECT doc_id, license, family, c, start, round(count(DISTINCT sh) / any_value(total), 6) AS containment
  FROM wd WHERE start >= 0 AND pos < start + 2 * c - {SHINGLE - 1} GROUP BY rid, doc_id, license, family, c, start HAVING round(count(DISTINCT sh) / any_value(total), 6) >= {CONTAINED}),
gd AS (SELECT DISTINCT * FROM g),
k AS (SELECT *, rank() OVER (PARTITION BY doc_id, family, c, start ORDER BY containment DESC) AS place FROM gd)
SELECT doc_id, license, max(containment) AS containment, count(*) AS n_windows, min(start) AS first_word FROM k WHERE place = 1 GROUP BY doc_id, license
"""
