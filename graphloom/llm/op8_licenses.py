"""License scans with DataFrame functions only.

Texts are compared by hashed five-word shingles.  A template of m shingles is sought in
windows of m + s - 1 shingles that start at every multiple of s = max(1, m // 4), so one
window holds a whole occurrence.  A window that contains ``least`` of a template has
a Jaccard similarity of at least least / (2.25 - least) with it; ``bands_for`` takes as
many MinHash bands as that needs for the wanted collision probability.  Windows and
templates meet on (size, band, value); exact containment of the shingles verifies them.

Windows that share no shingle with any template cannot match, so documents without
such a shingle are left out first; the templates' shingles go into that test as a
literal up to ``LITERAL`` of them, and beyond it through a semi join.

Defined cases: null texts and texts under five words have no shingles and no matches;
templates under five words match nothing; a document matches a template once, in its
best window, the first of equals; repeated rows match one by one; no templates or no
documents give no rows; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WORDS = 5
LEAST = 0.8
ROWS = 2
LITERAL = 4096

#: Common license notices.
TEMPLATES = [
    ("mit-line", "Released under the MIT License."),
    ("apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3-line", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0-line", "Licensed under CC BY 4.0. Attribution required."),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-3-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("bsd-redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
]


def bands_for(similarity: float, rows: int, miss: float) -> int:
    """Bands of ``rows`` minima so that a pair of this similarity collides but with probability ``miss``."""
    return math.ceil(math.log(miss) / math.log(1 - similarity**rows))


def words_array(text: str = "text"):
    """Lower-case words of a text: runs of a-z and 0-9."""
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def _shingle_array(words: str):
    n = F.size(words) - (WORDS - 1)
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.element_at(words, i + k) for k in range(WORDS)]))


def _bands(shingle_array, bands: int):
    """(band, value) of each MinHash band of a shingle array."""
    least = lambda j, k: F.array_min(F.transform(shingle_array, lambda x: F.xxhash64(x, j * ROWS + k)))
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda j: F.struct(j.alias("band"), F.xxhash64(*[least(j, k) for k in range(ROWS)]).alias("value")))


def scan(docs: DataFrame, templates: DataFrame, least: float = LEAST, miss: float = 1e-6) -> DataFrame:
    """doc_id, template_id, matched and template shingles, containment, first_word of the best window."""
    bands = bands_for(least / (2.25 - least), ROWS, miss)
    known = C.clean(templates, "template_id", "text").withColumn("words", words_array()).withColumn("ts", F.array_distinct(_shingle_array("words")))
    known = known.withColumn("m", F.size("ts")).where("m > 0").select("template_id", "ts", "m", F.greatest(F.lit(1), F.floor(F.col("m") / 4)).cast("int").alias("step"))
    known = known.withColumn("length", F.col("m") + F.col("step") - 1)
    parts = known.select(F.explode("ts").alias("h"), "m", "step", "length").distinct()
    texts = C.clean(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("rid"), "doc_id", words_array().alias("words"))
    texts = texts.select("rid", "doc_id", _shingle_array("words").alias("sh"))
    some = [r["h"] for r in parts.select("h").distinct().limit(LITERAL + 1).collect()]
    if len(some) <= LITERAL:
        texts = texts.where(F.arrays_overlap("sh", F.array(*map(F.lit, some)).cast("array<bigint>")))
    near = C.stored(texts, "licensed")
    if len(some) > LITERAL:
        near = near.join(near.select("rid", F.explode("sh").alias("h")).join(parts.select("h").distinct(), "h", "left_semi").select("rid").distinct(), "rid", "left_semi")
    # windows that hold a shingle of a template of their size
    hits = near.select("rid", F.posexplode("sh").alias("p", "h")).join(parts, "h")
    first = F.greatest(F.lit(0), F.ceil((F.col("p") - F.col("length") + 1) / F.col("step"))).cast("int")
    starts = hits.select("rid", "m", "step", "length", F.explode(F.sequence(first, F.floor(F.col("p") / F.col("step")).cast("int"))).alias("k")).distinct()
    cut = starts.join(near, "rid").select("rid", "doc_id", "m", (F.col("k") * F.col("step")).alias("start"), F.array_distinct(F.slice("sh", F.col("k") * F.col("step") + 1, F.col("length"))).alias("ws"))
    windows = C.stored(cut, "windows")
    found = windows.select("rid", "m", "start", F.explode(_bands(F.col("ws"), bands)).alias("b")).select("rid", "m", "start", "b.band", "b.value")
    sought = known.select("template_id", "m", F.explode(_bands(F.col("ts"), bands)).alias("b")).select("template_id", "m", "b.band", "b.value")
    candidates = found.join(sought, ["m", "band", "value"]).select("rid", "m", "start", "template_id").distinct()
    same = candidates.join(windows, ["rid", "m", "start"]).join(known.select("template_id", "ts"), "template_id")
    same = same.withColumn("matched", F.size(F.array_intersect("ws", "ts"))).where(F.col("matched") >= F.col("m") * F.lit(least))
    best = same.groupBy("rid", "doc_id", "template_id", "m").agg(F.max("matched").alias("matched"), F.max_by("start", F.struct("matched", -F.col("start"))).alias("start"))
    return best.select("doc_id", "template_id", F.col("matched").cast("bigint").alias("matched"), F.col("m").cast("bigint").alias("template_shingles"), (F.col("matched") / F.col("m")).alias("containment"), F.col("start").cast("bigint").alias("first_word"))


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "template_id string, text string")


def op8_licenses(spark, sf_dir: str) -> DataFrame:
    """All matches of the default templates in all documents."""
    return scan(C.table(spark, sf_dir, "documents"), default_templates(spark))


_VALUES = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in TEMPLATES)
SQL = f"""
WITH t AS (
  SELECT template_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM (VALUES {_VALUES}) AS v(template_id, text)
), ts AS (
  SELECT DISTINCT template_id, array_to_string(w[i : i + 4], ' ') AS h FROM t, range(1, len(w) - 3) AS r(i)
), tm AS (
  SELECT template_id, count(*) AS m, greatest(1, count(*) // 4) AS step FROM ts GROUP BY template_id
), d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents
), p AS (
  SELECT rid, doc_id, i - 1 AS p, array_to_string(w[i : i + 4], ' ') AS h
  FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)
), hit AS (
  SELECT p.rid, p.doc_id, p.p, ts.h, tm.* FROM p JOIN ts USING (h) JOIN tm USING (template_id)
), win AS (
  SELECT rid, doc_id, template_id, m, k * step AS start, count(DISTINCT h) AS matched
  FROM (SELECT *, unnest(range(greatest(0, CAST(ceil((p - (m + step - 1) + 1) / step) AS BIGINT)), p // step + 1)) AS k FROM hit)
  GROUP BY ALL
)
SELECT doc_id, template_id, CAST(matched AS BIGINT) AS matched, CAST(m AS BIGINT) AS template_shingles, matched / m AS containment, CAST(start AS BIGINT) AS first_word
FROM win WHERE matched >= m * 0.8
QUALIFY row_number() OVER (PARTITION BY rid, template_id ORDER BY matched DESC, start) = 1
"""
