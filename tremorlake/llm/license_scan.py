"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

DataFrame functions only. Windows start at each shingle of a template and of a text: where a text holds a whole window
of a template, both windows are equal and share every band; where edits broke all of them, the windows' Jaccard
similarity decides.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.llm.common import let, materialised

#: Words of a shingle; templates of fewer words have one shingle of all their words.
SHINGLE_WORDS = 5
MIN_CONTAINMENT = 0.8
#: (shingles in a window, bands of one row, smallest template in shingles). Templates take the windows of the last
#: class they reach. Where four-fifths of a template of up to 15 shingles stand, some window of 4 keeps 3 of them at
#: least, and mostly all 4; of a longer one some window of 16 keeps 13, a Jaccard similarity of 13 / 19.
WINDOWS = [(1, 1, 1), (4, 2, 4), (16, 5, 16)]
MAX_TEMPLATES = 1000
#: Bands of templates that may be broadcast; a thousand templates of 150 words have about as many.
MAX_TEMPLATE_BANDS = 2_000_000
#: Texts with a candidate that are broadcast to find their words again; more are joined by a shuffle of all texts.
MAX_BROADCAST_FOUND = 500_000
#: Marker words, and shingles of templates, up to which texts are looked through for one of them before they are sketched;
#: letters of a marker that stands alone, and shingles without one up to which texts are looked through.
MAX_MARKERS, LEAST_MARKER, MAX_SEVERAL = 2000, 5, 50
#: Shingles of a text that are sketched in one row; longer texts take several rows, which overlap by a window.
CHUNK = 4096

#: License statements and notices as they are commonly written.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "mit": "Released under the MIT License.",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "rights-reserved": "All rights reserved.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}


def collision_probability(jaccard: float, bands: int, rows: int = 1) -> float:
    """That windows of this Jaccard similarity share a band, over independent orders."""
    return 1 - (1 - jaccard**rows) ** bands


def word_list(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles(words: Column, size: int = SHINGLE_WORDS) -> Column:
    """Hashes of the runs of ``size`` words, in order."""
    some = F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))
    return F.when(F.size(words) < size, F.array().cast("array<bigint>")).otherwise(some)


def _halves(m: Column, span: int) -> Column:
    """Minima of windows twice as long as those of ``m``, which are ``span`` long; the last ones end with the array."""
    return F.zip_with(m, F.slice(m, span + 1, F.size(m)), lambda a, b: F.least(a, b))


def _minima(s: Column, band: int, classes: tuple[int, ...]) -> Column:
    """A struct of the distinct smallest hashes, in the order of ``band``, of all windows of 4 (a) and of 16 shingles (b):
    those of ``classes`` (1 and 2) alone."""
    ordered = F.transform(s, lambda x: F.xxhash64(x, F.lit(band)))
    a = lambda m4: F.array_distinct(m4).alias("a")
    b = lambda m4: F.array_distinct(let(_halves(m4, 4), lambda m8: _halves(m8, 8))).alias("b")
    found = lambda m4: F.struct(*[of(m4) for k, of in ((1, a), (2, b)) if k in classes])
    return let(ordered, lambda m: let(_halves(m, 1), lambda m2: let(_halves(m2, 2), found)))


def sketches(s: Column, classes: tuple[int, ...] = (0, 1, 2)) -> Column:
    """Structs (class, band, hashes) of the windows of ``classes`` of the shingles ``s``."""
    named = lambda k, b, hashes: F.struct(F.lit(k).alias("class"), F.lit(b).alias("band"), hashes.alias("hashes"))
    parts = [F.array(named(0, 0, F.array_distinct(s)))] if 0 in classes else []
    for b in range(max([0, *[WINDOWS[k][1] for k in classes if k]])):
        mine = tuple(k for k in (1, 2) if k in classes and b < WINDOWS[k][1])
        parts.append(let(_minima(s, b, mine), lambda m, b=b, mine=mine: F.array(*[named(k, b, m["a" if k == 1 else "b"]) for k in mine])))
    return F.when(F.size(s) > 0, F.flatten(F.array(*parts)))


def _template_bands(sized: DataFrame) -> DataFrame:
    """Distinct (template, size, class, band, h) of templates (template, size, s, n)."""
    parts = None
    for k, (_, _, least) in enumerate(WINDOWS):
        most = WINDOWS[k + 1][2] if k + 1 < len(WINDOWS) else None
        mine = sized.where(F.col("n") >= least if most is None else (F.col("n") >= least) & (F.col("n") < most))
        part = mine.select("template", "size", F.inline(sketches(F.col("s"), (k,)))).withColumn("h", F.explode("hashes")).drop("hashes").distinct()
        parts = part if parts is None else parts.unionByName(part)
    return parts


def _text_bands(texts: DataFrame) -> DataFrame:
    """(size, class, band, h) of texts' shingles ``s`` in all classes; a long text is sketched in chunks."""
    overlap = max(w[0] for w in WINDOWS)
    n = F.size("s")
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(n, F.lit(1)) - 1) / CHUNK).cast("int")), lambda i: F.slice("s", i * CHUNK + 1, CHUNK + overlap))
    ids = [c for c in texts.columns if c != "s"]
    cut = texts.where(n > 0).select(*ids, F.explode(chunks).alias("s"))
    # Short shingles belong to templates of less than five words, which have windows of one shingle only.
    first = F.when(F.col("size") == SHINGLE_WORDS, sketches(F.col("s"))).otherwise(sketches(F.col("s"), (0,)))
    # A few lists of hashes a chunk first, then their hashes: no struct is made for each hash.
    return cut.select(*ids, F.inline(first)).withColumn("h", F.explode("hashes")).drop("hashes")


def _by_size(words: Column, size: Column) -> Column:
    """The shingles of ``size`` words, a column from 1 to SHINGLE_WORDS."""
    out = F.lit(None).cast("array<bigint>")
    for k in range(1, SHINGLE_WORDS + 1):
        out = F.when(size == k, shingles(words, k)).otherwise(out)
    return out


def _templates(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """template, w, size (words of a shingle), s, n (distinct shingles)."""
    rows = spark.createDataFrame(sorted(templates.items()), "template string, text string").select("template", word_list(F.col("text")).alias("w"))
    size = F.least(F.size("w"), F.lit(SHINGLE_WORDS))
    return rows.select("template", "w", size.alias("size"), _by_size(F.col("w"), size).alias("s")).withColumn("n", F.size(F.array_distinct("s")))


def markers(words: list[str], size: int) -> set[tuple[str, ...]]:
    """Words of each shingle of ``size`` words, of which a text holds all of some shingle's, or no shingle of a template:
    the longest one, or all where none has ``LEAST_MARKER`` letters."""
    runs = [sorted(dict.fromkeys(words[i : i + size]), key=len, reverse=True) for i in range(len(words) - size + 1)]
    return {tuple(run[:1] if len(run[0]) >= LEAST_MARKER else run) for run in runs}


def _with_markers(worded: DataFrame, sized: DataFrame) -> DataFrame:
    """Rows of ``worded`` (w) that may share a shingle with a template; many markers leave all rows that are long enough."""
    rows = sized.select("w", "size").collect()
    found = sorted(set().union(*[markers(r["w"], r["size"]) for r in rows]))
    single, several = [x[0] for x in found if len(x) == 1], [x for x in found if len(x) > 1]
    if len(single) > MAX_MARKERS or len(several) > MAX_SEVERAL:
        return worded.where(F.size("w") >= min(r["size"] for r in rows))

    def held(w: Column) -> Column:
        some = F.arrays_overlap(w, F.array(*[F.lit(x) for x in single]).cast("array<string>"))
        for run in several:
            some = some | reduce(and_, [F.array_contains(w, x) for x in run])
        return some

    return worded.where(let(F.col("w"), held))


def _with_shingles(near: DataFrame, sized: DataFrame) -> DataFrame:
    """Rows of ``near`` (size, s) that hold a shingle of a template. A window's minimum is the hash of one of its shingles,
    so other rows share no band with any template."""
    known = {r["size"]: r["s"] for r in sized.groupBy("size").agg(F.array_distinct(F.flatten(F.collect_list("s"))).alias("s")).collect()}
    if sum(map(len, known.values())) > MAX_MARKERS:
        return near
    held = F.lit(False)
    for size, s in known.items():
        held = F.when(F.col("size") == size, F.arrays_overlap("s", F.array(*[F.lit(x) for x in s]).cast("array<bigint>"))).otherwise(held)
    return near.where(held)


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, min_containment: float = MIN_CONTAINMENT) -> DataFrame:
    """Per document and template found: doc_id, template, n_shingles of the template, n_found, containment.

    A template is found when at least ``min_containment`` of its distinct shingles occur in the text. Every window
    of whole texts of any length is looked up, but for texts without any shingle of a template, which have no band in
    common with one. Null and empty texts hold none. Rows that repeat doc_id and text give
    one row. Other columns are ignored. An empty table gives an empty result. A template without words is an error.
    """
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"{len(templates)} templates; at most {MAX_TEMPLATES} are broadcast")
    if empty := sorted(name for name, text in templates.items() if not any(c.isalnum() for c in text)):
        raise ValueError(f"templates without words: {empty}")
    spark: SparkSession = docs.sparkSession
    sized = _templates(spark, templates)
    bands = _template_bands(sized)
    known = sized.select(F.collect_set("size")).first()[0]
    n = bands.count()
    if n > MAX_TEMPLATE_BANDS:
        raise ValueError(f"the templates have {n} bands; at most {MAX_TEMPLATE_BANDS} are broadcast")

    keyed = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumns({"_text": F.xxhash64("text"), "_check": F.xxhash64(F.lit(1), F.length("text"), "text")})
    worded = _with_markers(keyed.select("doc_id", "_text", "_check", word_list(F.col("text")).alias("w")), sized)
    by_size = let(F.col("w"), lambda w: F.array(*[F.struct(F.lit(k).alias("size"), shingles(w, k).alias("s")) for k in sorted(known)]))
    near = _with_shingles(worded.select("doc_id", "_text", "_check", F.inline(by_size)), sized)
    same = ["_text", "_check"]
    hits = _text_bands(near).join(F.broadcast(bands), ["size", "class", "band", "h"])
    found = materialised(hits.groupBy("doc_id", *same, "size").agg(F.collect_set("template").alias("_templates")), "license-hits")

    other = found.withColumnsRenamed({c: f"_f{c}" for c in ["doc_id", *same]})
    on = F.col("doc_id").eqNullSafe(F.col("_fdoc_id"))
    for c in same:
        on = on & (F.col(c) == F.col(f"_f{c}"))
    met = keyed.join(F.broadcast(other) if found.count() <= MAX_BROADCAST_FOUND else other, on)
    candidates = met.withColumn("s", let(word_list(F.col("text")), lambda w: _by_size(w, F.col("size")))).withColumn("template", F.explode("_templates"))
    shared = F.size(F.array_intersect(F.col("s"), F.col("t")))
    verified = candidates.join(F.broadcast(sized.select("template", F.col("s").alias("t"), "n")), "template").withColumn("n_found", shared)
    return (
        verified.where(F.col("n_found") >= min_containment * F.col("n") - 1e-9)
        .groupBy("doc_id", "_text", "_check", "template")
        .agg(F.first("n").cast("long").alias("n_shingles"), F.first("n_found").cast("long").alias("n_found"))
        .select("doc_id", "template", "n_shingles", "n_found", F.round(F.col("n_found") / F.col("n_shingles"), 6).alias("containment"))
    )


def scan_sql(templates: dict[str, str] = TEMPLATES, min_containment: float = MIN_CONTAINMENT) -> str:
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(templates.items()))
    split = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    return f"""
WITH tpl AS (SELECT * FROM (VALUES {values}) v(template, text)),
tw AS (SELECT template, {split} AS w FROM tpl),
tz AS (SELECT template, w, least(len(w), 5) AS z FROM tw),
tg AS (SELECT DISTINCT template, z, w[i:i + z - 1] AS g FROM (SELECT template, z, w, unnest(range(1, len(w) - z + 2)) AS i FROM tz)),
tn AS (SELECT template, count(*) AS n FROM tg GROUP BY template),
dw AS (SELECT DISTINCT doc_id, text, {split} AS w FROM documents WHERE text IS NOT NULL),
dz AS (SELECT doc_id, text, w, z FROM dw JOIN (SELECT DISTINCT z FROM tz) ON len(w) >= z),
dg AS (SELECT DISTINCT doc_id, text, w[i:i + z - 1] AS g FROM (SELECT doc_id, text, z, w, unnest(range(1, len(w) - z + 2)) AS i FROM dz)),
hit AS (SELECT doc_id, text, template, count(*) AS f FROM dg JOIN tg USING (g) GROUP BY doc_id, text, template)
SELECT doc_id, template, n::BIGINT AS n_shingles, f::BIGINT AS n_found, round(f / n::DOUBLE, 6) AS containment
FROM hit JOIN tn USING (template) WHERE f >= {min_containment}::DOUBLE * n - 1e-9
"""
