"""License notices in documents, with Spark expressions only.

Overlapping windows of the documents' words and of the templates get MinHash signatures, and
windows that agree in a whole band retrieve the template; the number of bands follows from the
similarity at which windows must meet and the probability asked for. A retrieved template
counts if the document has enough of its shingles, which is counted exactly.

Windows are laid only where a match can be. A match holds a share CONTAINED of a template's
shingles; for each template the anchors are words whose shingles are more than the rest, so
every match holds an anchor. Documents without any anchor are passed over, and in the
others only windows around anchors are hashed.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.session import materialise, small_table

SHINGLE = 3
CONTAINED = 0.8
#: Window lengths in words; a template uses the longest that fits it at any alignment.
SIZES = (4, 8, 16)
#: Windows of this Jaccard similarity meet in a band with this probability.
ALIKE, MEET, ROWS = 0.7, 0.9999, 2
BANDS = math.ceil(math.log(1 - MEET) / math.log(1 - ALIKE**ROWS))

# Fixed texts: the notices of the licenses, as these are published.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "Apache-2.0-header",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file '
        "except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("MIT", "Released under the MIT License"),
    (
        "MIT-grant",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        'software and associated documentation files (the "Software"), to deal in the Software '
        "without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    (
        "GPL-3.0-header",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    (
        "CC-BY-4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
]


def plain(text: str) -> list[str]:
    """What ``_words`` makes of a template, for the anchors."""
    return [w for w in re.sub(r"[\W_]+", " ", text.lower()).split(" ") if w]


def _words(text: Column) -> Column:
    spaced = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def _stride(size: int) -> int:
    return max(1, size // 8)


def _size(words: int) -> int:
    fitting = [s for s in SIZES if words >= s + _stride(s) - 1]
    return max(fitting, default=SIZES[0])


def anchors(templates: Sequence[tuple[str, str]]) -> list[str]:
    """Words of which every match has one: longest first, until too few shingles are left."""
    out: set[str] = set()
    for _, text in templates:
        words = plain(text)
        shingles = {tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}
        free = {s for s in shingles if not out & set(s)}
        for word in sorted(set(words), key=lambda w: (-len(w), w)):
            if len(free) < CONTAINED * len(shingles):
                break
            if any(word in s for s in free):
                out.add(word)
                free = {s for s in free if word not in s}
    return sorted(out)


def _shingles(words: Column) -> Column:
    """Runs of SHINGLE words, as strings; none of fewer words."""
    last = F.size(words) - SHINGLE
    run = lambda i: F.array_join(F.slice(words, i + 1, SHINGLE), " ")
    none = F.array().cast("array<string>")
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), run)).otherwise(none)


def _bands() -> Column:
    """(band, value) of the column shingles."""

    def least_of(k: int) -> Column:
        return F.array_min(F.transform("shingles", lambda s: F.xxhash64(F.lit(k), s)))

    least = [least_of(k) for k in range(BANDS * ROWS)]
    values = [F.xxhash64(*least[b * ROWS : (b + 1) * ROWS]) for b in range(BANDS)]
    return F.array(*[F.struct(F.lit(b).alias("band"), v.alias("value")) for b, v in enumerate(values)])


def _banded(windows: DataFrame, *keys: str) -> DataFrame:
    """``windows`` (keys, size, window) as rows of keys, size, band, value."""
    hashed = windows.withColumn("shingles", _shingles(F.col("window")))
    rows = hashed.select(*keys, "size", F.explode(_bands()).alias("at"))
    return rows.select(*keys, "size", "at.band", "at.value")


def _template_bands(spark: SparkSession, templates: Sequence[tuple[str, str]]) -> DataFrame:
    rows = []
    for name, text in templates:
        words, size = plain(text), _size(len(plain(text)))
        rows += [(name, size, words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    windows = small_table(spark, rows, "license string, size int, window array<string>")
    return _banded(windows, "license").distinct()


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """``doc_id, license, n_shared, n_shingles, containment``: one row per document and license.

    Needs doc_id and text; other columns are ignored. ``n_shingles`` counts the template's
    distinct shingles, ``n_shared`` those that the whole document has. Null and empty texts
    match nothing. Rows without doc_id are reported under null, once for each different text.
    Repeated rows are reported once. Templates with equal texts are both reported. An empty
    table, or no templates, gives no rows. The templates come as a list, a few hundred windows
    each, so what is broadcast is bounded by it. A template has SHINGLE words at least.
    """
    spark = docs.sparkSession
    if any(len(plain(t)) < SHINGLE for _, t in templates):
        raise ValueError(f"a template needs {SHINGLE} words")
    found = anchors(templates)
    low = F.lower("text")
    # Holding an anchor as a part of some word is what holding it as a word implies.
    has = F.lit(False)
    for word in found:
        has = has | F.contains(low, F.lit(word))
    likely = docs.select(F.col("doc_id"), "text").where(F.col("text").isNotNull()).where(has)
    # Equal texts with one id are one row from here on.
    likely = materialise(
        likely.select("doc_id", F.sha2("text", 256).alias("digest"), _words(F.col("text")).alias("words"))
    )
    marks = F.array(*[F.lit(w) for w in found]) if found else F.array().cast("array<string>")
    n = F.size("words")
    places = F.filter(
        F.transform("words", lambda w, i: F.when(F.array_contains(marks, w), i)), lambda i: i.isNotNull()
    )
    placed = likely.select("doc_id", "digest", "words", places.alias("places")).where(F.size("places") > 0)

    def windows_of(size: int) -> DataFrame:
        step = _stride(size)

        def around(p: Column) -> Column:
            first = F.ceil((p - size - step + 1) / step)
            last = F.floor((p + step - 1) / step)
            return F.transform(F.sequence(first, last), lambda k: (k * step).cast("int"))

        starts = F.array_distinct(F.flatten(F.transform("places", around)))
        inside = F.filter(starts, lambda s: (s >= 0) & (s <= F.greatest(n - size, F.lit(0))))
        cut = F.transform(inside, lambda s: F.slice("words", s + 1, size))
        return placed.select("doc_id", "digest", F.lit(size).alias("size"), F.explode(cut).alias("window"))

    parts = [windows_of(size) for size in sorted({_size(len(plain(t))) for _, t in templates})]
    if not parts:
        return spark.createDataFrame([], RESULT)
    windows = parts[0]
    for part in parts[1:]:
        windows = windows.unionByName(part)
    # A document repeats few windows; equal ones of many documents are hashed for each.
    bands = _banded(windows, "doc_id", "digest")
    known = F.broadcast(_template_bands(spark, templates))
    candidates = bands.join(known, ["size", "band", "value"]).select("doc_id", "digest", "license")
    candidates = candidates.distinct()
    texts = small_table(spark, [(a, plain(b)) for a, b in templates], "license string, own array<string>")
    texts = F.broadcast(texts.select("license", F.array_distinct(_shingles(F.col("own"))).alias("own")))
    same = F.col("c.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("c.digest") == F.col("d.digest"))
    distinct = likely.groupBy("doc_id", "digest").agg(F.first("words").alias("words"))
    held = (
        candidates.alias("c")
        .join(distinct.alias("d"), same)
        .select("c.doc_id", "c.license", "d.words")
        .join(texts, "license")
    )
    shared = F.size(F.array_intersect("own", _shingles(F.col("words"))))
    return (
        held.select(
            "doc_id", "license", shared.cast("long").alias("n_shared"),
            F.size("own").cast("long").alias("n_shingles"),
        )
        .where(F.col("n_shared") >= CONTAINED * F.col("n_shingles"))
        .withColumn("containment", F.round(F.col("n_shared") / F.col("n_shingles"), 6))
    )


RESULT = "doc_id long, license string, n_shared long, n_shingles long, containment double"
