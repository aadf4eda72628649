"""License scans by MinHash over overlapping text windows (operator 4).

Windows of twice a template's length class, every class length, hold any copy of a template whole. A window
and a template meet when one of their MinHash values is equal; `bands_for` gives so many one-row bands
that a window with `CONTAINED` of a template's shingles is met with probability `SURE`. What meets
is verified by exact containment of the template's shingles.

Windows that share no shingle with any template have a similarity of 0 and are left out before hashing.

Defined cases: null and empty texts and templates match nothing; repeated ids are reported together;
of several windows the best one is named, the first of equals.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Public license notices.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

CONTAINED, SURE = 0.8, 0.999


def templates(spark: SparkSession, notices: dict[str, str] | None = None) -> DataFrame:
    """license, text: one row per notice."""
    pairs = list((NOTICES if notices is None else notices).items())
    rows = F.array(*[F.struct(F.lit(k).alias("license"), F.lit(v).cast("string").alias("text")) for k, v in pairs]) if pairs else F.array().cast("array<struct<license:string,text:string>>")
    return spark.range(1).select(F.inline(rows))


def shingles(text: Column) -> Column:
    """Hashes of the runs of three words of a text, lower-cased, in order; none for fewer words."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    pair = lambda a, b: F.xxhash64(a, b)
    # a one-element array binds the words, so that they are split once per row
    return F.transform(
        F.array(words),
        lambda w: F.when(
            F.size(w) >= 3,
            F.zip_with(F.zip_with(F.slice(w, F.lit(1), F.size(w) - 2), F.slice(w, F.lit(2), F.size(w) - 2), pair), F.slice(w, F.lit(3), F.size(w) - 2), pair),
        ).otherwise(F.array().cast("array<bigint>")),
    )[0]


def bands_for(length: int, contained: float = CONTAINED, sure: float = SURE) -> int:
    """Bands of one row for windows of 2 * length shingles and templates of more than length / 2."""
    least = max(1, length // 2 + 1)
    similarity = contained * least / (2 * length + (1 - contained) * least)
    return math.ceil(math.log(1 - sure) / math.log(1 - similarity))


def signature(window: Column, bands: int) -> list[Column]:
    """The smallest value of the window's hashes under each of `bands` permutations (a XOR with a constant)."""
    masks = [((i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) - (1 << 63) for i in range(bands)]

    def permuted(mask: int):
        return lambda h: F.xxhash64(h.bitwiseXOR(F.lit(mask)))

    return [F.array_min(F.transform(window, permuted(mask))) for mask in masks]


def scan(docs: DataFrame, notices: DataFrame, key: str = "doc_id", text: str = "text", contained: float = CONTAINED) -> DataFrame:
    """key, license, contained (share of its shingles), first_shingle: one row per document and license found."""
    known = notices.select("license", F.array_distinct(shingles(F.col("text"))).alias("own")).where(F.size("own") > 0)
    listed = known.collect()  # the templates are a parameter: tens of notices
    if not listed:
        return docs.select(F.col(key), F.lit(None).cast("string").alias("license"), F.lit(None).cast("double").alias("contained"), F.lit(None).cast("int").alias("first_shingle")).where(F.lit(False))
    all_own = sorted({h for r in listed for h in r["own"]})
    classes = {}
    for r in listed:
        length = max(4, 1 << (len(r["own"]) - 1).bit_length())
        classes.setdefault(length, []).append(r["license"])
    held = docs.select(F.col(key).alias("_key"), shingles(F.col(text)).alias("_s"))
    # as a generator's output, the shingles are made once and the filter is not copied into them
    held = held.select("_key", F.explode(F.array("_s")).alias("_s")).where(F.arrays_overlap("_s", F.array(*map(F.lit, all_own))))
    out = None
    for length, names in sorted(classes.items()):
        bands = bands_for(length, contained)
        starts = F.sequence(F.lit(0), F.greatest(F.size("_s") - 1, F.lit(0)), F.lit(length))
        windows = held.select("_key", "_s", F.explode(starts).alias("_at")).select("_key", "_at", F.slice("_s", F.col("_at") + 1, F.lit(2 * length)).alias("_w"))
        windows = windows.where(F.arrays_overlap("_w", F.array(*map(F.lit, all_own))))
        signed = windows.select("_key", "_at", "_w", F.posexplode(F.array(*signature(F.col("_w"), bands))).alias("_band", "_value"))
        ours = known.where(F.col("license").isin(names)).select("license", "own", F.posexplode(F.array(*signature(F.col("own"), bands))).alias("_band", "_value"))
        met = signed.join(ours, ["_band", "_value"]).select("_key", "_at", "license", (F.size(F.array_intersect("_w", "own")) / F.size("own")).alias("contained"))
        found = met.where(F.col("contained") >= contained)
        out = found if out is None else out.unionByName(found)
    best = out.groupBy("_key", "license").agg(F.max(F.struct(F.col("contained"), (-F.col("_at")).alias("at"))).alias("b"))
    return best.select(F.col("_key").alias(key), "license", F.col("b.contained").alias("contained"), (-F.col("b.at")).cast("int").alias("first_shingle"))
