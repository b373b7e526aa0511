"""License statements in texts, in DataFrame operations only.

Templates are parted by size. For each part, texts are read in windows of twice the largest size that overlap by three quarters, so that a passage of up to one
and a half times that size lies in one of them. A window and a template that it holds have a least Jaccard similarity, from which the number of MinHash
bands follows that collide with the probability asked for. A band can only collide on a shingle that is the minimum of a template; windows without one are
passed over, which loses no collision. Templates that collide are verified by exact containment of their word shingles in the whole text.

Words are runs of letters and digits in lower case, so that line breaks, comment signs and case don't matter. Null texts count as empty and match nothing, as do
texts shorter than a shingle; a template must have a shingle. Rows that repeat give rows that repeat; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolake.llm.common import texts

#: Statements by which licenses are named in texts and file heads. Fixed values.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "Apache-2.0-head": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0-head": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _numbers(words: Column, size: int) -> Column:
    """A 64-bit number for each run of size words; words must be numbers themselves."""
    n = F.size(words) - size + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(size))))).otherwise(F.array().cast("array<bigint>"))


def _let(value: Column, use) -> Column:
    """use(value), with value computed once: the optimiser may put a column's expression into each of its uses, but not that of a lambda's variable."""
    return F.get(F.transform(F.array(value), use), 0)


def _text_numbers(words: Column, size: int) -> Column:
    return _let(F.transform(words, lambda w: F.xxhash64(w)), lambda hashed: _numbers(hashed, size))


def _said(words: Column, size: int) -> Column:
    """The distinct runs of size words themselves."""
    n = F.size(words) - size + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(words, i, size), " ")))).otherwise(F.array().cast("array<string>"))


def _minimum(numbers: Column, band: int) -> Column:
    return F.array_min(F.transform(numbers, lambda x: F.xxhash64(x, F.lit(band))))


def bands_for(sizes: list[int], window: int, threshold: float, miss: float) -> int:
    """Bands of one value each by which a window that holds a template collides with it but for a probability of miss."""
    least = min((held := math.ceil(threshold * n - 1e-9)) / (window + n - held) for n in sizes)
    return math.ceil(math.log(miss) / math.log1p(-min(least, 1 - 1e-9)))


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, shingle: int = 5, threshold: float = 0.8, miss: float = 1e-4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document and license statement in it: doc_id, license, n_shingles and n_shared of the statement, containment. Templates are part of the plan, a few hundred at most."""
    spark = docs.sparkSession
    known = spark.createDataFrame([*(templates or TEMPLATES).items()], "license string, text string")
    known = known.select("license", _let(_words(F.col("text")), lambda w: F.struct(_said(w, shingle).alias("said"), F.array_distinct(_text_numbers(w, shingle)).alias("numbers"))).alias("x")).select("license", "x.*")
    every = [(r.license, list(r.said), list(r.numbers)) for r in known.collect()]
    if few := [name for name, said, _ in every if not said]:
        raise ValueError(f"templates of fewer than {shingle} words: {few}")
    parts: dict[int, list[int]] = {}
    for k, (_, said, _) in enumerate(every):
        parts.setdefault(math.ceil(math.log2(len(said))), []).append(k)

    # The minimum of each template in each band, by the expressions that windows get.
    bands = {c: bands_for([len(every[k][1]) for k in of], 2 << c, threshold, miss) for c, of in parts.items()}
    tiny = spark.createDataFrame([(k, every[k][2]) for k in range(len(every))], "k int, numbers array<bigint>")
    minima = {r.k: list(r.least) for r in tiny.select("k", F.array(*(_minimum(F.col("numbers"), j) for j in range(max(bands.values())))).alias("least")).collect()}
    starts = {x for k, (_, _, numbers) in enumerate(every) for x in numbers}

    sure = F.array(*(F.lit(x) for x in sorted(starts)))  # shingles of templates, among which all minima are

    def places(numbers: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.greatest(F.size(numbers), F.lit(1)) - 1), lambda i: F.array_contains(sure, F.get(numbers, i)))

    def signs(numbers: Column, at: Column, c: int) -> Column:
        """Band values of the windows of part c that hold one of the places."""
        window, step = 2 << c, max(1, (1 << c) // 2)
        near = lambda i: F.sequence(F.floor(F.greatest(i - (window - 1), F.lit(0)) / step).cast("int"), F.floor(i / step).cast("int"))
        first = F.array_distinct(F.flatten(F.transform(at, near)))
        return F.transform(first, lambda s: _let(F.slice(numbers, s * step + 1, window), lambda w: F.array(*(_minimum(w, j) for j in range(bands[c])))))

    def collided(sign: Column, c: int) -> Column:
        least = lambda k: F.array(*map(F.lit, minima[k][: bands[c]]))
        one = lambda k: F.exists(sign, lambda s: F.exists(F.zip_with(s, least(k), lambda x, y: x == y), lambda same: same))
        return F.array_compact(F.array(*(F.when(one(k), F.lit(k)) for k in parts[c])))

    def _collide(c: int):
        return lambda sign: collided(sign, c)

    hits = lambda numbers: _let(places(numbers), lambda at: F.concat(*(_let(signs(numbers, at, c), _collide(c)) for c in parts)))
    rows = texts(docs, id_col, text_col).select("doc_id", _words(F.col("text")).alias("words"))
    rows = rows.select("doc_id", "words", _let(_text_numbers(F.col("words"), shingle), lambda n: F.when(F.arrays_overlap(n, sure), hits(n))).alias("hits")).where(F.size("hits") > 0)
    rows = rows.select("doc_id", "hits", _said(F.col("words"), shingle).alias("said"))
    names = F.array(*(F.struct(F.lit(name).alias("license"), F.array(*map(F.lit, said)).alias("said")) for name, said, _ in every))
    out = rows.select("doc_id", "said", F.explode(F.transform("hits", lambda k: F.get(names, k))).alias("hit"))
    out = out.select("doc_id", "hit.license", F.size("hit.said").cast("long").alias("n_shingles"), F.size(F.array_intersect("said", "hit.said")).cast("long").alias("n_shared"))
    return out.withColumn("containment", F.col("n_shared") / F.col("n_shingles")).where(F.col("containment") >= threshold - 1e-9)
