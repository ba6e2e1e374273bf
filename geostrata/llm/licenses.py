"""License scan in DataFrame operations only: MinHash bands over overlapping windows find templates, exact containment of
five-word shingles decides.

Templates are grouped in classes of like length. A window holds 1.5 times the class's shingles and the next starts half
a class later, so some window holds any copy whole; then the Jaccard similarity with the template is 0.38 at least for a
containment of 0.8, and one of 48 bands of two rows agrees with a probability of 0.999 or more. Windows without any
shingle of a template, and texts without any of the words that four fifths of a template can't do without, can hold no
copy; they leave before the hashing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.llm.common import written

WORDS, BANDS, ROWS, CONTAINED = 5, 48, 2, 0.8

#: Fixed texts: usual notices and the core passages of public licenses.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
]


def words(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def anchors(templates: list[tuple[str, str]]) -> list[str]:
    """Words of which a text must hold one to contain four fifths of a template's shingles: without them too few are left."""
    out: list[str] = []
    for _, text in templates:
        own = words(text)
        shingles = [own[k : k + WORDS] for k in range(max(1, len(own) - WORDS + 1))]
        chosen = [w for w in out if w in own]
        for w in sorted(set(own), key=lambda w: ("licen" not in w, -len(w), w)):
            if sum(not set(s) & set(chosen) for s in shingles) < CONTAINED * len(shingles):
                break
            if w not in chosen:
                chosen.append(w)
                out.append(w)
    # A word that holds another anchor needs no test of its own.
    return sorted({w for w in out if not any(o != w and o in w for o in out)})


def _class(n: int) -> int:
    """The size of the class of templates with n shingles: at most a quarter larger."""
    size = 1
    while size < n:
        size = max(size + 1, int(size * 1.25))
    return size


def _shingles(text: Column) -> Column:
    """Hashes of the five-word shingles of a text; of the whole text if it has fewer words."""
    own = F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " ")
    last = F.greatest(F.lit(0), F.size("_w") - WORDS)
    return own, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.array_join(F.slice("_w", i + 1, F.lit(WORDS)), " ")))


def _with_shingles(df: DataFrame) -> DataFrame:
    own, hashes = _shingles(F.col("text"))
    return df.withColumn("_w", own).withColumn("sh", hashes).drop("_w", "text")


def _bands(sh: Column) -> Column:
    """(band, key) of each band of MinHash rows."""
    lows = F.transform(F.sequence(F.lit(0), F.lit(BANDS * ROWS - 1)), lambda j: F.array_min(F.transform(sh, lambda x: F.xxhash64(x, j))))
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(b.alias("band"), F.xxhash64(*[F.get(F.col("_min"), b * ROWS + r) for r in range(ROWS)]).alias("key"))), lows


def _with_bands(df: DataFrame, sh: str) -> DataFrame:
    keys, lows = _bands(F.col(sh))
    return df.withColumn("_min", lows).withColumn("_b", F.explode(keys)).drop("_min").select("*", "_b.*").drop("_b")


def template_table(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """template, license, class, sh (distinct shingle hashes): as many rows as templates."""
    rows = [(k, name, _class(max(1, len(words(text)) - WORDS + 1)), text) for k, (name, text) in enumerate(templates)]
    return _with_shingles(spark.createDataFrame(rows, "template int, license string, cls int, text string")).withColumn("sh", F.array_distinct("sh"))


def find(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """doc_id, license, template, containment and first_word for each template that a text of docs (doc_id, text) contains.

    containment is the largest share of the template's shingles in a window, first_word the first such window's first
    word. Null and empty texts contain nothing; rows that repeat a doc_id and text give one result; null doc_ids are kept;
    an empty table gives no rows. Templates are a fixed list, so they may be broadcast.
    """
    known = template_table(docs.sparkSession, templates)
    low = F.lower(F.col("text"))
    may = F.lit(False)
    for a in anchors(templates):
        may = may | F.contains(low, F.lit(a))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(may).withColumn("th", F.xxhash64("text"))
    texts = written(_with_shingles(rows), "license-texts").dropDuplicates(["doc_id", "th"])
    of = known.select("cls", F.explode("sh").alias("h")).distinct()
    # Windows of class c start at every step shingles and hold width.
    step, width = F.greatest(F.lit(1), (F.col("cls") / 2).cast("int")), F.ceil(F.col("cls") * 1.5).cast("int")
    hits = texts.select("doc_id", "th", F.posexplode("sh").alias("pos", "h")).join(F.broadcast(of), "h").select("doc_id", "th", "cls", "pos", step.alias("step"), width.alias("width"))
    lowest = F.greatest(F.lit(0), F.ceil((F.col("pos") - F.col("width") + 1) / F.col("step")).cast("int"))
    windows = hits.select("doc_id", "th", "cls", "step", "width", F.explode(F.sequence(lowest, (F.col("pos") / F.col("step")).cast("int"))).alias("k")).distinct()
    t = texts.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "sh")
    cut = windows.join(t, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))).select("doc_id", "th", "cls", (F.col("k") * F.col("step")).alias("first"), F.array_distinct(F.slice("sh", F.col("k") * F.col("step") + 1, F.col("width"))).alias("win"))
    keys = _with_bands(known.select("template", "cls", "sh"), "sh").select(F.col("cls").alias("_cls"), F.col("band").alias("_band"), F.col("key").alias("_key"), "template")
    met = _with_bands(cut, "win").join(F.broadcast(keys), (F.col("cls") == F.col("_cls")) & (F.col("band") == F.col("_band")) & (F.col("key") == F.col("_key"))).select("doc_id", "th", "first", "win", "template")
    share = F.size(F.array_intersect("win", "sh")) / F.size("sh")
    sure = met.join(F.broadcast(known.select("template", "license", "sh")), "template").withColumn("containment", share).where(F.col("containment") >= CONTAINED)
    return sure.groupBy("doc_id", "th", "license", "template").agg(F.max("containment").alias("containment"), F.min("first").cast("long").alias("first_word")).drop("th")
