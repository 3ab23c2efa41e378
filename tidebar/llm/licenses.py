"""License scans: TF-IDF cosine of lines to templates, then inheritance from the nearest directory: DataFrame functions only."""

from __future__ import annotations

import re
from collections import Counter
from math import log, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Headers as projects write them, by SPDX name.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
COSINE = 0.75
# Words that lines of any kind have.
PLAIN = set("a and any are by for free in into is of or person source subject terms the this to use version with without work 0 2 3 4".split())


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def model(least: float = COSINE) -> tuple[dict[str, float], float, list[tuple[int, str, float]], list[str]]:
    """Inverse document frequencies over the templates, that of other words, the templates' unit vectors, and words of which every line that
    reaches `least` has one: by Cauchy-Schwarz, the others' share of each template's length is below it."""
    bags = [Counter(words_of(t)) for _, t in TEMPLATES]
    seen = Counter(w for b in bags for w in b)
    idf = {w: log((1 + len(bags)) / (1 + n)) + 1 for w, n in seen.items()}
    rows, units = [], []
    for k, bag in enumerate(bags):
        size = sqrt(sum((n * idf[w]) ** 2 for w, n in bag.items()))
        units.append({w: n * idf[w] / size for w, n in bag.items()})
        rows += [(k, w, n * idf[w] / size) for w, n in sorted(bag.items())]
    strong: set[str] = set()
    for unit in units:
        # Words that are strong already come first, then the heaviest that aren't plain words, until the rest can't reach `least`.
        for word in sorted(unit, key=lambda w: (w not in strong, w in PLAIN, -unit[w], w)):
            if sqrt(sum(x * x for w, x in unit.items() if w not in strong)) < least:
                break
            strong.add(word)
    return idf, log(1 + len(bags)) + 1, rows, sorted(strong)


def scan_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = COSINE) -> DataFrame:
    """(doc, license, score): the best license of each document that has a line like a template, by cosine, then template order."""
    idf, other, rows, strong = model(least)
    pattern = "(?i)(?<![a-z0-9])(" + "|".join(strong) + ")(?![a-z0-9])"
    hits = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).where(F.col("text").rlike(pattern))
    lines = hits.select("doc", F.explode(F.split("text", "\n")).alias("body")).where(F.col("body").rlike(pattern))
    # Lines are scored where they are: no word leaves its row. Words that no template has all weigh the same, so the squares of their counts are enough.
    words = lines.select("doc", F.filter(F.split(F.lower("body"), "[^a-z0-9]+"), lambda w: w != "").alias("words"))
    split = words.select("doc", F.filter("words", lambda w: w.isin(list(idf))).alias("known"), F.array_sort(F.filter("words", lambda w: ~w.isin(list(idf)))).alias("others"))
    runs = F.aggregate(
        "others", F.struct(F.lit("").alias("word"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("sum")),
        # A word's n-th time takes its square from (n - 1)^2 to n^2.
        lambda at, w: F.struct(w.alias("word"), F.when(at["word"] == w, at["n"] + 1).otherwise(F.lit(1).cast("long")).alias("n"), (at["sum"] + F.when(at["word"] == w, 2 * at["n"] + 1).otherwise(F.lit(1).cast("long"))).alias("sum")),
        lambda at: at["sum"],
    )
    units: dict[str, list[Column]] = {w: [] for w in idf}
    for k, w, x in rows:
        units[w].append(F.struct(F.lit(k).alias("template"), F.lit(x).alias("unit")))
    table = F.create_map(*[c for w, x in idf.items() for c in (F.lit(w), F.struct(F.lit(x).alias("idf"), F.array(*units[w]).alias("units")))])
    parts = F.transform(F.array_distinct("known"), lambda w: F.struct((F.size(F.filter("known", lambda v: v == w)) * table[w]["idf"]).alias("w"), table[w]["units"].alias("units")))
    weighed = split.where(F.size("known") > 0).select("doc", runs.alias("rest"), parts.alias("parts"))
    squares = F.aggregate("parts", F.lit(0.0), lambda at, p: at + p["w"] * p["w"])
    # By Cauchy-Schwarz no template's cosine is above the share of its words in the line's length.
    vectors = weighed.select("doc", "parts", squares.alias("own"), (F.col("rest") * F.lit(other * other)).alias("rest")).where(F.col("own") >= (least - 1e-6) ** 2 * (F.col("own") + F.col("rest"))).select("doc", "parts", F.sqrt(F.col("own") + F.col("rest")).alias("size"))
    dot = lambda k: F.aggregate("parts", F.lit(0.0), lambda at, p: at + p["w"] * F.aggregate(F.filter(p["units"], lambda u: u["template"] == k), F.lit(0.0), lambda s, u: s + u["unit"]))
    scores = F.array(*[F.struct(F.round(dot(k) / F.col("size"), 6).alias("score"), F.lit(-k).alias("rank")) for k in range(len(TEMPLATES))])
    best = vectors.select("doc", F.array_max(scores).alias("best")).groupBy("doc").agg(F.max("best").alias("best")).where(F.col("best.score") >= least)
    names = F.array(*[F.lit(n) for n, _ in TEMPLATES])
    return best.select("doc", F.element_at(names, 1 - F.col("best.rank")).alias("license"), F.col("best.score").alias("score"))


def license_files(name: Column) -> Column:
    """Whether a file's name says that it licenses its directory."""
    return F.coalesce(F.lower(name).rlike("^(un)?licen[sc]e|^copying|^notice"), F.lit(False))


def license_scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", least: float = COSINE) -> DataFrame:
    """(doc_id, license, score, directory, inherited): a row for each row of files.

    license and score are the file's own, of the line most like a template; without one, `inherited` is the license of the nearest directory
    above it (its own first) that has a licence file with a license, of several the one of the least path, and `directory` is that one. Both are null where
    there is none. Null and empty texts have no license of their own; files without a path inherit nothing; rows that repeat
    an id share its best line. Whole texts are read, line by line.
    """
    own = scan_lines(files, id_col, text_col, least)
    rows = files.select(F.col(id_col).alias("doc"), F.col(path_col).alias("path")).join(own, "doc", "left")
    folder = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit(""))
    rows = rows.withColumn("folder", F.when(F.col("path").isNotNull(), folder))
    licensed = files.select(F.col(id_col).alias("doc"), F.col(path_col).alias("path")).where(license_files(F.element_at(F.split(path_col, "/"), -1))).join(own, "doc").withColumn("folder", folder)
    granted = licensed.groupBy("folder").agg(F.min_by("license", F.struct("path", "doc")).alias("granted"))
    # Directories are few beside files: each looks its ancestors up, then files look up their directory.
    folders = rows.where("folder is not null").select("folder").distinct()
    parts = F.split("folder", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    above = folders.select("folder", F.explode(F.array_distinct(ups)).alias("up"))
    near = above.join(granted.withColumnRenamed("folder", "up"), "up").groupBy("folder").agg(F.max_by(F.struct("up", "granted"), F.length("up")).alias("near"))
    out = rows.join(near, "folder", "left")
    mine = F.col("license").isNull()
    return out.select(F.col("doc").alias("doc_id"), "license", "score", F.when(mine, F.col("near.up")).alias("directory"), F.when(mine, F.col("near.granted")).alias("inherited"))
