"""Licence scan: TF-IDF cosine of lines and licence files to templates, then inheritance from the nearest directory.

Every line of a file (its headers and notices), and the whole text of a licence file, is compared with the templates.
Weights are term counts times ln((1 + T) / (1 + df)) + 1 over the T templates; terms of no template have df 0 and
lengthen a line's vector only. The best template with a cosine of at least `threshold` names the licence. A file
without one inherits that of the nearest directory above it that holds a licence file with one.

Files, then lines, are first narrowed by a bound: whatever else a line holds, its cosine is at most the length of the
template's unit vector on the terms that the line has. So the narrowing drops no match, and few lines are split into
terms. The vocabulary is as large as the templates and is broadcast if it has at most BROADCAST_BYTES; all else is
aggregated before it is joined.
Templates are notices, titles, first lines of headers, SPDX identifiers and lines that only one licence has; lines are scored one by one, so a
notice inside a longer line, or a licence wrapped over several lines of a file of another name, can be missed.

Null and empty texts have no licence of their own; a null path has no directory and inherits nothing. Of several
licence files of one directory the best cosine counts, then the earlier template. Texts of any length are scanned
whole. Repeated rows get equal answers, an empty table gives an empty one. Extra columns are dropped.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import ascii_lower, let, salted_left_join, size_in_bytes, staged

#: Licence names and their short notices.
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("BSD-3-Clause", "Redistribution is permitted under the BSD 3-Clause License."),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, version 2.0."),
]
#: Titles of licences, as they stand in headers. Neighbouring versions are here so that they aren't taken for another.
TITLES = [
    ("MIT", "MIT License"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("GPL-3.0", "GNU General Public License v3.0"),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-2.0", "GNU General Public License v2.0"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", "GNU Lesser General Public License v3.0"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-2.1", "GNU Lesser General Public License v2.1"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("AGPL-3.0", "GNU Affero General Public License v3.0"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("MPL-2.0", "Mozilla Public License, version 2.0"),
]
#: First lines and paragraphs of the usual headers of source files, and lines that only one licence has.
HEADERS = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License);"),
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license for"),
    ("AGPL-3.0", "The GNU Affero General Public License is a free, copyleft license for"),
    ("LGPL-3.0", "This version of the GNU Lesser General Public License incorporates"),
    ("GPL-2.0", "Version 2, June 1991"),
    ("LGPL-2.1", "Version 2.1, February 1999"),
    ("LGPL-2.0", "GNU Library General Public License, version 2"),
    ("LGPL-2.0", "GNU Library General Public License"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors"),
    ("BSD-3-Clause", "may be used to endorse or promote products derived from this software"),
    ("BSD-3-Clause", "contributors may be used to endorse or promote products derived from"),
    ("AGPL-3.0", "GNU Affero General Public License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "License, v. 2.0. If a copy of the MPL was not distributed with this"),
] + [
    (f"{short}-{version}.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU " + kind + "General Public License as published by the Free Software Foundation, "
     f"either version {version} of the License, or (at your option) any later version.")
    for short, kind, version in (("GPL", "", 3), ("LGPL", "Lesser ", 3), ("AGPL", "Affero ", 3), ("GPL", "", 2))
]
SPDX = "MIT Apache-2.0 GPL-3.0 LGPL-3.0 AGPL-3.0 GPL-2.0 LGPL-2.1 CC-BY-NC-4.0 CC-BY-SA-4.0 CC-BY-4.0 BSD-3-Clause BSD-2-Clause MPL-2.0".split()


def terms_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def weighted(title: str) -> str:
    """A title with words repeated, so that neither half of it is near enough: "MIT" alone, which is also a German word,
    or a title without its version, or a version alone."""
    if title == "MIT License":
        return f"The {title} License License"
    if "Public License v" in title:
        return "The terms of the " + title
    name, comma, version = title.replace(", Version", ", version").partition(", version ")
    if not comma:
        return title
    return " ".join([name] * 2 + ["version"] * 3 + [version] * (3 if version == "3" and "Lesser" in name else 2))


#: Several templates of one name: any of them names the licence.
TEMPLATES = (
    NOTICES
    + [(n, weighted(t)) for n, t in TITLES]
    + [(n, f"Licensed under the {t}." + (" License" if n == "MIT" else "")) for n, t in TITLES]
    + [(n, f"This project is licensed under the {t}.") for n, t in TITLES if n in ("MIT", "Apache-2.0", "BSD-3-Clause", "MPL-2.0")]
    + [(n, f"This work is licensed under the {t}.") for n, t in TITLES if n in ("GPL-2.0", "LGPL-2.1")]
    + HEADERS
    + [(n, f"SPDX-License-Identifier: {n}") for n in SPDX]
)
THRESHOLD = 0.75
#: Templates that a table may hold at most.
MOST_TEMPLATES = 2000
LICENSE_NAMES = r"(?i)^(licen[cs]e|copying|notice)(\.\w+)?$"


def vectors(templates: Sequence[tuple[str, str]]) -> tuple[dict[str, float], list[dict[str, float]], float]:
    """idf by term, unit vectors of the templates, and the idf of other terms."""
    return _vectors(tuple(templates))


@functools.lru_cache(4)
def _vectors(templates: tuple[tuple[str, str], ...]) -> tuple[dict[str, float], list[dict[str, float]], float]:
    counts = [Counter(terms_of(text)) for _, text in templates]
    df = Counter(t for c in counts for t in c)
    idf = {t: math.log((1 + len(counts)) / (1 + n)) + 1 for t, n in df.items()}
    raw = [{t: n * idf[t] for t, n in c.items()} for c in counts]
    return idf, [{t: w / math.sqrt(sum(x * x for x in v.values())) for t, w in v.items()} for v in raw], math.log(1 + len(counts)) + 1


def may_match(text: Column, units: Sequence[dict[str, float]], threshold: float, whole_words: bool = False) -> Column:
    """False only if no line of `text`, lower-cased, can reach the threshold.

    A cosine is at most the length of the template's unit vector on the terms that the line holds. Terms are looked
    for as substrings, which can only raise the bound, or as whole words.
    """
    names = sorted({t for unit in units for t in unit})
    held = lambda low: F.transform(F.expr("array(" + ", ".join(f"' {n} '" if whole_words else f"'{n}'" for n in names) + ")"), lambda n: F.contains(low, n))
    # scores are rounded to 6 places before they are compared
    least = (threshold - 1e-6) ** 2

    # Literals of one array: written out as columns, so many templates would take minutes to plan.
    parts = (", ".join(f"named_struct('i', {names.index(t)}, 'w', {w * w!r}D)" for t, w in sorted(unit.items())) for unit in units)
    literal = "array(" + ", ".join(f"array({p})" for p in parts) + ")"

    def bound(flags: Column) -> Column:
        reached = lambda unit: F.aggregate(unit, F.lit(0.0), lambda total, t: total + F.when(F.get(flags, t["i"]), t["w"]).otherwise(0.0)) >= least
        return F.exists(F.expr(literal), reached)

    low = ascii_lower(text)
    if whole_words:
        low = F.concat(F.lit(" "), F.regexp_replace(low, "[^a-z0-9]+", " "), F.lit(" "))
    return let(low, lambda low: let(held(low), bound))


def own_licenses(files: DataFrame, templates: Sequence[tuple[str, str]], threshold: float) -> DataFrame:
    """(_path, _hash, _template, _score) of files with a licence of their own. `files`: _path, _hash, _whole, _text."""
    idf, units, other = vectors(templates)
    some = files.where(may_match(F.col("_text"), units, threshold))
    lines = F.split("_text", "\n", -1)
    parts = some.select("_path", "_hash", F.posexplode(F.when(F.col("_whole"), F.concat(lines, F.array("_text"))).otherwise(lines)).alias("_line", "_part"))
    parts = parts.where(may_match(F.col("_part"), units, threshold)).where(may_match(F.col("_part"), units, threshold, whole_words=True))
    terms = parts.select("_path", "_hash", "_line", F.explode(F.regexp_extract_all(ascii_lower(F.col("_part")), F.lit("([a-z0-9]+)"))).alias("_term"))
    terms = terms.groupBy("_path", "_hash", "_line", "_term").agg(F.count("*").alias("_tf"))
    spark = files.sparkSession
    rows = [(t, w, [(k, unit[t]) for k, unit in enumerate(units) if t in unit]) for t, w in sorted(idf.items())]
    vocabulary = spark.createDataFrame(rows, "_term string, _idf double, _units array<struct<k: int, u: double>>")
    size = sum(len(t) + 32 + 16 * len(found) for t, _, found in rows)
    terms = terms.join(F.broadcast(vocabulary) if size <= common.BROADCAST_BYTES else vocabulary, "_term", "left").withColumn("_weight", F.col("_tf") * F.coalesce("_idf", F.lit(other)))
    # -1 stands for the part itself, the others for the templates
    own, none = F.struct(F.lit(-1).alias("k"), F.col("_weight").alias("u")), F.expr("cast(array() as array<struct<k: int, u: double>>)")
    dots = terms.select("_path", "_hash", "_line", "_weight", F.explode(F.concat(F.array(own), F.coalesce("_units", none))).alias("_e"))
    dots = dots.groupBy("_path", "_hash", "_line", F.col("_e.k").alias("_k")).agg(F.sum(F.col("_weight") * F.col("_e.u")).alias("_dot"))
    of_template = F.when(F.col("_k") >= 0, F.struct(F.col("_dot").alias("d"), (-F.col("_k")).alias("k")))
    scored = dots.groupBy("_path", "_hash", "_line").agg(F.sqrt(F.max(F.when(F.col("_k") < 0, F.col("_dot")))).alias("_norm"), F.collect_list(of_template).alias("_dots"))
    best = F.array_max(F.transform("_dots", lambda x: F.struct(F.round(x["d"] / F.col("_norm"), 6).alias("s"), x["k"].alias("k"))))
    best = scored.select("_path", "_hash", best.alias("_best")).where(F.col("_best.s") >= threshold).groupBy("_path", "_hash").agg(F.max("_best").alias("_best"))
    return best.select("_path", "_hash", (-F.col("_best.k")).alias("_template"), F.col("_best.s").alias("_score"))


def template_rows(templates: Sequence[tuple[str, str]] | DataFrame, most: int = MOST_TEMPLATES) -> list[tuple[str, str]]:
    """(licence, text) of each template. A table has these two columns, and may have several rows of one licence; rows
    with a null or without a term are left out, and so are repeats. Its order is that of its rows by name and text.
    More than `most` rows are refused: the templates are part of the plan."""
    if not isinstance(templates, DataFrame):
        return list(templates)
    found = templates.select("license", "text").where("license is not null and text is not null").distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} templates")
    return sorted((r[0], r[1]) for r in found if terms_of(r[1]))


def parent(path: Column) -> Column:
    """The directory of a path; the root is the empty string."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def scan_licenses(files: DataFrame, path_col: str = "path", text_col: str = "text", keep: Sequence[str] = (), templates: Sequence[tuple[str, str]] | DataFrame = TEMPLATES, threshold: float = THRESHOLD, names: str = LICENSE_NAMES) -> DataFrame:
    """Columns `keep`, path, license, score, and found_in: 'file', the directory inherited from, or null.

    `templates`: pairs of a licence and a text, or a table of them (see `template_rows`), full texts included.
    """
    templates = template_rows(templates)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.regexp_extract(F.coalesce(F.col(path_col), F.lit("")), "([^/]*)$", 1)
    rows = files.select(F.struct(*keep, F.col(path_col).alias("path")).alias("_keep"), F.coalesce(F.col(path_col), F.lit("")).alias("_path"), F.xxhash64(text).alias("_hash"), base.rlike(names).alias("_whole"), text.alias("_text"))
    own = staged(own_licenses(rows, templates, threshold), "own-licenses")
    labels = F.expr("array(" + ", ".join("'" + n.replace("'", "\\'") + "'" for n, _ in templates) + ")")
    label = F.get(labels, F.col("_template"))
    of_dir = own.where(F.regexp_extract("_path", "([^/]*)$", 1).rlike(names)).groupBy(parent(F.col("_path")).alias("_above")).agg(F.max(F.struct("_score", (-F.col("_template")).alias("k"))).alias("_best"))
    of_dir = staged(of_dir.select("_above", F.col("_best._score").alias("_dir_score"), (-F.col("_best.k")).alias("_dir_template")), "directory-licenses")
    # Directories meet their ancestors, not files: a directory counts once, however many files it holds.
    dirs = rows.where(F.col("_path") != "").select(parent(F.col("_path")).alias("_dir")).distinct()
    steps = F.split("_dir", "/", -1)
    above = F.transform(F.sequence(F.lit(0), F.when(F.col("_dir") == "", 0).otherwise(F.size(steps))), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(steps, 1, n), "/").alias("dir")))
    dirs = dirs.select("_dir", F.explode(above).alias("_a")).select("_dir", F.col("_a.depth").alias("_depth"), F.col("_a.dir").alias("_above"))
    nearest = dirs.join(of_dir, "_above").groupBy("_dir").agg(F.max(F.struct("_depth", "_above", "_dir_score", "_dir_template")).alias("_near"))
    nearest = staged(nearest, "nearest-licenses")
    # no text from here on
    slim = rows.select("_keep", "_path", "_hash", parent(F.col("_path")).alias("_dir"), F.xxhash64("_keep").alias("_row"))
    out = slim.join(own, ["_path", "_hash"], "left")
    out = salted_left_join(out, nearest, "_dir", size_in_bytes(nearest.select("_dir", "_near._above"), "_dir", "_above"))
    mine, near = F.col("_template").isNotNull(), (F.col("_near").isNotNull() & (F.col("_path") != ""))
    inherited = F.when(near, F.get(labels, F.col("_near._dir_template")))
    return out.select(
        "_keep.*",
        F.when(mine, label).otherwise(inherited).alias("license"),
        F.when(mine, F.col("_score")).when(near, F.col("_near._dir_score")).alias("score"),
        F.when(mine, F.lit("file")).when(near, F.col("_near._above")).alias("found_in"),
    )
