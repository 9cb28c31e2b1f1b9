from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cinetable.llm import common, license_scan, quality, queries, url_filter

from .fixtures import documents, texts, words

URLS = [
    None, "", "no scheme", "http://", "https://WWW.Example.com/en/1?x#y", "https://example.com/en/2", "https://a.www.example.com/en/2", "https://example.com", "http://x.net/es/1", "http://net/fr/", "http://notnet/fr/",
    "https://spam-farm.example.org/en/7.html?ref=1", "https://www.spam-farm.example.org/en/7/", "https://spam-farm.example.org/en/7777", "a://b://c/d", "x\ny://h/p\nq?z", "https://spam-farm.example.org/en/7.html?ref=1",
]


def judged(url: str | None, listed: set[str]) -> tuple[str, str, str | None, str]:
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = host.translate(str.maketrans(common.UPPER, common.LOWER))
    fits = [(h + p, v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        name, verdict = max(fits, key=lambda x: len(x[0]))
        return host, path, name, verdict
    key = re.sub(r"^(www|m)\.", "", host) + re.sub(r"(\.html)?/*$", "", path)
    return host, path, None, "block" if key in listed else "allow"


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_urls(spark: SparkSession, monkeypatch: pytest.MonkeyPatch, most: int) -> None:
    monkeypatch.setattr(common, "BROADCAST_BYTES", most)
    pages = spark.createDataFrame([(i, u, "a", "b") for i, u in enumerate(URLS)] + [(None, URLS[5], "a", "b")], "page_id long, url string, host string, verdict string")
    listed = queries.listed_urls(spark).unionAll(spark.createDataFrame([(None,)], "url string"))
    names = {r[0] for r in listed.collect() if r[0]}
    rows = url_filter.filter_urls(pages, listed, queries.URL_RULES).collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        want = judged(URLS[5 if r.page_id is None else r.page_id], names)
        assert (r.host, r.path, r.rule, r.verdict) == want
        assert r.possible_hit or not r.listed
    assert sum(r.verdict == "block" for r in rows) >= 5


def test_only_possible_hits_reach_the_exact_join(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    frame = url_filter.filter_urls(pages, queries.listed_urls(spark), [])
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.split("\n")
    at = next(i for i, line in enumerate(lines) if "Join LeftOuter" in line and "_key" in line)
    depth = len(lines[at]) - len(lines[at].lstrip(" :+-"))
    before = next(line for line in lines[at + 1 :] if "Filter" in line and len(line) - len(line.lstrip(" :+-")) > depth)
    assert "Union" in plan and "&" in before and "coalesce" in before.lower()  # the filter on the bits of the words


def test_bloom_shards_are_dense(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    monkeypatch.setattr(url_filter, "SHARD_BLOCKS", 8)
    listed = spark.range(50).select(F.concat(F.lit("h/p"), F.col("id").cast("string")).alias("u"))
    rows = {r._shard: r._words for r in url_filter.bloom_shards(listed, "u", 21).collect()}
    assert {k: len(v) for k, v in rows.items()} == {0: 32, 1: 32, 2: 20}
    pages = spark.range(100).select("id", F.concat(F.lit("x://h/p"), F.col("id").cast("string")).alias("url"))
    assert url_filter.filter_urls(pages, listed, [], id_col="id", listed_col="u").where("listed and possible_hit").count() == 50


def test_bloom_has_no_false_negatives_and_few_positives(spark: SparkSession) -> None:
    pages = spark.range(20_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.org/p"), F.col("id").cast("string")).alias("url"))
    listed = spark.range(2000).select(F.concat(F.lit("h.org/p"), F.col("id").cast("string")).alias("url"))
    found = url_filter.filter_urls(pages, listed, []).agg(F.sum(F.col("listed").cast("int")), F.sum(F.col("possible_hit").cast("int"))).first()
    assert found[0] == 2000 and 2000 <= found[1] < 2100


def test_urls_empty(spark: SparkSession) -> None:
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.filter_urls(none, queries.listed_urls(spark), queries.URL_RULES).count() == 0
    some = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    assert url_filter.filter_urls(some, none.select("url"), []).first().verdict == "allow"


def measured(text: str | None) -> tuple[int, int, int, int, int]:
    own = words(text)
    wins = [tuple(own[i : i + 5]) for i in range(len(own) - 4)]
    count = Counter(wins)
    cover = {j for i, w in enumerate(wins) if count[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cover)


def test_quality_measures(spark: SparkSession) -> None:
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = Counter((r.doc_id, *(r[n] for n in names)) for r in quality.judge_quality(documents(spark).drop("n_words"), measures=names).collect())
    rows = documents(spark).collect()
    assert got == Counter((r.doc_id, *measured(r.text)) for r in rows)


def test_quality_verdicts_do_not_depend_on_order_or_measures(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    docs = documents(spark)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    key = lambda r: (r.doc_id, r.rejected_by is None)
    full = Counter(map(key, quality.judge_quality(docs, measures=names).collect()))
    monkeypatch.setattr(quality, "ordered", lambda rules, of, there=(): rules[::-1])
    assert Counter(map(key, quality.judge_quality(docs).collect())) == full
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({i: n for (i, ok), n in full.items() if ok})
    assert 30 < kept.count() < docs.count() - 5


def test_quality_orders_by_rejection_per_cost() -> None:
    rule = lambda name, *needs, per_char=0.0: quality.QualityRule(name, None, needs, per_char)  # type: ignore[arg-type]
    dear, cheap, shared = rule("dear", "n_repeat_words"), rule("cheap", "n_shouts"), rule("shared", "n_words", "n_shouts")
    of = lambda **rejected: quality.Sampled(100, 1000.0, 160.0, {frozenset(k.split("_")): n for k, n in rejected.items()})
    names = lambda found: [r.name for r in found]
    assert names(quality.ordered([dear, cheap], of(dear=10, cheap=10))) == ["cheap", "dear"]
    assert names(quality.ordered([dear, cheap], of(dear=60, cheap=1))) == ["dear", "cheap"]
    # what the first rule rejects counts no more for the others, and what it has made is free for them
    assert names(quality.ordered([dear, cheap, shared], of(dear=5, cheap_dear=30, shared=9))) == ["cheap", "shared", "dear"]
    assert names(quality.ordered([dear, cheap, shared], of(dear=5, shared=5, cheap=5), quality.made_of(["n_repeat_words"]))) == ["dear", "cheap", "shared"]


def test_ten_estimates_give_one_order(spark: SparkSession) -> None:
    rules = quality.standard_rules() + quality.base_rules()
    estimates = [quality.sampled(quality.bounded_sample(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")), rules) for _ in range(10)]
    assert all(e == estimates[0] for e in estimates) and 500 < estimates[0].rows < 1500
    assert len({tuple(r.name for r in quality.ordered(rules, e)) for e in estimates}) == 1


def test_a_measure_waits_for_the_rules_before_its_own(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    """`word_chars` fails on any row it is taken of, so it must not be taken of rows that `too_short` rejects."""
    docs = spark.createDataFrame([(1, "too short"), (2, "of three words")], "doc_id long, text string")
    dear = quality.Measure(lambda: F.raise_error(F.lit("taken")).cast("long"), (), 1000, 0)
    monkeypatch.setitem(quality.MEASURES, "word_chars", dear)
    rules = [quality.QualityRule("late", F.col("word_chars") > 0, ("word_chars",)), quality.base_rules()[0]]
    monkeypatch.setattr(quality, "sampled", lambda sample, rules: quality.Sampled(2, 12.0, 2.5, {frozenset(["too_short"]): 2}))
    assert [r.rejected_by for r in quality.judge_quality(docs, rules).collect()] == ["too_short"] * 2


def test_quality_of_a_text_of_many_megabytes(spark: SparkSession) -> None:
    text = " ".join(f"w{i}" for i in range(700_000)) + "\n" + "a b c d e f\n" * 40_000
    (row,) = quality.judge_quality(spark.createDataFrame([(1, text)], "doc_id long, text string"), measures=("n_words", "n_dup_lines", "n_repeat_words")).collect()
    assert (row.n_words, row.n_dup_lines, row.n_repeat_words) == (940_000, 39_999, 240_000)


def test_quality_empty(spark: SparkSession) -> None:
    none = documents(spark, [])
    assert quality.judge_quality(none, measures=("n_words",)).count() == 0 and quality.keep_good(none).count() == 0


# -- licences -----------------------------------------------------------------------------------------------------


def cosines(line: str) -> list[float]:
    idf, units, other = license_scan.vectors(license_scan.TEMPLATES)
    counts = Counter(re.findall("[a-z0-9]+", line.translate(str.maketrans(common.UPPER, common.LOWER))))
    own = {t: n * idf.get(t, other) for t, n in counts.items()}
    norm = math.sqrt(sum(x * x for x in own.values())) or 1.0
    return [round(sum(own.get(t, 0.0) * w for t, w in unit.items()) / norm, 6) for unit in units]


def own_license(path: str, text: str | None) -> tuple[float, int] | None:
    parts = (text or "").split("\n") + ([text or ""] if path.endswith("LICENSE") else [])
    best = max((s, -k) for p in parts for k, s in enumerate(cosines(p)))
    return (best[0], -best[1]) if best[0] >= license_scan.THRESHOLD else None


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_licenses(spark: SparkSession, monkeypatch: pytest.MonkeyPatch, most: int) -> None:
    monkeypatch.setattr(common, "BROADCAST_BYTES", most)
    mit, apache, cc = "Released under the MIT license", "// Licensed under the Apache License, Version 2.0", "Licensed under CC BY-SA 4.0"
    files = [
        ("a/LICENSE", mit), ("a/b/x.txt", "nothing"), ("a/b/c/y.txt", apache + "\nmore words"), ("a/b/c/z.txt", None), ("a/b/c/LICENSE", cc), ("a/b/c/d/e.txt", "long " * 40), ("q/r.txt", ""), (None, mit), (None, None),
        ("ab/x.txt", "none"), ("a/b/x.txt", "nothing"), ("top.txt", "the terms of this general public thing"), ("a/bb/LICENSE", "no licence words"), ("a/bb/y", "z"), ("tie/LICENSE", mit), ("tie/LICENSE", cc), ("tie/f", "x"),
    ] + [(f"t/{i}.txt", t) for i, t in enumerate(texts())]
    frame = spark.createDataFrame([(i, p, t, "x") for i, (p, t) in enumerate(files)], "n long, path string, text string, license string")
    names = [n for n, _ in license_scan.TEMPLATES]
    dirs: dict[str, tuple[float, int]] = {}
    for p, t in files:
        if p and p.endswith("LICENSE") and (own := own_license(p, t)):
            where = p.rpartition("/")[0]
            dirs[where] = max(dirs.get(where, (0.0, -99)), own, key=lambda x: (x[0], -x[1]))
    for r in license_scan.scan_licenses(frame, keep=["n"]).collect():
        p, t = files[r.n]
        if own := own_license(p or "", t):
            want = (names[own[1]], own[0], "file")
        else:
            steps = p.split("/")[:-1] if p is not None else None
            above = next((d for k in range(len(steps), -1, -1) if (d := "/".join(steps[:k])) in dirs), None) if steps is not None else None
            want = (names[dirs[above][1]], dirs[above][0], above) if above is not None else (None, None, None)
        assert (r.license, r.found_in) == (want[0], want[2]), (p, t)
        assert r.score == pytest.approx(want[1]) if want[1] else r.score is None
    got = {r.n: r.license for r in license_scan.scan_licenses(frame, keep=["n"]).collect()}
    assert [got[i] for i in range(9)] == ["MIT", "MIT", "Apache-2.0", "CC-BY-SA-4.0", "CC-BY-SA-4.0", "CC-BY-SA-4.0", None, "MIT", None]


HEADER_LINES = [
    ("MIT License", "MIT"), ("The MIT License (MIT)", "MIT"), ("Licensed under the MIT License.", "MIT"), ("This project is licensed under the MIT License.", "MIT"), ("# SPDX-License-Identifier: MIT", "MIT"),
    ("BSD 3-Clause License", "BSD-3-Clause"), ("BSD 2-Clause License", "BSD-2-Clause"), (' * Licensed under the Apache License, Version 2.0 (the "License");', "Apache-2.0"), ("SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"),
    ("SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0"), ("GNU General Public License version 2", "GPL-2.0"), ("GNU General Public License v3", "GPL-3.0"), ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy", "MIT"), ("This Source Code Form is subject to the terms of the Mozilla Public", "MPL-2.0"), ("GNU AFFERO GENERAL PUBLIC LICENSE", "AGPL-3.0"),
    ("mit", None), ("mit der Lizenz", None), ("license", None), ("version 2.0", None), ("version 3", None), ("Version 2.1", None), ("v3.0", None), ("v2.0", None), ("Apache License", None), ("GNU GENERAL PUBLIC LICENSE", None), ("GNU Lesser General Public License", None),
    ("SPDX-License-Identifier: ISC", None), ("the terms of the license", None),
]

SYSTEM_TEXTS = Path("/usr/share/common-licenses")
SYSTEM_LICENSES = [("Apache-2.0", "Apache-2.0"), ("GPL-3", "GPL-3.0"), ("GPL-2", "GPL-2.0"), ("LGPL-3", "LGPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0"), ("BSD", "BSD-3-Clause"), ("Artistic", None), ("CC0-1.0", None), ("GFDL-1.3", None)]


def test_headers_and_full_texts(spark: SparkSession) -> None:
    lines = [(f"{i}/a.py", "some code\n" + text, want) for i, (text, want) in enumerate(HEADER_LINES)]
    wholes = [(f"system-{f}/LICENSE", (SYSTEM_TEXTS / f).read_text(encoding="utf-8"), want) for f, want in SYSTEM_LICENSES if (SYSTEM_TEXTS / f).is_file()]
    heirs = [(p.replace("LICENSE", "src/x.py"), "x", n) for p, _, n in wholes]
    files = spark.createDataFrame([f[:2] for f in lines + wholes + heirs], "path string, text string")
    got = {r.path: r.license for r in license_scan.scan_licenses(files).collect()}
    assert got == {p: want for p, _, want in lines + wholes + heirs}


def test_templates_as_a_table_with_full_texts(spark: SparkSession) -> None:
    """Each licence's own text, header and SPDX line are found, with templates from a table."""
    full = [(n, (SYSTEM_TEXTS / f).read_text(encoding="utf-8")) for f, n in SYSTEM_LICENSES if n and (SYSTEM_TEXTS / f).is_file()]
    lines = [("X-1.0", "Permission to juggle this software with three hands is granted."), ("X-1.0", "SPDX-License-Identifier: X-1.0"), ("Y", "All juggling prohibited by Y")]
    table = spark.createDataFrame(lines + full + [lines[0], (None, "a"), ("Z", None), ("Z", "--")], "license string, text string")
    files = [("x/LICENSE", lines[0][1]), ("x/src/a.c", "int x;"), ("b.c", "// SPDX-License-Identifier: X-1.0\nint y;"), ("c.c", "/* all juggling prohibited by y */")] + [(f"{n}/LICENSE", t) for n, t in full]
    got = {r.path: r.license for r in license_scan.scan_licenses(spark.createDataFrame(files, "path string, text string"), templates=table).collect()}
    assert got == {"x/LICENSE": "X-1.0", "x/src/a.c": "X-1.0", "b.c": "X-1.0", "c.c": "Y"} | {f"{n}/LICENSE": n for n, _ in full}
    assert len(license_scan.template_rows(table)) == 3 + len(full)
    with pytest.raises(ValueError, match="more than 2"):
        license_scan.template_rows(table, most=2)


def test_the_bound_keeps_what_rounds_up_to_the_threshold(spark: SparkSession) -> None:
    """A line whose cosine lies between the threshold less half a millionth and the threshold is scored as equal to it."""
    line, units = "alpha gamma", license_scan.vectors([("A", "alpha beta gamma"), ("B", "beta")])[1]
    reach = math.sqrt(sum(w * w for t, w in units[0].items() if t in line.split()))
    row = spark.createDataFrame([(line,)], "text string")
    assert row.where(license_scan.may_match(F.col("text"), units, reach + 4e-7)).count() == 1
    assert row.where(license_scan.may_match(F.col("text"), units, reach + 4e-6)).count() == 0


def test_licenses_empty(spark: SparkSession) -> None:
    assert license_scan.scan_licenses(spark.createDataFrame([], "path string, text string")).count() == 0
