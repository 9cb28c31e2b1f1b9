from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import SparkSession

import corpus_pipeline
from cinetable.llm import components, line_dedup, pii, simhash, weighted_sampling

from .fixtures import documents, texts, words
from .pii_cases import CASES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# -- personal data ------------------------------------------------------------------------------------------------


def plain_patterns(text: str) -> list[pii.Span]:
    """The patterns as they are defined, without the shortcuts of the operator."""
    out: list[pii.Span] = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            double = [int(d) * 2 - 9 * (int(d) > 4) if i % 2 else int(d) for i, d in enumerate(reversed(digits))]
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(digits) <= 19 and sum(double) % 10 == 0, "phone": 8 <= len(digits) <= 15}
            if good[kind]:
                out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(list("a@.1+ -()0é9\n4")), max_size=60))
def test_patterns(text: str) -> None:
    assert pii.pattern_spans(text) == plain_patterns(text)


def test_long_runs_stay_linear() -> None:
    pii.pattern_spans("a" * 10**6 + " @" + "1" * 10**6 + "1." * 10**5 + "+" * 10**5 + "+1 " * 10**5)


def test_field_on_held_out_rows() -> None:
    field = pii.standard_field()
    assert field.certified

    def spans(labels: list[str]) -> set[tuple[str, int, int]]:
        out, i = set(), 0
        while i < len(labels):
            j = i + 1
            if labels[i] != "O":
                while j < len(labels) and labels[j] == "I-" + labels[i][2:]:
                    j += 1
                out.add((labels[i][2:], i, j))
            i = j
        return out

    rows = pii.labelled_table(500, seed=4242)
    found = field.decode([field.scores(w) for w, _ in rows])
    want = [spans(labels) for _, labels in rows]
    got = [spans([pii.LABELS[k] for k in x]) for x in found]
    both, n_want, n_got = sum(len(a & b) for a, b in zip(want, got, strict=True)), sum(map(len, want)), sum(map(len, got))
    assert both / n_want > 0.93 and both / n_got > 0.93


def test_field_on_hand_written_texts() -> None:
    found = pii.find_spans([t for t, _ in CASES], pii.standard_field())
    want = {(i, k, x) for i, (_, spans) in enumerate(CASES) for k, x in spans}
    got = {(i, k, CASES[i][0][a:b]) for i, (_, added) in enumerate(found) for k, a, b in added}
    assert len(want) >= 35 and len(want & got) / len(want) >= 0.9 and len(want & got) / len(got) >= 0.9, want ^ got


def test_a_field_of_ones_own(spark: SparkSession) -> None:
    rows = [(["seat", f"{k}-A{k}"], ["O", "B-phone"]) for k in range(10, 60)] + [(["a", "b", "c"], ["O"] * 3), (["x"], None), ([], [])]
    labelled = spark.createDataFrame(rows, "words array<string>, labels array<string>")
    field = pii.field_of(labelled)
    assert [pii.LABELS[k] for k in field.decode([field.scores(["the", "seat", "33-A33"])])[0]] == ["O", "O", "B-phone"]
    docs = spark.createDataFrame([(1, "tel 613 555 3280")], "doc_id long, text string")
    assert pii.find_pii(docs, labelled=labelled.limit(0)).first().spans == []
    with pytest.raises(ValueError, match="unknown labels"):
        pii.field_of(spark.createDataFrame([(["a"], ["B-name"])], "words array<string>, labels array<string>"))


def test_long_words_are_read_whole() -> None:
    field = pii.standard_field()
    local = "a" * 300
    ((_, added),) = pii.find_spans([f"mail {local} (at) mail (dot) com and tel 030/1234567"], field)
    assert [k for k, _, _ in added] == ["email", "phone"] and added[0][2] - added[0][1] > 300
    pii.find_spans(["1-" * 300_000 + " call " + "x:" * 200_000 + " dot at " * 1000], field)


def test_viterbi_is_the_best_path() -> None:
    rng, field = np.random.default_rng(2), pii.standard_field()
    small = pii.Field(field.names, field.weights, rng.normal(size=(len(pii.LABELS),) * 2))
    for n in (1, 2, 3):
        scores = rng.normal(size=(n, len(pii.LABELS)))
        paths = np.stack(np.meshgrid(*[np.arange(len(pii.LABELS))] * n, indexing="ij")).reshape(n, -1)
        total = small.moves[0, paths[0]] + small.moves[paths[-1], 0] + sum(scores[i, paths[i]] for i in range(n)) + sum(small.moves[paths[i], paths[i + 1]] for i in range(n - 1))
        (got,) = small.decode([scores])
        assert got.tolist() == paths[:, total.argmax()].tolist()


def test_stretches_decode_like_whole_texts() -> None:
    field = pii.standard_field()
    whole = pii.Field(field.names, field.weights, field.moves)
    whole.certified = False
    some = [" ".join(w) for w, _ in pii.labelled_table(300, seed=5)] + [t or "" for t in texts()] + ["the " * 30 + " ".join(w) + " of" * 30 for w, _ in pii.labelled_table(100, seed=6)]
    assert pii.find_spans(some, field) == pii.find_spans(some, whole)


def test_pii(spark: SparkSession) -> None:
    docs = documents(spark).collect()
    rows = pii.find_pii(documents(spark), redact=True).collect()
    assert Counter((r.doc_id, tuple((s.kind, s.start, s.end) for s in r.spans if s.by == "pattern")) for r in rows) == Counter((d.doc_id, tuple(plain_patterns(d.text or ""))) for d in docs)
    text = {d.doc_id: d.text for d in docs}
    added = [text[r.doc_id][s.start : s.end] for r in rows for s in r.spans if s.by == "field"]
    assert "(613) 555-3280" in added and "joe (at) mail [dot] com" in added
    assert any("mail <EMAIL> or call <PHONE>, ip <IP> or 300.1.1.1, card <CARD> no 4111111111111112" in r.redacted for r in rows)
    assert pii.redact_documents(documents(spark)).columns == documents(spark).columns
    assert pii.find_pii(documents(spark, [])).count() == 0


# -- fingerprints -------------------------------------------------------------------------------------------------


def jaccard(a: str, b: str) -> float:
    x, y = Counter(words(a)), Counter(words(b))
    top = sum((x | y).values())
    return sum((x & y).values()) / top if top else 1.0


def test_likeness_estimates_generalised_jaccard() -> None:
    sampler, rng = weighted_sampling.Sampler(128), random.Random(3)
    errors = []
    for k in range(600):  # terms of their own for each pair, so that the errors are independent
        a = [rng.choice("abcdefghijklm") + str(k) for _ in range(rng.randint(1, 60))]
        b = a[: rng.randint(0, len(a))] + [rng.choice("abcdefghijklmnop") + str(k) for _ in range(rng.randint(1, 40))]
        x, y = " ".join(a), " ".join(b)
        errors.append(weighted_sampling.likeness(sampler.sign(x), sampler.sign(y)) - jaccard(x, y))
    assert abs(np.mean(errors)) < 0.008 and np.std(errors) < 0.055


def test_signatures_do_not_depend_on_the_cache() -> None:
    some = [t for t in texts() if t and words(t)]
    large, small = weighted_sampling.Sampler(64), weighted_sampling.Sampler(64, cached=40)
    want = [large.sign(t).tolist() for t in some]
    assert [small.sign(t).tolist() for t in some] == want and [large.sign(t).tolist() for t in reversed(some)] == want[::-1]


U64 = 2**64 - 1


def plain_mix(x: int) -> int:
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & U64
    x = (x ^ x >> 27) * 0x94D049BB133111EB & U64
    return x ^ x >> 31


def plain_signature(text: str, samples: int) -> list[int] | None:
    """Gamma sampling in a plain loop: every term against every hash, in double precision."""

    def units(h: int, stream: int, k: int) -> list[float]:
        bits = plain_mix(h ^ plain_mix((stream << 32) + k + 0x9E3779B97F4A7C15))
        return [((half >> 9) + 0.5) / 2**23 for half in (bits & 0xFFFFFFFF, bits >> 32)]

    def term_hash(word: str) -> int:
        data = word.encode()
        numbers = [plain_mix((b + 1) * 0x9E3779B97F4A7C15 & U64) for b in data]
        return plain_mix(sum(n * pow(weighted_sampling.BASE, i, 2**64) for i, n in enumerate(numbers)) + len(data) * 0xA0761D6478BD642F & U64)

    out = []
    weights = {term_hash(w): n for w, n in Counter(words(text)).items()}
    for k in range(samples if weights else 0):
        best = (math.inf, 0, 0)
        for h, w in weights.items():
            r, c, b = -math.log(math.prod(units(h, 0, k))), -math.log(math.prod(units(h, 1, k))), units(h, 2, k)[1]
            t = math.floor(math.log(w) / r + b)
            best = min(best, (math.log(c) - r * (t - b + 1), h, t))
        out.append(plain_mix(plain_mix(best[1] ^ plain_mix((3 << 32) + k + 0x9E3779B97F4A7C15)) + best[2] & U64) >> 48)
    return out or None


def test_signatures_are_those_of_a_plain_loop() -> None:
    some = [t or "" for t in texts()][:75] + ["a b b c c c c c c c c c", "x " * 1000 + "y", " ".join(f"w{i}" for i in range(300))]
    got = weighted_sampling.Sampler(32).sign_all(some)
    same = total = 0
    for text, own in zip(some, got, strict=True):
        want = plain_signature(text, 32)
        assert (own is None) == (want is None)
        if own is not None and want is not None:
            same, total = same + int((own == np.array(want)).sum()), total + 32
    assert total > 2000 and same / total > 0.998  # single precision may decide a near tie otherwise


def test_word_hashes_do_not_depend_on_blocks(monkeypatch: pytest.MonkeyPatch) -> None:
    data = "\n".join(t or "" for t in texts()).encode()
    want, places = weighted_sampling.WordHasher()(data)
    assert len(want) == len(words(data.decode())) and len(set(want.tolist())) == len(set(words(data.decode())))
    monkeypatch.setattr(weighted_sampling, "GROUP_BYTES", 50)
    got, at = weighted_sampling.WordHasher()(data)
    assert got.tolist() == want.tolist() and at.tolist() == places.tolist()


def test_a_text_of_many_megabytes_is_signed_whole(spark: SparkSession) -> None:
    text = " ".join(f"w{i % 200_000}" for i in range(900_000))
    docs = spark.createDataFrame([(1, text), (2, text + " end"), (3, "y" * 3_000_000)], "doc_id long, text string")
    rows = {r.doc_id: r for r in weighted_sampling.fingerprint_against_next(docs).collect()}
    assert rows[1].n_chars == len(text) and rows[1].near_next > 0.95 and rows[2].near_next < 0.1


@pytest.mark.parametrize("size", [1 << 27, 300])
def test_against_next(spark: SparkSession, monkeypatch: pytest.MonkeyPatch, size: int) -> None:
    monkeypatch.setattr(weighted_sampling, "RANGE_BYTES", size)
    docs = [(i, t) for i, t in enumerate(texts())]
    rows = {r.doc_id: r for r in weighted_sampling.fingerprint_against_next(documents(spark, docs)).collect()}
    assert sorted(rows) == [i for i, _ in docs]
    for i, t in docs:
        text, after, r = t or "", docs[(i + 1) % len(docs)][1] or "", rows[i]
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert abs(r.near_edited - jaccard(text, changed)) < 0.25 and abs(r.near_next - jaccard(text, after)) < 0.25
        if text == changed:
            assert r.near_edited == 1.0 and r.fingerprint == r.edited_fingerprint
    assert rows[0].fingerprint == rows[docs[-7][0]].fingerprint  # a repeated text
    single = {r.doc_id: r.fingerprint for r in weighted_sampling.fingerprint_documents(documents(spark, docs)).collect()}
    assert single == {i: r.fingerprint for i, r in rows.items()}


def test_against_next_with_repeats_and_nulls(spark: SparkSession) -> None:
    rows = weighted_sampling.fingerprint_against_next(documents(spark)).collect()
    assert Counter(r.doc_id for r in rows) == Counter(d.doc_id for d in documents(spark).collect())
    assert weighted_sampling.fingerprint_against_next(documents(spark, [])).count() == 0
    (one,) = weighted_sampling.fingerprint_against_next(documents(spark, [(1, "abcd")])).collect()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abab").hexdigest()


# -- lines --------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1)), max_size=300))
def test_perfect_hash(keys: set[tuple[int, int]]) -> None:
    hi, lo = (np.array([k[i] for k in sorted(keys)], np.uint64) for i in (0, 1))
    perfect = line_dedup.PerfectHash.from_bytes(line_dedup.PerfectHash.build(hi, lo).to_bytes())
    assert sorted(perfect.index(hi, lo).tolist()) == list(range(len(keys)))


def test_perfect_hash_keeps_what_collides_everywhere(monkeypatch: pytest.MonkeyPatch) -> None:
    monkeypatch.setattr(line_dedup, "LEVELS", 1)
    hi, lo = np.arange(500, dtype=np.uint64), np.arange(500, dtype=np.uint64) * np.uint64(7919)
    perfect = line_dedup.PerfectHash.from_bytes(line_dedup.PerfectHash.build(hi, lo).to_bytes())
    assert len(perfect.rest) and sorted(perfect.index(hi, lo).tolist()) == list(range(500))


def plain_dedup(docs: list[tuple[int | None, str | None]]) -> list[tuple[int | None, int, int, str]]:
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    number = lambda i: -(2**63) if i is None else i
    where: dict[str, set[int]] = {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            where.setdefault(key(line), set()).add(number(i))
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(k := key(x)) < 20 or len(where[k]) < 3 or max(where[k]) == number(i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("probes", [32_000, 5])
def test_line_dedup(spark: SparkSession, monkeypatch: pytest.MonkeyPatch, probes: int) -> None:
    monkeypatch.setattr(line_dedup, "SHARD_PROBES", probes)
    docs = [(d.doc_id, d.text) for d in documents(spark).collect()]
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(documents(spark)).collect())
    assert got == Counter(plain_dedup(docs)) and sum(n * k[2] for k, n in got.items()) > 20
    assert line_dedup.drop_shared_lines(documents(spark)).columns == documents(spark).columns
    assert line_dedup.dedup_lines(documents(spark, [])).count() == 0


# -- near-duplicates ----------------------------------------------------------------------------------------------


def plain_fingerprint(text: str | None) -> int:
    own = words((text or "").translate(LOWER))
    grams = [" ".join(own[i : i + 3]) for i in range(len(own) - 2)] if len(own) >= 3 else [" ".join(own)] if own else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps: list[int]) -> list[int]:
    """For each the place of the first that is reachable."""
    root = list(range(len(fps)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_near_duplicates(spark: SparkSession) -> None:
    docs = [(i, t) for i, t in enumerate(texts())]
    rows = {r.doc_id: r for r in simhash.near_duplicates(documents(spark, docs)).collect()}
    fps = [plain_fingerprint(t) for _, t in docs]
    assert [rows[i].fp & (2**64 - 1) for i, _ in docs] == fps
    assert [rows[i].component_id for i, _ in docs] == plain_components(fps)
    kept = simhash.keep_one_each(documents(spark, docs))
    assert kept.columns == documents(spark).columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(plain_components(fps)))


def test_near_duplicates_with_repeats_nulls_and_nothing(spark: SparkSession) -> None:
    rows = simhash.near_duplicates(documents(spark)).collect()
    assert Counter(r.doc_id for r in rows) == Counter(d.doc_id for d in documents(spark).collect())
    kept = [r.doc_id for r in simhash.keep_one_each(documents(spark)).collect()]
    assert kept.count(3) == 1 and kept.count(None) == 2  # two unlike texts with null ids
    assert simhash.near_duplicates(documents(spark, [])).count() == 0 and simhash.keep_one_each(documents(spark, [])).count() == 0


def cluster(n: int, seed: int) -> list[int]:
    """Random fingerprints, a dense cluster with few free bits, and long chains of small steps."""
    rng = random.Random(seed)
    base = rng.getrandbits(64)
    out = {rng.getrandbits(64) for _ in range(n)} | {base ^ sum(1 << b for b in rng.sample(range(40, 56), rng.randint(0, 5))) for _ in range(n)}
    step = rng.getrandbits(64)
    for _ in range(60):
        step ^= sum(1 << b for b in rng.sample(range(64), 3))
        out.add(step)
    return sorted(out | {0, 1, 2**64 - 1})


@pytest.mark.parametrize("grid", [*simhash.GRIDS, None])
@pytest.mark.parametrize("chunk", [600, 20])
def test_links_span_all_components(spark: SparkSession, grid: tuple[int, int] | None, chunk: int) -> None:
    fps = cluster(150, 9)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    distinct = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(2)
    links = simhash.fingerprint_links(distinct, grid=grid, chunk=chunk)
    pairs = links.collect()
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 3 for a, b in pairs)
    part = {r.node: r.component for r in components.connected_components(links).collect()}
    place: dict[int, list[int]] = {}
    for f, c in zip(signed, plain_components(fps), strict=True):
        place.setdefault(c, []).append(f)
    want = {f: min(group) for group in place.values() for f in group}
    assert {f: part.get(f, f) for f in signed} == want


@pytest.mark.parametrize("bits", [0, 1, 2, 5])
def test_other_distances(spark: SparkSession, bits: int) -> None:
    fps = cluster(40, 11)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"), bits).collect()
    near = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= bits}
    group = {f: f for f in signed}

    def find(i: int) -> int:
        while group[i] != i:
            i = group[i]
        return i

    for a, b in links:
        assert (min(a, b), max(a, b)) in near
        group[find(a)] = find(b)
    assert all(find(a) == find(b) for a, b in near)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark: SparkSession, pairs: list[tuple[int, int]]) -> None:
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    near: dict[int, set[int]] = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for node in near:
        seen, todo = {node}, [node]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        assert got[node] == min(seen)
    assert set(got) == set(near)


def test_components_of_a_long_chain(spark: SparkSession) -> None:
    order = list(range(400))
    random.Random(1).shuffle(order)
    chain = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a long, b long")
    assert {r.component for r in components.connected_components(chain).collect()} == {0}


# -- pipeline -----------------------------------------------------------------------------------------------------


def test_pipeline_stage_by_stage(spark: SparkSession, tmp_path) -> None:  # noqa: ANN001
    docs = [(i, t) for i, t in enumerate(texts())]
    frame = documents(spark, docs).select("doc_id", "text", "lang", "source", "n_chars")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    names, kept = frame.columns, spark.read.parquet(str(tmp_path / "documents.parquet"))
    results = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, kept, str(tmp_path)).write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        results.append(kept)
        assert kept.columns == names or name == "packing"
    rows = [sorted((r.doc_id, r.text) for r in f.collect()) for f in results[:-1]]
    assert set(rows[0]) < {(i, t) for i, t in docs} and 30 < len(rows[0])
    assert rows[1] == sorted((i, t) for i, _, _, t in plain_dedup(rows[0])) and rows[1] != rows[0]
    groups = plain_components([plain_fingerprint(t) for _, t in rows[1]])
    assert rows[2] == [rows[1][k] for k in sorted(set(groups))] and len(rows[2]) < len(rows[1])
    field = pii.standard_field()
    assert rows[3] == [(i, pii.redacted(t, [s for part in spans for s in part])) for (i, t), spans in zip(rows[2], pii.find_spans([t for _, t in rows[2]], field), strict=True)]
    assert all(r.n_chars == len(r.text) for r in results[3].collect())
    packed = sorted(map(tuple, results[4].collect()))
    assert {r[0] for r in packed} == {i for i, _ in rows[3]}
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == packed


def test_pipeline_on_nothing(spark: SparkSession, tmp_path) -> None:  # noqa: ANN001
    documents(spark, []).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
