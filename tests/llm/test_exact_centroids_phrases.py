"""Exact duplicates, centroid clustering and phrases against plain Python on hard rows."""

from __future__ import annotations

import hashlib
import math
import os
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402

from postscope.llm import centroids, exact, phrases  # noqa: E402
from postscope.llm import words as W  # noqa: E402
from postscope.llm.centroids import cluster_vectors  # noqa: E402
from postscope.llm.exact import exact_duplicates  # noqa: E402
from postscope.llm.phrases import mine_phrases  # noqa: E402

ROWS = brute.corpus()
LOWER = str.maketrans(exact.UPPER, exact.LOWER)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, brute.DOC_SCHEMA).repartition(5).persist()


# --- exact duplicates ----------------------------------------------------------


def duplicates(rows) -> list[tuple]:
    """Sorted (doc_id, keep_id, group size, kept, digest) of (doc_id, text)."""
    groups = defaultdict(list)
    for d, t in rows:
        groups[(t or "").translate(LOWER)].append(d)
    out = []
    for t, ids in groups.items():
        ids.sort(key=lambda d: (d is not None, d))
        sha = hashlib.sha256(t.encode()).hexdigest()
        out += [(d, ids[-1], len(ids), k == len(ids) - 1, sha) for k, d in enumerate(ids)]
    return sorted(out, key=repr)


def found_duplicates(frame) -> list[tuple]:
    rows = exact_duplicates(frame).collect()
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows), key=repr)


def test_exact_duplicates(docs):
    wanted = duplicates([(r[0], r[1]) for r in ROWS])
    assert found_duplicates(docs) == wanted
    assert sum(w[2] > 1 for w in wanted) > 10


def test_exact_duplicates_of_hot_and_hard_rows(spark):
    """Rows without an id, repeated rows, letters that only differ beyond A-Z, a long text, a hot text."""
    rows = [(None, "A b"), (None, "a B"), (3, "a b"), (3, "A B"), (2, "Ä"), (4, "ä"), (5, ""), (6, None), (None, ""), (None, "z"), (None, "Z")]
    rows += [(7, "long Text " * 300_000), (8, "LONG tEXT " * 300_000), (9, "long text " * 300_000 + "x"), (10, "a\x00"), (11, "A\x00"), (12, "a")]
    rows += [(100 + i, "the hot text") for i in range(500)]
    frame = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, print string, size int").repartition(6)
    assert found_duplicates(frame) == duplicates(rows)
    assert exact_duplicates(frame.where("false")).collect() == []


def test_texts_that_share_a_fingerprint_are_told_apart(spark, monkeypatch):
    """With a fingerprint of three values only bytes decide."""
    original = exact.F.xxhash64
    monkeypatch.setattr(exact.F, "xxhash64", lambda *c: original(*c) % 3)
    rows = [(i, f"text {i % 7}") for i in range(40)] + [(50, "alone"), (51, "single")]
    assert found_duplicates(spark.createDataFrame(rows, "doc_id long, text string")) == duplicates(rows)


def test_classes_beyond_the_broadcast_are_joined(docs, monkeypatch):
    monkeypatch.setattr(exact, "SENT_CLASSES", 1)
    monkeypatch.setattr(exact, "TASK_PRINTS", 3)
    assert found_duplicates(docs) == duplicates([(r[0], r[1]) for r in ROWS])


def test_quotient_filters_merge_without_loss():
    rng = np.random.default_rng(3)
    for shard in (0, 1, 8, 17):
        base = rng.integers(0, 1 << 64, 4000, dtype=np.uint64)
        if shard:
            base = (base >> np.uint64(shard)) | np.uint64(1 << (64 - shard))  # all in shard 1
        base[:3] = base[3]
        parts = [rng.choice(base, n) for n in (1, 2, 900, 5000)]
        runs = []
        for part in parts:
            prints, counts = np.unique(part, return_counts=True)
            packed = exact.build_filter(prints, counts, shard)
            again = exact.read_filter(packed, shard)
            assert (again[0] == prints).all() and (again[1] == counts).all()
            assert len(packed["remainders"]) <= 8 * len(prints)
            runs.append(again)
        wanted = np.unique(np.concatenate(parts), return_counts=True)
        merged = exact.merge_runs(runs)
        assert (merged[0] == wanted[0]).all() and (merged[1] == wanted[1]).all()
    assert exact.shard_bits(10) == 8 and exact.shard_bits(10**11) == 17


# --- centroids -----------------------------------------------------------------


def clustered(rows, k: int, rounds: int, dims: int) -> list[tuple]:
    """Sorted (vec_id, cluster, distance, cluster inertia, inertia, digest) in Python's whole numbers."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [int(x * 256 // 1) if abs(x) < 1e300 else int(x) * 256 for x in v]))
    ranks = {i: hashlib.sha256(f"2:{'null' if i is None else i}".encode()).hexdigest() for i, _ in kept}
    means = [v for _, v in sorted(kept, key=lambda r: ranks[r[0]])[:k]]

    def nearest(v):
        far = [sum((a - b) ** 2 for a, b in zip(v, m)) for m in means]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[0]].append(v)
        for c, members in groups.items():
            means[c] = [sum(x) // len(members) for x in zip(*members)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = Counter()
    for _, c, far in found:
        inertia[c] += far
    fit = lambda x: x if x < 1 << 63 else None
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in means]
    total = fit(sum(inertia.values()))
    return sorted(((i, c, fit(far), fit(inertia[c]), total, digest[c]) for i, c, far in found), key=repr)


def found_clusters(frame, **options) -> list[tuple]:
    rows = cluster_vectors(frame, **options).collect()
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in rows), key=repr)


def hard_vectors(seed: int, n: int, dims: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    rows = [(i * 3, [float(x) for x in np.round(rng.standard_normal(dims), 2)]) for i in range(n)]
    rows += rows[:4] + [(None, rows[5][1]), (7000, [0.0] * dims), (7001, [-0.0] * dims), (7002, [-1 / 512] * dims)]
    rows += [(8000, None), (8001, []), (8002, [1.0] * (dims - 1)), (8003, [None] + [1.0] * (dims - 1))]
    return rows + [(8004, [math.nan] + [0.5] * (dims - 1)), (8005, [-math.inf] * dims), (8006, [1.0] * (dims + 1))]


@pytest.mark.parametrize("k, rounds, dims, block", [(6, 5, 8, 2048), (40, 2, 3, 7), (500, 1, 4, 16)])
def test_clusters(spark, monkeypatch, k, rounds, dims, block):
    monkeypatch.setattr(centroids, "BLOCK", block)
    rows = hard_vectors(k, 150, dims)
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, cluster int, rank string")
    wanted = clustered(rows, k, rounds, dims)
    assert found_clusters(frame.repartition(5), k=k, rounds=rounds, dims=dims) == wanted
    assert found_clusters(frame.coalesce(1), k=k, rounds=rounds, dims=dims) == wanted


def test_clusters_of_very_large_numbers(spark):
    """Beyond 64 bits distances are null, and assignments still exact."""
    rows = [(i, [1.5 * i, -2.25]) for i in range(20)] + [(50, [3e9, 1e12]), (51, [1e30, -1e30]), (52, [1.7e308, 0.0]), (53, [1e30, -1e30])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found_clusters(frame, k=4, rounds=3, dims=2) == clustered(rows, 4, 3, 2)


def test_no_vectors(spark):
    frame = spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<float>")
    assert cluster_vectors(frame).collect() == [] and cluster_vectors(frame.where("false")).collect() == []


# --- phrases -------------------------------------------------------------------


def best_phrases(rows, least: int, top: int, share: int = 50) -> list[tuple]:
    """Sorted (lang, rank, phrase, a, l, r, n, score) of (text, lang)."""
    counts = defaultdict(Counter)
    for t, lang in rows:
        for piece in re.split("[.,;:!?\n-\r]", (t or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            for k in (1, 2, 3):
                counts[lang or ("und" if lang is None else lang)].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        some = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        gone = {g for t, n in some.items() if len(t) == 3 for g in (t[:2], t[1:]) if 100 * n >= share * f[g]}
        n = sum(a for g, a in f.items() if len(g) == 1)
        ranked = []
        for g, a in some.items():
            if g not in gone:
                cuts = [(1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g))]
                score, k = min(cuts)
                ranked.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        ranked.sort()
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(ranked[:top])]
    return sorted(out)


def found_phrases(frame, **options) -> list[tuple]:
    names = "lang rank phrase a l r n score".split()
    return sorted(tuple(r[x] for x in names) for r in mine_phrases(frame, **options).collect())


def prose(seed: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(30)] + ["Éa", "Big", "bIG", "日本", "new york city", "of the"]
    rows: list[tuple] = []
    for i in range(150):
        marks = [" ", " ", " ", " ", "\t ", ", ", ".", "\n", "\r", " ! "]
        picked = [words[min(int(x), len(words) - 1)] for x in rng.exponential(9, 60)]
        rows.append((i, "".join(w + marks[rng.integers(len(marks))] for w in picked), [None, "und", "en", "de"][i % 4]))
    rows += [(900, None, "en"), (901, "", None), (902, " \t. ,", "de"), (903, "alone", "xx"), (None, "same rows here " * 40, "en")]
    return rows + [(904, "a a a a " * 5000, "en"), (905, "big x " * 30 + "big y " * 30, "fr")] + rows[:5]


@pytest.mark.parametrize("hot, groups, chunk, words", [(1 / 512, 256, 1 << 20, 400_000), (0.004, 7, 2000, 5), (1.1, 1, 50, 1)])
def test_phrases(spark, monkeypatch, hot, groups, chunk, words):
    """With few and many hot words and pairs, groups and stretches of text."""
    for name, value in {"HOT_SHARE": hot, "LEAST_GROUPS": groups, "CHUNK_BYTES": chunk, "BLOCK_SUFFIXES": chunk, "TASK_WORDS": words}.items():
        monkeypatch.setattr(phrases, name, value)
    rows = prose(3)
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, n int, word string")
    wanted = best_phrases([(t, lang) for _, t, lang in rows], 10, 2000)
    assert found_phrases(frame.repartition(5)) == wanted
    assert len(wanted) > 50 and {w[0] for w in wanted} == {"und", "en", "de", "fr"}
    assert found_phrases(frame, least=2, top=25) == best_phrases([(t, lang) for _, t, lang in rows], 2, 25)


def test_phrases_of_the_corpus(docs):
    assert found_phrases(docs, least=3) == best_phrases([(r[1], r[2]) for r in ROWS], 3, 2000)
    assert mine_phrases(docs.where("false")).collect() == []


def test_quicksort_counts_prefixes():
    rng = np.random.default_rng(8)
    for n, values, least in ((0, 1, 1), (1, 1, 1), (5000, 6, 1), (5000, 40, 9), (20000, 3000, 10)):
        keys = [rng.integers(0, values + 1, n).astype(np.uint64) for _ in range(3)]
        keys[2][keys[1] == 0] = 0
        keys[0] += np.uint64(1)
        weights = rng.integers(1, 4, n)
        found = phrases.frequent_prefixes(keys, weights, least)
        for depth in (1, 2, 3):
            wanted = Counter()
            for *key, w in zip(*(k.tolist() for k in keys[:depth]), weights.tolist()):
                if key[-1]:
                    wanted[tuple(key)] += w
            at, counts = found[depth - 1]
            got = {tuple(int(k[i]) for k in keys[:depth]): int(c) for i, c in zip(at, counts)}
            assert got == {k: c for k, c in wanted.items() if c >= least} and len(got) == len(at)


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [(10**15 - 1, 10**15, 10**15 + 7), (9 * 10**14, 9 * 10**15, 9 * 10**14), (3_000_000_019, 3_000_000_020, 3_000_000_021)]
    frame = spark.createDataFrame(rows, "a long, l long, r long")
    found = frame.select("a", "l", "r", phrases.scored(frame["a"], frame["l"], frame["r"]).alias("score")).collect()
    assert all(s == 1_000_000 * a * a // (left * right) for a, left, right, s in found)


def test_suffixes_stop_at_marks():
    import pyarrow as pa

    (chunk,) = W.chunks(pa.array(["A b, c  d\te", None, "f", "a b"]))
    data, text, starts, stops, first, second, third = phrases.suffixes(chunk)
    spelled = [data[a:b].tobytes().decode() for a, b in zip(starts, stops)]
    name = dict(zip(first.tolist(), spelled)) | {0: ""}
    got = [(int(t), *(name[int(x)] for x in h)) for t, *h in zip(text, first, second, third)]
    assert got == [(0, "a", "b", ""), (0, "b", "", ""), (0, "c", "d", "e"), (0, "d", "e", ""), (0, "e", "", ""), (2, "f", "", ""), (3, "a", "b", ""), (3, "b", "", "")]
