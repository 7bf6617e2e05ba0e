"""Banded alignment of intervals against the whole table, ranks in parts, words out of vocabulary."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.operators import corpus, metrics, vectors
from lexiloom.queries import QUERIES

SF = "/root/testdata/sf0.001"


def least_cost(a, b, gap):
    table = [[gap * (i + j) for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            match = abs(x[0] - y[0]) + abs(x[1] - y[1]) + 2 * (x[2] != y[2])
            table[i][j] = min(table[i - 1][j] + gap, table[i][j - 1] + gap, table[i - 1][j - 1] + match)
    return table[-1][-1]


@pytest.mark.parametrize("seed", range(40))
def test_band_costs_as_little_as_the_whole_table(seed):
    rng = random.Random(seed)
    side = lambda: [(b, b + rng.random() * rng.choice((0.1, 3, 20)), rng.choice("abc")) for b in (rng.uniform(0, rng.choice((5, 60))) for _ in range(rng.randrange(0, 25)))]
    a, b = side(), side()
    if seed % 3:
        a, b = sorted(a), sorted(b)
    gap = rng.choice((5.0, 0.5))
    pairs = metrics.align(a, b, gap)
    assert sorted(i for i, _ in pairs if i is not None) == list(range(len(a))) and sorted(j for _, j in pairs if j is not None) == list(range(len(b)))
    matched = [(i, j) for i, j in pairs if i is not None and j is not None]
    cost = gap * (len(pairs) - len(matched)) + sum(abs(a[i][0] - b[j][0]) + abs(a[i][1] - b[j][1]) + 2 * (a[i][2] != b[j][2]) for i, j in matched)
    assert cost == pytest.approx(least_cost(sorted(a), sorted(b), gap))
    assert [a[i][0] for i, _ in matched] == sorted(a[i][0] for i, _ in matched) and [b[j][0] for _, j in matched] == sorted(b[j][0] for _, j in matched)


def test_long_keys_take_little_time():
    rng = random.Random(1)
    a = [(k * 0.1, k * 0.1 + 0.09, rng.choice("abcdef")) for k in range(30_000)]
    b = [(x + rng.uniform(-0.02, 0.02), y, z) for x, y, z in a if rng.random() > 0.05]
    start = time.process_time()
    pairs = metrics.align(a, b)
    assert time.process_time() - start < 30
    assert sum(i is not None and j is not None for i, j in pairs) == len(b)


def test_ranks_within_groups(spark):
    rows = [("a", k % 7, k) for k in range(60)] + [(None, 1, k) for k in range(3)] + [("b", 5, 1)]
    df = spark.createDataFrame(rows, "g string, v int, id int").repartition(6)
    want = {}
    for g in ("a", None, "b"):
        for k, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))):
            want[r] = k
    got = {(r.g, r.v, r.id): r["rank"] for r in corpus.ranks_within(df, "g", -F.col("v"), F.col("id")).collect()}
    assert got == want


def test_unknown_words_in_order(spark):
    df = spark.createDataFrame([(1, "b a zz b yy"), (2, "a"), (3, None), (4, "")], "id int, text string")
    vocabulary = spark.createDataFrame([("a",), ("b",), ("b",)], "word string")
    words = F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda x: x != "")
    got = {r.id: r.oovs for r in corpus.with_unknown_words(df, words, vocabulary, "id").collect()}
    assert got == {1: "zz yy", 2: "", 3: "", 4: ""}


def test_equal_error_rate_of_drawn_pairs(spark):
    """The query's value from its own pairs, with every score tried as a threshold."""
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    pairs = vectors.drawn_vectors(df, "embedding", "label", "vec_id").collect()
    labels = {r.vec_id: r.label for r in df.collect()}
    assert all(p.matched == (labels[p.a] == labels[p.b]) and p.a != p.b for p in pairs)
    assert len({(p.a, p.b, p.matched) for p in pairs}) == len(pairs)
    score = lambda p: float(np.dot(p.x, p.y) / np.linalg.norm(p.x) / np.linalg.norm(p.y))
    same, other = (np.sort([score(p) for p in pairs if p.matched == m]) for m in (True, False))
    best = min((abs(np.mean(same < t) - np.mean(other >= t)), t) for t in np.concatenate([same, other]))[1]
    got = QUERIES["pair_scores_eer"](spark, SF).first()
    assert got.eer == pytest.approx((np.mean(same < best) + np.mean(other >= best)) / 2, abs=2 / len(pairs))


def test_discriminant_axes_against_whole_arrays(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.array([r.label for r in rows])
    means = np.array([x[y == c].mean(axis=0) for c in y])
    within, between = np.cov((x - means).T, bias=True), np.cov(means.T, bias=True)
    d = len(within)
    values, axes = np.linalg.eigh(within + 1e-6 * np.trace(within) / d * np.eye(d))
    white = axes / np.sqrt(values)
    turn = np.linalg.eigh(white.T @ between @ white)[1][:, ::-1][:, :4]
    want = {r.vec_id: v for r, v in zip(rows, np.abs(x @ white @ turn), strict=True)}
    for r in QUERIES["discriminant_vectors"](spark, SF).collect():
        assert np.allclose(np.abs(r.projected), want[r.vec_id], atol=1e-6)


def test_clusters_are_those_of_the_nearest_centres(spark):
    """k-means has settled: no row is clearly nearer to the mean of another cluster."""
    rows = QUERIES["kmeans_clusters"](spark, SF).collect()
    x = {r.vec_id: np.array(r.embedding) / np.linalg.norm(r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    names = sorted({r.cluster for r in rows})
    centres = np.array([np.mean([x[r.vec_id] for r in rows if r.cluster == c], axis=0) for c in names])
    wrong = 0
    for r in rows:
        distance = ((centres - x[r.vec_id]) ** 2).sum(axis=1)
        wrong += distance[names.index(r.cluster)] > distance.min() + 0.05
    assert wrong <= 0.02 * len(rows)


def test_long_utterances_are_aligned_in_stretches(spark):
    """One utterance over hours: no list of it reaches Python whole, and the pairs are those of the whole lists."""
    rng = random.Random(11)
    ref, hyp, at = [], [], 0.0
    for k in range(400):
        at += rng.choice([0.3, 1.0, 9.9, 10.0, 10.2, 40.0])
        label = rng.choice("abc")
        if rng.random() < 0.9:
            ref.append((1, at, at + 0.2, label))
        if rng.random() < 0.9:
            hyp.append((1, at + rng.choice([0.0, 0.05]), at + 0.27, rng.choice([label, "d"])))
    kinds = "user long, begin double, end double, label string"
    a = spark.createDataFrame([*ref, (2, 0.0, 1.0, "a"), (None, 0.0, 1.0, "b")], kinds)
    b = spark.createDataFrame([*hyp, (3, 0.0, 1.0, "a"), (None, 0.0, 1.0, "b")], kinds)
    got = [tuple(r) for r in metrics.aligned_pairs(a, b, "user").collect()]
    one, two = ([x[1:] for x in side] for side in (ref, hyp))
    want = [(1, "-" if i is None else one[i][2], "-" if j is None else two[j][2]) for i, j in metrics.align(one, two)]
    assert sorted(r[:3] for r in got if r[0] == 1) == sorted(want)
    assert [r[:3] for r in got if r[0] == 2] == [(2, "a", "-")] and [r[:3] for r in got if r[0] is None] == [(None, "b", "-")] and not [r for r in got if r[0] == 3]
    sizes = metrics.stretches(a, b, "user").select((F.size("_ref") + F.size("_hyp")).alias("n")).collect()
    assert max(r.n for r in sizes) < 100
