import numpy as np
import pytest

from lexiloom.operators import mixtures


def frames(n=900, seed=2):
    rng = np.random.default_rng(seed)
    means = np.array([[0, 0, 0], [6, 0, -3], [0, 7, 3.0]])
    spread = np.array([[1, 0.5, 1], [0.4, 1, 0.3], [1, 1, 0.2]])
    kind = rng.choice(3, n, p=[0.5, 0.3, 0.2])
    x = means[kind] + rng.normal(size=(n, 3)) * spread[kind]
    return [(i, f"u{i % 7}", v.tolist()) for i, v in enumerate(x)], means, spread, kind


@pytest.fixture(scope="module")
def planted(spark):
    rows, means, spread, kind = frames()
    df = spark.createDataFrame([*rows, (9999, "u0", None)], "id long, utterance string, v array<double>").repartition(5).cache()
    return rows, df, means, spread, kind, mixtures.train(df, "v", 3, rounds=25)


def test_planted_mixture_is_found(planted):
    rows, df, means, spread, kind, model = planted
    order = [int(np.abs(model.means - m).sum(axis=1).argmin()) for m in means]
    assert sorted(order) == [0, 1, 2]
    for k, at in enumerate(order):
        assert model.weights[at] == pytest.approx((kind == k).mean(), abs=0.02)
        assert np.allclose(model.means[at], means[k], atol=0.2) and np.allclose(np.sqrt(model.variances[at]), spread[k], rtol=0.15)
    assert all(b >= a - 1e-9 for a, b in zip(model.likelihoods, model.likelihoods[1:]))
    x = np.array([r[2] for r in rows])
    dense = sum(w * np.prod(np.exp(-0.5 * (x - m) ** 2 / v) / np.sqrt(2 * np.pi * v), axis=1) for w, m, v in zip(model.weights, model.means, model.variances))
    assert model.likelihoods[-1] == pytest.approx(np.log(dense).mean())


def test_one_round_against_whole_arrays(spark, planted):
    rows, df, *_ = planted
    x = np.array([r[2] for r in rows])
    model = mixtures.Mixture(np.array([0.4, 0.6]), np.array([[1.0, 0, 0], [0, 3.0, 1]]), np.array([[1.0, 2, 3], [4, 5, 6.0]]))
    p = np.exp(model.log_densities(x))
    post = p / p.sum(axis=1, keepdims=True)
    counts, sums, squares, likelihood, n = mixtures._step(df.where("v IS NOT NULL"), "v", model)
    assert n == len(x) and likelihood == pytest.approx(np.log(p.sum(axis=1)).sum())
    assert np.allclose(counts, post.sum(axis=0)) and np.allclose(sums, post.T @ x) and np.allclose(squares, post.T @ (x * x))


def test_utterance_statistics_and_adaptation(planted):
    rows, df, _, _, _, model = planted
    want = {}
    for _, u, v in rows:
        p = np.exp(model.log_densities(np.array([v])))[0]
        p /= p.sum()
        top = sorted(range(3), key=lambda k: -p[k])[:2]
        keep = {k: p[k] for i, k in enumerate(top) if i == 0 or p[k] >= 0.1}
        for k, q in keep.items():
            n, f = want.get((u, k), (0.0, np.zeros(3)))
            want[u, k] = n + q / sum(keep.values()), f + np.array(v) * q / sum(keep.values())
    stats = mixtures.utterance_statistics(df, "v", model, "utterance", most=2, least=0.1)
    got = {(r.utterance, r.component): r for r in mixtures.adapted_means(stats, model, 5.0).collect()}
    assert got.keys() == want.keys()
    for key, (n, f) in want.items():
        assert got[key].n == pytest.approx(n) and np.allclose(got[key].f, f)
        assert np.allclose(got[key]["mean"], (f + 5.0 * model.means[key[1]]) / (n + 5.0))
    some = mixtures.posteriors(df, "v", model, most=3, least=0.0).where("id IN (1, 9999)").collect()
    assert {r.id: r.posteriors is None for r in some} == {1: False, 9999: True}
    assert sum(x.p for r in some if r.posteriors for x in r.posteriors) == pytest.approx(1.0)


def test_class_statistics_and_scatter(spark):
    rng = np.random.default_rng(1)
    rows = [(f"c{i % 4}", rng.normal(size=3).tolist()) for i in range(50)] + [(None, [1.0, 2, 3]), ("c0", None)]
    df = spark.createDataFrame([(k, None if v is None else [float(x) for x in v]) for k, v in rows], "k string, v array<double>").repartition(3)
    got = {(r.k, r.i): (r.n, r.total, r.square) for r in mixtures.class_statistics(df, "v", "k").collect()}
    by = {}
    for k, v in rows:
        if v is not None:
            by.setdefault(k, []).append(v)
    for k, v in by.items():
        x = np.array(v)
        for i in range(3):
            assert got[k, i] == (len(x), pytest.approx(x[:, i].sum()), pytest.approx((x[:, i] ** 2).sum()))
    assert len(got) == 15
    by.pop(None)
    x, means = np.concatenate([np.array(v) for v in by.values()]), np.concatenate([np.tile(np.mean(v, axis=0), (len(v), 1)) for v in by.values()])
    within, between = np.cov((x - means).T, bias=True), np.cov(means.T, bias=True)
    for r in mixtures.scatter(df, "v", "k").collect():
        assert (r.within, r.between) == (pytest.approx(within[r.i, r.j]), pytest.approx(between[r.i, r.j]))


def test_guards(spark):
    none = spark.createDataFrame([], "v array<double>")
    with pytest.raises(ValueError):
        mixtures.train(none, "v", 2)
    same = spark.createDataFrame([([1.0, 2.0],)] * 20, "v array<double>")
    model = mixtures.train(same, "v", 4, rounds=2)
    assert np.allclose(model.weights @ model.means, [1, 2]) and np.isfinite(model.likelihoods).all()
    assert mixtures.class_statistics(none, "v").count() == 0
