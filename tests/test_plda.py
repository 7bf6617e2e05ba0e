"""The two-covariance model against planted covariances, an expectation step by whole vectors and joint densities."""

import numpy as np
import pytest

from lexiloom.operators import plda, vectors
from lexiloom.queries import QUERIES


def planted(seed=0, speakers=150, d=3):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(2, d, d))
    between, within, mean = 2 * a @ a.T + np.eye(d), b @ b.T / 2 + 0.2 * np.eye(d), rng.normal(size=d) * 3
    rows = []
    for s in range(speakers):
        y = rng.multivariate_normal(mean, between)
        rows += [(len(rows) + i, f"s{s}", x.tolist()) for i, x in enumerate(rng.multivariate_normal(y, within, int(rng.integers(1, 12))))]
    return rows, mean, between, within


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, speaker string, v array<double>").repartition(5)


def log_density(x, mean, cov):
    diff = x - mean
    return -0.5 * (len(x) * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1] + diff @ np.linalg.solve(cov, diff))


def joint(xs, model):
    """Log density of vectors of one speaker, as one long vector."""
    n = len(xs)
    cov = np.kron(np.ones((n, n)), model.between) + np.kron(np.eye(n), model.within)
    return log_density(np.concatenate(xs), np.tile(model.mean, n), cov)


def brute_round(by, mean, between, within):
    """A round that looks at every vector."""
    ys, covs, n_all = [], [], sum(map(len, by))
    for xs in by:
        cov = np.linalg.inv(np.linalg.inv(between) + len(xs) * np.linalg.inv(within))
        ys.append(cov @ (np.linalg.solve(between, mean) + np.linalg.solve(within, np.sum(xs, axis=0))))
        covs.append(cov)
    new = np.mean(ys, axis=0)
    b = np.mean([c + np.outer(y - new, y - new) for y, c in zip(ys, covs)], axis=0)
    w = sum(np.outer(x - y, x - y) + c for xs, y, c in zip(by, ys, covs) for x in xs) / n_all
    return new, b, w


@pytest.fixture(scope="module")
def trained(spark):
    rows, *truth = planted()
    df = frame(spark, rows).cache()
    return rows, df, plda.train(df, "v", "speaker", rounds=8), truth


def test_rounds_against_whole_vectors(trained):
    rows, _, model, _ = trained
    by = {}
    for _, s, x in rows:
        by.setdefault(s, []).append(np.array(x))
    by, everything = list(by.values()), np.array([r[2] for r in rows])
    mean = everything.mean(axis=0)
    between = within = np.cov(everything.T, bias=True) / 2
    for k in range(8):
        now = plda.Plda(mean, between, within)
        assert model.likelihoods[k] == pytest.approx(sum(joint(xs, now) for xs in by), rel=1e-9)
        mean, between, within = brute_round(by, mean, between, within)
    for got, want in ((model.mean, mean), (model.between, between), (model.within, within)):
        assert np.allclose(got, want, rtol=1e-7, atol=1e-9)
    assert all(b >= a - 1e-6 for a, b in zip(model.likelihoods, model.likelihoods[1:]))


def test_planted_covariances_are_found(trained):
    _, _, model, (mean, between, within) = trained
    assert np.allclose(model.mean, mean, atol=0.6)
    assert np.linalg.norm(model.within - within) < 0.15 * np.linalg.norm(within)
    assert np.linalg.norm(model.between - between) < 0.3 * np.linalg.norm(between)
    matrix, spread = model.transform()
    assert np.allclose(matrix @ model.within @ matrix.T, np.eye(3)) and np.allclose(matrix @ model.between @ matrix.T, np.diag(spread))


def test_scores_against_joint_densities(spark, trained):
    rows, df, model, _ = trained
    xs = [np.array(r[2]) for r in rows[:12]]
    pairs = spark.createDataFrame([(i, j, xs[i].tolist(), xs[j].tolist()) for i in range(4) for j in range(12)] + [(9, 9, None, xs[0].tolist())], "a int, b int, x array<double>, y array<double>")
    for r in plda.score_pairs(pairs, model).collect():
        want = None if r.x is None else joint([xs[r.a], xs[r.b]], model) - joint([xs[r.a]], model) - joint([xs[r.b]], model)
        assert r.score == (want if want is None else pytest.approx(want, abs=1e-8))
    speakers = plda.speaker_statistics(df, "v", "speaker").where("speaker IN ('s1', 's2', 's3', 's40')")
    by = {}
    for _, s, x in rows:
        by.setdefault(s, []).append(np.array(x))
    asked = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(xs)] + [(99, None)], "vec_id long, v array<double>")
    for most in (100, 3):
        for r in plda.classify(asked, "v", speakers, "speaker", model, most=most).collect():
            if r.v is None:
                assert r.predicted is None and r.score is None
                continue
            ratios = {s: joint([*by[s], np.array(r.v)], model) - joint(by[s], model) - joint([np.array(r.v)], model) for s in ("s1", "s2", "s3", "s40")}
            assert r.predicted == max(ratios, key=ratios.get) and r.score == pytest.approx(max(ratios.values()), abs=1e-7)
    assert plda.classify(asked, "v", speakers, "speaker", model, threshold=1e9).where("predicted IS NOT NULL").count() == 0


def test_better_than_cosine_where_one_axis_is_noise(spark):
    rng = np.random.default_rng(8)
    rows = []
    for s in range(40):
        y = np.append(rng.normal(size=3), 0.0)
        rows += [(len(rows) + i, f"s{s}", (y + rng.normal(size=4) * [0.3, 0.3, 0.3, 6]).tolist()) for i in range(8)]
    df = frame(spark, rows).cache()
    model = plda.train(df, "v", "speaker", rounds=6)
    rate = lambda pairs: vectors.equal_error_rate(pairs).first().eer
    assert rate(plda.scored_pairs(df, "v", "speaker", "vec_id", model)) < 0.5 * rate(vectors.drawn_pairs(df, "v", "speaker", "vec_id"))


def test_adaptation_moves_total_covariance(spark, trained):
    rows, df, model, _ = trained
    same = plda.adapted(model, df, "v", 0.5, 0.5)
    wide = spark.createDataFrame([(i, s, [3 * x[0] + 5, x[1], x[2]]) for i, s, x in rows], "vec_id long, speaker string, v array<double>")
    moved = plda.adapted(model, wide, "v", 0.25, 0.75)
    x = np.array([[3 * r[2][0] + 5, *r[2][1:]] for r in rows])
    total = lambda m: m.between + m.within
    assert np.allclose(moved.mean, x.mean(axis=0)) and np.linalg.norm(total(same) - total(model)) < 0.2 * np.linalg.norm(total(model))
    assert np.linalg.eigvalsh(total(moved) - np.cov(x.T, bias=True)).min() > -1e-6  # covers what was seen
    assert np.allclose(moved.within - model.within, (moved.between - model.between) / 3)


def test_guards(spark):
    with pytest.raises(plda.TrainingError):
        plda.train(frame(spark, [(1, None, [1.0, 2.0, 3.0]), (2, "a", None)]), "v", "speaker")
    with pytest.raises(plda.TrainingError):
        plda.train(frame(spark, [(i, "a", [float(i), 2.0, 3.0]) for i in range(3)]), "v", "speaker")
    with pytest.raises(plda.TrainingError):
        plda.train(frame(spark, [(i, f"s{i}", [float(i), 2.0, i * i / 3]) for i in range(9)]), "v", "speaker")
    with pytest.raises(plda.TrainingError):
        plda.train(frame(spark, planted()[0]), "v", "speaker", least_vectors=1000)


def test_queries(spark):
    got = QUERIES["plda_classification"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 500 and all(r.score is not None for r in got)
    rates = {r.scoring: r.eer for r in QUERIES["plda_error_rates"](spark, "/root/testdata/sf0.001").collect()}
    assert rates.keys() == {"plda", "cosine"} and rates["plda"] < rates["cosine"]
