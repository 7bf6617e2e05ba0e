"""Embedding queries: vectors of utterances, the label is the speaker."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import cosine_distance
from ..operators import mixtures, plda
from ..operators import vectors as v
from ..session import kept
from .base import query

_U = (
    "WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), "
    "u AS (SELECT vec_id, label, CASE WHEN list_dot_product(x, x) > 0 THEN list_transform(x, lambda a: a / sqrt(list_dot_product(x, x))) ELSE x END AS u FROM e), "
)
_C = (
    _U + "c0 AS (SELECT label, i, avg(u[i]) AS m FROM u, range(1, 65) r(i) GROUP BY ALL), c1 AS (SELECT label, list(m ORDER BY i) AS m FROM c0 GROUP BY label), "
    "c AS (SELECT label, list_transform(m, lambda a: a / sqrt(list_dot_product(m, m))) AS c FROM c1), "
    "p AS (SELECT vec_id, u.label AS truth, c.label AS predicted, list_dot_product(u, c) AS s, row_number() OVER (PARTITION BY vec_id ORDER BY list_dot_product(u, c) DESC, c.label) AS k FROM u, c), "
    "t AS (SELECT predicted, truth, count(*) AS n FROM p WHERE k = 1 GROUP BY ALL) "
)


@query(
    _U + "m0 AS (SELECT i, avg(u[i]) AS m FROM u, range(1, 65) r(i) GROUP BY i), m AS (SELECT list(m ORDER BY i) AS m FROM m0), "
    "d AS (SELECT vec_id, list_transform(list_zip(u, m), lambda z: z[1] - z[2]) AS d FROM u, m) "
    "SELECT vec_id, i - 1 AS i, round(d[i] / sqrt(list_dot_product(d, d)), 6) AS x FROM d, range(1, 65) r(i)"
)
def normalized_vectors(t):
    rows = v.centred(t.embeddings, "embedding").select("vec_id", F.posexplode("unit").alias("i", "x"))
    return rows.select("vec_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query(_C + "SELECT label, i - 1 AS i, round(c[i], 6) AS x FROM c, range(1, 65) r(i)")
def speaker_centroids(t):
    rows = v.centroids(t.embeddings, "embedding", "label").select("label", F.posexplode("centroid").alias("i", "x"))
    return rows.select("label", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


def _classified(t):
    rows = t.embeddings.select("vec_id", F.col("label").alias("truth"), "embedding")
    return v.nearest_centroid(rows, "embedding", v.centroids(t.embeddings, "embedding", "label"), "label")


@query(_C + "SELECT vec_id, predicted, round(s, 6) AS score FROM p WHERE k = 1")
def nearest_centroid(t):
    return _classified(t).select("vec_id", "predicted", F.round("score", 6).alias("score"))


@query(
    _C + "SELECT predicted, arg_max(truth, n * 1000 - truth) AS majority FROM t GROUP BY predicted"
)
def majority_speakers(t):
    return v.majority(v.contingency(_classified(t), "predicted", "truth"), "predicted", "truth")


@query(
    _C + ", a AS (SELECT predicted, sum(n) AS n FROM t GROUP BY predicted), b AS (SELECT truth, sum(n) AS n FROM t GROUP BY truth), z AS (SELECT sum(n) AS n FROM t), "
    "s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM t) AS pt, (SELECT sum(n * (n - 1) / 2) FROM a) AS pa, (SELECT sum(n * (n - 1) / 2) FROM b) AS pb, "
    "(SELECT n * (n - 1) / 2 FROM z) AS pz, (SELECT -sum(a.n / z.n * ln(a.n / z.n)) FROM a, z) AS ha, (SELECT -sum(b.n / z.n * ln(b.n / z.n)) FROM b, z) AS hb, "
    "(SELECT sum(t.n / z.n * ln(t.n * z.n / (a.n * b.n))) FROM t JOIN a USING (predicted) JOIN b USING (truth), z) AS mi) "
    "SELECT round((pt - pa * pb / pz) / ((pa + pb) / 2 - pa * pb / pz), 6) AS adjusted_rand, round(mi, 6) AS mutual_information, round(mi / ((ha + hb) / 2), 6) AS normalized_mutual_information, "
    "round(mi / hb, 6) AS homogeneity, round(mi / ha, 6) AS completeness, round(2 * (mi / hb) * (mi / ha) / (mi / hb + mi / ha), 6) AS v_measure, round(pt / sqrt(pa * pb), 6) AS fowlkes_mallows FROM s"
)
def cluster_scores(t):
    s = v.cluster_scores(v.contingency(_classified(t), "predicted", "truth"), "predicted", "truth")
    return s.select(*(F.round(c, 6).alias(c) for c in s.columns))


@query(
    _C + ", tt AS (SELECT truth AS l, sum(n) AS nt, coalesce(sum(n) FILTER (truth = predicted), 0) AS hit FROM t GROUP BY truth), pp AS (SELECT predicted AS l, sum(n) AS np FROM t GROUP BY predicted), "
    "r AS (SELECT nt, coalesce(hit / nullif(np, 0), 0) AS p, hit / nt AS r FROM tt LEFT JOIN pp USING (l)) "
    "SELECT round(sum(p * nt) / sum(nt), 6) AS \"precision\", round(sum(r * nt) / sum(nt), 6) AS recall, round(sum(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END * nt) / sum(nt), 6) AS f1 FROM r"
)
def classification_prf(t):
    s = v.classification_scores(v.contingency(_classified(t), "predicted", "truth"), "predicted", "truth")
    return s.select(*(F.round(c, 6).alias(c) for c in s.columns))


@query()
def pair_scores_eer(t):
    """Equal error rate of drawn pairs of equal and different speakers."""
    return v.equal_error_rate(v.drawn_pairs(t.embeddings, "embedding", "label", "vec_id"))


@query(
    "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), d AS (SELECT q.vec_id, list_distance(q.x, e.x) AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.x, e.x)) AS k "
    "FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0) SELECT vec_id, round(d, 5) AS distance FROM d WHERE k = 10"
)
def kdistance_curve(t):
    """Distance of the tenth neighbour: every row whose id is divisible by 20 against all rows."""
    asked = t.embeddings.where("vec_id % 20 = 0")
    return v.kth_distance(t.embeddings, asked, "embedding", "vec_id", 10).select("vec_id", F.round("distance", 5).alias("distance"))


@query()
def kmeans_clusters(t):
    return v.kmeans(t.embeddings, "embedding", 10).select("vec_id", "label", "cluster")


def _plda(t):
    rows = plda.prepared(t.embeddings, "embedding", 64)
    return rows, plda.train(rows, "embedding", "label", rounds=6)


@query()
def plda_classification(t):
    """The speaker of the largest likelihood ratio for every vector."""
    rows, model = _plda(t)
    speakers = plda.speaker_statistics(rows, "embedding", "label")
    made = plda.classify(rows.select("vec_id", "embedding"), "embedding", speakers, "label", model)
    return made.select("vec_id", "predicted", "score")


@query()
def plda_error_rates(t):
    """Equal error rates of drawn pairs by likelihood ratio and by cosine."""
    rows, model = _plda(t)
    pairs = plda.score_pairs(v.drawn_vectors(rows, "embedding", "label", "vec_id"), model)
    scores = kept(pairs.select("matched", F.col("score").alias("plda"), (1 - cosine_distance(F.col("x"), F.col("y"))).alias("cosine")), "scores")
    rates = [v.equal_error_rate(scores.select("matched", F.col(name).alias("score"))).select(F.lit(name).alias("scoring"), "eer", "threshold") for name in ("plda", "cosine")]
    return rates[0].unionByName(rates[1])


@query(
    "WITH e AS (SELECT label, i - 1 AS i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) r(i)) "
    "SELECT label, i, count(x) AS n, round(sum(x), 6) AS total, round(sum(x * x), 6) AS square FROM e GROUP BY ALL"
)
def class_statistics(t):
    """Zeroth, first and second order statistics of each speaker's vectors."""
    s = mixtures.class_statistics(t.embeddings, "embedding", "label")
    return s.select("label", F.col("i").cast("long").alias("i"), "n", F.round("total", 6).alias("total"), F.round("square", 6).alias("square"))


@query(
    "WITH e AS (SELECT vec_id, label, i - 1 AS i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) r(i)), m AS (SELECT label, i, avg(x) AS m, count(*) AS n FROM e GROUP BY ALL), "
    "w AS (SELECT vec_id, e.i, x - m AS x FROM e JOIN m USING (label, i)), g AS (SELECT i, avg(x) AS g FROM e GROUP BY i), b AS (SELECT label, m.i, m - g AS x, n FROM m JOIN g USING (i)), "
    "ww AS (SELECT p.i, q.i AS j, avg(p.x * q.x) AS v FROM w p JOIN w q USING (vec_id) GROUP BY ALL), bb AS (SELECT p.i, q.i AS j, sum(p.n * p.x * q.x) / sum(p.n) AS v FROM b p JOIN b q USING (label) GROUP BY ALL) "
    "SELECT i, j, round(ww.v, 7) + 0.0::DOUBLE AS within, round(bb.v, 7) + 0.0::DOUBLE AS between FROM ww JOIN bb USING (i, j)"
)
def class_scatter(t):
    """Covariance within and between speakers, for every pair of dimensions."""
    s = mixtures.scatter(t.embeddings, "embedding", "label")
    return s.select("i", "j", (F.round("within", 7) + F.lit(0.0)).alias("within"), (F.round("between", 7) + F.lit(0.0)).alias("between"))


@query()
def gaussian_statistics(t):
    """How much of each speaker's vectors each component of a mixture has, and the component's mean moved to them."""
    model = mixtures.train(t.embeddings, "embedding", 8, rounds=4)
    stats = mixtures.utterance_statistics(t.embeddings, "embedding", model, "label")
    return mixtures.adapted_means(stats, model).select("label", "component", "n", "mean")
