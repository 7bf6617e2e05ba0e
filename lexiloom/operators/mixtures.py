"""Sufficient statistics of vectors by class, and mixtures of diagonal Gaussians trained from them.

Every pass sums within its Arrow batches or tasks first, so what is shuffled has the size of the model or one row a class and place, not that of the
data. The driver holds a mixture (components x dimensions) and nothing that grows with the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import mean_vector, second_moment, vector_sums


def class_statistics(rows: DataFrame, vector: str, *keys: str) -> DataFrame:
    """keys, i, n, total, square: number, sum and sum of squares of the entries at each place of each class's vectors (nulls count nowhere)."""
    wide = F.transform(F.col(vector), lambda x: x.cast("double"))
    both = F.concat(wide, F.transform(wide, lambda x: x * x)).alias("_both")
    sums = vector_sums(rows.where(F.col(vector).isNotNull()).select(*keys, F.size(vector).alias("_d"), both), "_both", *keys, "_d")
    place = F.pmod("_i", "_d").alias("i")
    first = F.when(F.col("_i") < F.col("_d"), F.col("_s"))
    again = F.when(F.col("_i") >= F.col("_d"), F.col("_s"))
    counted = F.when(F.col("_i") < F.col("_d"), F.col("_c"))
    return sums.groupBy(*keys, place).agg(F.sum(counted).alias("n"), F.sum(first).alias("total"), F.sum(again).alias("square"))


def scatter(rows: DataFrame, vector: str, key: str) -> DataFrame:
    """i, j, within, between: covariances of vectors around their class's mean, and of the class means by their rows. Rows without a class or a vector are left out.

    One pass of sums of products over the rows, one over the class means. The result has a row for each pair of dimensions.
    """
    rows = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    square, total, n = second_moment(rows, vector)
    sizes = rows.groupBy(key).agg(F.count("*").cast("double").alias("_n"))
    means, _, _ = second_moment(mean_vector(rows, vector, key).join(sizes, key), "mean", "_n")
    mean = total / n
    within, between = (square - means) / n, means / n - np.outer(mean, mean)
    d = len(mean)
    i, j = np.divmod(np.arange(d * d), d)
    return rows.sparkSession.createDataFrame(pd.DataFrame({"i": i, "j": j, "within": within.ravel(), "between": between.ravel()}))


@dataclass(frozen=True)
class Mixture:
    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray
    likelihoods: tuple[float, ...] = ()

    def log_densities(self, x: np.ndarray) -> np.ndarray:
        """Log of weight times density, rows by components."""
        precision = 1 / self.variances
        fixed = np.log(self.weights) - 0.5 * (np.log(2 * np.pi * self.variances) + self.means**2 * precision).sum(axis=1)
        return fixed + x @ (self.means * precision).T - 0.5 * (x * x) @ precision.T


def _log_sum(logs: np.ndarray) -> np.ndarray:
    top = logs.max(axis=1)
    return top + np.log(np.exp(logs - top[:, None]).sum(axis=1))


def _step(rows: DataFrame, vector: str, model: Mixture) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
    """Sums over all rows of posteriors, of posteriors times entries and times their squares, of the log likelihood, and the rows."""
    k, d = model.means.shape

    def work(batches):
        total = np.zeros(k * (2 * d + 1) + 2)
        for pdf in batches:
            for at in range(0, len(pdf), 4096):
                x = np.array(pdf[vector].iloc[at : at + 4096].tolist(), np.float64)
                logs = model.log_densities(x)
                whole = _log_sum(logs)
                post = np.exp(logs - whole[:, None])
                total += np.concatenate([post.sum(axis=0), (post.T @ x).ravel(), (post.T @ (x * x)).ravel(), [whole.sum(), len(x)]])
        yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

    parts = rows.select(vector).mapInPandas(work, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
    flat = parts.sort_values("i")["v"].to_numpy() if len(parts) else np.zeros(k * (2 * d + 1) + 2)
    return flat[:k], flat[k : k + k * d].reshape(k, d), flat[k + k * d : -2].reshape(k, d), float(flat[-2]), float(flat[-1])


def _split(model: Mixture, components: int, shift: float = 0.2) -> Mixture:
    """The heaviest components doubled, the halves moved apart by a share of their spread, up to ``components``."""
    w, m, v = model.weights, model.means, model.variances
    heavy = np.argsort(-w, kind="stable")[: min(len(w), components - len(w))]
    signs = np.where(np.arange(m.shape[1]) % 2, -1.0, 1.0)  # not along a diagonal alone
    step = shift * np.sqrt(v[heavy]) * np.where((np.arange(len(heavy)) % 2)[:, None], signs, 1.0)
    w = w.copy()
    w[heavy] /= 2
    moved = m.copy()
    moved[heavy] -= step
    return Mixture(np.append(w, w[heavy]), np.concatenate([moved, m[heavy] + step]), np.concatenate([v, v[heavy]]))


def train(rows: DataFrame, vector: str, components: int, rounds: int = 8, floor: float = 1e-3, least_share: float = 1e-6) -> Mixture:
    """Mixture of at most ``components`` diagonal Gaussians by expectation maximisation.

    It starts from one Gaussian and doubles the heaviest until there are enough, with ``rounds`` rounds at each size. Variances don't fall under ``floor`` of the whole
    spread, components with less than ``least_share`` of the rows are dropped. ``likelihoods`` holds the mean log likelihood a row before each round at the last size, and after it.
    Null vectors are left out; raises ValueError without any other.
    """
    rows = rows.where(F.col(vector).isNotNull())
    first = rows.select(vector).first()
    if first is None:
        raise ValueError("no vectors to train a mixture on")
    d = len(first[0])
    _, total, square, _, n = _step(rows, vector, Mixture(np.ones(1), np.zeros((1, d)), np.ones((1, d))))
    mean = total / n
    least = np.maximum(floor * (square / n - mean**2), 1e-12)
    model = Mixture(np.ones(1), mean, np.maximum(square / n - mean**2, least))
    while True:
        likelihoods = []
        for k in range(rounds + 1):
            counts, sums, squares, likelihood, n = _step(rows, vector, model)
            likelihoods.append(likelihood / n)
            if k == rounds:
                break
            live = counts > least_share * n
            counts, sums, squares = counts[live], sums[live], squares[live]
            means = sums / counts[:, None]
            model = Mixture(counts / counts.sum(), means, np.maximum(squares / counts[:, None] - means**2, least))
        if len(model.weights) >= components:
            return Mixture(model.weights, model.means, model.variances, tuple(likelihoods))
        grown = _split(model, components)
        if len(likelihoods) > 1 and len(grown.weights) == len(model.weights):
            return Mixture(model.weights, model.means, model.variances, tuple(likelihoods))
        model = grown


def posteriors(rows: DataFrame, vector: str, model: Mixture, most: int = 20, least: float = 0.025) -> DataFrame:
    """rows with ``posteriors``: array of (component, p) of the likeliest ``most`` components, those under ``least`` left out but for the first, scaled to sum to 1.

    ``log_likelihood`` is the row's by all components. Both are null for null vectors.
    """

    @F.pandas_udf("components array<int>, shares array<double>, log_likelihood double")
    def selected(v: pd.Series) -> pd.DataFrame:
        components, shares, likelihood = ([None] * len(v) for _ in range(3))
        there = np.flatnonzero(v.notna().to_numpy())
        if len(there):
            logs = model.log_densities(np.array(v.iloc[there].tolist(), np.float64))
            whole = _log_sum(logs)
            order = np.argsort(-logs, axis=1, kind="stable")[:, :most]
            p = np.exp(np.take_along_axis(logs, order, axis=1) - whole[:, None])
            p[:, 1:][p[:, 1:] < least] = 0
            p /= p.sum(axis=1, keepdims=True)
            for at, c, q, w in zip(there, order, p, whole, strict=True):
                components[at], shares[at], likelihood[at] = c[q > 0].tolist(), q[q > 0].tolist(), float(w)
        return pd.DataFrame({"components": components, "shares": shares, "log_likelihood": pd.Series(likelihood, dtype=float)})

    out = rows.withColumn("_found", selected(F.col(vector)))
    pairs = F.zip_with("_found.components", "_found.shares", lambda c, p: F.struct(c.alias("component"), p.alias("p")))
    likelihood = F.when(F.col(vector).isNotNull(), F.col("_found.log_likelihood"))
    return out.withColumns({"posteriors": pairs, "log_likelihood": likelihood}).drop("_found")


def utterance_statistics(rows: DataFrame, vector: str, model: Mixture, *keys: str, most: int = 20, least: float = 0.025) -> DataFrame:
    """keys, component, n and f: how many of an utterance's frames a component has, and their sum, by the posteriors of posteriors().

    Batches are summed by utterance and component before the shuffle.
    """
    frames = posteriors(rows.where(F.col(vector).isNotNull()), vector, model, most, least)
    flat = frames.select(*keys, F.explode("posteriors").alias("_p"), vector)
    weighted = F.transform(F.col(vector), lambda x: x.cast("double") * F.col("_p.p"))
    flat = flat.select(*keys, F.col("_p.component").alias("component"), F.concat(F.array("_p.p"), weighted).alias("_v"))
    sums = vector_sums(flat, "_v", *keys, "component")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("_i", "_s"))), lambda x: x["_s"])
    whole = sums.groupBy(*keys, "component").agg(listed.alias("_l"))
    return whole.select(*keys, "component", F.get("_l", 0).alias("n"), F.slice("_l", 2, F.size("_l") - 1).alias("f"))


def adapted_means(statistics: DataFrame, model: Mixture, relevance: float = 10.0) -> DataFrame:
    """statistics (see utterance_statistics) with ``mean``: the component's mean moved to the utterance's frames, as far as it has more of them than ``relevance``."""
    table = pa.table({"component": pa.array(range(len(model.weights)), pa.int32()), "_prior": pa.array(model.means.tolist(), pa.list_(pa.float64()))})
    prior = statistics.sparkSession.createDataFrame(table)
    joined = statistics.join(F.broadcast(prior), "component")  # a row a component
    mean = F.zip_with("f", "_prior", lambda f, m: (f + m * relevance) / (F.col("n") + relevance))
    return joined.select(*statistics.columns, mean.alias("mean"))
