"""Probabilistic linear discriminant analysis: speakers vary by one covariance, the vectors of a speaker by another.

A speaker's mean is drawn around the corpus mean with covariance ``between``, each of its vectors around that with covariance ``within``. All that training
needs of a speaker is how many vectors it has and their sum, and of the corpus the sum of products; both are added up in Spark, and so is
what each round of expectation maximisation gathers from the speakers. The driver holds matrices of the vectors' dimension only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import scale_to_length
from ..session import checkpoint_folder
from .vectors import best_match, drawn_vectors, mean_vector, second_moment, vector_sums


class TrainingError(ValueError):
    """The vectors can't train a model."""


@dataclass(frozen=True)
class Plda:
    mean: np.ndarray
    between: np.ndarray
    within: np.ndarray
    likelihoods: tuple[float, ...] = ()

    def transform(self) -> tuple[np.ndarray, np.ndarray]:
        """(matrix, spread): after the matrix the within covariance is the identity and the between covariance has ``spread`` on its diagonal, falling."""
        values, axes = np.linalg.eigh(self.within)
        white = (axes / np.sqrt(values)).T
        spread, turn = np.linalg.eigh(white @ self.between @ white.T)
        return turn.T[::-1] @ white, np.maximum(spread[::-1], 0.0)


def _positive(m: np.ndarray, floor: float = 1e-10) -> np.ndarray:
    """Symmetric, with eigenvalues of at least ``floor`` of their mean."""
    values, axes = np.linalg.eigh((m + m.T) / 2)
    return (axes * np.maximum(values, floor * max(values.mean(), 1e-300))) @ axes.T


def prepared(rows: DataFrame, vector: str, dimension: int) -> DataFrame:
    """rows with the vector at length sqrt(dimension), as training and scoring take it; null vectors go."""
    return rows.where(F.col(vector).isNotNull()).withColumn(vector, scale_to_length(F.col(vector), float(np.sqrt(dimension))))


def speaker_statistics(rows: DataFrame, vector: str, key: str) -> DataFrame:
    """key, n and sum of each speaker's vectors. Rows without a speaker or a vector are left out."""
    rows = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    sums = vector_sums(rows, vector, key)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("_i", "_s"))), lambda x: x["_s"])
    return sums.groupBy(key).agg(F.max("_c").alias("n"), listed.alias("sum"))


def _gathered(stats: DataFrame, model: Plda) -> tuple[np.ndarray, float]:
    """One expectation step over the speakers: sums of (1, E y, E y y^T, n E y y^T - s E y^T - E y s^T) and of the log likelihood's parts by speaker."""
    d = len(model.mean)
    precision_b, precision_w = np.linalg.inv(model.between), np.linalg.inv(model.within)
    pull = precision_b @ model.mean
    fixed = np.linalg.slogdet(model.between)[1]

    def work(batches):
        total = np.zeros(2 + d + 2 * d * d)
        for pdf in batches:
            if not len(pdf):
                continue
            counts, sums = pdf["n"].to_numpy(np.float64), np.array(pdf["sum"].tolist(), np.float64)
            for n in np.unique(counts):  # speakers with as many vectors share a covariance
                s = sums[counts == n]
                precision = precision_b + n * precision_w
                spread = np.linalg.inv(precision)
                y = (pull + s @ precision_w) @ spread
                products = len(s) * spread + y.T @ y
                cross = s.T @ y
                energy = np.einsum("ij,jk,ik->", y, precision, y) - len(s) * (model.mean @ pull)
                likelihood = 0.5 * (energy - len(s) * (fixed + np.linalg.slogdet(precision)[1]))
                total += np.concatenate([[len(s), likelihood], y.sum(axis=0), products.ravel(), (n * products - cross - cross.T).ravel()])
        yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

    parts = stats.select("n", "sum").mapInPandas(work, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
    flat = parts.sort_values("i")["v"].to_numpy()
    return np.delete(flat, 1), float(flat[1])


def train(rows: DataFrame, vector: str, key: str, rounds: int = 10, least_vectors: int = 1) -> Plda:
    """Model of rows (vector, key: the speaker) by expectation maximisation, with the log likelihood before each round and after the last.

    Speakers of fewer than ``least_vectors`` vectors are left out, as are rows without a speaker or a vector. Raises TrainingError where nothing is left, where there are no
    more vectors than dimensions, and where no speaker has two vectors.
    """
    checkpoint_folder(rows.sparkSession)
    stats = speaker_statistics(rows, vector, key).where(F.col("n") >= least_vectors).checkpoint()
    kept = rows.where(F.col(vector).isNotNull()).join(stats.select(key), key, "left_semi")
    counts = stats.agg(F.count("*").alias("s"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    if not counts["s"]:
        raise TrainingError("no speaker has enough vectors")
    square, total, n = second_moment(kept, vector)
    d = len(total)
    if n <= d:
        raise TrainingError(f"{int(n)} vectors of {d} dimensions: there must be more vectors than dimensions")
    if counts["s"] == counts["n"]:
        raise TrainingError("no speaker has several vectors")
    mean = total / n
    half = _positive((square / n - np.outer(mean, mean)) / 2)
    model, likelihoods = Plda(mean, half, half), []
    for k in range(rounds + 1):
        sums, by_speaker = _gathered(stats, model)
        energy = float((np.linalg.inv(model.within) * square).sum())
        likelihoods.append(by_speaker - 0.5 * (n * (d * np.log(2 * np.pi) + np.linalg.slogdet(model.within)[1]) + energy))
        if k == rounds:
            break
        speakers, first, rest = sums[0], sums[1 : d + 1], sums[d + 1 :].reshape(2, d, d)
        mean = first / speakers
        model = Plda(mean, _positive(rest[0] / speakers - np.outer(mean, mean)), _positive((square + rest[1]) / n))
    return Plda(model.mean, model.between, model.within, tuple(likelihoods))


def adapted(model: Plda, rows: DataFrame, vector: str, within_share: float = 0.3, between_share: float = 0.7, mean_share: float = 1.0) -> Plda:
    """The model moved to vectors of another source, whose speakers needn't be known.

    Where the vectors spread further along an axis than the model's total covariance says, the excess is dealt to the covariances by the two shares. The mean becomes theirs, and
    its distance from the old one counts as spread by ``mean_share``.
    """
    square, total, n = second_moment(rows.where(F.col(vector).isNotNull()), vector)
    mean = total / n
    moved = mean - model.mean
    seen = square / n - np.outer(mean, mean) + mean_share * np.outer(moved, moved)
    values, axes = np.linalg.eigh(model.within + model.between)
    white = (axes / np.sqrt(values)).T
    spread, turn = np.linalg.eigh(white @ seen @ white.T)
    back = np.linalg.inv(turn.T @ white)  # from axes on which the model's total is the identity
    excess = (back * np.maximum(spread - 1.0, 0.0)) @ back.T
    return Plda(mean, model.between + between_share * excess, model.within + within_share * excess)


def project(rows: DataFrame, vector: str, model: Plda, dimensions: int | None = None) -> DataFrame:
    """rows with ``projected``: the vectors on the axes of transform(), those that tell speakers apart best first (null where the vector is)."""
    matrix = model.transform()[0][:dimensions]

    @F.pandas_udf("array<double>")
    def times(v: pd.Series) -> pd.Series:
        there = v.notna().to_numpy()
        out = pd.Series([None] * len(v), dtype=object)
        if there.any():
            out[there] = list((np.array(v[there].tolist(), np.float64) - model.mean) @ matrix.T)
        return out

    return rows.withColumn("projected", times(F.col(vector)))


def _ratio(u: np.ndarray, centres: np.ndarray, counts: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Log likelihood ratios of projected vectors u against speakers with ``counts`` vectors of mean ``centres`` (projected), one row a vector and one column a speaker."""
    share = counts[:, None] * spread / (counts[:, None] * spread + 1)  # how far a speaker's mean is believed
    expected, variance = share * centres, 1 + share / np.maximum(counts[:, None], 1e-300)
    same = (u**2) @ (1 / variance).T - 2 * u @ (expected / variance).T + (expected**2 / variance).sum(axis=1) + np.log(variance).sum(axis=1)
    other = (u**2 / (1 + spread)).sum(axis=1) + np.log(1 + spread).sum()
    return 0.5 * (other[:, None] - same)


def classify(rows: DataFrame, vector: str, speakers: DataFrame, key: str, model: Plda, threshold: float | None = None, most: int = 4096) -> DataFrame:
    """rows with ``predicted`` and ``score``: the speaker (key, n, sum: see speaker_statistics) of the largest log likelihood ratio.

    Below the threshold predicted is null (unknown speaker).
    """
    matrix, spread = model.transform()

    def score(x: np.ndarray, block: pd.DataFrame) -> np.ndarray:
        n = block["n"].to_numpy(np.float64)
        centres = (np.array(block["sum"].tolist(), np.float64) / n[:, None] - model.mean) @ matrix.T
        return np.round(_ratio((x - model.mean) @ matrix.T, centres, n, spread), 9)

    out = best_match(rows, vector, speakers.select(key, "n", "sum"), key, score, most)
    return out if threshold is None else out.withColumn("predicted", F.when(F.col("score") >= threshold, F.col("predicted")))


def score_pairs(pairs: DataFrame, model: Plda, x: str = "x", y: str = "y") -> DataFrame:
    """pairs with ``score``: log of how much likelier two vectors are with one speaker than with two; null where a vector is."""
    matrix, spread = model.transform()
    one, two = 1 + spread, 1 + 2 * spread
    weight_sum, weight_square = spread / two, spread * spread / (one * two)
    constant = float((np.log(one) - 0.5 * np.log(two)).sum())

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        there = (a.notna() & b.notna()).to_numpy()
        out = np.full(len(a), np.nan)
        if there.any():
            u, v = ((np.array(s[there].tolist(), np.float64) - model.mean) @ matrix.T for s in (a, b))
            out[there] = constant + (weight_sum * u * v - 0.5 * weight_square * (u * u + v * v)).sum(axis=1)
        return pd.Series(out)

    return pairs.withColumn("score", F.nanvl(ratio(F.col(x), F.col(y)), F.lit(None).cast("double")))


def scored_pairs(rows: DataFrame, vector: str, key: str, id: str, model: Plda, partners: int = 5) -> DataFrame:
    """a, b, matched, score of drawn pairs of equal and different speakers, ready for vectors.equal_error_rate()."""
    return score_pairs(drawn_vectors(rows, vector, key, id, partners), model).drop("x", "y")


def speaker_vectors(rows: DataFrame, vector: str, key: str, model: Plda) -> DataFrame:
    """key, projected: each speaker's mean vector on the model's axes."""
    return project(mean_vector(rows.where(F.col(key).isNotNull()), vector, key), "mean", model).select(key, "projected")
