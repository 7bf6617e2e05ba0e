"""Quality classifier: a factorisation machine over words, structure and length (operator 9).

A document is a sparse vector of hashed words (logarithmic counts, unit length) and binned statistics of
its structure. Every feature has a weight and a short factor; the factors' inner products are the weights
of feature pairs, and all pairs are scored in time linear in the features by
sum_{i<j} <v_i, v_j> x_i x_j = (|sum_i v_i x_i|^2 - sum_i |v_i x_i|^2) / 2.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import release_memory, text_bytes, tidy

WORD_BITS = 16
BINS = 12
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_KINDS = {
    "upper": bytes(range(65, 91)),
    "digit": bytes(range(48, 58)),
    "stop": b".!?",
    "comma": b",;:",
    "symbol": bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".!?,;:'\"-()"),
    "bang": b"!",
    "line": b"\n",
    "space": b" \t\r\x0b\x0c",
}
#: Statistics of a text, in the order of the vector that structure() returns.
STATISTICS = (*_KINDS, "length", "word_length", "distinct", "top_word", "repeats", "letters", "short", "odd_words")
#: One slot a statistic and bin (and one for the bias of an empty text) after the hashed words.
DIMENSIONS = (1 << WORD_BITS) + len(STATISTICS) * BINS + 1


def is_held_out(modulus: int = 5):
    """Rows that no model learns from (null ids are not held out, nor learned from)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == 0, F.lit(False))


def structure(raw: bytes, hashes: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Statistics in 0..1: shares of byte kinds, length, word repetition and the like."""
    n, words = len(raw), len(hashes)
    table = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = [min(1.0, 4.0 * table[list(k)].sum() / n) for k in _KINDS.values()]
    letters = float(table[_LETTER].sum()) / n
    repeats = float((hashes[1:] == hashes[:-1]).mean()) if words > 1 else 0.0
    odd = float((lengths > 15).mean())
    return np.array(
        [
            *shares,
            min(1.0, np.log1p(n) / 14.0),
            min(1.0, float(lengths.mean()) / 16.0),
            len(counts) / words,
            float(counts.max()) / words,
            repeats,
            letters,
            float((lengths <= 2).mean()),
            odd,
        ]
    )


def features(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text's vector. A text without words has the last feature alone."""
    words = raw.split()
    if not words:
        return np.array([DIMENSIONS - 1]), np.ones(1, np.float32)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    slots, counts = np.unique(hashes >> np.uint64(64 - WORD_BITS), return_counts=True)
    values = np.log1p(counts)
    values = values / np.sqrt((values * values).sum())
    at = np.minimum((structure(raw, hashes, lengths, counts) * BINS).astype(np.int64), BINS - 1)
    bins = (1 << WORD_BITS) + np.arange(len(at)) * BINS + at
    return (
        np.concatenate([slots.astype(np.int64), bins]),
        np.concatenate([values, np.full(len(bins), 0.5)]).astype(np.float32),
    )


@dataclass
class FactorizationMachine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margin(self, index: np.ndarray, value: np.ndarray) -> float:
        scaled = self.factors[index] * value[:, None]
        total = scaled.sum(axis=0)
        pairs = 0.5 * float((total * total).sum() - (scaled * scaled).sum())
        return self.bias + float(self.weights[index] @ value) + pairs

    def score(self, raw: bytes) -> float:
        """Probability of label 1, whole texts at any length."""
        z = self.margin(*features(raw))
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -30.0, 30.0))))


def fit(
    samples: list[tuple[np.ndarray, np.ndarray]],
    labels: list[int],
    rank: int = 6,
    epochs: int = 10,
    rate: float = 0.1,
    decay: float = 1e-4,
    batch: int = 64,
    negative_weight: float = 3.0,
    seed: int = 3,
) -> FactorizationMachine:
    """Adagrad on the logistic loss of labels 0 and 1, where 0 (the rarer label) weighs more."""
    rng = np.random.default_rng(seed)
    share = (sum(labels) + 1.0) / (len(labels) + 2.0)
    model = FactorizationMachine(
        float(np.log(share / (1 - share))),
        np.zeros(DIMENSIONS, np.float32),
        rng.normal(0, 0.02, (DIMENSIONS, rank)).astype(np.float32),
    )
    gw, gv = np.full(DIMENSIONS, 1e-2, np.float32), np.full((DIMENSIONS, rank), 1e-2, np.float32)
    for _ in range(epochs if samples else 0):
        order = rng.permutation(len(samples))
        for k in range(0, len(order), batch):
            chosen = order[k : k + batch]
            index = np.concatenate([samples[i][0] for i in chosen])
            value = np.concatenate([samples[i][1] for i in chosen])
            row = np.repeat(np.arange(len(chosen)), [len(samples[i][0]) for i in chosen])
            starts = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1])
            scaled = model.factors[index] * value[:, None]
            total = np.add.reduceat(scaled, starts)
            z = model.bias + np.add.reduceat(model.weights[index] * value, starts)
            z = z + 0.5 * ((total * total).sum(axis=1) - np.add.reduceat((scaled * scaled).sum(axis=1), starts))
            gold = np.array([labels[i] for i in chosen])
            error = ((1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))) - gold) / len(chosen)
            error *= np.where(gold, 1.0, negative_weight)
            mine = (error[row] * value).astype(np.float32)
            touched, back = np.unique(index, return_inverse=True)
            grad_w = np.bincount(back, mine, len(touched)) + decay * model.weights[touched]
            each = mine[:, None] * (total[row] - scaled)
            grad_v = np.stack([np.bincount(back, each[:, c], len(touched)) for c in range(rank)], axis=1)
            grad_v += decay * model.factors[touched]
            gw[touched] += grad_w**2
            gv[touched] += grad_v**2
            model.weights[touched] -= rate * grad_w / np.sqrt(gw[touched])
            model.factors[touched] -= 0.3 * rate * grad_v / np.sqrt(gv[touched])
            model.bias -= rate * float(error.sum())
    return model


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000, seed: int = 5) -> FactorizationMachine:
    """A model from at most about ``sample_rows`` labelled rows, drawn by a hash of doc_id.

    Rows that are held out or whose label is null are not drawn. Without any, scores are 0.5.
    """
    ship_package(docs.sparkSession)
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~is_held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    share = sample_rows / max(sample_rows, known.count())
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    picked = F.broadcast(known.where(draw < share))  # about sample_rows ids

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([x[0].astype("<i4").tobytes() for x in found], pa.binary()),
                    pa.array([x[1].astype("<f4").tobytes() for x in found], pa.binary()),
                ],
                names=["doc_id", "quality", "slots", "amounts"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("raw")).join(picked, "doc_id")
    rows = rows.select("doc_id", F.col("quality").cast("int"), "raw").mapInArrow(
        tidy(vectors), "doc_id long, quality int, slots binary, amounts binary"
    )
    table = rows.toPandas().sort_values(["doc_id", "slots"], kind="stable")
    samples = [
        (np.frombuffer(a, "<i4").astype(np.int64), np.frombuffer(b, "<f4"))
        for a, b in zip(table["slots"], table["amounts"], strict=True)
    ]
    model = fit(samples, [int(x > 0) for x in table["quality"]])
    del table, samples
    release_memory()  # what training used on the driver
    return model


def score(
    docs: DataFrame, labels: DataFrame | None = None, model: FactorizationMachine | None = None, threshold: float = 0.3, **options
) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs.

    Only the text enters a score; null counts as empty. Rows may repeat, other columns are ignored,
    an empty table gives an empty result.
    """
    model = model or train(docs, labels, **options)
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS * (rank + 1) floats

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = shared.value
        for batch in batches:
            scores = [tool.score(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), is_held_out().alias("held_out"), text_bytes().alias("raw"))
    return rows.mapInArrow(tidy(work), "doc_id long, held_out boolean, score double, predicted int")
