"""Comparison of transcripts and intervals: error rates, confusions, boundary scores, alignment."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.edit import text_edits, token_edits, without_bracketed


def error_counts(rows: DataFrame, gold: str, hyp: str) -> DataFrame:
    """rows with word_edits, n_words, char_edits, n_chars; bracketed words don't count.

    An empty hypothesis makes every word and character an edit.
    """
    g, h = without_bracketed(F.col(gold)), without_bracketed(F.coalesce(hyp, F.array().cast("array<string>")))
    return rows.withColumns(
        {
            "word_edits": token_edits(g, h),
            "n_words": F.size(g).cast("long"),
            "char_edits": text_edits(F.array_join(g, ""), F.array_join(h, "")),
            "n_chars": F.length(F.array_join(g, "")).cast("long"),
        }
    )


def severity(rate, warn: float, bad: float):
    return F.when(rate > bad, "high").when(rate > warn, "medium").otherwise("low")


def error_report(counts: DataFrame) -> DataFrame:
    """ser, wer, cer and their severity over all rows of error_counts."""
    totals = counts.agg(
        F.try_divide(F.sum((F.col("word_edits") > 0).cast("long")), F.count("*")).alias("ser"),
        F.try_divide(F.sum("word_edits"), F.sum("n_words")).alias("wer"),
        F.try_divide(F.sum("char_edits"), F.sum("n_chars")).alias("cer"),
    )
    return totals.withColumns(
        {
            "ser_severity": severity(F.col("ser"), 0.3, 0.8),
            "wer_severity": severity(F.col("wer"), 0.25, 0.75),
            "cer_severity": severity(F.col("cer"), 0.25, 0.75),
        }
    )


def confusions(pairs: DataFrame) -> DataFrame:
    """reference, hypothesis, n of pairs that differ."""
    rows = pairs.where("reference <> hypothesis")
    return rows.groupBy("reference", "hypothesis").agg(F.count("*").alias("n"))


def align(reference: list[tuple], hypothesis: list[tuple], gap: float = 5.0) -> list[tuple[int | None, int | None]]:
    """Least-cost alignment of two interval lists (begin, end, label), as index pairs.

    A match costs the boundary differences and two for different labels; a gap costs ``gap``. A match that costs more than two gaps is never
    taken, so an interval meets only those that begin within two gaps of it: memory and time grow with these pairs, not with the product of the lengths. Both lists
    are sorted first if they aren't; the pairs hold places in the given lists.
    """
    orders = [sorted(range(len(side)), key=lambda k, side=side: float(side[k][0])) for side in (reference, hypothesis)]
    a, b = ([side[k] for k in order] for side, order in zip((reference, hypothesis), orders, strict=True))
    n, m = len(a), len(b)
    if not n or not m:
        return [(k, None) for k in orders[0]] + [(None, k) for k in orders[1]]
    begins, ends = ([np.array([float(x[k]) for x in side]) for side in (a, b)] for k in (0, 1))
    labels = [np.array([hash(x[2]) for x in side]) for side in (a, b)]
    low = np.searchsorted(begins[1], begins[0] - 2 * gap, "left")
    high = np.searchsorted(begins[1], begins[0] + 2 * gap, "right")
    # best[j]: what matches among the rows so far and the first j columns save over gaps; beyond ``reach`` it is best[reach]
    best, reach = np.zeros(m + 1), 0
    steps: list[np.ndarray] = []
    for i in range(n):
        lo, hi = int(low[i]), int(high[i])
        if hi > reach:
            best[reach + 1 : hi + 1] = best[reach]
            reach = hi
        if lo == hi:
            steps.append(np.zeros(0, np.uint8))
            continue
        cost = np.abs(begins[0][i] - begins[1][lo:hi]) + np.abs(ends[0][i] - ends[1][lo:hi]) + 2.0 * (labels[0][i] != labels[1][lo:hi])
        matched = best[lo:hi] + cost - 2 * gap
        now = np.minimum(best[lo + 1 : hi + 1], matched)
        along = np.minimum.accumulate(np.concatenate([[best[lo]], now]))[1:]
        tiny = 1e-9 * (1.0 + np.abs(along))
        # 1: this match, 2: as without this row, 3: as without this column
        steps.append(np.where(np.abs(matched - along) <= tiny, 1, np.where(np.abs(best[lo + 1 : hi + 1] - along) <= tiny, 2, 3)).astype(np.uint8))
        best[lo + 1 : hi + 1] = along
    out: list[tuple[int | None, int | None]] = []
    i, j = n, m
    while i or j:
        lo, hi = (int(low[i - 1]), int(high[i - 1])) if i else (0, 0)
        step = 2 if i and j <= lo else 3 if not i or j > hi else steps[i - 1][j - 1 - lo]
        if step == 1:
            i, j = i - 1, j - 1
            out.append((orders[0][i], orders[1][j]))
        elif step == 2:
            i -= 1
            out.append((orders[0][i], None))
        else:
            j -= 1
            out.append((None, orders[1][j]))
    return out[::-1]


#: Pairs of intervals that a task turns from Python objects into Arrow at once.
_PAIRS = 1 << 14


def stretches(reference: DataFrame, hypothesis: DataFrame, key: str, silence: tuple[str, ...] = ("sil", ""), gap: float = 5.0) -> DataFrame:
    """key, _ref, _hyp: each utterance's intervals cut wherever none begins for more than two gaps, and sorted.

    No match goes over such a cut (see align), so stretches are aligned for themselves and none grows with the utterance. Utterances without a reference are left out.
    """
    ref, hyp = (x.where(~F.col("label").isin(*silence)).select(key, "begin", "end", "label") for x in (reference, hypothesis))
    hyp = hyp.join(ref.select(key).distinct(), key, "left_semi")
    both = ref.withColumn("_side", F.lit(0)).unionByName(hyp.withColumn("_side", F.lit(1)))
    order = Window.partitionBy(key).orderBy("begin")
    begin = F.col("begin").cast("double")
    apart = F.coalesce(begin - F.lag(begin).over(order) > 2 * gap + 1e-3, F.lit(False))  # wider than need be is never wrong
    cut = F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = both.withColumn("_new", apart.cast("long")).withColumn("_stretch", cut)
    interval = F.struct("begin", "end", "label")
    listed = lambda side: F.sort_array(F.collect_list(F.when(F.col("_side") == side, interval)))
    return rows.groupBy(key, "_stretch").agg(listed(0).alias("_ref"), listed(1).alias("_hyp")).drop("_stretch")


def aligned_pairs(reference: DataFrame, hypothesis: DataFrame, key: str, silence: tuple[str, ...] = ("sil", "")) -> DataFrame:
    """key, reference, hypothesis, overlap: aligned labels of each utterance, ``-`` for a gap, and the boundary error of pairs.

    Both sides: key, begin, end, label. One stretch of an utterance is aligned at a time; what comes out feeds plain aggregates.
    """
    kind = pa.list_(pa.struct([("reference", pa.string()), ("hypothesis", pa.string()), ("overlap", pa.float64())]))

    @F.arrow_udf("array<struct<reference:string,hypothesis:string,overlap:double>>")
    def pairs(ref: pa.Array, hyp: pa.Array) -> pa.Array:
        done, out, n = [], [], 0
        for x, y in zip(ref, hyp, strict=True):  # only one row's intervals are Python objects at a time
            a, b = ([(r["begin"], r["end"], r["label"]) for r in side.as_py() or []] for side in (x, y))
            out.append([
                {
                    "reference": "-" if i is None else a[i][2],
                    "hypothesis": "-" if j is None else b[j][2],
                    "overlap": None if i is None or j is None else float(abs(a[i][0] - b[j][0]) + abs(a[i][1] - b[j][1])) / 2,
                }
                for i, j in align(a, b)
            ])
            n += len(out[-1])
            if n >= _PAIRS:
                done.append(pa.array(out, kind))
                out, n = [], 0
        return pa.concat_arrays([*done, pa.array(out, kind)])

    rows = stretches(reference, hypothesis, key, silence)
    return rows.select(key, F.explode(pairs("_ref", "_hyp")).alias("_p")).select(key, "_p.*")


def alignment_totals(pairs: DataFrame) -> DataFrame:
    """n_reference, n_insertions, n_deletions, n_substitutions, error_rate, mean_overlap over a whole corpus of aligned_pairs."""
    gap_r, gap_h = F.col("reference") == "-", F.col("hypothesis") == "-"
    same = F.col("reference") == F.col("hypothesis")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    totals = pairs.agg(
        count(~gap_r).alias("n_reference"), count(gap_r).alias("n_insertions"), count(gap_h).alias("n_deletions"),
        count(~same & ~gap_r & ~gap_h).alias("n_substitutions"), F.avg(F.when(same, F.col("overlap"))).alias("mean_overlap"),
    )
    wrong = F.col("n_insertions") + F.col("n_deletions") + 2 * F.col("n_substitutions")
    return totals.withColumn("error_rate", F.try_divide(wrong, "n_reference"))


def confusion_examples(pairs: DataFrame, key: str, examples: int = 5) -> DataFrame:
    """reference, hypothesis, n and the first ``examples`` utterances of each confusion. Examples are ranked, so none gathers a whole group."""
    rows = pairs.where("reference <> hypothesis").groupBy("reference", "hypothesis", key).agg(F.count("*").alias("_n"))
    totals = rows.groupBy("reference", "hypothesis").agg(F.sum("_n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("reference", "hypothesis").orderBy(key))
    first = rows.withColumn("_k", rank).where(F.col("_k") <= examples).groupBy("reference", "hypothesis").agg(F.sort_array(F.collect_list(key)).alias("examples"))
    return totals.join(first, ["reference", "hypothesis"])


def boundary_report(reference: DataFrame, hypothesis: DataFrame, key: str, tolerance: float) -> DataFrame:
    """key, precision, recall, f1 of the ends of intervals (key, end), by boundary_scores."""

    @F.pandas_udf("precision double, recall double, f1 double")
    def compare(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        none: list = []
        found = [boundary_scores(list(x) if x is not None else none, list(y) if y is not None else none, tolerance) for x, y in zip(a, b, strict=True)]
        return pd.DataFrame(found, columns=["precision", "recall", "f1"], dtype="float64")

    ends = lambda x, name: x.groupBy(key).agg(F.collect_list(F.col("end").cast("double")).alias(name))
    joined = ends(reference, "_a").join(ends(hypothesis, "_b"), key, "outer")
    return joined.withColumn("_s", compare("_a", "_b")).select(key, "_s.*")


def verified(words: DataFrame, texts: DataFrame, key: str, shortest: float, silence: tuple[str, ...] = ("<eps>", "sil", "")) -> DataFrame:
    """key, aligned, text, edits, changed: words of intervals that are long enough, in order, against the transcript (an array ``words``)."""
    rows = words.where((F.col("end") - F.col("begin") > shortest) & ~F.col("label").isin(*silence))
    said = rows.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("begin", "end", "label"))), lambda x: x["label"]).alias("aligned"))
    both = texts.select(key, F.col("words").alias("text")).join(said, key, "left")
    both = both.withColumn("aligned", F.coalesce("aligned", F.array().cast("array<string>")))
    edits = token_edits(F.col("text"), F.col("aligned"))
    return both.withColumn("edits", edits).withColumn("changed", F.col("edits") > 0)


def evaluate_alignments(reference: DataFrame, hypothesis: DataFrame, key: str, silence: tuple[str, ...] = ("sil", "")) -> DataFrame:
    """key, score (mean boundary error of matched labels / 2), error_rate ((ins + del + 2 sub) / reference).

    Both sides: key, begin, end, label. One Arrow group a key (an utterance).
    """
    sides = [
        x.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("begin", "end", "label"))).alias(name))
        for x, name in ((reference, "_ref"), (hypothesis, "_hyp"))
    ]

    @F.pandas_udf("score double, error_rate double")
    def compare(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b in zip(ref, hyp, strict=True):
            a = [(x["begin"], x["end"], x["label"]) for x in (a if a is not None else []) if x["label"] not in silence]
            b = [(x["begin"], x["end"], x["label"]) for x in (b if b is not None else []) if x["label"] not in silence]
            wrong, costs = 0, []
            for i, j in align(a, b):
                if i is None or j is None:
                    wrong += 1
                elif a[i][2] != b[j][2]:
                    wrong += 2
                else:
                    costs.append((abs(a[i][0] - b[j][0]) + abs(a[i][1] - b[j][1])) / 2)
            rows.append((sum(costs) / len(costs) if costs else None, wrong / len(a) if a else None))
        return pd.DataFrame(rows, columns=["score", "error_rate"])

    joined = sides[0].join(sides[1], key, "left").withColumn("_r", compare("_ref", "_hyp"))
    return joined.select(key, "_r.score", "_r.error_rate")


def boundary_scores(reference: list[float], hypothesis: list[float], tolerance: float) -> tuple[float, float, float]:
    """Precision, recall and F1 of boundaries matched one to one within the tolerance, in order."""
    i = j = hits = 0
    reference, hypothesis = sorted(reference), sorted(hypothesis)
    while i < len(reference) and j < len(hypothesis):
        if abs(reference[i] - hypothesis[j]) <= tolerance:
            hits, i, j = hits + 1, i + 1, j + 1
        elif reference[i] < hypothesis[j]:
            i += 1
        else:
            j += 1
    p = hits / len(hypothesis) if hypothesis else 0.0
    r = hits / len(reference) if reference else 0.0
    return p, r, 2 * p * r / (p + r) if p + r else 0.0
