"""Grapheme-to-phoneme models: many-to-many alignment by expectation maximisation, and generation.

A pair of spelling and pronunciation is a lattice of chunks (a few letters to a few phones, either may be empty).
The expected number of each chunk comes from forward-backward over every pair; tasks sum their own pairs,
Spark adds the sums, and the next round's weights go to all tasks. The table of weights is bounded by
the alphabets and chunk sizes, not by the lexicon.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.edit import g2p_score
from .language_model import ngrams

EMPTY = "_"


def _chunks(letters: list[str], phones: list[str], most: tuple[int, int], deletions: bool):
    """(i, j, i2, j2, chunk) of the lattice between prefixes (i, j) and (i2, j2)."""
    for i in range(len(letters) + 1):
        for j in range(len(phones) + 1):
            for a in range(most[0] + 1):
                for b in range(most[1] + 1):
                    if a + b == 0 or i + a > len(letters) or j + b > len(phones) or a > 1 and b > 1:
                        continue
                    if (a == 0 or b == 0) and (not deletions or a + b > 1):
                        continue
                    yield i, j, i + a, j + b, (" ".join(letters[i : i + a]) or EMPTY, " ".join(phones[j : j + b]) or EMPTY)


def _start_weight(chunk: tuple[str, str]) -> float:
    """Larger chunks and empty sides begin as unlikely."""
    if EMPTY in chunk:
        return math.exp(-9.0)
    return 1.0 / (len(chunk[0].split()) * len(chunk[1].split()))


def _add(a: float, b: float) -> float:
    """ln(e^a + e^b)."""
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def expected_chunks(letters: list[str], phones: list[str], weights: dict | None, most: tuple[int, int], deletions: bool = True) -> Counter:
    """Expected count of every chunk over all alignments of a pair; empty if there is none. Sums are of logarithms, so no
    word is too long."""
    arcs = list(_chunks(letters, phones, most, deletions))
    weight = [(_start_weight(c) if weights is None else weights.get(c, 0.0)) for *_, c in arcs]
    weight = [math.log(w) if w > 0 else -math.inf for w in weight]
    none = -math.inf
    alpha = {(0, 0): 0.0}
    for (i, j, i2, j2, _), w in zip(arcs, weight, strict=True):  # arcs leave in order of (i, j)
        if w > none and (i, j) in alpha:
            alpha[i2, j2] = _add(alpha.get((i2, j2), none), alpha[i, j] + w)
    total = alpha.get((len(letters), len(phones)))
    if total is None:
        return Counter()
    beta = {(len(letters), len(phones)): 0.0}
    out: Counter = Counter()
    for (i, j, i2, j2, c), w in zip(reversed(arcs), reversed(weight), strict=True):
        if w > none and (i2, j2) in beta and (i, j) in alpha:
            beta[i, j] = _add(beta.get((i, j), none), w + beta[i2, j2])
            out[c] += math.exp(alpha[i, j] + w + beta[i2, j2] - total)
    return out


def best_alignment(letters: list[str], phones: list[str], weights: dict, most: tuple[int, int], deletions: bool = True) -> list[tuple[str, str]]:
    """Chunks of the likeliest alignment; empty if there is none."""
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for i, j, i2, j2, c in _chunks(letters, phones, most, deletions):
        if (i, j) in best and weights.get(c):
            p = best[i, j][0] + math.log(weights[c])
            if (i2, j2) not in best or p > best[i2, j2][0]:
                best[i2, j2] = (p, (i, j, c))
    out, at = [], (len(letters), len(phones))
    while at in best and best[at][1]:
        i, j, c = best[at][1]
        out.append(c)
        at = (i, j)
    return out[::-1]


def valid_chunks(lexicon: DataFrame, most: tuple[int, int] = (2, 2)) -> DataFrame:
    """side, ngram, n: letter and phone n-grams of the lexicon up to the chunk sizes, from which chunks are made."""
    sides = [
        lexicon.select(F.lit(side).alias("side"), F.explode(ngrams(F.col(column), k)).alias("g"))
        for side, column, size in (("letters", "letters", most[0]), ("phones", "phones", most[1]))
        for k in range(1, size + 1)
    ]
    rows = reduce(DataFrame.unionByName, (x.select("side", F.array_join("g", " ").alias("ngram")) for x in sides))
    return rows.groupBy("side", "ngram").agg(F.count("*").alias("n"))


def train_alignment(lexicon: DataFrame, rounds: int = 6, most: tuple[int, int] = (2, 2), deletions: bool = True, threshold: float = 1e-4) -> DataFrame:
    """letters, phones, weight of chunks after EM over a lexicon (letters, phones: arrays).

    Stops early when the weights move less than the threshold in sum.
    """
    spark = lexicon.sparkSession
    weights: dict | None = None
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(weights)

        def expect(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            total: Counter = Counter()
            for pdf in batches:
                for a, b in zip(pdf["letters"], pdf["phones"], strict=True):
                    total.update(expected_chunks(list(a), list(b), shared.value, most, deletions))
            yield pd.DataFrame([(a, b, n) for (a, b), n in total.items()], columns=["letters", "phones", "n"])

        sums = lexicon.select("letters", "phones").mapInPandas(expect, "letters string, phones string, n double")
        rows = sums.groupBy("letters", "phones").agg(F.sum("n").alias("n")).where("n > 1e-9").collect()
        whole = sum(r.n for r in rows) or 1.0
        now = {(r.letters, r.phones): r.n / whole for r in rows}
        moved = sum(abs(p - (weights or {}).get(c, 0.0)) for c, p in now.items())
        weights = now
        if moved < threshold:
            break
    return spark.createDataFrame([(a, b, p) for (a, b), p in (weights or {}).items()], "letters string, phones string, weight double")


def generate(words: DataFrame, letters: Column, weights: DataFrame, best: int = 3, beam: int = 20, most: int = 2) -> DataFrame:
    """word, rank, pronunciation, score: the likeliest pronunciations of each word by its chunks; score is a natural logarithm.

    A beam search: of the pronunciations of a word's beginning only the ``beam`` likeliest go on, so a larger beam may find
    better ones. Letters that no chunk holds leave a word without a pronunciation.
    """
    table: dict[str, list[tuple[str, float]]] = {}
    for r in weights.collect():  # bounded by the alphabets and chunk sizes
        if r.letters != EMPTY and r.weight > 0:
            table.setdefault(r.letters, []).append((r.phones, math.log(r.weight)))
    shared = words.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("array<struct<pronunciation:string,score:double>>")
    def rewrite(s: pd.Series) -> pd.Series:
        def one(word: list[str]) -> list[dict]:
            states: list[dict[str, float]] = [{} for _ in range(len(word) + 1)]
            states[0][""] = 0.0
            for i in range(len(word)):
                for made, p in sorted(states[i].items(), key=lambda x: (-x[1], x[0]))[:beam]:
                    for n in range(1, most + 1):
                        if i + n > len(word):
                            break
                        for phones, w in shared.value.get(" ".join(word[i : i + n]), ()):
                            text = made if phones == EMPTY else f"{made} {phones}".strip()
                            states[i + n][text] = max(states[i + n].get(text, -math.inf), p + w)
            found = sorted(states[-1].items(), key=lambda x: (-x[1], x[0]))[:best]
            return [{"pronunciation": t, "score": p} for t, p in found if t]

        return s.map(lambda x: one(list(x)))

    rows = words.select("word", F.posexplode(rewrite(letters)).alias("rank", "_r"))
    return rows.select("word", (F.col("rank") + 1).cast("long").alias("rank"), "_r.pronunciation", "_r.score")


def within_threshold(generated: DataFrame, share: float) -> DataFrame:
    """Pronunciations at least ``share`` as likely as the word's best."""
    top = generated.groupBy("word").agg(F.max("score").alias("_top"))
    return generated.join(top, "word").where(F.col("score") >= math.log(share) + F.col("_top")).drop("_top")


def clean_word(word: Column, known: Column) -> Column:
    """(word of known letters, letters that are missing)."""
    letters = F.filter(F.split(word, ""), lambda x: x != "")
    return F.struct(
        F.array_join(F.filter(letters, lambda x: F.array_contains(known, x)), "").alias("word"),
        F.array_sort(F.array_except(letters, known)).alias("missing"),
    )


def strict_words(words: DataFrame, known: Column) -> DataFrame:
    """The words all of whose letters are known; the others get no pronunciation."""
    return words.where(F.size(clean_word(F.col("word"), known)["missing"]) == 0)


def spoken(rows: DataFrame, key: list[str], words: Column, pronunciations: DataFrame, unknown: str = "spn") -> DataFrame:
    """key, pronunciation: each utterance's words in order, each as its first pronunciation (word, pronunciation)."""
    first = pronunciations.groupBy("word").agg(F.min("pronunciation").alias("_p"))
    placed = rows.select(*key, F.posexplode_outer(words).alias("_i", "word")).join(first, "word", "left")
    said = F.when(F.col("_i").isNotNull(), F.struct("_i", F.coalesce("_p", F.lit(unknown)).alias("p")))
    listed = placed.groupBy(*key).agg(F.sort_array(F.collect_list(said)).alias("_w"))
    return listed.select(*key, F.array_join(F.transform("_w", lambda x: x["p"]), " ").alias("pronunciation"))


def evaluation(rows: DataFrame) -> DataFrame:
    """n_words, wer, ler from rows (word, hypotheses, gold: arrays of pronunciations): words none of whose hypotheses is right, and edits by letters of the best gold."""

    @F.pandas_udf("edits long, size long")
    def compare(hypotheses: pd.Series, gold: pd.Series) -> pd.DataFrame:
        found = [g2p_score(list(h) if h is not None else [], list(g) if g is not None else []) for h, g in zip(hypotheses, gold, strict=True)]
        return pd.DataFrame(found, columns=["edits", "size"], dtype="int64")

    scored = rows.withColumn("_s", compare("hypotheses", "gold"))
    return scored.agg(
        F.count("*").alias("n_words"),
        F.try_divide(F.sum((F.col("_s.edits") > 0).cast("long")), F.count("*")).alias("wer"),
        F.try_divide(F.sum("_s.edits"), F.sum("_s.size")).alias("ler"),
    )
