import pytest
from pyspark.sql import functions as F

from lexiloom.operators import g2p


def test_expected_chunks_sum_to_the_letters():
    got = g2p.expected_chunks(list("abc"), list("xy"), None, (2, 1))
    used = sum(n * (0 if a == g2p.EMPTY else len(a.split())) for (a, _), n in got.items())
    assert used == pytest.approx(3.0)
    assert g2p.expected_chunks(list("a"), list("xyz"), None, (1, 1), deletions=False) == {}


def test_training_finds_the_digraph(spark):
    words = ["that", "thin", "tan", "hat", "bath", "hit", "math", "tin", "hath", "bat"]
    pairs = [(w, list(w), list(w.replace("th", "θ"))) for w in words]
    df = spark.createDataFrame(pairs, "word string, letters array<string>, phones array<string>")
    weights = {(r.letters, r.phones): r.weight for r in g2p.train_alignment(df, 6, (2, 1)).collect()}
    assert sum(weights.values()) == pytest.approx(1.0)
    assert g2p.best_alignment(list("bath"), ["b", "a", "θ"], weights, (2, 1))[-1] == ("t h", "θ")
    made = g2p.generate(df, F.col("letters"), g2p.train_alignment(df, 6, (2, 1)))
    first = {r.word: r.pronunciation for r in made.where("rank = 1").collect()}
    assert first["thin"] == "θ i n" and first["hit"] == "h i t"
    assert g2p.within_threshold(made, 1.0).count() >= len(words)


def test_clean_word(spark):
    row = spark.range(1).select(g2p.clean_word(F.lit("+abc"), F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("r")).first().r
    assert (row.word, row.missing) == ("abc", ["+"])
