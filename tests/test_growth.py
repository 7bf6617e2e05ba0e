"""Queries whose cost grew faster than their input: what they do once, what they no longer move, and odd inputs."""

from pyspark.sql import functions as F

from lexiloom.functions.text import tokens
from lexiloom.operators import corpus, language_model, lexicon, selection, vectors
from lexiloom.sinks import files as sinks


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_cut_once(spark):
    df = spark.createDataFrame([("a", "x y x y"), ("a", "x y."), ("b", None), ("b", "x"), (None, " y x ")], "g string, text string")
    counts = language_model.ngram_counts(df, tokens(F.col("text")), 2, "g")
    assert optimized(counts).count("split(") == 1
    assert {tuple(r) for r in counts.collect()} == {("a", "x y", 3), ("a", "y x", 1), (None, "y x", 1)}


def test_numbered_alignments_with_repeated_and_null_keys(spark):
    """Ids are those of the rows in order, whatever the partitions; no sorted table holds a text."""
    texts = [("k", 1, "bb a"), ("k", 1, "c"), ("k", None, "a zz"), (None, 2, "a"), ("a", 5, ""), ("a", 3, None), ("a", 1, "cab bb a")]
    df = spark.createDataFrame(texts, "f string, t int, text string").repartition(3)
    vocabulary = spark.createDataFrame([("a", 0), ("bb", 1)], "word string, word_id int")
    split = lambda c, p: F.filter(F.split(c, p), lambda x: x != "")
    nested = F.transform(split(F.coalesce("text", F.lit("")), " "), lambda w: F.struct(w.alias("word"), split(w, "").alias("phones")))
    words, phones, new = lexicon.numbered_alignments(df, nested, vocabulary, "f", "t")
    assert {tuple(r) for r in new.collect()} == {("c", 2), ("cab", 3), ("zz", 4)}
    ids = {"a": 0, "bb": 1, "c": 2, "cab": 3, "zz": 4}
    order = sorted((x for x in texts if x[2]), key=lambda x: (x[0] is not None, x[0] or "", x[1] is not None, x[1] or 0, len(x[2].split())))
    want = [(f, t, i, w) for f, t, text in order for i, w in enumerate(text.split())]
    got = sorted(words.collect())
    assert [r.id for r in got] == list(range(len(want)))
    assert [(r.f, r.t, r.word_index, r.word_id) for r in got] == [(f, t, i, ids[w]) for f, t, i, w in want]
    letters = [(k, ids[w], j, x) for k, (_, _, _, w) in enumerate(want) for j, x in enumerate(w)]
    assert [tuple(r) for r in phones.orderBy("id").collect()] == [(n, *x) for n, x in enumerate(letters)]


def test_hold_out_makes_its_words_once(spark):
    df = spark.createDataFrame([("ab", False), ("b", True), ("bz", True), ("q", True), ("q", True), ("a", None), ("é", None), (None, True)], "w string, p boolean")
    words = df.groupBy("w", "p").agg(F.count("*").alias("n")).select("w", "p")
    got = lexicon.hold_out(words, F.split("w", ""), F.col("p"))
    assert {(r.w, r.held_out) for r in got.collect()} == {("ab", False), ("b", True), ("bz", False), ("q", False), ("a", None), ("é", None), (None, True)}
    rows = got.collect() and got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in rows


def test_unknown_words_are_not_put_together(spark):
    df = spark.createDataFrame([(1, "b a zz b yy zz"), (2, "a"), (3, None), (None, "zz a"), (1, "a q")], "id int, text string")
    vocabulary = spark.createDataFrame([("a",), ("b",), ("b",)], "word string")
    words = tokens(F.col("text"))
    got = corpus.unknown_words(df, words, vocabulary, "id")
    assert sorted(map(str, got.collect())) == sorted(map(str, sinks.oov_utterances(corpus.with_unknown_words(df, words, vocabulary, "id"), "oovs", "id").collect()))
    assert sorted((r.id or 0, r.word) for r in got.collect()) == [(0, "zz"), (1, "q"), (1, "yy"), (1, "zz"), (1, "zz")]
    assert "Aggregate [id" not in optimized(got)


def test_training_subset_ranks_no_texts(spark, monkeypatch):
    df = spark.createDataFrame([(k, "xy"[k % 2], f"s{k % 3}", k % 5 == 0, k % 7, "long " * 50) for k in range(80)], "id int, lang string, source string, manual boolean, n int, text string")
    seen, ranks = [], selection.ranks_within
    monkeypatch.setattr(selection, "ranks_within", lambda rows, *a, **b: seen.append(rows.columns) or ranks(rows, *a, **b))
    wide = selection.training_subset(df, 20, "lang", "source", "manual", "n", "id")
    assert seen and not any("text" in columns for columns in seen)
    narrow = selection.training_subset(df.drop("text"), 20, "lang", "source", "manual", "n", "id")
    assert wide.columns == ["id", "lang", "source", "manual", "n", "text"] and {r.text for r in wide.collect()} == {"long " * 50}
    assert sorted(r.id for r in wide.collect()) == sorted(r.id for r in narrow.collect()) and wide.count() == 20


def test_tested_bigrams_are_those_of_the_whole_model(spark):
    df = spark.createDataFrame([("x", "a b a c. b a"), ("x", "c"), ("y", "a a a"), ("y", None), (None, "a b"), ("z", "q")], "lang string, text string")
    tested = spark.createDataFrame([("<s>", "a"), ("a", "b"), ("b", "b"), ("a", "</s>"), ("zz", "a"), ("c", "zz"), ("q", "</s>")], "history string, word string").withColumn("n", F.lit(2))
    asked = spark.createDataFrame([("x",), ("y",), ("z",), (None,)], "lang string").crossJoin(tested)
    words = tokens(F.col("text"))

    def scored(model):
        rows = language_model.backoff_probability(asked, *model, "lang").collect()
        return {(r.lang, r.history, r.word): r.prob if r.prob is None else round(r.prob, 12) for r in rows}

    some = language_model.tested_bigram_model(df, words, "lang", tested)
    assert scored(some) == scored(language_model.bigram_model(df, words, "lang"))
    assert {(r.history, r.word) for r in some[0].collect()} <= {(h, w) for h in ("<s>", "a", "b", "c", "q") for w in ("a", "b", "</s>")}
    assert not {r.word for r in some[1].collect()} & {"zz"}


def test_drawn_pairs_need_no_deduplication(spark):
    df = spark.createDataFrame([(k, g, [float(k), 1.0]) for g, n in (("a", 9), ("b", 2), ("c", 1)) for k in range(ord(g) * 100, ord(g) * 100 + n)], "id int, g string, v array<double>")
    pairs = vectors.drawn_vectors(df, "v", "g", "id")
    got = [(r.a, r.b, r.matched) for r in pairs.collect()]
    assert len(got) == len(set(got)) == 9 * 5 + 9 * 2 + 2 * 1 + 2 * 1 + 1 * 5  # within a, a to b, within b, b to c, c to a
    assert "Aggregate [a" not in optimized(pairs)


def test_word_pairs_are_stored_compressed(spark):
    df = spark.createDataFrame([("a", "x y x y"), ("a", "x"), (None, None)], "g string, text string")
    pairs = language_model.word_pairs(df, tokens(F.col("text")), "g")
    assert all(f.endswith(".zstd.parquet") for f in pairs.inputFiles()) and pairs.inputFiles()
    assert {tuple(r) for r in pairs.collect()} == {("a", "<s>", "x", 2), ("a", "x", "y", 2), ("a", "y", "x", 1), ("a", "y", "</s>", 1), ("a", "x", "</s>", 1), (None, "<s>", "</s>", 1)}
