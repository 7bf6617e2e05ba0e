"""Operators on small hand-made frames, and round trips of the file formats."""

import datetime
import random
import struct

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import edit, numbers, phones, text
from lexiloom.operators import corpus, intervals, language_model, lexicon, metrics, sampling, vectors
from lexiloom.plans import commands
from lexiloom.sinks import files as sinks
from lexiloom.sources import files as sources
from lexiloom.streaming import segments


def column(spark, expression, *values, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] for r in df.select(expression(F.col("x"))).collect()]


@pytest.mark.parametrize(
    "line, known, want",
    [
        ("rain, wind; snow", (), ["rain", "wind", "snow"]),  # marks at word ends go
        ("Rain WIND", (), ["rain", "wind"]),  # lower case
        ("(two words) after", (), ["(two_words)", "after"]),  # what brackets hold is one word
        ("tea-pot", (), ["tea-pot"]),  # a compound stays whole without a vocabulary
        ("tea-pot", ("tea", "pot"), ["tea", "pot"]),  # and is cut where all parts are known
        ("tea-pot", ("tea-pot", "tea", "pot"), ["tea-pot"]),  # not if it is known itself
        ("vim-bexq", ("tea",), ["vim-bexq"]),  # nor if no part is
        ("", (), []),
    ],
)
def test_words_of_marked_text(line, known, want):
    assert text.simple_words(line, frozenset(known)) == want if known else text.simple_words(line) == want


def test_text_functions(spark):
    assert column(spark, text.is_bracketed, "(the)", "<c>", "[a]", "{cold}", "uh", "", None) == [True] * 4 + [False] * 3
    assert column(spark, text.tokens, "Hello, WORLD!! it's a-b", None) == [["hello", "world", "it's", "a-b"], []]
    assert column(spark, text.word_class, "[x]", "<s>", "ab") == ["[bracketed]", "<unk>", "ab"]
    assert text.character_class("a-b]^") == r"[-ab\]\^]" and text.character_class("x", True) == "[^x]"
    patterns = text.marker_patterns()
    assert column(spark, lambda x: F.regexp_replace(x, patterns["edges"], ""), "«well-known», ", "-x-", "a.b") == ["well-known», ", "x", "a.b"]
    assert column(spark, lambda x: text.tokenized(x, "simple"), "A b") == [["a", "b"]]
    text.register_tokenizer("pairs", lambda x: F.array(F.substring(x, 1, 2), F.substring(x, 3, 2)))
    assert column(spark, lambda x: text.tokenized(x, "pairs"), "abcd") == [["ab", "cd"]]
    with pytest.raises(ValueError):
        text.tokenized(F.col("x"), "none")
    assert column(spark, text.strip_cutoff, "<cutoff-ab>", "ab") == ["ab", "ab"]
    assert column(spark, text.nfkc, "ﬁ", None) == ["fi", None]
    assert column(spark, text.attach_cutoffs, ["<cutoff>", "ab", "<cutoff>"], kind="array<string>") == [["<cutoff-ab>", "ab", "<cutoff>"]]
    assert column(spark, text.human_list, ["a"], ["a", "b"], ["a", "b", "c"], kind="array<string>") == ["a", "a and b", "a, b, and c"]
    assert column(spark, lambda x: text.unescape_scp(text.escape_scp(x)), "a b") == ["a b"]


def test_numbers_round_as_python_does(spark):
    assert column(spark, numbers.probability, 0.125, 2.675, -1.0, None, kind="double") == [0.12, 0.99, 0.01, None]
    assert column(spark, numbers.correction, 2.675, -1.0, kind="double") == [2.67, 0.01]


def test_phones(spark):
    assert column(spark, phones.base_phone, "AA1", "o˨˩ˀ", "tʰ") == ["AA", "o", "t"]
    assert column(spark, phones.with_positions, ["a"], ["a", "b", "c"], kind="array<string>") == [["a_S"], ["a_B", "b_I", "c_E"]]
    assert column(spark, phones.strip_position, "AH0_B", "x") == ["AH0", "x"]
    assert [tuple(x) for x in column(spark, phones.split_position, "a_b_S", "a")] == [("a_b", "S"), ("a", None)]
    assert column(spark, phones.phone_set, "AH0", "ə", "ma1") == ["ARPA", "IPA", "PINYIN"]


def test_edits():
    assert edit.edits(list("kitten"), list("sitting")) == 3 and edit.edits([], [1, 2]) == 2
    assert edit.edits(list(range(400)), []) == 400
    assert edit.g2p_score(["a b"], ["a b", "c"]) == (0, 2) and edit.g2p_score(["a c"], ["a b"]) == (1, 2)


def test_error_rates(spark):
    rows = spark.createDataFrame([("the cat sat", "the cat sat"), ("the [noise] cat", "a cat"), ("one two", None)], "gold string, hyp string")
    split = rows.select(F.split("gold", " ").alias("g"), F.split("hyp", " ").alias("h"))
    counts = metrics.error_counts(split, "g", "h")
    assert [(r.word_edits, r.n_words) for r in counts.collect()] == [(0, 3), (1, 2), (2, 2)]
    report = metrics.error_report(counts).first()
    assert report.wer == pytest.approx(3 / 7) and report.wer_severity == "medium" and report.ser_severity == "medium"
    assert metrics.boundary_scores([1.0, 2.0, 3.0], [1.01, 2.5, 3.0], 0.02) == pytest.approx((2 / 3, 2 / 3, 2 / 3))
    assert metrics.align([(0, 1, "a"), (1, 2, "b")], [(0, 1, "a")]) == [(0, 0), (1, None)]


def test_evaluate_alignments(spark):
    ref = spark.createDataFrame([(1, 0.0, 1.0, "a"), (1, 1.0, 2.0, "b"), (2, 0.0, 1.0, "a")], "utterance long, begin double, end double, label string")
    hyp = spark.createDataFrame([(1, 0.0, 1.2, "a"), (1, 1.2, 2.0, "c")], ref.schema)
    got = {r.utterance: (r.score, r.error_rate) for r in commands.evaluate_alignments(ref, hyp).collect()}
    assert got[1] == (pytest.approx(0.1), 1.0) and got[2] == (None, 1.0)


def test_lexicon_lines_round_trip(spark, tmp_path):
    (tmp_path / "lex.txt").write_text("this 1.0 0.43 1.23 0.85 dh ih s\ni’m 0.01 ay m\nsick\ts ih k\nempty\none 1 w ah n\n")
    lex = sources.read_lexicon(spark, str(tmp_path / "lex.txt"))
    got = {r.word: (r.probability, r.silence_after, r.phones) for r in lex.collect()}
    assert got == {"this": (1.0, 0.43, ["dh", "ih", "s"]), "i’m": (0.01, None, ["ay", "m"]), "sick": (None, None, ["s", "ih", "k"]), "one": (1.0, None, ["w", "ah", "n"])}
    sinks.write_lexicon(lex, str(tmp_path / "out"))
    assert sources.read_lexicon(spark, str(tmp_path / "out")).count() == 4


def test_rules(spark):
    df = spark.createDataFrame([("w", "t h e n d")], "word string, pronunciation string")
    assert df.select(lexicon.apply_rule(F.col("pronunciation"), "t h", "^", "", "θ")).first()[0] == "θ e n d"
    got = {r.pronunciation: r.generated for r in lexicon.expand_rules(df, [("t h", "", "", "θ"), ("d", "n", "$", "")]).collect()}
    assert got == {"t h e n d": False, "θ e n d": True, "t h e n": True, "θ e n": True}


def test_pronunciation_probabilities(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "sil"), (1, 3, "b"), (1, 4, "a")], "utterance int, begin int, word string")
    counts = lexicon.pronunciation_counts(rows, ["utterance"], "begin", F.col("word") == "sil")
    assert {r.word: tuple(r)[1:] for r in counts.collect()} == {"a": (2, 2, 0, 1, 1), "b": (1, 0, 1, 1, 0)}
    assert commands.train_dictionary(rows, ("sil",)).count() == 2


def test_models_and_arpa(spark, tmp_path):
    docs = spark.createDataFrame([("x", "a b a"), ("x", "a b")], "lang string, text string")
    two, one = commands.train_lm(docs, "lang")
    mass = one.where("p IS NOT NULL").agg(F.sum("p")).first()[0]
    assert mass == pytest.approx(1.0)
    sinks.write_arpa(language_model.arpa_lines(two, one.where("p IS NOT NULL")).coalesce(1), str(tmp_path / "arpa"))
    back = sources.read_arpa(spark, str(next((tmp_path / "arpa").glob("part-*"))))
    got = {(r.order, r.history, r.word): r.prob for r in back.collect()}
    want = {(2, r.history, r.word): r.p for r in two.collect()}
    assert {k: got[k] for k in want} == pytest.approx(want, rel=1e-4)


def test_intervals(spark):
    df = spark.createDataFrame([(1, 0, 10, "a"), (1, 5, 20, "b"), (1, 25, 30, "c"), (1, 90, 95, "d"), (2, 3, 4, "e")], "key long, begin long, end long, label string")
    assert sorted(tuple(r)[:3] for r in intervals.fill_gaps(df, ["key"]).collect()) == [(1, 20, 25), (1, 30, 90)]
    merged = {(r.key, r.begin, r.end, r.labels) for r in intervals.merge_close(df, ["key"], 5).collect()}
    assert merged == {(1, 0, 30, "a b c"), (1, 90, 95, "d"), (2, 3, 4, "e")}
    cut = {(r.key, r.begin, r.end, r.n) for r in intervals.merge_segments(df, ["key"], 5, 20).collect()}
    assert cut == {(1, 0, 20, 2), (1, 25, 30, 1), (1, 90, 95, 1), (2, 3, 4, 1)}
    blockers = spark.createDataFrame([(1, 8, 9)], "key long, begin long, end long")
    assert sorted(r.label for r in intervals.without_overlap(df, blockers, ["key"], 7).collect()) == ["c", "d", "e"]
    points = spark.createDataFrame([(1, 7), (1, 22), (2, 3)], "key long, at long")
    assert sorted(r.label for r in intervals.contained(points, df, ["key"], "at", 6).collect()) == ["a", "b", "e"]


def test_segments_of_frames(spark):
    frames = spark.createDataFrame([(1, k, v) for k, v in enumerate([0.1, 0.9, 0.5, 0.2, 0.1, 0.9, 0.9])], "key long, at long, value double")
    got = sorted((r.begin, r.end, r.n) for r in commands.segment(frames, 0.8, 0.3, 1, 100).collect())
    assert got == [(1, 2, 1), (5, 6, 1)]


def test_tables(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    c = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (2, None, 3), (9, "z", 1)], "id long, v string, k int")
    assert {tuple(r) for r in corpus.merge_update(t, c.where("v IS NOT NULL"), "id", ["v"], [F.col("k")]).collect()} == {(1, "a"), (2, "y")}
    assert {r.id for r in corpus.insert_or_ignore(t, c.select("id", "v"), ["id"]).collect()} == {1, 2, 9}
    assert [tuple(r) for r in corpus.replace_group(t, c.where("k = 2").select("id", "v"), "id").orderBy("id").collect()] == [(1, "a"), (2, "y")]
    assert corpus.lookup(t, id=1, v=None).count() == 1


def test_quota_and_jobs(spark):
    counts = spark.createDataFrame([("a", 5), ("b", 50), ("c", 60)], "lang string, n long")
    assert {r.lang: r.quota for r in sampling.allocate_quota(counts, "lang", 60).collect()} == {"a": 5, "b": 27, "c": 28}
    assert {r.lang: r.job for r in sampling.balance(counts, "lang", 2).collect()} == {"c": 0, "b": 1, "a": 1}
    many = spark.createDataFrame([(f"s{k:03}", 200 - k) for k in range(100)], "source string, n long")
    dealt = sampling.balance(many, "source", 3, most=10).collect()
    loads = [sum(r.n for r in dealt if r.job == j) for j in range(3)]
    assert len(dealt) == 100 and max(loads) - min(loads) < 200


def test_vectors(spark):
    rows = [(k, [float(k % 3 == j) + 0.01 * k for j in range(3)], k % 3) for k in range(12)] + [(99, [0.0, 0.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = commands.diarize(df.where("vec_id < 99").withColumnRenamed("label", "speaker"))
    assert got.where("predicted <> speaker").count() == 0
    small = vectors.nearest_centroid(df, "embedding", vectors.centroids(df, "embedding", "label"), "label", most=2)
    assert {r.vec_id: r.predicted for r in small.collect()} == {r.vec_id: r.predicted for r in vectors.nearest_centroid(df, "embedding", vectors.centroids(df, "embedding", "label"), "label").collect()}
    pairs = vectors.drawn_pairs(df.where("vec_id < 99"), "embedding", "label", "vec_id", 3)
    assert pairs.where("matched").count() == 36 and vectors.equal_error_rate(pairs).first().eer == pytest.approx(0.0, abs=0.02)
    near = {r.vec_id: r.distance for r in vectors.kth_distance(df, df, "embedding", "vec_id", 2, block=4).collect()}
    flat = {i: v for i, v, _ in rows}
    for i, v in flat.items():
        d = sorted(sum((a - b) ** 2 for a, b in zip(v, w)) ** 0.5 for j, w in flat.items() if j != i)
        assert near[i] == pytest.approx(d[1], abs=1e-6)


def test_textgrid_round_trip(spark, tmp_path):
    tiers = {"mary - words": [(0.0, 0.5, "the"), (0.7, 1.0, 'ca"t')], "mary - phones": [(0.0, 0.005, "dh"), (0.005, 0.5, "ah")]}
    for form, short in (("long_textgrid", False), ("short_textgrid", True)):
        content = sinks.textgrid_text(tiers, 1.5, short)
        got = [x for x in sources.parse_textgrid(content) if x[3]]
        assert sorted(got) == sorted((k, *x) for k, v in tiers.items() for x in v)
    folder = tmp_path / "corpus" / "mary"
    folder.mkdir(parents=True)
    (folder / "a.TextGrid").write_text(sinks.textgrid_text(tiers, 1.5))
    (folder / "bad.TextGrid").write_text("nothing")
    (folder / "a.lab").write_text(" hello there \n")
    (folder / "a.txt").write_text("other")
    samples = b"\0\0" * 800
    (folder / "a.wav").write_bytes(b"RIFF" + struct.pack("<I", 36 + len(samples)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 16000, 2, 16) + b"data" + struct.pack("<I", len(samples)) + samples)
    found = sources.scan(spark, str(tmp_path / "corpus"))
    row = next(r for r in sources.utterance_files(found).collect() if r.stem == "a")
    assert row.speaker == "mary" and row.text.endswith("a.lab") and row.audio.endswith("a.wav") and row.textgrid.endswith("a.TextGrid")
    grid = sources.textgrid_intervals(found)
    assert grid.where("tier IS NULL").count() == 1
    words = sources.aligned_intervals(grid).where("label <> ''")
    assert sorted((r.speaker, r.level, r.label) for r in words.collect()) == [("mary", "phone", "ah"), ("mary", "word", 'ca"t'), ("mary", "word", "the")]
    assert sources.transcripts(found).where("path LIKE '%lab'").first().text == "hello there"
    head = sources.wave_headers(found).first()
    assert (head.channels, head.sample_rate, head.duration) == (1, 8000, 0.1)
    rows = words.select(F.lit("a").alias("file"), F.lit(1.5).alias("duration"), F.concat_ws(" - ", "speaker", "level").alias("tier"), "begin", "end", "label")
    spoken, problems = sources.corpus_utterances(found)
    assert sorted((r.problem, r.path.rsplit("/", 1)[1]) for r in problems.collect()) == [("no sound", "bad.TextGrid"), ("not a TextGrid", "bad.TextGrid")]
    assert spoken.count() == 0  # all tiers of the TextGrid, which wins over the .lab, hold alignments
    for form in ("json", "csv", "long_textgrid"):
        assert sinks.rendered(rows, form).count() == 1
    sinks.write_contents(sinks.rendered(rows), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() > 10


def test_small_files(spark, tmp_path):
    (tmp_path / "x.ctm").write_text("u1 1 0.5 0.25 b 0.9\nu1 1 0.0 0.5 a\nu2 1 0 1 c\n")
    got = {r.utterance: [(i.begin, i.end, i.label) for i in r.intervals] for r in sources.read_ctm(spark, str(tmp_path / "x.ctm")).collect()}
    assert got == {"u1": [(0.0, 0.5, "a"), (0.5, 0.75, "b")], "u2": [(0.0, 1.0, "c")]}
    rows = spark.createDataFrame([("k 1", ["a b", "c"])], "key string, values array<string>")
    sinks.write_scp(rows, str(tmp_path / "scp"))
    assert [tuple(r) for r in sources.read_scp(spark, str(tmp_path / "scp")).collect()] == [("k 1", ["a b", "c"])]


def run_stream(stream, name, folder, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(folder / name)).start()
    assert q.awaitTermination(120)


def test_streams_match_batch(spark, tmp_path):
    rows = [(k % 2, f"2024-01-01 00:{k:02d}:00", "x", float(v)) for k, v in enumerate([1, 9, 9, 5, 1, 9, 9, 1, 0, 0])]
    df = spark.createDataFrame(rows, "key long, t string, label string, value double").select("key", F.to_timestamp("t").alias("ts"), "label", "value")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run_stream(segments.window_counts(source(), "5 minutes"), "counts", tmp_path, "complete")
    assert {(r.start.minute, r.n) for r in spark.table("counts").collect()} == {(0, 5), (5, 5)}
    # key 0: 1 9 1 9 0, key 1: 9 5 9 1 0; a stretch ends below 2
    run_stream(segments.active_segments(source(), 8, 2), "active", tmp_path)
    assert sorted((r.key, r.begin.minute, r.end.minute, r.n) for r in spark.table("active").collect()) == [(0, 2, 2, 1), (0, 6, 6, 1), (1, 1, 5, 3)]


def test_late_rows_and_sessions(spark, tmp_path):
    schema = "key long, ts timestamp, label string, value double"
    at = lambda text: datetime.datetime.fromisoformat(f"2024-01-01 {text}:00")
    batches = [[(1, at("00:00")), (1, at("00:02")), (1, at("00:09")), (2, at("00:01"))], [(1, at("02:00"))], [(1, at("00:03")), (2, at("03:00"))], [(9, at("09:00"))]]
    for k, rows in enumerate(batches):
        made = spark.createDataFrame([(key, ts, "x", 1.0) for key, ts in rows], schema)
        made.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        for name, build in (("late", lambda s: segments.window_counts(s, "10 minutes")), ("pauses", lambda s: segments.sessions(s, "5 minutes"))):
            q = build(stream()).writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
            q = q.option("checkpointLocation", str(tmp_path / f"{name}-state")).option("path", str(tmp_path / name)).start()
            assert q.awaitTermination(120)
    late = {(r.start.hour, r.start.minute): r.n for r in spark.read.parquet(str(tmp_path / "late")).collect()}
    assert late == {(0, 0): 4, (2, 0): 1, (3, 0): 1}  # the row of 00:03 came after the watermark had passed it
    found = sorted((r.key, r.begin.hour, r.begin.minute, r.n) for r in spark.read.parquet(str(tmp_path / "pauses")).collect())
    assert found == [(1, 0, 0, 2), (1, 0, 9, 1), (1, 2, 0, 1), (2, 0, 1, 1), (2, 3, 0, 1)]


def test_new_files(spark, tmp_path):
    folder = tmp_path / "corpus" / "mary"
    folder.mkdir(parents=True)
    (folder / "a.lab").write_text(" hello\n there ")
    (folder / "a.wav").write_bytes(b"no text")
    run_stream(segments.new_utterances(spark, str(tmp_path / "corpus")), "arrived", tmp_path)
    assert [(r.speaker, r.text) for r in spark.table("arrived").collect()] == [("mary", "hello there")]


def test_edits_against_the_table(spark):
    edits = edit.edits

    def table(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
            row = now
        return row[-1]

    rng = random.Random(5)
    for k in range(400):
        a, b = ([rng.choice(["ab", "b", "\U0001f600", None]) for _ in range(rng.randrange(90 if k % 7 == 0 else 9))] for _ in range(2))
        assert edits(a, b) == table(a, b)
    assert edits("", "") == 0 and edits("abc", "") == 3 and edits("kitten", "sitting") == 3
    df = spark.createDataFrame([("kitten", "sitting"), (None, "a\U0001f600"), ("", "")], "a string, b string")
    assert [r.n for r in df.select(edit.text_edits(F.col("a"), F.col("b")).alias("n")).collect()] == [3, 2, 0]
