"""Configuration files, exports, dictionaries and clusterings on small frames; queries without SQL against brute force."""

import functools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.operators import corpus, dictionary, g2p, intervals, language_model, lexicon, metrics, selection, vectors
from lexiloom.plans import commands
from lexiloom.queries import QUERIES
from lexiloom.sinks import files as sinks
from lexiloom.sources import config, files as sources

SF = "/root/testdata/sf0.001"


def tuples(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_configuration_files(spark, tmp_path):
    write = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    table = config.speaker_dictionaries(spark, write("d.yaml", "ann: us.dict\ndefault: uk.dict\nnonnative: nn.dict\n"))
    assert tuples(table) == sorted([("ann", "us.dict", "speaker"), (None, "uk.dict", "default"), (None, "nn.dict", "nonnative")], key=str)
    rows = spark.createDataFrame([("ann",), ("bob",)], "speaker string")
    assert tuples(config.dictionary_of(rows, table)) == [("ann", "us.dict"), ("bob", "uk.dict")]
    text = "rules:\n- {segment: iy, replacement: ih, preceding_context: '', following_context: ''}\ndialects:\n  uk:\n  - {segment: r, replacement: '', preceding_context: '', following_context: $}\n"
    rules = config.phonological_rules(spark, write("r.yaml", text), ["us"])
    assert tuples(rules) == [("uk", "iy", "", "", "ih"), ("uk", "r", "", "$", ""), ("us", "iy", "", "", "ih")]
    assert config.rule_tuples(rules, "us") == [("iy", "", "", "ih")]
    assert config.phone_groups(spark, write("g.yaml", "-\n  - p\n  - b\n-\n  - s\n")).groupBy("phone_group").count().count() == 2
    assert tuples(config.phone_groups(spark, write("n.yaml", "stops:\n- p\n- t\n"))) == [("stops", 0, "p"), ("stops", 1, "t")]
    assert tuples(config.phone_topologies(spark, write("t.yaml", "r: {max_states: 1, min_states: 1}\na:\n"))) == [("a", 3, 3), ("r", 1, 1)]
    assert tuples(config.word_list(spark, write("w.txt", "Cat\ndog d o g\ncat\n\n"))) == [("cat",), ("dog",)]
    flat, stages = config.settings(spark, write("c.yaml", "beam: 10\ntraining:\n- monophone: {subset: 100}\n- triphone: {subset: 200}\n"), {"beam": 1, "jobs": 3})
    assert flat == {"beam": 10, "jobs": 3} and [(s["stage"], s["subset"]) for s in stages] == [("monophone", 100), ("triphone", 200)]
    with pytest.raises(ValueError):
        config.settings(spark, str(tmp_path / "c.yaml"), {"jobs": 3})
    info = config.speaker_info(spark, write("s.tsv", "ann\tx\tFemale\nbob\ty\tm\ncy\tz\t\n"))
    assert dictionary.sex_counts(info, "f2").first() == (1, 1, 1)
    assert config.corpus_description(spark, write("c.json", '{"name": "x",\n "num_hours": 2.5}')).first().num_hours == 2.5
    assert config.model_metadata(spark, write("m.json", '{"phones": ["a"]}')) == {"phones": ["a"]}
    assert config.dataset_kind(spark, str(tmp_path / "nothing")) == "none"
    assert config.dataset_kind(spark, str(tmp_path)) == "corpus" and config.dataset_kind(spark, SF) == "database"


def test_exports(spark, tmp_path):
    rows = [("f", "t", 0.0, 1.0, "il"), ("f", "t", 1.0, 2.0, "l'"), ("f", "t", 2.01, 3.0, "a"), ("f", "t", 3.5, 4.0, "'s"), ("f", "t", 4.0, 4.0, "x"), ("f", "t", 5.0, 6.0, "sil")]
    df = spark.createDataFrame(rows, "file string, tier string, begin double, end double, label string")
    assert tuples(sinks.export_rows(df, ("sil",))) == [("f", "t", 0.0, 1.0, "il"), ("f", "t", 1.0, 3.0, "l'a"), ("f", "t", 3.5, 4.0, "'s")]
    assert sinks.export_rows(df, clitics="").count() == 5
    path = df.limit(1).select(sinks.output_path(F.lit("a/b"), F.lit("c"), "long_textgrid", "/out/"), sinks.output_path(F.lit(""), F.lit("c"), "lab"))
    assert tuple(path.first()) == ("/out/a/b/c.TextGrid", "c.lab")
    spoken = spark.createDataFrame([("a", 2.0, "ann", 0.0, 2.0, "hi"), ("b", 2.0, "ann", 0.0, 1.0, "x"), ("b", 2.0, "bob", 1.0, 2.0, "y")], "file string, duration double, speaker string, begin double, end double, text string")
    made = {r.file: (r.form, r.content) for r in sinks.transcription_contents(spoken).collect()}
    assert made["a"] == ("lab", "hi") and sorted(x[0] for x in sources.parse_textgrid(made["b"][1]) if x[3]) == ["ann", "bob"]
    contents = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5)], "file string, changed int")
    assert [r.file for r in sinks.outdated(contents, spark.createDataFrame([("a", 9), ("b", 1)], "file string, written int")).orderBy("file").collect()] == ["b", "c"]
    utts = spark.createDataFrame([("u 2", "ann", "f", 0, 1, "x"), ("u1", "ann", "f", 1, 2, None)], "utterance string, speaker string, file string, begin int, end int, text string")
    sinks.write_split(utts, str(tmp_path / "split"))
    lines = lambda name: [r[0] for r in spark.read.text(str(tmp_path / "split" / name)).collect()]
    assert lines("spk2utt") == ["ann u1 u_SPACE_2"] and lines("segments") == ["u1 f 1.0000 2.0000", "u_SPACE_2 f 0.0000 1.0000"]
    entries = spark.createDataFrame([("w", None, 0.4, None, 1.2, ["a"]), ("v", 0.5, None, None, None, ["b"])], "word string, probability double, silence_after double, silence_before_correction double, nonsilence_before_correction double, phones array<string>")
    sinks.write_lexicon(entries, str(tmp_path / "lex"))
    back = {r.word: (r.probability, r.silence_after, r.silence_before_correction, r.nonsilence_before_correction) for r in sources.read_lexicon(spark, str(tmp_path / "lex")).collect()}
    assert back == {"w": (0.99, 0.4, 1.0, 1.2), "v": (0.5, None, None, None)}
    sinks.write_pronunciations(spark.createDataFrame([("b", "x y"), ("a", "z")], "word string, pronunciation string"), str(tmp_path / "p"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "p")).collect()] == ["a\tz", "b\tx y"]
    sinks.write_rules(spark.createDataFrame([("t", "d", 0.2), ("s", "z", 0.9)], "segment string, replacement string, probability double"), str(tmp_path / "rules"))
    assert [json.loads(r[0])["segment"] for r in spark.read.text(str(tmp_path / "rules")).collect()] == ["s", "t"]
    vecs = spark.createDataFrame([(1, [0.5, 1.0], "ann")], "id long, v array<double>, speaker string")
    sinks.write_vectors(vecs, str(tmp_path / "vec"), "v")
    assert config.read_vectors(spark, str(tmp_path / "vec")).first().v == [0.5, 1.0]
    for k in (1, 2):
        sinks.load_intervals(df.withColumn("workflow_id", F.lit(k)), str(tmp_path / "table"))
    table = spark.read.parquet(str(tmp_path / "table"))
    assert table.count() == 12 and selection.truncate(table, 1).count() == 6 and selection.truncate(table).count() == 0
    files = spark.createDataFrame([("f", "a", None, "a.lab", None), ("f", "b", "b.wav", None, None), ("f", "c", "c.wav", "c.lab", None)], "folder string, stem string, audio string, text string, textgrid string")
    assert tuples(sinks.error_lists(files, spark.createDataFrame([("c.lab", "not UTF-8"), ("d", None)], "path string, error string"))) == [("a.lab", "no sound"), ("b.wav", "no text"), ("c.lab", "not UTF-8")]


def test_dictionaries(spark):
    cases = {
        "walking": "walk +ing", "hoping": "hope +ing", "stopped": "stop +ed", "happiness": "happy +ness", "undo": "un+ do", "xyz": "xyz", "walk": "walk",
        "reundoes": "re+ un+ do +es", "un-walked": "un+ walk +ed", "understop": "under+ stop", "nonsense": "nonsense", "un": "un", "terribly": "terrible +ly",
    }
    words = spark.createDataFrame([(w,) for w in [*cases, "walk", None]], "word string")
    known = spark.createDataFrame([(w,) for w in ["walk", "hope", "happy", "able", "stop", "do", "terrible"]], "word string")
    assert {r.word: " ".join(r.parts) for r in dictionary.split_affixes(words, known).collect()} == cases
    assert dictionary.split_affixes(words.limit(0), known).count() == 0 and dictionary.split_affixes(words, known.limit(0)).where("size(parts) > 1").count() == 0
    rows = spark.createDataFrame([("I walk [noise] qq", ), (None,)], "text string")
    got = dictionary.normalized(rows, "text", frozenset(["i", "walk"])).collect()
    assert got[0].normalized_text == "i walk [bracketed] qq" and got[0].oovs == ["qq"] and got[1].oovs == []
    flow = spark.createDataFrame([(1, "align", "a", True)], "id long, name string, kind string, current boolean")
    flow = selection.add_workflow(flow, "train", "t")
    assert tuples(flow) == [(1, "align", "a", False), (2, "train", "t", True)]
    assert tuples(selection.add_workflow(flow, "align", "a")) == [(1, "align", "a", True), (2, "train", "t", False)]
    assert selection.stage_sizes(30_000) == [10_000, 20_000, 20_000, 20_000, 30_000, 30_000, 30_000, 30_000, 30_000]
    assert selection.linear_steps(0.0, 1.0, 3) == [0.0, 0.5, 1.0]
    long = "a" * 80
    done = dictionary.cutoff_completions(spark.createDataFrame([(f"<cutoff-{long[:70]}>",), ("<cutoff-ca>",)], "word string"), spark.createDataFrame([(long,), ("cat",), ("dog",)], "word string"))
    assert sorted(r.word for r in done.collect()) == [long, "cat"]
    utts = spark.createDataFrame([(1, 7, 5), (2, 8, 6)], "id long, file_id long, speaker_id long")
    files, speakers = spark.createDataFrame([(7, "a"), (8, "b")], "file_id long, file_name string"), spark.createDataFrame([(5, "ann")], "speaker_id long, speaker_name string")
    assert corpus.lookup_joined(utts, files, speakers, file_name="a", speaker_name="ann", id=None).first().id == 1
    assert corpus.lookup_joined(utts, files, speakers, id=2).first().file_id == 8


def test_language_model_of_any_order(spark):
    model = [(1, "", "a", 0.5, 0.4), (1, "", "b", 0.3, 0.5), (1, "", "c", 0.2, None), (2, "a", "b", 0.6, 0.7), (3, "a b", "c", 0.9, None)]
    m = spark.createDataFrame(model, "order int, history string, word string, prob double, backoff double")
    grams = [(1, ["a", "b", "c"]), (2, ["a", "b", "a"]), (3, ["c", "a"]), (4, ["a", "z"]), (5, ["b"])]
    got = {r.id: r.prob for r in language_model.model_probability(spark.createDataFrame(grams, "id long, words array<string>"), m, 3).collect()}
    assert got == {1: 0.9, 2: pytest.approx(0.7 * 0.5 * 0.5), 3: 0.5, 4: None, 5: 0.3}
    two, one = commands.train_lm(spark.createDataFrame([("x", "a b a b a c")], "lang string, text string"), "lang")
    kept = [language_model.pruned_pairs(two, one, "lang", x).count() for x in (-100.0, 0.5, 1.5, 100.0)]
    assert kept[0] == two.count() and kept == sorted(kept, reverse=True) and kept[3] == 0 and len(set(kept)) > 2
    assert language_model.lowered_arpa(spark.createDataFrame([("-1 A B  ",)], "value string")).first()[0] == "-1 a b"


def test_intervals_in_full(spark):
    utts = spark.createDataFrame([("f", 0, 100, 1), ("f", 100, 200, 2)], "file string, begin long, end long, utterance long")
    refs = spark.createDataFrame([("f", 10, 40, "a"), ("f", 60, 120, "b"), ("f", 195, 230, "c")], "file string, begin long, end long, label string")
    assert tuples(intervals.attached(refs, utts, ["file"], 50)) == [(1, 0, 10, "sil"), (1, 10, 40, "a"), (1, 40, 60, "sil"), (1, 60, 100, "b"), (2, 100, 200, "sil")]
    df = spark.createDataFrame([(1, 10, 20), (1, 24, 30), (1, 80, 81), (1, 95, 120)], "key long, begin long, end long")
    assert tuples(intervals.merge_segments(df, ["key"], 5, 100, shortest=5, snap=4).select("begin", "end")) == [(6, 34), (91, 124)]
    frames = spark.createDataFrame([(1, t, float(t)) for t in range(0, 100, 10)], "key long, at long, energy double")
    loud = intervals.confirmed_by_energy(spark.createDataFrame([(1, 0, 30), (1, 50, 100)], "key long, begin long, end long"), frames, ["key"], 20, F.lit(30.0))
    assert [(r.begin, r.energy) for r in loud.collect()] == [(50, 70.0)]


@pytest.mark.parametrize("method", ["kmeans", "bisecting", "gaussian", "agglomerative", "dbscan"])
def test_clusterings_find_the_groups(spark, method):
    rng = np.random.default_rng(4)
    centres = np.eye(4)[:3]
    rows = [(k, (centres[k % 3] + rng.normal(0, 0.05, 4)).tolist(), k % 3) for k in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    made, scores = commands.cluster_speakers(df, method=method, truth="label", k=3, micro=30, eps=0.3)
    assert scores.first().adjusted_rand > 0.95 and vectors.silhouette(made, "embedding", "cluster") > 0.8
    assert vectors.adjusted_mutual_information(vectors.contingency(made, "cluster", "label"), "cluster", "label").first()[0] > 0.95


def test_large_clusters_are_split(spark):
    rng = np.random.default_rng(5)
    rows = [(k, (np.eye(3)[k % 2] + rng.normal(0, 0.05, 3)).tolist(), 7) for k in range(60)] + [(100, [0.0, 0.0, 1.0], 2)]
    got = vectors.split_large(spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster long"), "embedding", "cluster", 50).collect()
    parts = {r.vec_id: r.cluster for r in got}
    assert len({parts[k] for k in range(0, 60, 2)}) == 1 and parts[0] != parts[1] and parts[100] == 2 and max(parts.values()) == 8


def test_repeated_rows_stay_apart_among_many_centroids(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 1.0], 2), (3, [0.7, 0.7], 3)], "vec_id long, embedding array<double>, label int")
    centres = vectors.centroids(df, "embedding", "label")
    for most in (1, 2, 100):
        got = vectors.nearest_centroid(df, "embedding", centres, "label", most=most).collect()
        assert sorted((r.vec_id, r.predicted) for r in got) == [(1, 1), (1, 1), (2, 2), (3, 3)]
    assert vectors.nearest_centroid(df, "embedding", centres.limit(0), "label").where("predicted IS NULL").count() == 4


def test_long_entries_do_not_underflow(spark):
    letters = ["a", "b"] * 150
    got = g2p.expected_chunks(letters, letters, {("a", "a"): 0.01, ("b", "b"): 0.01}, (1, 1))
    assert got[("a", "a")] == pytest.approx(150) and g2p.best_alignment(letters, letters, {("a", "a"): 0.01, ("b", "b"): 0.01}, (1, 1))
    df = spark.createDataFrame([("ab" * 150, ["a", "b"] * 150)], "word string, phones array<string>")
    weights = spark.createDataFrame([("a", "a", 0.01), ("b", "b", 0.01)], "letters string, phones string, weight double")
    made = commands.generate_pronunciations(df.select("word"), weights, 1).first()
    assert made.pronunciation == " ".join(letters) and made.score == pytest.approx(300 * math.log(0.01))
    assert commands.validate_dictionary(df, weights).first().edits == 0
    assert commands.generate_pronunciations(spark.createDataFrame([("abc",)], "word string"), weights).count() == 0


# --- queries without SQL ----------------------------------------------------------------------


def slow_edits(a, b):
    @functools.lru_cache(None)
    def go(i, j):
        if not i or not j:
            return i + j
        return min(go(i - 1, j) + 1, go(i, j - 1) + 1, go(i - 1, j - 1) + (a[i - 1] != b[j - 1]))

    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            go(i, j)
    return go(len(a), len(b))


def turns(spark):
    from lexiloom.functions.text import tokens

    rows = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", tokens(F.col("text")).alias("w")).collect()
    by = {(r.conv_id, r.turn): r.w for r in rows}
    order = sorted(by)
    follow = {k: by[order[n + 1]] if n + 1 < len(order) and order[n + 1][0] == k[0] else [] for n, k in enumerate(order)}
    return {k: (by[k], follow[k]) for k in order}


def test_edit_queries_against_recursion(spark):
    want = {k: (slow_edits(a, b), len(a), slow_edits("".join(a), "".join(b)), len("".join(a))) for k, (a, b) in turns(spark).items()}
    got = QUERIES["word_error_rate"](spark, SF).collect()
    assert {(r.conv_id, r.turn): (r.word_edits, r.n_words, r.char_edits, r.n_chars) for r in got} == want
    assert {(r.conv_id, r.turn): r.edits for r in QUERIES["token_edit_distance"](spark, SF).collect()} == {k: v[0] for k, v in want.items()}
    report = QUERIES["error_rate_report"](spark, SF).first()
    assert report.ser == pytest.approx(sum(v[0] > 0 for v in want.values()) / len(want))
    assert report.wer == pytest.approx(sum(v[0] for v in want.values()) / sum(v[1] for v in want.values()))
    assert report.cer == pytest.approx(sum(v[2] for v in want.values()) / sum(v[3] for v in want.values()))


def test_probabilities_against_counts(spark):
    pause = {"the", "a", "of", "de", "la", "und", "der"}
    n, after, before = {}, {}, {}
    sequences = {}
    for (conv, _), (words, _) in turns(spark).items():
        sequences.setdefault(conv, []).extend(words)
    for words in sequences.values():
        for k, w in enumerate(words):
            if w not in pause:
                n[w] = n.get(w, 0) + 1
                after.setdefault(w, []).append(k + 1 == len(words) or words[k + 1] in pause)
                before.setdefault(w, []).append(k == 0 or words[k - 1] in pause)
    p = sum(map(sum, before.values())) / sum(map(len, before.values()))
    top = {}
    for w in n:
        top[w[0]] = max(top.get(w[0], 0), n[w] + 1)
    clamp = lambda x: min(0.99, max(0.01, round(x, 2)))
    want = {w: (n[w], clamp((n[w] + 1) / top[w[0]]), clamp((sum(after[w]) + 2 * p) / (len(after[w]) + 2))) for w in n}
    got = {r.word: (r.n, r.probability, r.silence_after) for r in QUERIES["pronunciation_probabilities"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(got[w] == pytest.approx(want[w], abs=0.0100001) for w in want)
    assert sum(got[w] != want[w] for w in want) <= 0.01 * len(want)  # sums in another order may round to the other side


def events(spark):
    rows = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("begin")).collect()
    return [(r.user_id, r.begin, r.begin + math.floor(r.value * 1_000_000), r.event_type, r.event_id) for r in rows]


def test_evaluation_queries_against_recursion(spark):
    sides = {}
    for user, begin, end, label, k in events(spark):
        ref, hyp = sides.setdefault(user, ([], []))
        if label not in ("sil", ""):
            ref.append((begin / 1e6, end / 1e6, label))
        if k % 17:
            hyp.append((begin / 1e6 + 0.01, end / 1e6 + 0.02, "view" if k % 11 == 0 else label))
    wrong = n = 0
    for ref, hyp in sides.values():
        ref, hyp = sorted(ref), sorted(hyp)

        @functools.lru_cache(None)
        def cost(i, j, ref=ref, hyp=hyp):
            if not i or not j:
                return 5.0 * (i + j)
            a, b = ref[i - 1], hyp[j - 1]
            return min(cost(i - 1, j - 1) + abs(a[0] - b[0]) + abs(a[1] - b[1]) + 2 * (a[2] != b[2]), cost(i - 1, j) + 5, cost(i, j - 1) + 5)

        made = metrics.align(ref, hyp)
        total = sum(5.0 if i is None or j is None else abs(ref[i][0] - hyp[j][0]) + abs(ref[i][1] - hyp[j][1]) + 2 * (ref[i][2] != hyp[j][2]) for i, j in made)
        assert total == pytest.approx(cost(len(ref), len(hyp)))
        wrong += sum(1 if i is None or j is None else 2 * (ref[i][2] != hyp[j][2]) for i, j in made)
        n += len(ref)
    got = QUERIES["alignment_evaluation"](spark, SF).first()
    assert got.n_reference == n and got.error_rate == pytest.approx(wrong / n, abs=1e-5) and got.mean_overlap == pytest.approx(0.015, abs=0.2)
    found = QUERIES["phone_confusions"](spark, SF).collect()
    assert sum(r.n for r in found) == got.n_insertions + got.n_deletions + got.n_substitutions and all(len(r.examples) <= 5 for r in found)
    ends = {u: (sorted(x[1] for x in a), sorted(x[1] for x in b)) for u, (a, b) in sides.items()}
    for r in QUERIES["boundary_precision_recall"](spark, SF).collect():
        assert (r.precision, r.recall, r.f1) == pytest.approx(metrics.boundary_scores(*ends[r.user_id], 0.025))


def rewritten(phones, rule):
    """A rule of whole phones applied everywhere, by a walk."""
    segment, before, after, replacement = rule
    seg, k, out = segment.split(), 0, []
    while k < len(phones):
        fits = phones[k : k + len(seg)] == seg
        fits &= before != "^" or k == 0
        fits &= before in ("", "^") or k > 0 and phones[k - 1] == before
        fits &= after != "$" or k + len(seg) == len(phones)
        fits &= after in ("", "$") or k + len(seg) < len(phones) and phones[k + len(seg)] == after
        out += replacement.split() if fits else [phones[k]]
        k += len(seg) if fits else 1
    return out


def test_rule_closure_against_all_paths(spark):
    rules = [("a b", "", "", "c"), ("c", "", "$", "d e"), ("e", "", "", ""), ("x", "^", "", "y"), ("y", "", "a", "x"), ("d", "b", "", "a")]
    starts = ["a b", "x a b c", "a b a b", "e", "x", "q", "y a", "b d c a b", None]
    df = spark.createDataFrame([(f"w{i}", p) for i, p in enumerate(starts)] + [("w0", "a b"), ("w0", "c")], "word string, pronunciation string")
    want = {}
    for word, given in [*((f"w{i}", [p]) for i, p in enumerate(starts[1:-1], 1)), ("w0", ["a b", "c"])]:
        best, level = {p: () for p in given}, {p: () for p in given}
        while level:
            fresh = {}
            for p, path in level.items():
                for k, rule in enumerate(rules):
                    made = " ".join(rewritten(p.split(), rule))
                    if made and made not in best:
                        fresh[made] = min(fresh.get(made, (99,)), (*path, k))
            best |= fresh
            level = fresh
        want |= {(word, p): (len(path), sorted(set(path))) for p, path in best.items()}
    made = lexicon.expand_rules(df, rules)
    got = {(r.word, r.pronunciation): (r.depth, r.rules) for r in made.collect()}
    assert got == want and made.count() == len(want)
    assert not made.where("endless OR generated <> (depth > 0)").count()
    assert lexicon.rule_applications(made).count() == sum(len(r) for _, r in want.values())
    assert lexicon.expand_rules(df, []).count() == 9 and lexicon.expand_rules(df.limit(0), rules).count() == 0


def test_growing_words_stop_alone(spark):
    df = spark.createDataFrame([("grows", "a"), ("stays", "b c"), ("cycle", "u")], "word string, pronunciation string")
    rules = [("a", "", "", "a a"), ("b", "", "", "v"), ("u", "", "", "o"), ("o", "", "", "u")]
    rows = lexicon.expand_rules(df, rules, inventory=["a", "b", "c", "v", "u", "o"]).collect()
    assert {r.word for r in rows if r.endless} == {"grows"}
    assert {r.pronunciation for r in rows if r.word == "grows"} == {" ".join("a" * 2**k) for k in range(5)}
    assert {(r.pronunciation, tuple(r.rules)) for r in rows if r.word != "grows"} == {("b c", ()), ("v c", (1,)), ("u", ()), ("o", (2,))}
    assert lexicon.expand_rules(df, rules, inventory=["b", "c", "u", "a"]).where("word <> 'grows'").count() == 2


def walked(labels, mapping, longest):
    """(start, length, new labels) from the left, the longest match first."""
    out, i = [], 0
    while i < len(labels):
        for n in range(min(longest, len(labels) - i), 0, -1):
            part = labels[i : i + n]
            if None not in part and " ".join(part) in mapping:
                out.append((i, n, mapping[" ".join(part)]))
                break
        else:
            n = 1
            out.append((i, 1, [labels[i]]))
        i += n
    return out


def test_remapped_sequences_against_a_walk(spark):
    import random

    rng = random.Random(5)
    mapping = {"a": ["A"], "a b": ["ab"], "b a a": ["x", "y", "z"], "b b": ["B"], "c": ["k", "s"], "d d d": ["D"]}
    sides = {k: [rng.choice("aabbcde") for _ in range(rng.randrange(1, 40))] for k in range(25)}
    sides[30], sides[31], sides[32] = ["d"] * 700, ["b"] * 601, ["d", "d", None, "d", "d", "d", "b"]  # long chains of overlapping matches
    rows = [(k, 10 * i, 10 * i + 8, x, f"{k}-{i}") for k, labels in sides.items() for i, x in enumerate(labels)]
    df = spark.createDataFrame(rows, "key int, begin long, end long, label string, name string").repartition(7)
    want = []
    for key, labels in sides.items():
        for i, n, made in walked(labels, mapping, 3):
            b, e = 10 * i, 10 * (i + n - 1) + 8
            cuts = [b, b + (e - b) * 3 // 10, e] if len(made) == 2 else [b + (e - b) * j // len(made) for j in range(len(made) + 1)]
            want += [(key, cuts[j], cuts[j + 1], x, f"{key}-{i}", j) for j, x in enumerate(made)]
    assert tuples(intervals.remap_labels(df, ["key"], ["begin"], mapping, 0.3)) == sorted(want, key=str)
    assert intervals.remap_labels(df.limit(0), ["key"], ["begin"], mapping).count() == 0
    assert intervals.remap_labels(df, ["key"], ["begin"], {}).count() == len(rows)


def test_remapped_entries_mean_corrections(spark):
    entries = [("w", ["a"], 0.4, 0.2, None), ("w", ["b"], 0.9, 0.4, 1.5), ("w", ["q"], 0.1, 0.1, 1.0), ("v", ["a", "s"], None, None, None)]
    df = spark.createDataFrame(entries, "word string, phones array<string>, probability double, silence_after double, silence_before_correction double")
    got = {(r.word, *r.phones): (r.probability, r.silence_after, r.silence_before_correction, r.n) for r in lexicon.remap_alternatives(df, {"a": ["x"], "b": ["x", "y"]}, ["s"]).collect()}
    assert got == {("w", "x"): (0.9, pytest.approx(0.3), 1.5, 2), ("w", "y"): (0.9, 0.4, 1.5, 1), ("v", "x", "s"): (None, None, None, 1)}


def test_corrections_of_a_whole_dictionary(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "sil"), (1, 3, "b"), (1, 4, "a"), (2, 1, "b"), (2, 2, "a")], "utterance int, begin int, word string")
    got = {r.word: r for r in commands.train_dictionary_with_corrections(rows, ("sil",)).collect()}
    after = {w: got[w].silence_after for w in got}
    # before a: b twice; before b: a once
    assert got["a"].silence_before_correction == pytest.approx(round((1 + 2) / (2 * after["b"] + 2), 2), abs=0.011)
    assert got["b"].silence_before_correction == pytest.approx(round((2 + 2) / (1 * after["a"] + 2), 2), abs=0.011)


def test_merged_segments_against_a_loop(spark):
    sides = {}
    for user, begin, end, *_ in events(spark):
        sides.setdefault(user, []).append((begin, end))
    for pause, longest in ((0, 3_600_000_000), (6 * 3_600_000_000, 24 * 3_600_000_000), (3_600_000_000, 10**18)):
        want = []
        for user, rows in sides.items():
            out, reach = [], None
            for begin, end in sorted(rows):
                if reach is None or begin - reach > pause or end - out[-1][0] > longest:
                    out.append([begin, end, 1])
                else:
                    out[-1][1:] = [max(out[-1][1], end), out[-1][2] + 1]
                reach = end if reach is None else max(reach, end)
            want += [(user, *x) for x in out]
        df = spark.createDataFrame([(u, b, e) for u, rows in sides.items() for b, e in rows], "user_id long, begin long, end long")
        assert tuples(intervals.merge_segments(df, ["user_id"], pause, longest)) == sorted(want, key=str)


def test_trained_queries_make_sense(spark):
    """Invariants of queries whose results come from training or drawing."""
    rows = QUERIES["kmeans_clusters"](spark, SF).collect()
    assert len({r.cluster for r in rows}) <= 10 and len(rows) == 500
    ranks = QUERIES["g2p_generation"](spark, SF).collect()
    assert all(r.score <= 0 for r in ranks) and {r.rank for r in ranks} <= {1, 2, 3}
    weights = QUERIES["m2m_alignment"](spark, SF).collect()
    assert sum(r.weight for r in weights) == pytest.approx(1.0)
    eer = QUERIES["pair_scores_eer"](spark, SF).first()
    assert 0 <= eer.eer <= 1 and -1 <= eer.threshold <= 1
    assert all(len(r.projected) == 4 for r in QUERIES["discriminant_vectors"](spark, SF).collect())
    sizes = {}
    for r in QUERIES["iterative_speaker_clusters"](spark, SF).collect():
        sizes[r.cluster] = sizes.get(r.cluster, 0) + 1
    assert all(n >= 5 for k, n in sizes.items() if k is not None)
