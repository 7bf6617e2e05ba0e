import re

from pyspark.sql import functions as F

import corpus_pipeline
from lexiloom.llm import decontaminate, exact_dedup, language_id, simhash


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] < sizes[0]
    assert docs.select(exact_dedup.normalised()).distinct().count() == sizes[-1]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == sizes[-1]


def test_clashing_columns_and_nulls_pass_through(spark):
    rows = [(1, "the of and the is", "k", "r", "d", "o"), (1, "the of and the is", "k", "r", "d", "o"), (None, None, None, None, None, None), (2, "of the and in to", "x", "y", "z", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string, _row string, text_sha256 string, _one string")
    bench = spark.createDataFrame([(1, "nothing of this is in there at all today")], "item_id long, text string")
    for out, n in ((exact_dedup.deduplicate(docs), 3), (simhash.drop_near_duplicates(docs), 3), (decontaminate.drop_contaminated(docs, bench), 4)):
        got = out.collect()
        assert out.columns == docs.columns and len(got) == n
        assert {tuple(r) for r in got} == set(rows)


def test_clashing_columns_of_the_outer_stages(spark):
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    names = "score held_out raw row sequence_id length _rank _gap slot size part _spot".split()
    docs = base.select("*", *(F.lit(k).alias(n) for k, n in enumerate(names)))
    nulls = spark.range(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema))
    nulls = nulls.unionByName(nulls.withColumns({"doc_id": F.lit(7000).cast("long"), "text": F.lit("")}))
    kept = language_id.keep_identified(docs.unionByName(nulls))
    assert kept.columns == docs.columns and kept.where("doc_id IS NULL OR doc_id = 7000").count() == 0
    some = docs.limit(20).unionByName(nulls)
    packed = corpus_pipeline.pack_sequences(spark, some, "").collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in some.collect()}
    assert all(r.sequence_id is not None and r.offset + r.length <= 2048 for r in packed)


def shingles(text, k=5):
    words = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text.lower()).split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def near_groups(texts):
    """doc_id: the smallest doc_id reachable by similarities of 0.8, every pair compared."""
    sets = {i: shingles(t or "") for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 10 * both >= 8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def leaks(text, items):
    """Whether an item stands in the text by the rule, on any diagonal."""
    doc = decontaminate.word_hashes(decontaminate.words_of((text or "").encode()))
    for item in items:
        need = min(12, 0.6 * len(item) if len(item) >= 6 else len(item))
        for shift in range(-len(item) + 1, len(doc)):
            _, n, same = decontaminate.best_overlap(doc, item, shift)
            if n and len(item) > 2 and same >= need:
                return True
    return False


def test_every_stage_against_brute_force(spark, tmp_path):
    """run() stage by stage on a small table: each stage's rows from its own input by plain loops."""
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 2500").orderBy("doc_id").limit(70)
    rows = [tuple(r) for r in base.collect()]
    words = [r[1].split() for r in rows]
    item = " ".join(words[5][3:23])
    extra = [
        (9000, rows[3][1].replace(" ", "  "), "en", "s", 0), (9001, " ".join(words[7][:-3]), "en", "s", 0), (9002, " ".join([*words[8], "one", "more"]), "en", "s", 0),
        (9003, " ".join(words[9][:30]) + " " + item + " " + " ".join(words[9][30:]), "en", "s", 0), (9004, None, None, None, 0), (9005, "12 34 !!", "en", "s", 0), (9006, "", "en", "s", 0),
    ]
    sf = tmp_path / "sf"
    spark.createDataFrame([*rows, *extra], base.schema).repartition(3).write.parquet(str(sf / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, "nothing of this sort stands in any of these texts at all")], "item_id long, text string").write.parquet(str(sf / "benchmark.parquet"))
    items = [decontaminate.word_hashes(decontaminate.words_of(x.encode())) for x in (item, "nothing of this sort stands in any of these texts at all")]
    docs = spark.read.parquet(str(sf / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, str(sf)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r.doc_id for r in docs.collect()}
        if name == "language_id":
            found = {r.doc_id: r for r in language_id.identify(spark.createDataFrame([(i, t, None) for i, t in before.items()], "doc_id long, text string, lang string")).collect()}
            assert not {9004, 9005, 9006} & after and len(after) >= 70 and found[9005].lang_pred == "und"
        elif name == "exact_dedup":
            first = {}
            for i, t in sorted(before.items()):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
            assert after == set(first.values()) and 9000 not in after
        elif name == "simhash_near_dedup":
            assert after == {i for i, r in near_groups(before).items() if i == r} and before.keys() - after
        else:
            assert after == {i for i, t in before.items() if not leaks(t, items)} and not {rows[5][0], 9003} & after
    packed = corpus_pipeline.pack_sequences(spark, docs, str(sf)).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    whole = corpus_pipeline.run(spark, str(sf)).collect()
    assert sorted(map(key, whole)) == sorted(map(key, packed))
    assert len({r.sequence_id for r in whole}) == len({r.sequence_id for r in packed})


def test_empty_tables(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    assert exact_dedup.deduplicate(docs).count() == 0 and decontaminate.drop_contaminated(docs, bench).count() == 0
    some = spark.createDataFrame([(1, "a text of some words")], "doc_id long, text string")
    assert decontaminate.drop_contaminated(some, bench.limit(0)).count() == 1
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
