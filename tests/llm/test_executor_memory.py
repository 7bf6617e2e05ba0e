"""What a Python worker of the pipeline's stages holds, and that bounds on it change no result."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import language_id, packing

ENGLISH = "the of and to in that was with for from this have which they were their would there about people"
SPANISH = "el la los que del las con una por para como pero sus este entre cuando muy sobre también hasta"


@pytest.fixture(scope="module")
def model():
    return language_id.fit([(ENGLISH, "en"), (SPANISH, "es")] * 20, epochs=2)


def test_a_full_word_cache_changes_no_prediction(model):
    rng = np.random.default_rng(3)
    texts = []
    for k in range(60):
        words = (ENGLISH, SPANISH)[k % 2].split()
        texts.append(" ".join(f"{words[i]} {words[i]}x{k}" for i in rng.integers(0, len(words), 12)))
    apart = [model.predict([x])[0] for x in texts]
    assert {x[0] for x in apart} == {"en", "es"}
    small = language_id.Crf(model.languages, model.weights, model.transition, model.lexicons, cache_words=40)
    for tool in (model, small):
        got = tool.predict(texts)
        assert [x[0] for x in got] == [x[0] for x in apart]
        assert np.allclose([x[1] for x in got], [x[1] for x in apart], atol=1e-5)


@pytest.mark.parametrize("texts", [["the"] * 10_000, [f"{ENGLISH} {SPANISH} " * 25] * 200], ids=["short", "prose"])
def test_memory_of_a_slice_is_bounded(model, texts):
    model.predict(texts[:10])
    tracemalloc.start()
    try:
        assert len(model.predict(texts)) == len(texts)
        assert tracemalloc.get_traced_memory()[1] < 12e6
    finally:
        tracemalloc.stop()


def test_packing_plan_needs_no_python_worker(spark):
    rows = spark.range(50).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), (F.col("id") * 40 + 1).alias("length"))
    packed = packing.pack(rows)
    plan = packed._jdf.queryExecution().toString()
    assert "LocalRelation" in plan and "LogicalRDD [_length" not in plan
    got = packed.collect()
    assert len(got) == 50 and len({(r.sequence_id, r.offset) for r in got}) == 50
    assert packing.pack(rows.limit(0)).count() == 0
