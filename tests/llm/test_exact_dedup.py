import hashlib
import re

import pytest

from lexiloom.llm import exact_dedup


@pytest.mark.parametrize("heavy", [64, 2])
def test_against_brute_force(spark, heavy):
    texts = ["a b", "a  b", "a\tb", "a\n\x0bb", "ab", "", None, " ", "x" * 5000, "é  é", "é é", "a b"] + ["hot text"] * 40
    rows = [(100 - i, t, "keep", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, group_size int")
    got = {r.doc_id: tuple(r) for r in exact_dedup.groups(df, heavy_rows=heavy).collect()}
    norm = {i: re.sub("[\x20\x09-\x0d]+", " ", t or "") for i, t, *_ in rows}
    for i, n in norm.items():
        same = [j for j in norm if norm[j] == n]
        assert got[i] == (i, min(same), len(same), i == min(same), hashlib.sha256(n.encode()).hexdigest())
    kept = exact_dedup.deduplicate(df, heavy_rows=heavy)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i in got if got[i][3])


@pytest.mark.parametrize("heavy", [64, 2])
def test_repeated_rows_and_null_ids(spark, heavy):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b")], "doc_id long, text string")
    rows = exact_dedup.groups(df, heavy_rows=heavy).collect()
    assert sum(r.kept for r in rows) == 2 and exact_dedup.deduplicate(df, heavy_rows=heavy).count() == 2
    assert exact_dedup.groups(df.limit(0)).count() == 0
