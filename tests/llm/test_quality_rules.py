import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from lexiloom.llm import quality_rules as q

SCHEMA = "doc_id long, text string, lang string, source string, kept string, bin int"


def brute_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(w, w[1:], w[2:]))
    hit = {j for i, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), seen, len(hit)


TEXTS = [
    "", None, " \n\t", "a", "a b c a b c d", "a a a a", "x y z\nx y z\n x y z\n\nx y z", "日本語 é 𝒳 y z\x0bq\x1cr", "# $5 <b>|&%* #",
    "one two three " * 3 + "four", "line\r\nline\r\nother", "a b\n" * 30_000,
]


def test_counts_against_brute_force(spark):
    df = spark.createDataFrame([(i, t, "en", "s", "", 0) for i, t in enumerate(TEXTS)], SCHEMA)
    got = {r["doc_id"]: tuple(r[c] for c in q.COUNTS) for r in q.document_counts(df, "doc_id").collect()}
    for i, t in enumerate(TEXTS[:-1]):
        assert got[i] == brute_counts(t), t
    assert got[len(TEXTS) - 1] == (60_000, 60_000, 0, 30_000, 29_999, 60_000)


def test_sketch_error_and_merging(spark):
    rng = np.random.default_rng(4)
    values = np.concatenate([np.zeros(200, int), rng.lognormal(3, 2, 3000).astype(int)])
    rows = [("abc"[i % 3], int(v), 7) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "lang string, word_chars long, n_words long")
    df = df.selectExpr("*", "0L n_symbols", "0L n_dup_lines", "0L n_lines", "0L n_repeat_words")
    whole, parts = q.sketches(df), q.merged(q.sketches(df, "lang"))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))
    shares = (0.0, 0.01, 0.1, 0.5, 0.9, 0.99, 1.0)
    got = q.quantiles(whole, [], *shares).where("measure = 'chars_a_word'").first()
    exact = np.quantile(values / 7, shares, method="lower")
    assert [got[f"q{i}"] for i in range(len(shares))] == pytest.approx(exact.tolist(), rel=1.01 * q.ACCURACY)
    assert q.quantiles(whole, [], 0.5).where("measure = 'duplicate_lines'").count() == 0  # nothing to divide by


def made_corpus():
    rng = np.random.default_rng(9)
    word = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    prose = lambda n: " ".join(word(int(k)) for k in rng.integers(2, 8, n))
    rows = []
    for lang, source, n in (("en", "hot", 150), ("en", None, 60), (None, "a", 8), ("de", "b", 3)):
        for i in range(n):
            text = prose(80)
            if i % 4 == 3:
                text = text.replace(" ", "$$ ") if i % 8 == 3 else text.replace(" ", "_" + word(9) + " ")
            rows.append((len(rows), text, lang, source, "", 0))
    return [*rows, (900, None, "en", "hot", "", 0), (901, "short", "en", "hot", "", 0), (902, "a b c " * 40, None, None, "", 0), rows[3], rows[0]]


def test_verdict_against_sql_and_by_shuffle(spark):
    rows = made_corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, q.judge(df).select("doc_id", *[c for c in q.COUNTS if c != "n_lines"], "base_failed", "kept").collect()))
    import pandas as pd

    documents = pd.DataFrame([r[:4] for r in rows], columns=["doc_id", "text", "lang", "source"])  # noqa: F841
    want = duckdb.sql(q.ORACLE_SQL).fetchall()
    assert got == sorted(want)
    kept = {r[0]: r[-1] for r in got}
    assert all(kept[i] == (i not in (900, 901, 902) and not _junk(rows, i)) for i in kept)
    salted = q.judge(df, broadcast_groups=0).select("doc_id", "kept").collect()
    assert sorted(map(tuple, salted)) == sorted((r[0], r[-1]) for r in got)
    good = q.keep_good(df)
    assert good.columns == df.columns and sorted(r["doc_id"] for r in good.collect()) == sorted(r[0] for r in got if r[-1])


def _junk(rows, i):
    text = next(r[1] for r in rows if r[0] == i)
    return "$$" in text or "_" in text


def test_empty_table_and_only_failures(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert q.judge(none).collect() == [] and q.keep_good(none).collect() == []
    short = spark.createDataFrame([(1, "x", "en", "s", "", 0), (2, None, None, None, "", 0)], SCHEMA)
    assert [r["kept"] for r in q.judge(short).collect()] == [False, False]
