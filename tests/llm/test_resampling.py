import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from lexiloom.llm import resampling

SCHEMA = "doc_id long, text string, score string, rank int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, runs):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return w, [zlib.crc32(" ".join(w[i : i + k]).encode()) for k in range(1, runs + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, runs, buckets, share=10, least=20):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(f % buckets for f in features(text, runs)[1])
    for text in target:
        t.update(f % buckets for f in features(text, runs)[1])
    ss, tt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets))))
    out = []
    for i, text in docs:
        w, f = features(text, runs)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(x % buckets) for x in f)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)))
    enough = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0]))
    rank = {}
    for k, x in enumerate(enough[: share * len(enough) // 100], 1):
        rank.setdefault(x, []).append(k)
    return sorted((*x[:4], r) for x in out for r in [rank[x].pop(0) if rank.get(x) else None]) if None not in [x[0] for x in out] else (out, rank)


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()]


@pytest.mark.parametrize("runs,buckets", [(1, 10_000), (3, 500), (2, 70_000)])
def test_against_brute_force(spark, runs, buckets):
    import random

    rng = random.Random(runs)
    words = ["Alpha", "beta", "Éa", "x1", "ÀÉ", "tau-tau", "日本語", "don't", "7", "_", "."]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 60)))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, "!!! ..."), (203, "lone"), (204, "beta " * 50_000), (7, docs[7][1])]
    target = ["beta x1 日本語", None, "Éa beta", ""]
    df = spark.createDataFrame([(*d, "s", 1) for d in docs], SCHEMA).repartition(5)
    got = rows_of(resampling.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), runs, buckets))
    assert sorted(got, key=str) == sorted(brute(docs, target, runs, buckets), key=str)


def test_ties_nulls_and_empty_tables(spark):
    text = "one two three four five six seven eight nine ten " * 2
    docs = spark.createDataFrame([(5, text, "", 1)] * 30 + [(None, text, "", 1)] * 3, SCHEMA)
    empty = spark.createDataFrame([], "text string")
    got = rows_of(resampling.resample(docs, empty, share=50))
    assert len(got) == 33 and sorted(r[4] for r in got if r[4]) == list(range(1, 17))
    assert {r[1] for r in got} == {20}
    assert rows_of(resampling.resample(docs.limit(0), empty)) == []
    assert rows_of(resampling.resample(docs.limit(0), docs.select("text"))) == []


def test_ring_takes_one_step_a_run():
    tokens = [b"a", b"bb", b"c", b"dd"]
    got = list(resampling.run_states(tokens, 3))
    want = [zlib.crc32(b" ".join(tokens[max(0, e - k) : e])) for e in range(1, 5) for k in range(min(3, e), 0, -1)]
    assert got == want
