import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lexiloom.llm.suffix_dedup import Segmenter, SuffixLevels, digest, merge_spans, remove_repeats, sliding_min, suffix_order

SCHEMA = "doc_id long, text string, start string, spans int"


def brute(rows, window):
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(r[k : k + window] for _, r in raws for k in range(len(r) - window + 1))
    out = []
    for i, r in raws:
        mask = bytearray(len(r))
        for k in range(len(r) - window + 1):
            if seen[r[k : k + window]] > 1:
                mask[k : k + window] = b"\x01" * window
        kept = bytes(b for b, m in zip(r, mask) if not m)
        runs = sum(1 for k, m in enumerate(mask) if m and (k == 0 or not mask[k - 1]))
        out.append((i, len(r), sum(mask), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(60) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [text(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, 60)
            parts += [s[a : a + rng.randint(150, 400)], text(rng.randint(0, 30))]
        rows.append((i, " ".join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, rows[5][1] + "x"), (103, None), (104, ""), (105, "a" * 900)]
    return rows


@pytest.mark.parametrize("per_task", [20_000, 5])
def test_matches_brute_force(spark, per_task):
    rows = corpus(1)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(3)
    got = digest(remove_repeats(df, contents_per_task=per_task)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 200)


def test_repeated_and_null_ids_and_empty_table(spark):
    rows = [(1, "ab " * 100), (1, "ab " * 100), (None, "q" * 250), (None, "z" * 199), (2, None)]
    df = spark.createDataFrame([(i, t, None, None) for i, t in rows], SCHEMA)
    got = digest(remove_repeats(df)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 200)
    assert digest(remove_repeats(df.limit(0))).count() == 0


def test_long_text_in_blocks():
    rng = random.Random(5)
    raw = bytes(rng.choice(b"abcdef ") for _ in range(9000))
    parts = Segmenter(200, 32, block=1500).segments(raw)
    assert parts[3].sum() == len(raw) - 199 and (np.diff(parts[2]) == parts[3][:-1]).all()


@pytest.mark.parametrize("window", [3, 8, 20, 24, 200])
def test_suffix_order_is_that_of_the_bytes(window):
    rng = random.Random(window)
    raw = bytes(rng.choice(b"ab\x00") for _ in range(500)) + b"ab" * 200 + bytes(300) + bytes(rng.randbytes(300))
    places = np.array([k for k in range(len(raw) - window + 1) if k % 7])
    order, new = suffix_order(np.frombuffer(raw, np.uint8), places, window)
    windows = [raw[k : k + window] for k in places[order]]
    assert windows == sorted(windows)
    assert new.tolist() == [True] + [x != y for x, y in zip(windows, windows[1:])]


@pytest.mark.parametrize("chunk", [4, 1 << 14])
def test_levels_against_counts(chunk):
    rng = random.Random(0)
    levels, seen = SuffixLevels(9), []
    levels.CHUNK = chunk
    for n in (1, 50, 3, 200, 0, 70, 400):
        raw = bytes(rng.choice(b"ab\x00") for _ in range(n + 8))
        places = np.arange(n)
        seen += [raw[k : k + 9] for k in places]
        levels.add(np.frombuffer(raw, np.uint8), places)
    count = Counter(seen)
    assert levels.repeated.tolist() == [count[x] > 1 for x in seen]
    sizes = [len(x[0]) for x in levels.levels]
    assert all(2 * b < a for a, b in zip(sizes, sizes[1:])) and sum(sizes) == len(count)
    for place, number in levels.levels:
        entries = [levels.text[k : k + 9].tobytes() for k in place]
        assert entries == sorted(entries) and entries == [seen[k] for k in number]


def test_small_parts():
    x = np.array([5, 3, 8, 1, 9, 2, 7], np.uint64)
    assert sliding_min(x, 3).tolist() == [3, 1, 1, 1, 2]
    assert merge_spans([(5, 9), (0, 3), (3, 5), (11, 12)]) == [(0, 9), (11, 12)]
