import random
from itertools import combinations

import pytest
import xxhash

from lexiloom.llm import common, simhash
from lexiloom.llm.common import connected_components


def brute_fp(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    out = {i: i for i in fps}

    def find(x):
        while out[x] != x:
            x = out[x]
        return x

    for a, b in combinations(fps, 2):
        if (fps[a] ^ fps[b]).bit_count() <= 2:
            a, b = find(a), find(b)
            out[max(a, b)] = min(a, b)
    return {i: find(i) for i in fps}


def test_fingerprints_and_components(spark):
    rng = random.Random(2)
    texts = {i: " ".join(rng.choice("ab cd ef gh Ij é".split()) for _ in range(rng.randint(0, 5))) for i in range(150)}
    texts |= {200: None, 201: "", 202: "one", 203: "ONE", 204: texts[3]}
    rows = [(i, t, "x", "y") for i, t in texts.items()] + [(3, texts[3], "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, node string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.components(df).collect()}
    fps = {i: brute_fp(t) for i, t in texts.items()}
    want = brute_components(fps)
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in texts}


@pytest.mark.parametrize("light", [128, 1])
def test_close_pairs_connect_what_brute_force_connects(spark, light):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = set(base)
    for b in base:
        for _ in range(14):
            fps.add(b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 3))))
    fps |= {0, 1 << 63, (1 << 63) | 1}
    signed = {x: x - (1 << 64) if x >> 63 else x for x in fps}
    df = spark.createDataFrame([(x,) for x in signed.values()], "fp long")
    edges = simhash.close_pairs(df, light=light)
    for u, v in edges.collect():
        assert ((u ^ v) & (1 << 64) - 1).bit_count() <= 2
    got = {r.node: r.root for r in connected_components(edges).collect()}
    want = brute_components({s: x for x, s in signed.items()})
    groups = lambda m: {frozenset(k for k in signed.values() if m.get(k, k) == r) for r in set(m.get(k, k) for k in signed.values())}
    assert groups(got) == groups(want)


def test_blocks_leave_one_whole():
    blocks = simhash.covering_blocks(8, 2, 5)
    assert all(any(not set(gone) & set(b) for b in blocks) for gone in combinations(range(8), 2))


def test_long_text_in_blocks(monkeypatch):
    rng = random.Random(1)
    text = " ".join(rng.choice("abcdefg") for _ in range(500)).encode()
    whole = simhash.fingerprint64(text)
    monkeypatch.setattr(simhash, "BLOCK_WORDS", 37)
    assert simhash.fingerprint64(text) == whole == brute_fp(text.decode())


@pytest.mark.parametrize("light", [24, 1])
def test_similar_groups_against_all_pairs(spark, light):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    texts = {}
    for g in range(8):
        base = [rng.choice(words) for _ in range(rng.randint(60, 300))]
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts[len(texts)] = " ".join(copy)
    texts |= {len(texts) + k: " ".join(rng.choice(words) for _ in range(80)) for k in range(20)}
    texts |= {900: "", 901: None, 902: "  "}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(df, light=light).collect()}
    sets = {i: set(simhash.shingle_set((t or "").encode(), 5).tolist()) for i, t in texts.items()}
    want = {i: i for i in texts}
    for a, b in combinations(sorted(texts), 2):
        if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            assert got[a] == got[b]
            for i in [i for i in want if want[i] == want[b]]:
                want[i] = want[a]
    assert len(set(got.values())) == len(set(want.values()))
    kept = simhash.drop_near_duplicates(df)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({min(j for j in got if got[j] == got[i]) for i in got})


def test_repeated_ids_and_empty_table(spark):
    text = " ".join(f"word{k}" for k in range(40))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (None, "other words here now again")], "doc_id long, text string")
    assert simhash.drop_near_duplicates(df).count() == 2
    assert simhash.drop_near_duplicates(df.limit(0)).count() == 0
    assert simhash.components(df.limit(0)).count() == 0


def check_groups(spark, texts, **options):
    """Against all pairs; returns how many documents are in the group of another."""
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(df, **options).collect()}
    sets = {i: set(simhash.shingle_set(t.encode(), 5).tolist()) for i, t in texts.items()}
    want = {i: i for i in texts}
    for a, b in combinations(sorted(texts), 2):
        if want[a] != want[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            old, new = max(want[a], want[b]), min(want[a], want[b])
            want = {i: new if r == old else r for i, r in want.items()}
    assert got == want
    return sum(i != r for i, r in want.items())


def test_appended_and_truncated_copies(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9)))
    texts = {}
    for g in range(40):
        base = [word() for _ in range(rng.randint(60, 300))]
        n = len(base)
        longer = base + [word() for _ in range(int(n * rng.uniform(0.15, 0.24)))]
        shorter = base[: int(n * rng.uniform(0.82, 0.9))]
        for k, copy in enumerate((base, longer if g % 2 else shorter)):
            texts[2 * g + k] = " ".join(copy)
    assert check_groups(spark, texts) == 40


def test_smaller_family_in_long_postings(spark):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(200)]
    other = base[:130] + [f"x{k}" for k in range(70)]  # shares postings with the base, under 0.8 to it
    texts = {}
    for k in range(60):
        copy = list(base if k % 3 else other)
        for _ in range(3):
            copy[rng.randrange(len(copy))] = f"y{rng.random()}"
        texts[k] = " ".join(copy)
    assert check_groups(spark, texts, light=4, leaders=1) > 20


def test_same_lines_in_another_order(spark):
    lines = [" ".join(f"w{k}x{j}" for j in range(8)) for k in range(12)]
    turned = random.Random(1).sample(lines, len(lines))
    texts = {0: " ".join(lines), 1: " ".join(turned), 2: " ".join([*turned, turned[-1]]), 3: " ".join([*turned, "tail of other words"])}
    assert check_groups(spark, texts) == 2


@pytest.mark.parametrize("one_task", [0, 1000])
def test_components_of_a_graph(spark, one_task):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(k, k + 1) for k in range(300, 420)] + [(500, 500), (501, 500), (500, 501)]
    edges += [(600, k) for k in range(601, 640)]
    root = {x: x for e in edges for x in e}
    for _ in range(500):
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    want = {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}
    rows = common.connected_components(spark.createDataFrame([*edges, (None, 3)], "u long, v long"), one_task=one_task).collect()
    assert len(rows) == len(want) and {r.node: r.root for r in rows} == want


def test_groups_come_through_the_fingerprints(spark, monkeypatch):
    """Near copies with close fingerprints are candidates of the SimHash index, and the prefix filter only adds to them."""
    rng = random.Random(8)
    base = [" ".join(f"w{rng.randrange(4000)}" for _ in range(400)) for _ in range(12)]
    texts = dict(enumerate(base)) | {100 + k: x + " end" for k, x in enumerate(base)}
    prints = {i: simhash.set_fingerprint(simhash.shingle_set(t.encode(), 5)) for i, t in texts.items()}
    close = {(i, j) for i, j in combinations(sorted(texts), 2) if ((prints[i] ^ prints[j]) & (1 << 64) - 1).bit_count() <= 2}
    seen = []
    plain = simhash.simhash_pairs
    monkeypatch.setattr(simhash, "simhash_pairs", lambda *a: seen.append(plain(*a)) or seen[-1])
    assert check_groups(spark, texts) == 12
    assert {(r.a, r.b) for r in seen[0].collect()} == close and len(close) >= 10
