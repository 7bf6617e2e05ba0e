import bisect
import json
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lexiloom.llm import packing, wavelet
from lexiloom.llm.encoding import WordwiseEncoder
from lexiloom.llm.queries import vocabulary

ODD = [
    "it's  we'll I'M don't 12 345²½ x y z 　q  \n\n a\tb\x1cc İSTANBUL ΣΑΣ ß ﬁ éa <|endoftext|> hi\n",
    "  lead", "trail ", "a\n b", " \n ", "\n", "日本語 テキスト 한국어", "ÀÉ×÷ éàßç's", "chßbe", "", "x" * 3000,
    "hello <|endoftext|> world", "<|startoftext|>a <|ENDOFTEXT|> <|endoftext|><|endoftext|>x  <|endoftext|>", "DB it's It'S x 's  'll", " 're y ,.; É's",
]


def texts():
    rng = random.Random(1)
    return ODD + ["".join(rng.choice("ab é\n .,'stIS12\t 日Σ×ß") for _ in range(200)) for _ in range(100)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("limits", [(500_000, 1_000_000), (50, 64)])
def test_encoding_is_that_of_the_library(name, limits):
    enc, library = WordwiseEncoder(vocabulary(name), *limits), Tokenizer.from_file(vocabulary(name))
    assert enc.mode != "whole"
    for t in texts():
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == want, t
    plain = WordwiseEncoder(vocabulary(name), *limits, special_as_text=True)
    library.encode_special_tokens = True
    for t in texts()[:20]:
        assert np.frombuffer(plain.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_caches_are_bounded_and_other_tokenizers_go_whole(tmp_path):
    enc = WordwiseEncoder(vocabulary("byte_bpe_50k.json"), 100)
    enc.encode(" ".join(f"w{k}" for k in range(5000)) + " " + "x" * 100_000 + "  ")
    for cache in (enc.first, enc.rest):
        assert len(cache) <= 100 and all(len(x) <= enc.LONGEST for x in cache)
    assert all(len(x) <= enc.LONGEST + 1 for x in enc.tokens)
    enc.forget()
    assert not enc.first and not enc.rest and not enc.tokens
    spec = json.load(open(vocabulary("word_bpe_49k.json"), encoding="utf-8"))
    spec["normalizer"]["normalizers"].pop()
    (tmp_path / "cased.json").write_text(json.dumps(spec))
    other, library = WordwiseEncoder(str(tmp_path / "cased.json")), Tokenizer.from_file(str(tmp_path / "cased.json"))
    assert other.mode == "whole"
    for t in texts()[:10]:
        assert np.frombuffer(other.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_wavelet_matrix_operations():
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 511, 512, 513, 3000):
        ids = rng.integers(0, 37, n).astype(np.uint32)
        m = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids, 16).to_bytes())
        assert (m.decode() == ids).all()
        for i in range(0, n, 97):
            assert m.access(i) == ids[i]
        for s in (0, 5, 36, 40, 1 << 20):
            where = np.flatnonzero(ids == s).tolist()
            assert m.count(s) == len(where) and list(m.occurrences(s)) == where
            lo, hi = n // 3, n - n // 5
            assert list(m.occurrences(s, lo, hi)) == [k for k in where if lo <= k < hi]
            if where:
                assert m.select(s, len(where) - 1) == where[-1]
    with pytest.raises(ValueError):
        wavelet.WaveletMatrix.build(np.array([1 << 16], np.uint32), 16)


def test_shards_round_trip(spark, tmp_path):
    enc = WordwiseEncoder(vocabulary("word_bpe_49k.json"))
    rows = [(7 * i % 111, t, "s") for i, t in enumerate(texts())] + [(500, None, "s"), (None, "none", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    wavelet.write_shards(df, str(tmp_path / "w"), vocabulary("word_bpe_49k.json"), shard_tokens=500)
    got = wavelet.shard_documents(wavelet.read_shards(spark, str(tmp_path / "w"))).collect()
    start, want = 0, []
    for i, t, _ in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], (r[1] or "").encode())):
        raw = enc.encode(t or "") + (1).to_bytes(4, "little")
        want.append((i, start, len(raw) // 4, zlib.crc32(raw)))
        start += len(raw) // 4
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert wavelet.token_file_digest(df.limit(0), vocabulary("word_bpe_49k.json")).count() == 0


def best_fit_decreasing(lengths, capacity):
    gaps = []  # one document after the other, longest first, each into the smallest gap that holds it
    for length in sorted(lengths, reverse=True):
        k = bisect.bisect_left(gaps, length)
        bisect.insort(gaps, (gaps.pop(k) if k < len(gaps) else capacity) - length)
    return len(gaps)


def test_sweep_takes_the_smallest_gap_that_holds():
    # 9 leaves 7 and 7 of 16; 8 opens a sequence; 6 goes into a 7 (not the 8), then into the other 7; 5 into the 8; 3 beside it
    assert packing.sweep({9: 2, 8: 1, 6: 2, 5: 1, 3: 1}, 16) == [
        (9, 0, 2, 0, 1, 0), (8, 2, 3, 2, 2, 0), (6, 3, 5, 0, 1, 9), (5, 5, 6, 2, 1, 8), (3, 6, 7, 2, 1, 13),
    ]
    assert packing.sweep({4: 5}, 9) == [(4, 0, 5, 0, 2, 0)]
    assert packing.sweep({}, 9) == []


@pytest.mark.parametrize("draw", [
    lambda rng: int(rng.expovariate(1 / 300)) + 1,
    lambda rng: rng.randint(1, 300),
    lambda rng: int(rng.lognormvariate(5.3, 1)) + 1,
    lambda rng: rng.choice((1, 2, 3, 700, 1025, 2048)),
])
def test_sweep_against_best_fit_decreasing(draw):
    rng = random.Random(11)
    lengths = [min(2048, draw(rng)) for _ in range(20_000)]
    counts = {}
    for n in lengths:
        counts[n] = counts.get(n, 0) + 1
    plan = packing.sweep(counts, 2048)
    ends = {}
    at = 0
    for length, low, high, sequence, each, place in plan:
        assert low == at and length * each <= 2048 - place
        at = high
        for r in range(high - low):
            spot = sequence + r // each
            assert ends.get(spot, 0) == place + r % each * length  # gapless
            ends[spot] = ends.get(spot, 0) + length
    assert at == len(lengths) and max(ends.values()) <= 2048 and sorted(ends) == list(range(len(ends)))
    assert len(ends) == best_fit_decreasing(lengths, 2048)


@pytest.mark.parametrize("capacity,lengths", [
    (16, [1, 16, 8, 8, 9, 7, 3, 3, 3, 3, 3, 5, 11]),
    (64, [random.Random(k).randint(1, 64) for k in range(400)]),
    (100, [20] * 300 + [34] * 50 + [51, 49, 1]),
    (64, [random.Random(k).choice((1, 2, 3, 30)) for k in range(300)]),
    (7, [7, 7, 1]),
])
def test_rounds_pack_like_best_fit_decreasing(spark, capacity, lengths):
    rows = [(k // 3, k % 3, n, "x", "y") for k, n in enumerate(lengths)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, length int, slot string, _rank_ string").repartition(3)
    got = packing.pack(df, capacity).collect()
    assert sorted((r.doc_id, r.piece, r.length) for r in got) == sorted(x[:3] for x in rows)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(sequences) == best_fit_decreasing(lengths, capacity)


def test_packing_documents(spark):
    enc = WordwiseEncoder(vocabulary("byte_bpe_50k.json"))
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("ab cde fgh the of".split()) for _ in range(rng.randint(0, 300))), 1) for i in range(80)]
    rows += [(100, None, 1), (101, "word " * 5000, 1), (102, "", 1), (102, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, offset int").repartition(3)
    got = packing.pack_documents(df, vocabulary("byte_bpe_50k.json")).collect()
    want = []
    for i, t, _ in rows:
        raw = enc.encode(t or "") + bytes(4)
        for k, (a, n) in enumerate(packing.cut_points(len(raw) // 4, 2048)):
            want.append((i, k, a, n, zlib.crc32(raw[4 * a : 4 * (a + n)])))
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.cut_points(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)]
    assert packing.cut_points(4096, 2048) == [(0, 2048), (2048, 2048)]
    assert packing.pack_documents(df.limit(0), vocabulary("byte_bpe_50k.json")).count() == 0
