"""Benchmark decontamination by spaced-seed hashing (operator 7).

Fixed masks of ones and zeros pass over the words of benchmark items and documents; a seed is the hash of
the words under the ones, so that a word changed under a zero leaves it as it was. Seeds of both
sides are joined, and around every hit the two texts are laid over each other on the hit's diagonal: a
stretch that agrees in enough words, substitutions allowed, is a leak.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import stored, text_bytes, tidy, unused

# fixed values: the masks for items of LONG words and more (weight 6), and for shorter ones (weight 4)
MASKS = ("111111", "1101101011", "11011000111", "1010110010101", "1110010011001")
LIGHT = ("1111", "11011", "10111", "11101")
#: Items of SHORTEST to WEIGHT - 1 words are looked for as a whole; those of WEIGHT to LONG - 1 by the light masks.
SHORTEST, WEIGHT, LONG = 3, 6, 16
#: Items that a region is laid over in one row.
ITEMS = 256
_SPLIT = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))
#: Words handled at once.
SLICE_WORDS = 1 << 20


def words_of(raw: bytes) -> list[bytes]:
    """Lower-cased words; ASCII punctuation separates them."""
    return raw.decode("utf-8", "replace").lower().encode().translate(_SPLIT).split()


def word_hashes(words) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64)


def seed_hashes(tokens: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """Hash of the words under the mask's ones, for every place where the mask fits."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, 0x9E3779B97F4A7C15 * (salt + 1) & (1 << 64) - 1, np.uint64)
    for k, one in enumerate(mask):
        if one == "1":
            h = (h ^ tokens[k : k + n]) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(31)
    return h


def masks_of(n_words: int) -> list[tuple[int, str]]:
    """(number, mask) of the masks that an item of so many words is looked for by.

    Of a leak by the default rule (see find_leaks) in an item of 7 to 15 words, every stretch has 1111 or 11011 in its agreeing words: it has at most two changed words, so that
    four agree in a row, or else runs of two and more stand on both sides of a changed one. In a six-word item four of five may agree as 10111 or 11101 too.
    """
    if n_words < SHORTEST:
        return []
    if n_words < WEIGHT:
        return [(len(MASKS) + len(LIGHT) + n_words, "1" * n_words)]
    if n_words < LONG:
        return [(len(MASKS) + k, m) for k, m in enumerate(LIGHT[: 4 if n_words == WEIGHT else 2])]
    return list(enumerate(MASKS))


def item_seeds(tokens: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(mask number, seeds) of an item."""
    for m, mask in masks_of(len(tokens)):
        yield m, seed_hashes(tokens, mask, m)


def agreeing_words(doc: np.ndarray, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """For each item (a part of ``flat``) how many of its words agree with the document's at its shift; all items at once."""
    ends = np.cumsum(lengths)
    step = np.arange(ends[-1])
    begin = ends - lengths
    place = step + np.repeat(shifts - begin, lengths)
    inside = (place >= 0) & (place < len(doc))
    same = inside & (doc[np.where(inside, place, 0)] == flat[step + np.repeat(starts - begin, lengths)])
    return np.add.reduceat(same, begin, dtype=np.int64)


class Sieve:
    """Membership in a sorted array of hashes, behind a small bitmap."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.map = np.zeros(1 << 22, bool)
        self.map[hashes >> np.uint64(42)] = True

    def hits(self, h: np.ndarray) -> np.ndarray:
        """Places whose hash is a member."""
        near = np.flatnonzero(self.map[h >> np.uint64(42)])
        if not len(self.hashes) or not len(near):
            return near[:0]
        k = np.minimum(np.searchsorted(self.hashes, h[near]), len(self.hashes) - 1)
        return near[self.hashes[k] == h[near]]


def best_overlap(doc: np.ndarray, item: np.ndarray, shift: int, identity: float = 0.8) -> tuple[int, int, int]:
    """(first item word, words, agreeing words) of the best stretch with doc[k + shift] over item[k].

    Best: the most agreeing words of all stretches at the identity or more, then the fewest words,
    then the first. Without an agreeing word, no words.
    """
    a, b = max(0, -shift), min(len(item), len(doc) - shift)
    if a >= b:
        return a, 0, 0
    same = doc[a + shift : b + shift] == item[a:b]
    ends = np.flatnonzero(same) + 1
    if not len(ends):
        return a, 0, 0
    # whole numbers, so that an identity met exactly counts; a stretch counts if its sum isn't negative
    part = Fraction(identity).limit_denominator(10**6)
    gain = np.where(same, part.denominator - part.numerator, -part.numerator)
    total = np.concatenate([[0], np.cumsum(gain)])
    agreed = np.concatenate([[0], np.cumsum(same)])
    low = np.minimum.accumulate(total)
    # the first place from which the sum up to an end isn't negative; the stretch begins at the next agreeing word
    first = np.searchsorted(-low, -total[ends])
    start = ends[agreed[first]] - 1
    agree = agreed[ends] - agreed[first]
    k = int(np.lexsort((start, ends - start, -agree))[0])
    return a + int(start[k]), int(ends[k] - start[k]), int(agree[k])


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    least_words: int = 12,
    least_identity: float = 0.8,
    least_share: float = 0.6,
    broadcast_seeds: int = 2_000_000,
    key=None,
) -> DataFrame:
    """doc_id, item_id, doc_start, n_words, n_agree, item_words: benchmark items that documents hold.

    A leak is a stretch of at least min(least_words, least_share of the item's words) words that
    agree, with an identity of least_identity or more; of several, the longest is told. Whole
    texts are scanned. Items of three to five words leak where they stand as a whole, without a
    change; items of one or two words tell nothing and don't leak. Only diagonals that share a seed are looked at. With the default rule that misses nothing in items of
    up to 15 words (see masks_of); in longer ones, which have heavier masks, a leak whose agreeing words are scattered past every mask can be missed (the tests measure it). Null texts count as empty; null ids are kept as they are; repeated rows and ids give one row a pair of
    ids; other columns are ignored; an empty table on either side gives an empty result.

    Seeds of the benchmark are broadcast as a sieve if there are at most ``broadcast_seeds`` (8 bytes
    each); beyond that all seeds of the documents take part in the join. Both ways find the same.
    key: a column to report in place of doc_id.
    """
    spark = docs.sparkSession
    ship_package(spark)

    def seeds_of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tokens, seeds = [], [], []
            for item_id, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                toks = word_hashes(words_of(raw.as_py()))
                ids.append(item_id)
                tokens.append(toks.view(np.int64))
                seeds.append(
                    [
                        {"hash": int(h), "at": k}
                        for _, seeds_ in item_seeds(toks)
                        for k, h in enumerate(seeds_.view(np.int64))
                    ]
                )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(tokens, pa.list_(pa.int64())),
                    pa.array(seeds, pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int32())]))),
                ],
                names=["item_id", "item", "seeds"],
            )

    items = benchmark.select(F.col("item_id").cast("long"), text_bytes().alias("raw")).distinct()
    items = items.mapInArrow(tidy(seeds_of_items), "item_id long, item array<long>, seeds array<struct<hash:long,at:int>>")
    items = stored(items.select(F.xxhash64("item_id", "item").alias("item_key"), "*"), "items", benchmark.count())
    seeds = items.select("item_key", F.explode("seeds").alias("s")).select("item_key", "s.hash", "s.at")
    sieve = None
    if seeds.count() <= broadcast_seeds:
        known = seeds.select("hash").distinct().toPandas()["hash"].to_numpy(np.int64, copy=True)
        sieve = spark.sparkContext.broadcast(np.sort(known.view(np.uint64)))
    reach = items.agg(F.coalesce(F.max(F.size("item")), F.lit(0))).first()[0]
    sizes = items.select(F.least(F.size("item"), F.lit(LONG))).distinct().collect()  # LONG + 1 numbers at most
    masks = sorted({m for r in sizes for m in masks_of(r[0])})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Sieve(sieve.value) if sieve else None
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, size = [], 0
                names = []
                while at < batch.num_rows and (not texts or size < SLICE_WORDS):
                    texts.append(words_of(batch.column(1)[at].as_py()))
                    names.append(batch.column(0)[at].as_py())
                    size += len(texts[-1])
                    at += 1
                lengths = np.array([len(x) for x in texts])
                ends = np.cumsum(lengths)
                tokens = word_hashes(chain.from_iterable(texts))
                found: list[np.ndarray] = [np.zeros(0, np.int64)]
                hashes: list[np.ndarray] = [np.zeros(0, np.uint64)]
                for m, mask in masks:
                    h = seed_hashes(tokens, mask, m)
                    hit = tool.hits(h) if tool else np.arange(len(h))
                    doc = np.searchsorted(ends, hit, side="right")
                    inside = hit + len(mask) <= ends[doc]
                    found.append(hit[inside])
                    hashes.append(h[hit[inside]])
                where, what = np.concatenate(found), np.concatenate(hashes)
                order = np.argsort(where, kind="stable")
                yield regions(names, tokens, ends - lengths, ends, where[order], what[order])

    def regions(names, tokens, starts, ends, where, what) -> pa.RecordBatch:
        """Hits no further apart than an item is long share a stretch of the document."""
        doc = np.searchsorted(ends, where, side="right")
        fresh = np.ones(len(where), bool)
        fresh[1:] = (doc[1:] != doc[:-1]) | (np.diff(where) > 2 * reach)
        firsts = np.flatnonzero(fresh)
        lasts = np.concatenate([firsts[1:], [len(where)]]) if len(firsts) else firsts
        out: list[list] = [[], [], [], []]
        for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True):
            d = int(doc[a])
            begin = max(int(starts[d]), int(where[a]) - reach)
            stop = min(int(ends[d]), int(where[b - 1]) + reach)
            out[0].append(names[d])
            out[1].append(begin - int(starts[d]))
            out[2].append(tokens[begin:stop].view(np.int64))
            out[3].append([{"hash": h, "at": w} for h, w in zip(what[a:b].view(np.int64).tolist(), (where[a:b] - begin).tolist(), strict=True)])
        kinds = (name_kind, pa.int64(), pa.list_(pa.int64()), pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int32())])))
        return pa.RecordBatch.from_arrays(
            [pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["name", "first", "words", "hits"]
        )

    name = F.col("doc_id").cast("long") if key is None else key
    name_kind, name_type = (pa.int64(), "long") if key is None else (pa.string(), "string")
    scanned = docs.select(name.alias("name"), text_bytes().alias("raw")).mapInArrow(
        tidy(scan), f"name {name_type}, first long, words array<long>, hits array<struct<hash:long,at:int>>"
    )
    places = stored(scanned.select(F.monotonically_increasing_id().alias("region"), "*"), "regions")
    hits = places.select("region", F.explode("hits").alias("h")).select("region", "h.hash", F.col("h.at").alias("doc_at"))
    diagonals = (
        hits.join(seeds, "hash").select("region", "item_key", (F.col("doc_at") - F.col("at")).alias("shift")).distinct()
    )
    found = f"name {name_type}, item_id long, doc_start long, n_words long, n_agree long, item_words long"

    def overlap(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int] | None:
        """The best stretch on a diagonal if it is a leak."""
        need = least_share * len(item) if len(item) >= WEIGHT else len(item)
        low, high = max(0, -shift), min(len(item), len(doc) - shift)
        # most diagonals of a common seed agree in little else
        if high <= low or np.count_nonzero(doc[low + shift : high + shift] == item[low:high]) < min(least_words, need):
            return None
        a, n, same = best_overlap(doc, item, shift, least_identity)
        return (a, n, same) if n and same >= min(least_words, need) else None

    def leak_rows(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * 6
        return pa.RecordBatch.from_arrays(
            [pa.array(x, k) for x, k in zip(columns, (name_kind, *[pa.int64()] * 5), strict=True)],
            names=["name", "item_id", "doc_start", "n_words", "n_agree", "item_words"],
        )

    if sieve is not None:
        # the items' words are no more than their seeds: they go to all tasks, and a region's words meet ITEMS items at once
        # (items of one or two words have no seed, and so no place in this bound)
        rows = items.where(F.size("item") >= SHORTEST).select("item_key", "item_id", "item").collect()
        words = [np.array(r["item"], np.int64) for r in rows]
        lengths = np.array([len(w) for w in words], np.int64)
        needs = np.array([min(least_words, least_share * n if n >= WEIGHT else n) for n in lengths.tolist()])
        table = ({r["item_key"]: k for k, r in enumerate(rows)}, [r["item_id"] for r in rows], np.concatenate([*words, np.zeros(0, np.int64)]), np.cumsum(lengths) - lengths, lengths, needs)
        known_items = spark.sparkContext.broadcast(table)
        block = F.pmod("item_key", F.lit(max(1, -(-len(rows) // ITEMS))))
        asked = diagonals.groupBy("region", block.alias("_b")).agg(F.collect_list(F.struct("item_key", "shift")).alias("asked"))
        laid = asked.join(places.select("region", "name", "first", "words"), "region").select("name", "first", "words", "asked")

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            places_, ids, flat, starts, lengths, needs = known_items.value
            for batch in batches:
                out = []
                for k in range(batch.num_rows):
                    doc = batch.column(2)[k].values.to_numpy(zero_copy_only=False)
                    name, first = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                    pairs = batch.column(3)[k].values
                    at = np.array([places_[key] for key in pairs.field(0).to_pylist()])
                    shifts = pairs.field(1).to_numpy(zero_copy_only=False).astype(np.int64)
                    # most diagonals of a common seed agree in little else
                    enough = agreeing_words(doc, flat, starts[at], lengths[at], shifts) >= needs[at]
                    for i, shift in zip(at[enough].tolist(), shifts[enough].tolist(), strict=True):
                        if leak := overlap(doc, flat[starts[i] : starts[i] + lengths[i]], shift):
                            out.append((name, ids[i], first + shift + leak[0], leak[1], leak[2], int(lengths[i])))
                yield leak_rows(out)
    else:
        laid = (
            diagonals.join(places.select("region", "name", "first", "words"), "region")
            .join(items.select("item_key", "item_id", "item"), "item_key")
            .select("name", "item_id", "first", "shift", "words", "item")
        )

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for k in range(batch.num_rows):
                    doc = batch.column(4)[k].values.to_numpy(zero_copy_only=False)
                    item = batch.column(5)[k].values.to_numpy(zero_copy_only=False)
                    name, item_id, first, shift = (batch.column(c)[k].as_py() for c in range(4))
                    if leak := overlap(doc, item, shift):
                        out.append((name, item_id, first + shift + leak[0], leak[1], leak[2], len(item)))
                yield leak_rows(out)

    leaks = laid.mapInArrow(tidy(verify), found)
    best = F.max_by(
        F.struct("doc_start", "n_words", "n_agree", "item_words"), F.struct("n_agree", -F.col("n_words"), -F.col("doc_start"))
    )
    told = leaks.groupBy("name", "item_id").agg(best.alias("b"))
    return told.select(F.col("name").alias("doc_id" if key is None else "key"), "item_id", "b.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs without a leak (see find_leaks), with all their columns.

    Ids may repeat or be null: a row is judged by its own text. Null texts count as empty and stay; columns of any name pass through; an empty
    table on either side leaves docs as they are.
    """
    key, name = F.concat_ws(":", F.col("doc_id").cast("string"), F.md5(text_bytes())), unused(docs, "_key")
    leaks = find_leaks(docs, benchmark, key=key, **options).select(F.col("key").alias(name)).distinct()
    return docs.withColumn(name, key).join(leaks, name, "left_anti").select(*docs.columns)
