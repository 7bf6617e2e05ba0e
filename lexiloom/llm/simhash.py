"""SimHash near-duplicates by a byte-position inverted index with count filtering (operator 10).

Fingerprints whose distance is at most d differ in at most d bytes, so they share at least
B - d of B bytes at their places: the guaranteed minimum of matches. The index posts a fingerprint
under compound keys of several (place, byte) terms, chosen so that every pair with the
minimum shares a key; the shared positional bytes of each pair met in a posting are tallied, pairs
under the minimum go, and the rest is verified. A single (place, byte) term would put 1/256 of
all rows into one posting; a compound term keeps postings short at any size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from itertools import combinations, repeat
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ship_package
from .common import clean_up, connected_components, cut, held, stored, text_bytes, tidy, unused

#: Words are taken this many at a time from a text, so memory does not follow its length.
BLOCK_WORDS = 1 << 18


def shingle_hashes(raw: bytes, shingle: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles of a text (A-Z lowered, ASCII white space), in blocks."""
    words = raw.lower().split()
    if not words:
        return
    if len(words) < shingle:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
        return
    for at in range(0, len(words) - shingle + 1, BLOCK_WORDS):
        block = words[at : at + BLOCK_WORDS + shingle - 1]
        n = len(block) - shingle + 1
        joined = map(b" ".join, zip(*(block[k:] for k in range(shingle)), strict=False))
        yield np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(seed)), np.uint64, n)


def fingerprint64(raw: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Bits set in over half the shingle hashes, repeats included; zero without words."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(raw, shingle, seed):
        n += len(h)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]) if n else 0


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row; null text counts as empty."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint64(x.as_py(), shingle, seed) for x in batch.column(1)]
            bits = np.array(fps, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.int64())], names=["doc_id", "fp"])

    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("raw")).mapInArrow(tidy(work), "doc_id long, fp long")


def covering_blocks(places: int = 8, missing: int = 2, keep: int = 5) -> list[tuple[int, ...]]:
    """Sets of ``keep`` places such that any ``missing`` places leave one set whole.

    Greedy cover of the sets of missing places by complements; a pair that differs in no more
    bytes shares every place of at least one set.
    """
    open_sets = set(combinations(range(places), missing))
    choices = list(combinations(range(places), places - keep))
    out = []
    while open_sets:
        best = max(choices, key=lambda c: sum(set(m) <= set(c) for m in open_sets))
        open_sets -= {m for m in open_sets if set(m) <= set(best)}
        out.append(tuple(p for p in range(places) if p not in best))
    return out


def _byte(col: str, place: int) -> Column:
    return F.shiftrightunsigned(F.col(col), 8 * place).bitwiseAND(F.lit(255))


def close_pairs(fps: DataFrame, distance: int = 2, light: int = 128) -> DataFrame:
    """Edges u, v between distinct fingerprints (column fp) that connect all pairs within the distance.

    Postings of up to ``light`` fingerprints give all their pairs to the tally. A longer
    posting would give a square of pairs, so its fingerprints go the exact way instead: each
    is written under itself and its one-bit neighbours; fingerprints that meet there are within two
    bits, those within two bits meet, and at most 65 meet, each linked to the smallest.
    """
    if distance != 2:
        raise ValueError("the exact way for long postings is made for a distance of two")
    least = 8 - distance
    blocks = covering_blocks(8, distance, 5)
    keys = [
        reduce(lambda a, p: a * 256 + _byte("fp", p), block, F.lit(k).cast("long")) for k, block in enumerate(blocks)
    ]
    index = cut(fps.select("fp", F.explode(F.array(*keys)).alias("key")))
    sizes = index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    posted = cut(index.join(sizes, "key"))
    short = posted.where(F.col("n") <= light)
    tally = reduce(add, [(_byte("u", p) == _byte("v", p)).cast("int") for p in range(8)])
    pairs = (
        short.select("key", F.col("fp").alias("u"))
        .join(short.select("key", F.col("fp").alias("v")), "key")
        .where("u < v")
        .where(tally >= least)
        .where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance)
        .select("u", "v")
    )
    hot = posted.where(F.col("n") > light).select("fp").distinct()
    flips = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(-(1 << 63) if i == 63 else 1 << i)) for i in range(64)]
    meet = hot.select("fp", F.explode(F.array(*flips)).alias("at"))
    star = meet.select("fp", F.min("fp").over(Window.partitionBy("at")).alias("v")).where("fp <> v")
    return pairs.unionByName(star.select(F.col("fp").alias("u"), "v")).distinct()


def components(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row of docs.

    component_id is the smallest doc_id reachable over fingerprints within the distance, itself
    included (null ids count only where a component has no other). Texts without words
    have fingerprint zero and link like any other. Repeated rows and ids are allowed, other columns ignored.
    """
    rows = cut(fingerprints(docs, shingle))
    reps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = connected_components(close_pairs(reps.select("fp")))
    named = reps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    smallest = cut(named.groupBy("root").agg(F.min("rep").alias("component_id")))
    by_fp = cut(named.join(smallest, "root").select("fp", "component_id"))
    return rows.join(by_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


# --- near duplicates at a similarity, over ordered shingles -------------------------------------

_PUNCTUATION = re.compile(rb"[!-/:-@\[-`{-~]+")
#: Bits of a set's print: every shingle turns one of them over.
PRINT_BITS = 1024
#: Ids of texts to be looked at again that are sent to all tasks; more are joined by a shuffle.
BROADCAST_IDS = 200_000


def _folded_words(raw: bytes) -> list[bytes]:
    """Lower-cased words without ASCII punctuation."""
    return _PUNCTUATION.sub(b"", raw.lower()).split()


def shingle_set(raw: bytes, shingle: int) -> np.ndarray:
    """Distinct 64-bit hashes of the folded word shingles (fewer words: the whole sequence)."""
    words = _folded_words(raw)
    parts = [np.unique(h) for h in shingle_hashes(b" ".join(words), shingle)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def set_head(hashes: np.ndarray, common: np.ndarray, part: Fraction) -> np.ndarray:
    """The first shingles of a sorted set, common ones last: as many as a similar set can't all lack.

    A set at the similarity holds at least ceil(part * n) of the n, so of the first n - ceil(part * n) + 1
    in any one order it holds one, and the first that both hold is in the heads of both.
    """
    if len(common) and len(hashes):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        late = common[at] == hashes
        hashes = np.concatenate([hashes[~late], hashes[late]])
    n = len(hashes)
    return hashes[: n + 1 + (-part.numerator * n) // part.denominator]


def set_fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a set, as a signed long: bits set in over half of its hashes, each counted once."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK_WORDS):
        block = np.ascontiguousarray(hashes[at : at + BLOCK_WORDS])
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def set_print(hashes: np.ndarray) -> np.ndarray:
    """PRINT_BITS bits as longs; the prints of two sets differ in at most as many bits as the sets in shingles."""
    odd = np.bincount((hashes >> np.uint64(54)).astype(np.int64), minlength=PRINT_BITS) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    """One list of longs an array."""
    ends = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    values = np.concatenate([np.zeros(0, np.int64), *(x.view(np.int64) for x in arrays)])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int64()))


def common_shingles(texts: DataFrame, shingle: int, sample: int = 8_000, share: float = 1 / 12, least: int = 2, most: int = 400_000) -> np.ndarray:
    """Shingles that are frequent in a sample of the texts, sorted. They serve for the order alone, which may be any.

    The sample is a share of the texts, ``sample`` of them at least, so that how often a shingle must occur to be found doesn't grow with the corpus.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, size = [], 0
            for k, x in enumerate(batch.column(1), 1):
                sets.append(shingle_set(x.as_py(), shingle))
                size += len(sets[-1])
                if size > BLOCK_WORDS or k == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([_lists(sets)], names=["hashes"])
                    sets, size = [], 0

    share = min(1.0, max(share, sample / max(1, texts.count())))
    some = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    counts = some.mapInArrow(tidy(listed), "hashes array<long>").select(F.explode("hashes").alias("h")).groupBy("h").count()
    top = counts.where(F.col("count") >= least).orderBy(F.desc("count"), "h").limit(most).select("h")
    return np.sort(top.toPandas()["h"].to_numpy(np.int64, copy=True).view(np.uint64))


def simhash_pairs(by_fp: DataFrame, rows: int | None = None) -> DataFrame:
    """a, b: candidates of fp, rep. Of equal fingerprints the smallest rep with each other one, and of close ones the two smallest."""
    first = cut(by_fp.groupBy("fp").agg(F.min("rep").alias("first")), rows)
    same = by_fp.join(first, "fp").where("rep <> first").select("first", "rep")
    ends = close_pairs(first.select("fp"))
    near = ends.join(first.select(F.col("fp").alias("u"), F.col("first").alias("x")), "u").join(first.select(F.col("fp").alias("v"), F.col("first").alias("y")), "v")
    both = same.toDF("x", "y").unionByName(near.select("x", "y"))
    return cut(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), rows)


def similar_groups(
    docs: DataFrame, shingle: int = 5, similarity: float = 0.8, light: int = 24, leaders: int = 4
) -> DataFrame:
    """doc_id and component_id: groups of documents linked by a Jaccard similarity of word shingles.

    Texts with equal shingle sets form a class. The first of each class has a SimHash of its set; those whose fingerprints are equal or meet in the
    byte-position index with count filtering (``close_pairs``) are candidates, verified like all others. What fingerprints
    can't guarantee is made up for by an exact prefix filter, for sets that are not yet in one component: the first of a class is posted
    under the shingles of its set's head (``set_head``); two sets at the similarity meet under the
    first shingle that both hold, where their sizes and places allow it. A posting of up to ``light``
    sets gives all its pairs. In a longer one the most central set (largest sum of posting sizes) is paired with
    the others first, then that of those outside the largest component, up to ``leaders`` times; in the end every
    pair that is still in different components is made, so only pairs already linked are left out. Pairs that
    their prints don't rule out are verified on the whole texts. Texts without words are linked to nothing.
    doc_id must be unique; null ids and null, empty or wordless texts are linked to nothing and are groups of their own (a null
    id has a null component), other columns are ignored, an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship_package(spark)
    part = Fraction(similarity).limit_denominator(10**6)
    texts = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("raw"))
    common = spark.sparkContext.broadcast(common_shingles(texts, shingle))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, digests, fps, prints, heads = [], [], [], [], [], []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                hashes = shingle_set(x.as_py(), shingle)
                if i is None or not len(hashes):
                    continue
                ids.append(i)
                sizes.append(len(hashes))
                digests.append(xxhash.xxh3_128_digest(hashes))
                fps.append(set_fingerprint(hashes))
                prints.append(set_print(hashes))
                heads.append(set_head(hashes, common.value, part))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(fps, pa.int64()), _lists(prints), _lists(heads)],
                names=["doc_id", "size", "digest", "fp", "print", "head"],
            )

    kinds = "doc_id long, size long, digest binary, fp long, print array<long>, head array<long>"
    sketches = held(texts.mapInArrow(tidy(sketch), kinds))
    n_sets, n_heads = sketches.agg(F.count("*"), F.coalesce(F.sum(F.size("head")), F.lit(0))).first()
    classes = sketches.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    same = sketches.select("doc_id", "digest").join(classes, "digest").where("doc_id <> rep")
    same = cut(same.select(F.col("rep").alias("u"), F.col("doc_id").alias("v")), n_sets)
    index = sketches.join(same.select(F.col("v").alias("doc_id")), "doc_id", "left_anti")
    prints = index.select("doc_id", "size", "print")
    by_fp = cut(index.select("fp", F.col("doc_id").alias("rep")), n_sets)
    index = index.select(F.col("doc_id").alias("rep"), "size", F.posexplode("head").alias("pos", "key"))
    sizes = cut(index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), n_heads)

    def possible(most: Column, both: Column) -> Column:
        """Whether sets of ``both`` shingles together may be similar with at most ``most`` in common."""
        return most * (part.numerator + part.denominator) >= both * part.numerator

    def meeting(a: str, b: str) -> Column:
        left = F.least(F.col(f"{a}.size") - F.col(f"{a}.pos"), F.col(f"{b}.size") - F.col(f"{b}.pos"))
        return possible(left, F.col(f"{a}.size") + F.col(f"{b}.size"))

    def ordered(a: str, b: str) -> list[Column]:
        x, y = F.col(f"{a}.rep"), F.col(f"{b}.rep")
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x.as_py(), shingle) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(sets)], names=["doc_id", "hashes"])

    def similar(x: Column, y: Column) -> Column:
        """Whether two sets of shingles have the similarity; whole numbers, so that a similarity met exactly counts."""
        both = F.size(F.array_intersect(x, y)).cast("long")
        return both * (part.numerator + part.denominator) >= (F.size(x) + F.size(y)) * part.numerator

    def verified(pairs: DataFrame) -> DataFrame:
        """u, v: the pairs a, b at the similarity."""
        n = pairs.count()
        x = prints.select(F.col("doc_id").alias("a"), F.col("print").alias("x"), F.col("size").alias("m"))
        y = prints.select(F.col("doc_id").alias("b"), F.col("print").alias("y"), F.col("size").alias("n"))
        apart = reduce(add, [F.bit_count(F.col("x")[k].bitwiseXOR(F.col("y")[k])) for k in range(PRINT_BITS // 64)])
        # n shingles together of which at least d are in one set only leave (n - d) / 2 in common
        near = pairs.join(x, "a").join(y, "b").where(possible(F.col("m") + F.col("n") - apart, 2 * (F.col("m") + F.col("n"))))
        near = cut(near.select("a", "b"), n)
        wanted = near.select(F.col("a").alias("doc_id")).unionByName(near.select(F.col("b").alias("doc_id"))).distinct()
        if 2 * near.count() <= BROADCAST_IDS:
            wanted = F.broadcast(wanted)  # then the texts stay where they are
        sets = held(texts.join(wanted, "doc_id", "left_semi").mapInArrow(tidy(shingled), "doc_id long, hashes array<long>"))
        left = sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("x"))
        right = sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("y"))
        found = near.join(left, "a").join(right, "b").where(similar(F.col("x"), F.col("y")))
        links = cut(found.select(F.col("a").alias("u"), F.col("b").alias("v")), n)
        sets.unpersist()
        return links

    def unsettled(links: DataFrame) -> DataFrame:
        """The long postings whose sets are not all in one component; comp, and main: the one most of them are in."""
        roots = connected_components(links).select(F.col("node").alias("rep"), "root")
        named = cut(long_.drop("comp").join(roots, "rep", "left").withColumn("comp", F.coalesce("root", "rep")).drop("root"), n_posted)
        kinds = named.groupBy("key", "comp").count().groupBy("key")
        kinds = kinds.agg(F.max_by("comp", F.struct("count", "comp")).alias("main"), F.count("*").alias("kinds"))
        return cut(named.join(kinds.where("kinds > 1").select("key", "main"), "key"), n_posted)

    def led(rows: DataFrame) -> DataFrame:
        """Pairs of the most central set of every posting with the others."""
        top = F.max_by(F.struct("rep", "size", "pos", "comp"), F.struct("score", -F.col("rep"))).alias("t")
        best = rows.groupBy("key").agg(top)
        found = rows.alias("m").join(best, "key").select("m.*", "t").where(F.col("comp") != F.col("t.comp"))
        return found.alias("m").where(meeting("m", "t")).select(*ordered("m", "t"))

    found = simhash_pairs(by_fp, n_sets)
    close = verified(found)
    clean_up(spark)
    linked = cut(connected_components(close).select(F.col("node").alias("rep"), "root"), n_sets)
    posted = index.join(sizes, "key").join(linked, "rep", "left")
    posted = cut(posted.withColumn("comp", F.coalesce("root", "rep")).drop("root"), n_heads)
    n_posted = posted.count()
    short = posted.where(F.col("n") <= light)
    pairs = short.alias("a").join(short.alias("b"), "key").where("a.rep < b.rep AND a.comp <> b.comp").where(meeting("a", "b"))
    central = posted.groupBy("rep").agg(F.sum("n").alias("score"))
    long_ = cut(posted.where(F.col("n") > light).join(central, "rep"), n_posted)
    tested = cut(pairs.select(*ordered("a", "b")).unionByName(led(long_)).distinct())
    tested = cut(tested.join(found, ["a", "b"], "left_anti"))
    links = close.unionByName(verified(tested))
    tested = tested.unionByName(found)
    clean_up(spark)
    turn = 1 if not long_.isEmpty() else None
    while turn is not None:
        rows = unsettled(links)
        spread = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum((F.col("comp") != F.col("main")).cast("long")).alias("out"))
        all_pairs = spread.agg(F.sum(F.col("n") * F.col("out"))).first()[0]
        if all_pairs is None:
            break
        rest = rows.where("comp <> main")
        if all_pairs <= n_posted:
            turn = leaders  # few enough to make them all at once
        if turn < leaders:
            new = led(rest)
        else:
            new = rest.alias("a").join(rows.alias("b"), "key").where("a.comp <> b.comp AND (b.comp = b.main OR a.rep < b.rep)")
            new = new.where(meeting("a", "b")).select(*ordered("a", "b"))
        new = cut(new.distinct().join(tested, ["a", "b"], "left_anti"))
        tested = tested.unionByName(new)
        more = verified(new)
        links = links.unionByName(more)
        clean_up(spark)
        # leaders that link nothing more leave all that is left to the last turn
        turn = None if turn >= leaders else leaders if more.isEmpty() else turn + 1
    sketches.unpersist()
    roots = connected_components(links.unionByName(same))
    out = docs.select(F.col("doc_id").cast("long")).join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", F.coalesce("root", "doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs of which each is the first of its group, with all their columns.

    First: the smallest doc_id. Where ids repeat or are null, rows are numbered in a stored copy and
    the smallest number stays.
    """
    odd = docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1")
    row = unused(docs, "_row")
    if odd.limit(1).count():
        rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    else:
        rows = docs.withColumn(row, F.col("doc_id").cast("long"))
    groups = similar_groups(rows.select(F.col(row).alias("doc_id"), "text"), **options)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias(row))
    return rows.join(gone, row, "left_anti").select(*docs.columns)
