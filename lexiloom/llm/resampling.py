"""Importance resampling towards a target distribution (operator 11).

Features are runs of 1 to ``runs`` consecutive words, hashed into buckets. A ring holds the CRC states of the runs that
may still grow: a new word extends each by a space and itself, and starts a run of its own, so that every run's hash takes one step,
whatever its length. One scan of a document emits its buckets; all later passes read those.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, stored, text_bytes, tidy

#: A-Z to a-z; all other ASCII but digits and letters to a space. What is left between spaces are the words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(raw: bytes) -> list[bytes]:
    return raw.translate(_FOLD).split()


def run_states(tokens: list[bytes], runs: int) -> Iterator[int]:
    """CRC-32 of every run of 1 to ``runs`` tokens joined by a space: by last token, the longest first."""
    if runs == 1:  # the ring is empty
        yield from map(crc32, tokens)
        return
    ring: deque[int] = deque(maxlen=runs)
    for token in tokens:
        joined = b" " + token
        if len(ring) == runs:
            ring.popleft()  # the run from there is as long as runs get
        for k, state in enumerate(ring):
            ring[k] = crc32(joined, state)
        ring.append(crc32(token))
        yield from ring


def _width(buckets: int) -> np.dtype:
    return np.dtype("<u2" if buckets <= 1 << 16 else "<u4")


def bucketed(docs: DataFrame, runs: int = 1, buckets: int = 10_000) -> DataFrame:
    """doc_id, n_words, n_features and buckets of every document, in the order of its text.

    ``buckets`` is binary: little-endian unsigned integers of 16 bits, or of 32 where the number of buckets asks for it. Null
    texts count as empty; other columns are ignored.
    """
    dtype = _width(buckets)

    def work(batches):
        for batch in batches:
            sizes, counts, out = [], [], []
            for raw in batch.column(1).to_pylist():
                tokens = words(raw)
                states = np.fromiter(run_states(tokens, runs), np.uint32)
                sizes.append(len(tokens))
                counts.append(len(states))
                out.append((states % np.uint32(buckets)).astype(dtype).tobytes())
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "buckets"])

    rows = docs.select("doc_id", text_bytes().alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(work), f"doc_id {kind}, n_words long, n_features long, buckets binary")


def bucket_counts(rows: DataFrame, buckets: int) -> DataFrame:
    """bucket, n: occurrences over all rows of bucketed(). A task sends one row a bucket, so the shuffle doesn't grow with the texts."""
    dtype = _width(buckets)

    def work(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    return rows.select("buckets").mapInArrow(tidy(work), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Gain of each bucket from its counts in corpus and target (bucket, n): thousandths of the log ratio of their smoothed shares,
    rounded down. What reaches the driver is a row a bucket, as many as the parameter says."""
    tables = []
    for counts in (corpus, target):
        tables.append(np.zeros(buckets, np.int64))
        for bucket, n in counts.collect():
            tables[-1][bucket] = n
    s, t = tables
    all_s, all_t = float(s.sum() + buckets), float(t.sum() + buckets)
    ratio = (t + 1.0) * all_s / ((s + 1.0) * all_t)
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def weighed(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """rows of bucketed() with ``weight`` (the sum of its gains) in place of the buckets."""
    dtype = _width(len(gain))

    def work(batches):
        for batch in batches:
            raw = batch.column(3).to_pylist()
            ends = np.cumsum([0] + [len(x) // dtype.itemsize for x in raw])
            sums = np.concatenate([[0], np.cumsum(gain[np.frombuffer(b"".join(raw), dtype)])])
            weight = pa.array(sums[ends[1:]] - sums[ends[:-1]], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], weight], names=["doc_id", "n_words", "n_features", "weight"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(work), f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(seed: str = "2024"):
    """Gumbel noise of a document in thousandths, from its id alone, rounded down."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(key, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame, target: DataFrame, runs: int = 1, buckets: int = 10_000, share: int = 10, least_words: int = 20, seed: str = "2024"
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document.

    docs: doc_id, text. target: text. Of the N documents with ``least_words`` words or more, the floor(share * N / 100) of the highest
    scores (ties: smaller doc_id, null last) are drawn and ranked from 1; rank is null elsewhere. The draw is the top of weight plus Gumbel noise,
    a sample without replacement in proportion to exp(weight / 1000). Null texts count as empty, repeated rows count each, an empty target
    leaves only the smoothing, an empty table gives an empty result; other columns are ignored.

    Ranks come from range partitions by score, each shifted by the rows before it; equal rows are dealt apart by their place.
    """
    rows = stored(bucketed(docs, runs, buckets), "buckets")
    wanted = bucketed(target.select(F.lit(0).alias("doc_id"), "text"), runs, buckets)
    gain = gains(bucket_counts(rows, buckets), bucket_counts(wanted, buckets), buckets)
    scored = weighed(rows, gain).withColumn("score", F.col("weight") + noise(seed))
    scored = stored(scored.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id())), "scores")
    enough = F.col("n_words") >= least_words
    drawn = scored.where(enough).count() * share // 100

    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "_salt"]
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    sorted_ = scored.where(enough).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(sorted_.select("*", F.spark_partition_id().alias("_part"), place.alias("_place")))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # one row a partition
    starts = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    rank = F.col("_start") + F.col("_place") + 1
    columns = ["doc_id", "n_features", "weight", "score"]
    ranked = placed.join(F.broadcast(starts), "_part").select(*columns, F.when(rank <= drawn, rank).alias("rank"))
    return ranked.unionByName(scored.where(~enough).select(*columns, F.lit(None).cast("long").alias("rank")))


#: The CRC table is made by its rule; distinct words are hashed once.
ORACLE_SQL = r"""
WITH crc_table AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i))
), texts AS (
  SELECT false AS target, doc_id, text FROM documents UNION ALL SELECT true, NULL, text FROM benchmark
), split AS (
  SELECT target, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts
), flat AS (SELECT target, doc_id, unnest(w) AS word FROM split),
hashed AS (
  SELECT word, xor(list_reduce([4294967295] || list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT),
                               lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT word, hex(encode(word)) AS x FROM (SELECT DISTINCT word FROM flat)), crc_table
), counted AS (
  SELECT bucket, count(*) FILTER (WHERE NOT target) AS s, count(*) FILTER (WHERE target) AS t FROM flat JOIN hashed USING (word) GROUP BY bucket
), gain AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE
                                 / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS g
  FROM counted
), weights AS (
  SELECT doc_id, sum(g)::BIGINT AS weight FROM flat JOIN hashed USING (word) JOIN gain USING (bucket) WHERE NOT target GROUP BY doc_id
), scored AS (
  SELECT doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM split LEFT JOIN weights USING (doc_id) WHERE NOT target
), drawn AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scored LEFT JOIN drawn USING (doc_id)
"""
