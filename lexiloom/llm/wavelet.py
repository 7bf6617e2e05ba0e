"""Token ids in wavelet-matrix shards (operator 3).

A shard holds the ids of consecutive documents as one wavelet matrix: a bit plane for each bit
of an id, most significant first, where each plane is ordered by a stable partition on the planes
above it. Rank and select over the planes give access to a token, counts of an id in a range and
the places of its occurrences without decoding the shard.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ship_package
from .common import scratch_path, text_bytes, tidy
from .encoding import encoder

_HEAD = struct.Struct("<4sBQ")
_MAGIC = b"LXW1"
#: Bits between two entries of a plane's rank directory.
_STEP = 512


class WaveletMatrix:
    """Ids (uint32) as bit planes with rank directories. Positions count from 0."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], ranks: list[np.ndarray]):
        self.n, self.planes, self.zeros, self.ranks = n, planes, zeros, ranks

    @classmethod
    def build(cls, ids: np.ndarray, width: int) -> WaveletMatrix:
        if len(ids) and int(ids.max()) >> width:
            raise ValueError(f"an id needs more than {width} bits")
        now = ids.astype(np.uint16 if width <= 16 else np.uint32)
        planes, zeros, ranks = [], [], []
        for level in range(width - 1, -1, -1):
            bit = (now & (1 << level)) != 0
            planes.append(np.packbits(bit, bitorder="little"))
            ranks.append(cls._directory(planes[-1]))
            zeros.append(len(now) - int(ranks[-1][-1]))
            after = np.empty_like(now)  # zeros first, then ones, each in order
            np.compress(~bit, now, out=after[: zeros[-1]])
            np.compress(bit, now, out=after[zeros[-1] :])
            now = after
        return cls(len(ids), planes, zeros, ranks)

    @staticmethod
    def _directory(plane: np.ndarray) -> np.ndarray:
        """Ones before each step of the plane."""
        padded = np.zeros(-(-len(plane) // (_STEP // 8)) * (_STEP // 8), np.uint8)
        padded[: len(plane)] = plane
        ones = np.bitwise_count(padded).reshape(-1, _STEP // 8).sum(axis=1, dtype=np.uint64)
        return np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32)

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (i & 7) & 1

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        step = i // _STEP
        plane, at = self.planes[level], step * (_STEP // 8)
        ones = int(self.ranks[level][step]) + int(np.bitwise_count(plane[at : i >> 3]).sum())
        return ones + (int(plane[i >> 3]) & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else ones

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of this value."""
        directory = self.ranks[level].astype(np.int64)
        before = directory if bit else np.arange(len(directory)) * _STEP - directory
        step = int(np.searchsorted(before, k, side="right")) - 1
        step = min(step, len(directory) - 2)
        at = step * (_STEP // 8)
        bits = np.unpackbits(self.planes[level][at : at + _STEP // 8], bitorder="little")
        return step * _STEP + int(np.flatnonzero(bits == bit)[k - int(before[step])])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level in range(len(self.planes)):
            bit = self._bit(level, i)
            out = out << 1 | bit
            ones = self._rank1(level, i)
            i = self.zeros[level] + ones if bit else i - ones
        return out

    def _range(self, symbol: int, lo: int, hi: int) -> tuple[int, int]:
        for level in range(len(self.planes)):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            if symbol >> (len(self.planes) - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, symbol: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of an id at lo <= place < hi."""
        if symbol >> len(self.planes):
            return 0
        a, b = self._range(symbol, lo, self.n if hi is None else hi)
        return b - a

    def select(self, symbol: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of an id."""
        a, b = self._range(symbol, 0, self.n)
        if symbol >> len(self.planes) or not 0 <= k < b - a:
            raise IndexError(k)
        at = a + k
        for level in range(len(self.planes) - 1, -1, -1):
            if symbol >> (len(self.planes) - 1 - level) & 1:
                at = self._select(level, 1, at - self.zeros[level])
            else:
                at = self._select(level, 0, at)
        return at

    def occurrences(self, symbol: int, lo: int = 0, hi: int | None = None) -> Iterator[int]:
        """Places of an id at lo <= place < hi, ascending."""
        first = self.count(symbol, 0, lo)
        for k in range(first, first + self.count(symbol, lo, hi)):
            yield self.select(symbol, k)

    def decode(self) -> np.ndarray:
        """All ids in order: the partitions undone from the lowest plane up."""
        now = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level in range(len(self.planes) - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            zeros, above = self.zeros[level], np.empty_like(now)
            above[np.flatnonzero(~bit)] = now[:zeros]
            above[np.flatnonzero(bit)] = now[zeros:] | now.dtype.type(1 << (len(self.planes) - 1 - level))
            now = above
        return now.astype(np.uint32)

    def to_bytes(self) -> bytes:
        """magic, width, n; zeros a plane; then each plane and its rank directory."""
        head = _HEAD.pack(_MAGIC, len(self.planes), self.n) + np.array(self.zeros, "<u8").tobytes()
        return head + b"".join(p.tobytes() + r.astype("<u4").tobytes() for p, r in zip(self.planes, self.ranks, strict=True))

    @classmethod
    def from_bytes(cls, raw: bytes) -> WaveletMatrix:
        magic, width, n = _HEAD.unpack_from(raw)
        if magic != _MAGIC:
            raise ValueError("not a wavelet shard")
        at = _HEAD.size
        zeros = [int(x) for x in np.frombuffer(raw, "<u8", width, at)]
        at += 8 * width
        size = -(-n // 8)
        steps = -(-size // (_STEP // 8)) + 1
        planes, ranks = [], []
        for _ in range(width):
            planes.append(np.frombuffer(raw, np.uint8, size, at))
            ranks.append(np.frombuffer(raw, "<u4", steps, at + size))
            at += size + 4 * steps
        return cls(n, planes, zeros, ranks)


SHARDS = "part int, shard int, n_tokens long, doc_ids array<long>, doc_tokens array<long>, matrix binary"


def write_shards(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, width: int = 16, shard_tokens: int = 1 << 20
) -> None:
    """Writes the ids of all documents, ascending by doc_id, as wavelet shards below ``path``.

    Documents are dealt by ranges of doc_id; each task cuts its run of documents into shards of
    about shard_tokens ids (a document stays whole). A shard is one row of a zstd-compressed
    Parquet file: its place (part, shard), its documents with their number of ids, and the matrix.
    Spark's own writer commits the files, so tasks may be lost and repeated. Null text counts as empty;
    null doc_ids come first; rows with the same doc_id follow each other by the bytes of their texts. Other columns are ignored; an
    empty table writes files without a shard.
    """
    ship_package(docs.sparkSession)
    end = int(end_id).to_bytes(4, "little")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        ids: list[bytes] = []
        names: list = []
        sizes: list[int] = []
        shard = total = 0

        def flush() -> pa.RecordBatch:
            matrix = WaveletMatrix.build(np.frombuffer(b"".join(ids), "<u4"), width)
            row = [[part], [shard], [matrix.n], [names[:]], [sizes[:]], [matrix.to_bytes()]]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(row, kinds, strict=True)],
                names=["part", "shard", "n_tokens", "doc_ids", "doc_tokens", "matrix"],
            )

        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(enc.encode(raw.as_py().decode("utf-8", "replace")) + end)
                names.append(doc_id)
                sizes.append(len(ids[-1]) // 4)
                total += sizes[-1]
                if total >= shard_tokens:
                    yield flush()
                    shard, total = shard + 1, 0
                    ids, names, sizes = [], [], []
        if names:
            yield flush()

    ordered = docs.select("doc_id", text_bytes().alias("raw")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "raw")
    ordered.mapInArrow(tidy(build, cache=tokenizer_path), SHARDS).write.option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards below a path that write_shards filled."""
    return spark.read.schema(SHARDS).parquet(path)


def shard_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the shards' contents.

    Every shard is decoded; start sums the ids of all shards before (a prefix sum over one row a
    part, then over the shards of a part).
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part, shard = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                names, sizes = batch.column(2)[k].as_py(), batch.column(3)[k].as_py()
                ids = WaveletMatrix.from_bytes(batch.column(4)[k].as_buffer()).decode().astype("<u4")
                ends = np.cumsum(sizes)
                starts = ends - sizes
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * len(names), pa.int32()),
                        pa.array([shard] * len(names), pa.int32()),
                        pa.array(names, pa.int64()),
                        pa.array(starts, pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array(sums, pa.int64()),
                    ],
                    names=["part", "shard", "doc_id", "_start", "n_tokens", "ids_crc32"],
                )

    ship_package(shards.sparkSession)
    sizes = shards.select("part", "shard", "n_tokens")
    by_part = sizes.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = by_part.select("part", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_part_start"))
    upto = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.join(by_part, "part").select(
        "part", "shard", (F.col("_part_start") + F.coalesce(F.sum("n_tokens").over(upto), F.lit(0))).alias("_base")
    )
    rows = shards.select("part", "shard", "doc_ids", "doc_tokens", "matrix").mapInArrow(
        tidy(decode), "part int, shard int, doc_id long, _start long, n_tokens long, ids_crc32 long"
    )
    return rows.join(starts, ["part", "shard"]).select(
        "doc_id", (F.col("_base") + F.col("_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_file_digest(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Writes the documents as shards into the shared folder and describes what the files hold: doc_id, start, n_tokens, ids_crc32.

    Nulls, repeated ids, other columns and empty tables: see write_shards; an empty table gives an empty result.
    """
    path = scratch_path(docs.sparkSession, "wavelet")
    write_shards(docs, path, tokenizer_path, end_id)
    return shard_documents(read_shards(docs.sparkSession, path))
