"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_folder, ship_package


def read_table(spark: SparkSession, sf_dir: str, table: str, *cols: str) -> DataFrame:
    """One table of the data folder, read by Spark so that any store works."""
    ship_package(spark)
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
    return df.select(*cols) if cols else df


def text_bytes(col: str = "text"):
    """The text as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(bytearray()))


def small_batches(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The rows in slices of about ``most_bytes`` (one row at least), without a copy."""
    for batch in batches:
        rows = max(1, min(batch.num_rows, batch.num_rows * most_bytes // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def release_memory() -> None:
    """Gives memory that this worker no longer uses back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library: memory stays with the worker


#: Bounded caches of this worker by name, each with what drops it.
_caches: dict[str, Callable[[], None]] = {}


def keep_cache(name: str, drop: Callable[[], None]) -> None:
    """Lets a cache live on from task to task until a task of another operator comes to this worker."""
    _caches[name] = drop


def tidy(work: Callable, most_bytes: int = 4 << 20, cache: str | None = None) -> Callable:
    """A function for mapInArrow whose memory follows neither the batch size of the session nor earlier operators.

    ``work`` gets slices of bounded size. Workers outlive their tasks: caches but the one named are dropped first, and what
    is free in the end is given back to the system.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if others := [x for x in _caches if x != cache]:
            for name in others:
                _caches.pop(name)()
            release_memory()
        try:
            yield from work(small_batches(batches, most_bytes))
        finally:
            release_memory()

    return run


def clean_up(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the broadcasts, shuffles and checkpoints that nothing refers to any longer.

    The cleaner learns of them when the driver collects its garbage, which it does on its own only every half an hour
    or when its heap is full; jobs of many rounds call this in between.
    """
    spark.sparkContext._jvm.System.gc()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is spark.checkpoint.dir when the cluster names one; only where that is unset (local
    tests) a temporary folder takes its place.
    """
    ship_package(spark)
    return checkpoint_folder(spark)


def unused(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of a small intermediate table that go to one file.
ROWS_PER_FILE = 1_000_000


def few(df: DataFrame, rows: int | None) -> DataFrame:
    """The frame in as many partitions as ``rows``, a bound on its rows, need; a small table gets no swarm of files."""
    return df if rows is None else df.coalesce(max(1, -(-rows // ROWS_PER_FILE)))


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A reliable checkpoint: stored in the shared folder, so it survives lost executors. rows: see few."""
    shared_dir(df.sparkSession)
    return few(df, rows).checkpoint()


def held(df: DataFrame) -> DataFrame:
    """A frame that is read several times, kept on the executors' disks. Its lineage stays, so what a lost executor held is
    made again; for frames that come straight from a stored table. Kept until unpersist or the end of the session."""
    return df.persist(StorageLevel.DISK_ONLY)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the session ends."""
    path = f"{shared_dir(spark).rstrip('/')}/lexiloom/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def stored(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """The frame written as Parquet in the shared folder and read back: lineage ends there and
    later readers prune columns. rows: see few."""
    path = scratch_path(df.sparkSession, label)
    few(df, rows).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, root of the edges u, v of one task, by joining sets under their smallest node."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for at in range(0, len(nodes), 1 << 16):
        some = nodes[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([find(x) for x in some], pa.int64())], names=["node", "root"])


def connected_components(edges: DataFrame, max_rounds: int = 60, one_task: int = 400_000) -> DataFrame:
    """Roots of an undirected graph by alternating large-star and small-star rounds.

    Up to ``one_task`` distinct edges, which one task holds in less than 100 MB, are settled there instead; the
    result is the same.

    edges: columns u, v (long, self loops and repeats allowed, nulls dropped). Returns node,
    root (smallest node of the component) for every node that has an edge to another node.
    Each round is a few joins of plain shuffles, so AQE can split the rows of a hub; the
    frames are checkpointed, in as many files as the edges need, and nothing is collected but two numbers.
    """
    pairs = edges.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    pairs = cut(pairs.distinct())
    mark, n = None, pairs.count()
    if n <= one_task:
        return pairs.coalesce(1).mapInArrow(tidy(_settle), "node long, root long")
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), 2 * n)
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.distinct(), n)
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")), n)
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), n)
        now = tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == mark:
            clean_up(pairs.sparkSession)
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        mark = now
    raise RuntimeError("connected components did not settle")
