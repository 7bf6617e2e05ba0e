"""Subsets, quotas and the dealing of speakers to jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .corpus import dense_ids


def first_of_each(rows: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group in a total order, with their rank.

    A rank limit over a window lets Spark cut each task's part to n rows a group before the shuffle.
    """
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)


def allocate_quota(counts: DataFrame, key: str, total: int) -> DataFrame:
    """key, quota: total shared out evenly, what small groups leave going to larger ones.

    counts (key, n) is one row a dictionary; it is walked on the driver from the smallest group up.
    """
    rows = sorted((r["n"], r[key]) for r in counts.collect())
    out, left = [], total
    for i, (n, name) in enumerate(rows):
        quota = min(n, left // (len(rows) - i))
        out.append((name, quota))
        left -= quota
    return counts.sparkSession.createDataFrame(out, f"{key} string, quota long")


def balance(counts: DataFrame, key: str, jobs: int, most: int = 100_000) -> DataFrame:
    """key, n, job: the largest group first, each to the job with the least load, the first on ties.

    counts (key, n) is one row a speaker. The driver walks the ``most`` largest; where there are more, the small
    ones after them are dealt to the jobs in turn, there and back, in the order of their size.
    """
    order = [F.desc("n"), F.col(key)]
    loads, out = [0] * jobs, []
    for r in counts.orderBy(*order).limit(most).collect():
        job = loads.index(min(loads))
        loads[job] += r["n"]
        out.append((r[key], r["n"], job))
    made = counts.sparkSession.createDataFrame(out, f"{key} string, n long, job int")
    if len(out) < most:
        return made
    rest = counts.join(F.broadcast(made.select(key)), key, "left_anti")  # ``most`` names
    ids = dense_ids(rest.withColumn("_down", -F.col("n")), "_down", key, name="_place")
    turn = F.col("_place") % (2 * jobs)
    seats = F.array(*(F.lit(k) for k in sorted(range(jobs), key=loads.__getitem__)))  # the least loaded comes first
    job = F.get(seats, F.when(turn < jobs, turn).otherwise(2 * jobs - 1 - turn).cast("int"))
    return made.unionByName(ids.select(key, F.col("n").cast("long").alias("n"), job.alias("job")))


def ladder(counts: DataFrame, needed: int, steps: Sequence[int]) -> DataFrame:
    """Groups of at least the first step whose groups together have the rows needed, else the last."""
    sums = counts.agg(*(F.coalesce(F.sum(F.when(F.col("n") >= s, F.col("n"))), F.lit(0)).alias(f"s{s}") for s in steps))
    least = F.lit(steps[-1])
    for s in reversed(steps[:-1]):
        least = F.when(F.col(f"s{s}") >= needed, F.lit(s)).otherwise(least)
    return counts.crossJoin(sums.select(least.alias("_least"))).where("n >= _least").drop("_least")


def speaker_ladder(rows: DataFrame, speaker: str, duration: str, needed: int, steps: Sequence[int] = (30, 15, 5)) -> DataFrame:
    """speaker, n: how many utterances no longer than the mean of all rows each speaker has, of the speakers of the first step that together has the rows needed (see ladder)."""
    mean = rows.agg(F.avg(duration).alias("_mean"))
    short = rows.crossJoin(F.broadcast(mean)).where(F.col(duration) <= F.col("_mean"))  # one row
    return ladder(short.groupBy(speaker).agg(F.count("*").alias("n")), needed, steps)
