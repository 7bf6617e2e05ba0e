"""Table functions for SQL: operators over the rows of a partition, in its order, and job functions whose errors become rows.

    register(spark)
    SELECT * FROM speech_segments(TABLE(frames) PARTITION BY (key) ORDER BY (begin), 500, 30000)

A call sees one partition (PARTITION BY) and holds a bounded state; Spark deals the partitions to tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from ..session import ship_package


class SpeechSegments:
    """Intervals (key, begin, end) of a partition in order, merged while the pause is at most ``pause`` and the whole no longer than ``longest``.

    Gives key, begin, end, n and error. A row without bounds, or whose end is before its begin, gives a row with the error and takes no part; so does one
    that begins before the row before it, as the partition isn't in order then.
    """

    def __init__(self) -> None:
        self.key, self.begin, self.reach, self.n, self.at = None, 0, 0, 0, None

    def eval(self, row: Row, pause: int, longest: int) -> Iterator[tuple]:
        key, begin, end = row["key"], row["begin"], row["end"]
        if begin is None or end is None or end < begin:
            yield key, begin, end, 0, "no interval"
            return
        if self.at is not None and begin < self.at:
            yield key, begin, end, 0, "not in order"
            return
        self.at = begin
        if self.n and (begin - self.reach > pause or max(end, self.reach) - self.begin > longest):
            yield self.key, self.begin, self.reach, self.n, None
            self.n = 0
        if not self.n:
            self.key, self.begin, self.reach = key, begin, end
        self.reach, self.n = max(self.reach, end), self.n + 1

    def terminate(self) -> Iterator[tuple]:
        if self.n:
            yield self.key, self.begin, self.reach, self.n, None


def job_function(work: Callable[[Row], Iterator[tuple]], columns: str, finish: Callable[[], Iterator[tuple]] | None = None):
    """A table function of a job: ``work`` gives result rows for each row of the partition, ``finish`` those at its end.

    columns: their names and types. The result also has ``job_error``: where a row raises, one row tells the error's kind and text, with nulls elsewhere, and the job goes on.
    """
    width = columns.count(",") + 1  # plain types only

    class Job:
        def eval(self, row: Row) -> Iterator[tuple]:
            try:
                yield from [(*out, None) for out in work(row)]
            except Exception as e:  # noqa: BLE001  any error of the job's own code
                yield (*[None] * width, f"{type(e).__name__}: {e}")

        def terminate(self) -> Iterator[tuple]:
            if finish:
                yield from [(*out, None) for out in finish()]

    return udtf(Job, returnType=f"{columns}, job_error string")


def register(spark: SparkSession) -> None:
    """Makes the table functions known to SQL."""
    ship_package(spark)
    spark.udtf.register("speech_segments", udtf(SpeechSegments, returnType="key string, begin long, end long, n long, error string"))
