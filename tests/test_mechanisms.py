"""Streams with timers, table functions in SQL, and TextGrids as a data source."""

import random

import pandas as pd
import pytest

from lexiloom.functions import tables
from lexiloom.sinks.files import textgrid_text
from lexiloom.sources import textgrid
from lexiloom.streaming import voice

ON, OFF, PAUSE = 5.0, 2.0, 60_000


def batch_segments(rows):
    out = set()
    for key in {r[0] for r in rows}:
        begin = last = n = 0
        for _, ts, value in sorted(r for r in rows if r[0] == key):
            if n and ts - last > PAUSE:
                out.add((key, begin, last, n))
                n = 0
            if n and value < OFF:
                out.add((key, begin, last, n))
                n = 0
            elif n or value > ON:
                begin, last, n = (begin if n else ts), ts, n + 1
        if n:
            out.add((key, begin, last, n))
    return out


def test_stream_of_shuffled_batches_equals_the_batch(spark, tmp_path):
    rng = random.Random(4)
    start = 1_700_000_000_000
    rows = [(k, start + 1000 * i + k, rng.choice((1.0, 3.0, 6.0, 9.0))) for k in range(4) for i in range(200) if not 80 < i < 80 + 45 * k]
    rows.sort(key=lambda r: r[1])
    batches = [rows[i : i + 60] for i in range(0, len(rows), 60)]
    for b in batches:
        rng.shuffle(b)
    batches.append([(99, start + 10_000_000, 0.0)])  # another key moves the watermark: only timers close what is open
    batches.append([(0, start + 5_000, 9.0), (99, start + 10_001_000, 0.0)])  # far too late
    source = tmp_path / "in"
    source.mkdir()
    voice.use_state_store(spark)
    read = spark.readStream.schema("key long, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(str(source))
    made = voice.voice_segments(read, ON, OFF, PAUSE, "5 minutes")
    query = None
    for k, b in enumerate(batches):
        frame = pd.DataFrame(b, columns=["key", "ts", "value"])
        frame["ts"] = pd.to_datetime(frame["ts"], unit="ms")
        spark.createDataFrame(frame).coalesce(1).write.mode("append").parquet(str(source))
        query = made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).selectExpr("key", "unix_millis(begin) b", "unix_millis(end) e", "n", "closed_by").collect()
    assert {tuple(r)[:4] for r in got} == batch_segments(rows) and len(got) == len(batch_segments(rows))
    assert {"value", "timer"} <= {r.closed_by for r in got} <= {"value", "pause", "timer"}


def test_segments_by_sql(spark):
    tables.register(spark)
    rows = [("a", 0, 10), ("a", 12, 20), ("a", 60, 70), ("a", 71, 120), ("b", 5, 6), ("b", None, 7), ("b", 9, 8), ("c", 0, 100), ("c", 5, 20), ("c", 101, 102)]
    spark.createDataFrame(rows, "key string, begin long, end long").repartition(3).createOrReplaceTempView("frames")
    got = spark.sql("SELECT * FROM speech_segments(TABLE(SELECT * FROM frames) PARTITION BY (key) ORDER BY (begin), 5, 50)").collect()
    want = {("a", 0, 20, 2, None), ("a", 60, 70, 1, None), ("a", 71, 120, 1, None), ("b", 5, 6, 1, None), ("b", None, 7, 0, "no interval"), ("b", 9, 8, 0, "no interval"), ("c", 0, 100, 1, None), ("c", 5, 20, 1, None), ("c", 101, 102, 1, None)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_job_function_tells_errors_as_rows(spark):
    def work(row):
        if row["text"] is None:
            raise ValueError("no text")
        yield from ((row["id"], w) for w in row["text"].split())

    job = tables.job_function(work, "id long, word string")
    spark.udtf.register("words_of", job)
    spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (4, "c")], "id long, text string").createOrReplaceTempView("texts")
    got = spark.sql("SELECT * FROM words_of(TABLE(texts) PARTITION BY id)").collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted([(1, "a", None), (1, "b", None), (None, None, "ValueError: no text"), (4, "c", None)], key=str)


def test_textgrids_as_a_source(spark, tmp_path):
    textgrid.register(spark)
    want = set()
    for k in range(9):
        folder = tmp_path / "corpus" / f"s{k % 3}"
        folder.mkdir(parents=True, exist_ok=True)
        tiers = {f"ann{k} - words": [(0.0, 0.5, "a"), (0.5, 1.25, 'say "b"')], "ben": [(0.25, 1.0, f"é{k}")]}
        (folder / f"f{k}.TextGrid").write_text(textgrid_text(tiers, 2.0, short=k % 2 == 0))
        want |= {(str(folder / f"f{k}.TextGrid"), t, b, e, x, None) for t, rows in tiers.items() for b, e, x in rows}
    (tmp_path / "corpus" / "bad.TextGrid").write_text("nothing of the kind")
    (tmp_path / "corpus" / "worse.textgrid").write_bytes(b"\xff\xfe\x00\x01\xff")
    (tmp_path / "corpus" / "other.txt").write_text("x")
    df = spark.read.format("textgrid").option("files_a_partition", 2).load(str(tmp_path / "corpus"))
    assert {tuple(r) for r in df.where("error IS NULL AND label <> ''").collect()} == want
    assert {(r.path.split("/")[-1], r.error) for r in df.where("error IS NOT NULL").collect()} == {("bad.TextGrid", "not a TextGrid"), ("worse.textgrid", "not UTF-8")}
    assert df.rdd.getNumPartitions() == 6
    one = df.where("tier = 'ben' AND label <> ''")
    assert {tuple(r) for r in one.collect()} == {w for w in want if w[1] == "ben"}
    path = str(tmp_path / "corpus" / "s1" / "f4.TextGrid")
    assert {tuple(r) for r in df.where(f"path = '{path}' AND label <> ''").collect()} == {w for w in want if w[0] == path}
    reader = textgrid.TextGridReader(str(tmp_path / "corpus"), 64)
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("path",), path), EqualTo(("path",), "y"), EqualTo(("begin",), 1.0), GreaterThan(("tier",), "a")]))
    assert len(left) == 3 and [p.paths for p in reader.partitions()] == [[path]]
    empty = tmp_path / "none"
    empty.mkdir()
    assert spark.read.format("textgrid").load(str(empty)).count() == 0
    with pytest.raises(Exception, match="(?i)no such file|does not exist|not found"):
        spark.read.format("textgrid").load(str(tmp_path / "missing")).count()
