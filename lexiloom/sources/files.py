"""Corpus files: directory scans, transcripts, TextGrids, CTM, lexicons, scp tables, wave headers."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import nfkc, unescape_scp
from ..operators.language_model import parse_arpa
from ..operators.lexicon import parse_lines

AUDIO = ("wav", "flac", "ogg", "aiff", "mp3", "opus")
INTERVALS = "path string, tier string, begin double, end double, label string, error string"


def scan(spark: SparkSession, root: str, speaker_characters: int = 0) -> DataFrame:
    """path, folder, stem, extension, speaker of every file below a folder, hidden folders left out.

    The speaker is the parent folder, or the first characters of the name. Listing and reading are
    split over tasks by Spark; contents are read only if asked for.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    rows = files.where(~F.col("path").rlike(r"/\.[^/]+/")).select("path", name.alias("_name"), F.element_at(parts, -2).alias("folder"), "content")
    stem = F.regexp_replace("_name", r"\.[^.]*$", "")
    speaker = F.substring("_name", 1, speaker_characters) if speaker_characters else F.col("folder")
    return rows.select(
        "path", "folder", stem.alias("stem"), F.lower(F.regexp_extract("_name", r"\.([^.]*)$", 1)).alias("extension"),
        speaker.alias("speaker"), "content",
    )


def utterance_files(files: DataFrame) -> DataFrame:
    """folder, stem, speaker, audio, text, textgrid: one row a stem; a .lab file wins over a .txt."""
    of = lambda *kinds: F.min(F.when(F.col("extension").isin(*kinds), F.col("path")))
    return files.groupBy("folder", "stem", "speaker").agg(
        F.coalesce(of("wav"), of(*AUDIO)).alias("audio"),
        F.coalesce(of("lab"), of("txt")).alias("text"),
        of("textgrid").alias("textgrid"),
    )


def transcripts(files: DataFrame) -> DataFrame:
    """path, speaker, text (NFKC) of the .lab and .txt files."""
    text = F.regexp_replace(F.decode("content", "UTF-8"), r"^\s+|\s+$", "")
    return files.where(F.col("extension").isin("lab", "txt")).select("path", "speaker", nfkc(text).alias("text"))


def parse_textgrid(text: str) -> list[tuple[str, float, float, str]]:
    """(tier, begin, end, label) of the intervals of a TextGrid in long or short form."""
    body = text.lstrip("﻿")
    tokens = re.findall(r'"(?:[^"]|"")*"|[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?(?![^\s\]])|<exists>', re.sub(r"\[\d*\]|(?m:^!.*$)", "", body))
    values = [t[1:-1].replace('""', '"') if t[0] == '"' else t if t == "<exists>" else float(t) for t in tokens]
    at = values.index("<exists>") + 1
    n_tiers, at = int(values[at]), at + 1
    out = []
    for _ in range(n_tiers):
        kind, name, n = values[at], values[at + 1], int(values[at + 4])
        at += 5
        for _ in range(n):
            if kind == "IntervalTier":
                out.append((name, values[at], values[at + 1], values[at + 2].strip()))
                at += 3
            else:
                out.append((name, values[at], values[at], values[at + 1].strip()))
                at += 2
    return out


def textgrid_intervals(files: DataFrame) -> DataFrame:
    """path, tier, begin, end, label, error of all TextGrids; a file that can't be read gives one row with the error's kind."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += [(path, *x, None) for x in parse_textgrid(bytes(content).decode("utf-8-sig"))]
                except UnicodeDecodeError:
                    rows.append((path, None, None, None, None, "not UTF-8"))
                except (ValueError, IndexError, TypeError, AttributeError):
                    rows.append((path, None, None, None, None, "not a TextGrid"))
            yield pd.DataFrame(rows, columns=["path", "tier", "begin", "end", "label", "error"])

    return files.where("extension = 'textgrid'").select("path", "content").mapInPandas(read, INTERVALS)


def aligned_intervals(intervals: DataFrame, shortest: float = 0.01) -> DataFrame:
    """path, speaker, level (word or phone), begin, end, label of tiers named ``speaker - words``."""
    rows = intervals.where(F.col("tier").rlike(r"(?i)^(.*) ?- ?(phone|word)s?$") & (F.col("end") - F.col("begin") >= shortest))
    return rows.select(
        "path",
        F.trim(F.regexp_extract("tier", r"(?i)^(.*?) ?- ?(phone|word)s?$", 1)).alias("speaker"),
        F.lower(F.regexp_extract("tier", r"(?i)^(.*?) ?- ?(phone|word)s?$", 2)).alias("level"),
        "begin", "end", "label",
    )


ALIGNED_TIER = r"(?i)(^| ?- ?)(phone|word)s?$"


def utterances(intervals: DataFrame, durations: DataFrame | None = None) -> DataFrame:
    """Speaker tiers as utterances: non-empty, cut to the file's duration (path, duration), to four places, text in NFKC.

    Tiers of words and phones hold alignments, not utterances (``aligned_intervals``).
    """
    rows = intervals.where(F.col("tier").isNotNull() & (F.col("label") != "") & ~F.col("tier").rlike(ALIGNED_TIER))
    if durations is not None:
        rows = rows.join(durations.select("path", "duration"), "path", "left").withColumn("end", F.least("end", F.coalesce("duration", "end")))
    rows = rows.where("begin < end")
    return rows.select("path", F.col("tier").alias("speaker"), F.round("begin", 4).alias("begin"), F.round("end", 4).alias("end"), nfkc(F.col("label")).alias("text"))


def corpus_utterances(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(utterances, errors) of a scanned corpus: sound headers, texts and TextGrids joined by folder and name.

    utterances: path (of the text), speaker, begin, end, text, audio, duration. A .lab or .txt file is one utterance over the whole sound;
    a TextGrid has one for each interval of a speaker's tier. errors: path, problem.
    """
    joined = utterance_files(files)
    heads = wave_headers(files).select(F.col("path").alias("audio"), "duration")
    joined = joined.join(heads, "audio", "left")
    texts = transcripts(files).select(F.col("path").alias("text"), F.col("text").alias("_said"))
    whole = joined.where("textgrid IS NULL AND text IS NOT NULL").join(texts, "text")
    whole = whole.select(F.col("text").alias("path"), "speaker", F.lit(0.0).alias("begin"), F.col("duration").alias("end"), F.col("_said").alias("text"), "audio", "duration")
    grids = textgrid_intervals(files)
    owned = joined.where("textgrid IS NOT NULL").select(F.col("textgrid").alias("path"), "audio", "duration")
    spoken = utterances(grids, owned).join(owned, "path")
    broken = grids.where("error IS NOT NULL").select("path", F.col("error").alias("problem"))
    unheard = joined.where("audio IS NULL").select(F.coalesce("text", "textgrid").alias("path"), F.lit("no sound").alias("problem"))
    unsaid = joined.where("text IS NULL AND textgrid IS NULL").select(F.col("audio").alias("path"), F.lit("no text").alias("problem"))
    unread = joined.where("audio LIKE '%.wav' AND duration IS NULL").select(F.col("audio").alias("path"), F.lit("broken sound").alias("problem"))
    return whole.unionByName(spoken), broken.unionByName(unheard).unionByName(unsaid).unionByName(unread)


def read_ctm(spark: SparkSession, path: str) -> DataFrame:
    """utterance, intervals in order, from lines ``utterance channel begin duration label [confidence]``."""
    parts = F.split(F.trim("value"), r"\s+")
    begin = F.get(parts, 2).cast("double")
    rows = spark.read.text(path).where("trim(value) <> ''").select(
        F.get(parts, 0).alias("utterance"),
        F.struct(
            begin.alias("begin"), (begin + F.get(parts, 3).cast("double")).alias("end"), F.get(parts, 4).alias("label"), F.get(parts, 5).cast("double").alias("confidence")
        ).alias("interval"),
    )
    return rows.groupBy("utterance").agg(F.sort_array(F.collect_list("interval")).alias("intervals"))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a pronunciation lexicon; repeated (word, phones) once."""
    return parse_lines(spark.read.text(path)).dropDuplicates(["word", "phones"])


def read_arpa(spark: SparkSession, path: str) -> DataFrame:
    """N-grams of an ARPA file, read in splits."""
    return parse_arpa(spark.read.text(path))


def read_scp(spark: SparkSession, path: str) -> DataFrame:
    """key, values of a table file; escaped spaces come back."""
    parts = F.split(F.trim("value"), " ")
    return spark.read.text(path).where("trim(value) <> ''").select(
        unescape_scp(F.get(parts, 0)).alias("key"), F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: unescape_scp(x)).alias("values")
    )


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """source, target of a YAML mapping with single or listed values (a small driver-side file)."""
    import yaml

    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    pairs = [(str(k), str(x)) for k, v in (yaml.safe_load(text) or {}).items() for x in (v if isinstance(v, list) else [v])]
    return spark.createDataFrame(pairs, "source string, target string")


def wave_headers(files: DataFrame) -> DataFrame:
    """path, channels, sample_rate, duration of RIFF wave files; nulls where the header is broken."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                raw, at, found = bytes(content), 12, {}
                while raw[:4] == b"RIFF" and at + 8 <= len(raw) and "duration" not in found:
                    name, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
                    if name == b"fmt " and at + 24 <= len(raw):
                        found["channels"], found["sample_rate"], rate = struct.unpack_from("<HII", raw, at + 10)
                        found["rate"] = rate
                    elif name == b"data" and found.get("rate"):
                        found["duration"] = min(size, len(raw) - at - 8) / found["rate"]
                    at += 8 + size + size % 2
                rows.append((path, found.get("channels"), found.get("sample_rate"), found.get("duration")))
            yield pd.DataFrame(rows, columns=["path", "channels", "sample_rate", "duration"]).astype({"channels": "Int64", "sample_rate": "Int64"})

    wav = files.where("extension = 'wav'").select("path", "content")
    return wav.mapInPandas(read, "path string, channels long, sample_rate long, duration double")
