"""Sinks: TextGrid, JSON and CSV exports of intervals, lexicons, language models and reports."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import escape_scp
from ..operators.corpus import ranks_within
from ..operators.lexicon import lexicon_lines


def export_rows(
    intervals: DataFrame, silence: tuple[str, ...] = (), gap: float = 0.02, clitics: str = "'", key: tuple[str, ...] = ("file", "tier")
) -> DataFrame:
    """Intervals ready for export: empty ones and silence left out, clitics joined to the word before, ends to six places.

    An interval whose label begins with a clitic mark, or whose neighbour before it ends with one, is joined to that neighbour where
    less than ``gap`` lies between them.
    """
    rows = intervals.where("end > begin")
    if silence:
        rows = rows.where(~F.col("label").isin(*silence))
    if clitics:
        marks = "[" + re.escape(clitics) + "]"
        w = Window.partitionBy(*key).orderBy("begin", "end")
        before = F.lag("label").over(w)
        joins = (F.col("label").rlike(f"^{marks}") | before.rlike(f"{marks}$")) & (F.col("begin") - F.lag("end").over(w) < gap)
        marked = rows.withColumn("_fresh", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
        marked = marked.withColumn("_run", F.sum("_fresh").over(w))
        rest = [c for c in intervals.columns if c not in (*key, "begin", "end", "label")]
        labels = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("begin", "end", "label"))), lambda x: x["label"]), "")
        rows = marked.groupBy(*key, "_run").agg(
            F.min("begin").alias("begin"), F.max("end").alias("end"), labels.alias("label"), *(F.min_by(c, "begin").alias(c) for c in rest)
        ).select(*intervals.columns)
    return rows.withColumns({"begin": F.round("begin", 6), "end": F.round("end", 6)})


def output_path(folder: Column, stem: Column, form: str, root: str = "") -> Column:
    """Where a file's export goes: the same folders below the root, the name with the form's ending."""
    ending = {"long_textgrid": "TextGrid", "short_textgrid": "TextGrid", "json": "json", "csv": "csv", "lab": "lab"}[form]
    return F.concat_ws("/", F.nullif(F.lit(root.rstrip("/")), F.lit("")), F.nullif(folder, F.lit("")), F.concat(stem, F.lit("." + ending)))


def export_forms(utterances: DataFrame) -> DataFrame:
    """file, form, text: ``lab`` with its text where one utterance spans the whole file, else ``long_textgrid`` without one.

    utterances: file, duration, begin, end, text.
    """
    one = utterances.groupBy("file").agg(
        F.count("*").alias("n"), F.min("begin").alias("b"), F.max("end").alias("e"), F.max("duration").alias("d"), F.min("text").alias("text")
    )
    whole = (F.col("n") == 1) & (F.col("b") <= 0) & (F.abs(F.col("e") - F.col("d")) < 0.001)
    return one.select("file", F.when(whole, "lab").otherwise("long_textgrid").alias("form"), F.when(whole, F.col("text")).alias("text"))


def transcription_contents(utterances: DataFrame) -> DataFrame:
    """file, form, content of transcripts (file, duration, speaker, begin, end, text), in the form that export_forms gives."""
    forms = export_forms(utterances)
    tiers = utterances.select("file", "duration", F.col("speaker").alias("tier"), "begin", "end", F.col("text").alias("label"))
    grids = rendered(tiers.join(forms.where("form <> 'lab'").select("file"), "file", "left_semi"))
    plain = forms.where("form = 'lab'").select("file", "form", F.col("text").alias("content"))
    return plain.unionByName(grids.select("file", F.lit("long_textgrid").alias("form"), "content"))


def outdated(contents: DataFrame, written: DataFrame) -> DataFrame:
    """Contents (file, changed) that are not yet written (file, written) or have changed since: what an export still has to do."""
    done = written.groupBy("file").agg(F.max("written").alias("_at"))
    return contents.join(done, "file", "left").where("_at IS NULL OR changed > _at").drop("_at")


def textgrid_text(tiers: dict[str, list[tuple[float, float, str]]], duration: float, short: bool = False) -> str:
    """A TextGrid of interval tiers: gaps filled with empty labels, overlaps cut, the last end snapped."""
    out = ['File type = "ooTextFile"', 'Object class = "TextGrid"', ""]
    say = (lambda name, value: out.append(value)) if short else (lambda name, value: out.append(f"{name} = {value}"))
    quote = lambda x: '"' + x.replace('"', '""') + '"'
    say("xmin", "0")
    say("xmax", f"{duration:g}")
    out.append("<exists>" if short else "tiers? <exists>")
    say("size", str(len(tiers)))
    if not short:
        out.append("item []:")
    for k, (name, intervals) in enumerate(sorted(tiers.items()), 1):
        full, at = [], 0.0
        for begin, end, label in sorted(intervals):
            begin = max(begin, at)
            end = duration if abs(duration - end) < 0.02 else min(end, duration)
            if end <= begin:
                continue
            if begin > at:
                full.append((at, begin, ""))
            full.append((begin, end, label))
            at = end
        if at < duration:
            full.append((at, duration, ""))
        if not short:
            out.append(f"    item [{k}]:")
        for name_, value in (("class", quote("IntervalTier")), ("name", quote(name)), ("xmin", "0"), ("xmax", f"{duration:g}")):
            say(name_, value)
        say("intervals: size", str(len(full)))
        for i, (begin, end, label) in enumerate(full, 1):
            if not short:
                out.append(f"        intervals [{i}]:")
            say("xmin", f"{round(begin, 6)!r}")
            say("xmax", f"{round(end, 6)!r}")
            say("text", quote(label))
    return "\n".join(out) + "\n"


def rendered(intervals: DataFrame, form: str = "long_textgrid") -> DataFrame:
    """file, content: each file's intervals (file, duration, tier, begin, end, label) in a text form.

    form: long_textgrid, short_textgrid, json or csv.
    """

    def render(pdf: pd.DataFrame) -> pd.DataFrame:
        tiers: dict[str, list] = {}
        for row in pdf.sort_values(["tier", "begin", "end"]).itertuples(index=False):
            tiers.setdefault(row.tier, []).append((row.begin, row.end, row.label))
        duration = float(pdf["duration"].max())
        if form == "json":
            body = {"start": 0, "end": duration, "tiers": {k: {"type": "interval", "entries": v} for k, v in tiers.items()}}
            text = json.dumps(body, ensure_ascii=False)
        elif form == "csv":
            text = "Begin,End,Label,Type\n" + "".join(f"{b},{e},{json.dumps(x, ensure_ascii=False)},{k}\n" for k, v in tiers.items() for b, e, x in v)
        else:
            text = textgrid_text(tiers, duration, form == "short_textgrid")
        return pd.DataFrame({"file": [pdf["file"].iloc[0]], "content": [text]})

    return intervals.groupBy("file").applyInPandas(render, "file string, content string")


def write_contents(contents: DataFrame, root: str) -> None:
    """Each file's content below root/file=name, by Spark's writer, so any store works."""
    contents.write.mode("overwrite").partitionBy("file").text(root)


def write_lexicon(lexicon: DataFrame, path: str) -> None:
    """word, known numbers and phones, tab separated, in word order; no entry is left out."""
    lexicon.orderBy("word", F.array_join("phones", " ")).select(lexicon_lines(lexicon).alias("value")).write.mode("overwrite").text(path)


def write_arpa(lines: DataFrame, path: str) -> None:
    """Sections of operators.language_model.arpa_lines in order."""
    head = F.when(F.col("section") == 0, "\\data\\").otherwise(F.format_string("\\%d-grams:", "section"))
    heads = lines.select("section", head.alias("line")).distinct().withColumn("_k", F.lit(0))
    rows = heads.unionByName(lines.withColumn("_k", F.lit(1)))
    end = lines.sparkSession.createDataFrame([(9, "\\end\\", 2)], "section int, line string, _k int")
    rows.unionByName(end).orderBy("section", "_k", "line").select("line").write.mode("overwrite").text(path)


def scp_line(key: Column, values: Column) -> Column:
    return F.concat_ws(" ", escape_scp(key), F.array_join(F.transform(values, lambda x: escape_scp(x)), " "))


def write_scp(rows: DataFrame, path: str) -> None:
    """A table file sorted by key (key, values)."""
    rows.orderBy("key").select(scp_line(F.col("key"), F.col("values"))).write.mode("overwrite").text(path)


def write_report(rows: DataFrame, path: str, *order: Column) -> None:
    """A CSV report with a header."""
    (rows.orderBy(*order) if order else rows).write.mode("overwrite").option("header", "true").csv(path)


def split_lines(utterances: DataFrame) -> dict[str, DataFrame]:
    """The table files of a job split, by name, as lines: spk2utt, utt2spk, text, segments (utterance, speaker, file, begin, end, text)."""
    of = lambda *parts: F.concat_ws(" ", *(escape_scp(F.col(p).cast("string")) if isinstance(p, str) else p for p in parts)).alias("line")
    listed = utterances.groupBy("speaker").agg(F.sort_array(F.collect_list(escape_scp(F.col("utterance").cast("string")))).alias("_u"))
    return {
        "spk2utt": listed.select(of("speaker", F.array_join("_u", " "))),
        "utt2spk": utterances.select(of("utterance", "speaker")),
        "text": utterances.select(of("utterance", F.coalesce("text", F.lit("")))),
        "segments": utterances.select(of("utterance", "file", F.format_string("%.4f", F.col("begin").cast("double")), F.format_string("%.4f", F.col("end").cast("double")))),
    }


def write_split(utterances: DataFrame, root: str) -> None:
    """split_lines below root/name, sorted by line."""
    for name, lines in split_lines(utterances).items():
        lines.orderBy("line").write.mode("overwrite").text(f"{root.rstrip('/')}/{name}")


def write_pronunciations(rows: DataFrame, path: str) -> None:
    """word and pronunciation, tab separated, in order: what pronunciation generation gives."""
    rows.select(F.concat_ws("\t", "word", "pronunciation").alias("line")).orderBy("line").write.mode("overwrite").text(path)


def write_vectors(rows: DataFrame, path: str, vector: str) -> None:
    """Vectors as Parquet, and below path-metadata the other columns as tab separated text with a header."""
    rows.write.mode("overwrite").parquet(path)
    rows.drop(vector).write.mode("overwrite").option("header", "true").option("sep", "\t").csv(path.rstrip("/") + "-metadata")


def write_rules(rules: DataFrame, path: str) -> None:
    """Trained rules as one JSON object a line, the likeliest first."""
    rules.orderBy(F.desc("probability"), "segment", "replacement").select(F.to_json(F.struct(*rules.columns)).alias("line")).write.mode("overwrite").text(path)


def load_intervals(rows: DataFrame, path: str) -> None:
    """Appends intervals to the interval table, a folder a workflow."""
    rows.write.mode("append").partitionBy("workflow_id").parquet(path)


def oov_report(counts: DataFrame) -> DataFrame:
    """dictionary, line of words out of vocabulary with their counts (dictionary, word, n), the most frequent first."""
    ranked = ranks_within(counts, "dictionary", -F.col("n"), F.col("word"))
    return ranked.select("dictionary", (F.col("rank") + 1).alias("place"), F.concat_ws("\t", "word", F.col("n").cast("string")).alias("line"))


def oov_utterances(utterances: DataFrame, oovs: str, *keep: str) -> DataFrame:
    """keep, word: each word out of vocabulary of each utterance (a string of words, blank where there is none)."""
    words = F.filter(F.split(F.coalesce(F.col(oovs), F.lit("")), r"\s+"), lambda x: x != "")
    return utterances.select(*keep, F.explode(words).alias("word"))


def error_lists(files: DataFrame, readable: DataFrame) -> DataFrame:
    """path, problem of files (folder, stem, audio, text, textgrid) that can't be used: missing sound or text, or not readable.

    readable: path, error (null where the file was read).
    """
    missing = files.select(
        F.coalesce("audio", "text", "textgrid").alias("path"),
        F.when(F.col("audio").isNull(), "no sound").when(F.col("text").isNull() & F.col("textgrid").isNull(), "no text").alias("problem"),
    )
    return missing.where("problem IS NOT NULL").unionByName(readable.where("error IS NOT NULL").select("path", F.col("error").alias("problem")))
