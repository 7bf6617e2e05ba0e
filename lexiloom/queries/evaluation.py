"""Queries that compare and describe alignments: events as intervals, users as utterances, event types as labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokens
from ..operators import corpus, intervals, metrics
from ..operators import language_model as lm
from ..operators import vectors as v
from ..sinks import files as sinks
from .base import query, tokens_sql
from .intervals import _SPANS, _spans

_T = tokens_sql()


def _text():
    return tokens(F.col("text"))


@query(
    f"SELECT user_id, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY user_id"
)
def intensity_stats(t):
    """Mean and spread of the intensity of each phone."""
    rows = t.events.where("value IS NOT NULL").groupBy("user_id")
    return rows.agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sd"), F.count("*").alias("n"))


@query(f"SELECT user_id, min(begin) AS begin, max(\"end\") AS \"end\" FROM ({_SPANS}) GROUP BY user_id")
def spans_after_tuning(t):
    return intervals.spans_of(_spans(t), "user_id")


@query("SELECT user_id, count(*) FILTER (event_type = 'error') AS n, count(*) FILTER (event_type = 'error') > 0 AS flagged FROM events GROUP BY user_id")
def flagged_utterances(t):
    """Utterances with the number of their failed parts, and whether there is any."""
    failed = F.sum((F.col("event_type") == "error").cast("long"))
    return t.events.groupBy("user_id").agg(failed.alias("n")).withColumn("flagged", F.col("n") > 0)


@query("SELECT event_type AS workflow, round(sum(value) / count(*), 6) AS mean_loglik, round(avg(value / (user_id + 1)), 6) AS mean_per_frame FROM events GROUP BY event_type")
def workflow_likelihoods(t):
    """Mean likelihood of each workflow, by utterance and by frame."""
    return t.events.groupBy(F.col("event_type").alias("workflow")).agg(
        F.round(F.sum("value") / F.count("*"), 6).alias("mean_loglik"), F.round(F.avg(F.col("value") / (F.col("user_id") + 1)), 6).alias("mean_per_frame")
    )


@query(
    f"WITH s AS ({_SPANS}), o AS (SELECT user_id, event_id, begin AS b, \"end\" + 3600000000 AS e FROM s WHERE event_id % 3 = 0) "
    "SELECT s.event_id, o.event_id AS outer_id FROM s JOIN o ON s.user_id = o.user_id AND s.begin >= b AND s.\"end\" <= e"
)
def interval_inside(t):
    """Intervals that lie wholly within an utterance (here: an hour from every third event)."""
    rows = _spans(t).select("user_id", "event_id", "begin", "end")
    outer = rows.where("event_id % 3 = 0").select("user_id", F.col("event_id").alias("outer_id"), "begin", (F.col("end") + 3_600_000_000).alias("end"))
    return intervals.inside(rows, outer, ["user_id"], 3_600_000_000, "outer_id").select("event_id", "outer_id")


@query(
    f"WITH s AS ({_SPANS}), c AS (SELECT * FROM s WHERE label = 'error' AND \"end\" > begin) SELECT user_id, begin, \"end\", label FROM s WHERE label <> 'error' AND NOT EXISTS (SELECT 1 FROM c WHERE c.user_id = s.user_id AND s.\"end\" > c.begin AND s.begin < c.\"end\") "
    "UNION ALL SELECT user_id, begin, \"end\", 'spn' FROM c"
)
def cutoff_masks(t):
    """Phones under a cut-off word give way to one unknown phone."""
    rows = _spans(t).select("user_id", "begin", "end", "label")
    return intervals.mask_cutoffs(rows.where("label <> 'error'"), rows.where("label = 'error'"), ["user_id"], 3_600_000_000)


@query(
    f"WITH s AS (SELECT user_id, begin, greatest(\"end\", begin + 1) AS \"end\" FROM ({_SPANS})), g AS (SELECT *, max(\"end\") OVER (PARTITION BY user_id ORDER BY begin, \"end\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM s), "
    "k AS (SELECT user_id, min(begin) AS b, max(\"end\") AS e FROM s GROUP BY user_id) SELECT user_id, c AS begin, begin AS \"end\", 'sil' AS label FROM g WHERE c < begin UNION ALL SELECT user_id, b - 1000, b, 'sil' FROM k UNION ALL SELECT user_id, e, e + 500, 'sil' FROM k"
)
def gap_fill_edges(t):
    """Silence between intervals and up to the bounds of the utterance."""
    rows = _spans(t).select("user_id", "begin", F.greatest("end", F.col("begin") + 1).alias("end"))
    edges = rows.groupBy("user_id").agg((F.min("begin") - 1000).alias("first"), (F.max("end") + 500).alias("last"))
    return intervals.fill_gaps(rows, ["user_id"], edges=edges)


@query(f"SELECT doc_id, j - 1 AS place, a[j] AS label, (j - 1) * n_chars // len(a) AS first, j * n_chars // len(a) - 1 AS last FROM (SELECT doc_id, n_chars, a, unnest(range(1, len(a) + 1)) AS j FROM (SELECT doc_id, n_chars, {_T} AS a FROM documents))")
def equal_alignment(t):
    """Characters as frames dealt evenly over the words."""
    rows = t.documents.select("doc_id", "n_chars", _text().alias("words"))
    out = intervals.equal_alignment(rows, "n_chars", "words")
    return out.select("doc_id", F.col("place").cast("long").alias("place"), "label", "first", "last")


@query(
    "WITH e AS (SELECT vec_id, label, i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) r(i)), s AS (SELECT label, i, avg(x) AS m, stddev_pop(x) AS s FROM e GROUP BY ALL) "
    "SELECT vec_id, i - 1 AS i, round(CASE WHEN s > 0 THEN (x - m) / s ELSE 0 END, 5) AS x FROM e JOIN s USING (label, i)"
)
def speaker_normalized(t):
    """Mean and variance normalisation by speaker."""
    rows = t.embeddings.withColumn("x", F.transform("embedding", lambda a: a.cast("double")))
    out = intervals.mean_variance_normalized(rows, "label", "x").select("vec_id", F.posexplode("normalized").alias("i", "x"))
    return out.select("vec_id", F.col("i").cast("long").alias("i"), F.round("x", 5).alias("x"))


def _shaken(t):
    """Reference and hypothesis: events in seconds, the hypothesis with another label on some, some missing, all a little later."""
    rows = _spans(t).select("user_id", "event_id", (F.col("begin") / 1e6).alias("begin"), (F.col("end") / 1e6).alias("end"), "label")
    hyp = rows.where("event_id % 17 <> 0").withColumn("label", F.when(F.col("event_id") % 11 == 0, F.lit("view")).otherwise(F.col("label")))
    return rows.drop("event_id"), hyp.withColumns({"begin": F.col("begin") + 0.01, "end": F.col("end") + 0.02}).drop("event_id")


@query()
def alignment_evaluation(t):
    """Error rate and mean boundary error of a whole corpus."""
    totals = metrics.alignment_totals(metrics.aligned_pairs(*_shaken(t), "user_id"))
    return totals.withColumns({"mean_overlap": F.round("mean_overlap", 6), "error_rate": F.round("error_rate", 6)})


@query()
def phone_confusions(t):
    """Confusions of aligned phones, with up to five utterances each."""
    return metrics.confusion_examples(metrics.aligned_pairs(*_shaken(t), "user_id"), "user_id")


@query()
def boundary_precision_recall(t):
    return metrics.boundary_report(*(x.select("user_id", "end") for x in _shaken(t)), "user_id", 0.025)


@query(
    f"WITH w AS (SELECT user_id, list(label ORDER BY begin, \"end\", label) AS a FROM ({_SPANS}) WHERE \"end\" - begin > 30000 AND label <> 'error' GROUP BY user_id), "
    f"x AS (SELECT user_id, list(label ORDER BY begin, \"end\", label) AS b FROM ({_SPANS}) GROUP BY user_id) SELECT x.user_id, len(b) AS n_text, coalesce(len(a), 0) AS n_aligned, a IS DISTINCT FROM b AS changed FROM x LEFT JOIN w USING (user_id)"
)
def transcript_verification(t):
    """Words of intervals that are long enough against the transcript."""
    rows = _spans(t).select("user_id", "begin", "end", "label")
    text = rows.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("begin", "end", "label"))), lambda x: x["label"]).alias("words"))
    out = metrics.verified(rows, text, "user_id", 30_000, ("error",))
    return out.select("user_id", F.size("text").cast("long").alias("n_text"), F.size("aligned").cast("long").alias("n_aligned"), "changed")


@query(
    "WITH s AS (SELECT value AS s, count(*) FILTER (event_type = 'purchase') AS m, count(*) FILTER (event_type <> 'purchase') AS u FROM events WHERE value IS NOT NULL GROUP BY value), "
    "r AS (SELECT s, coalesce(sum(m) OVER w, 0) / sum(m) OVER () AS frr, 1 - coalesce(sum(u) OVER w, 0) / sum(u) OVER () AS far FROM s WINDOW w AS (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) "
    "SELECT round((frr + far) / 2, 9) AS eer, s AS threshold FROM r ORDER BY abs(frr - far), s LIMIT 1"
)
def equal_error_rate(t):
    """Purchases as matched pairs, the value as their score; every score is tried."""
    pairs = t.events.select((F.col("event_type") == "purchase").alias("matched"), F.col("value").alias("score"))
    return v.equal_error_rate(pairs).select(F.round("eer", 9).alias("eer"), "threshold")


@query(
    "WITH t AS (SELECT event_type AS p, user_id % 7 AS q, count(*) AS n FROM events GROUP BY ALL), z AS (SELECT sum(n) AS z FROM t), a AS (SELECT p, sum(n) AS a FROM t GROUP BY p), b AS (SELECT q, sum(n) AS b FROM t GROUP BY q), "
    "h AS (SELECT (SELECT -sum(a / z * ln(a / z)) FROM a, z) AS ha, (SELECT -sum(b / z * ln(b / z)) FROM b, z) AS hb, (SELECT sum(n / z * ln(n * z / (a * b))) FROM t JOIN a USING (p) JOIN b USING (q), z) AS mi), "
    "c AS (SELECT z::DOUBLE AS z, a::DOUBLE AS a, b::DOUBLE AS b, unnest(range(CAST(greatest(1, a + b - z) AS BIGINT), CAST(least(a, b) AS BIGINT) + 1))::DOUBLE AS k FROM a, b, z), "
    "e AS (SELECT sum(k / z * ln(z * k / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(z - a + 1) + lgamma(z - b + 1) - lgamma(z + 1) - lgamma(k + 1) - lgamma(a - k + 1) - lgamma(b - k + 1) - lgamma(z - a - b + k + 1))) AS emi FROM c) "
    "SELECT round((mi - emi) / ((ha + hb) / 2 - emi), 6) AS adjusted_mutual_information FROM h, e"
)
def adjusted_mutual_information(t):
    table = v.contingency(t.events.select("event_type", (F.col("user_id") % 7).alias("part")), "event_type", "part")
    out = v.adjusted_mutual_information(table, "event_type", "part")
    return out.select(F.round("adjusted_mutual_information", 6).alias("adjusted_mutual_information"))


@query(
    "WITH c AS (SELECT value AS d, row_number() OVER (ORDER BY value, event_id) - 1 AS i FROM events), z AS (SELECT min(d) AS lo, max(d) AS hi, max(i) AS n FROM c) "
    "SELECT i AS rank, d AS distance FROM c, z ORDER BY i / n - (d - lo) / (hi - lo) DESC, i LIMIT 1"
)
def curve_knee(t):
    """The knee of a sorted curve (here: of event values)."""
    return v.knee(t.events.select("event_id", "value"), "value", "event_id").withColumnRenamed("value", "distance")


@query(
    f"WITH p AS (SELECT user_id, list_concat(['<s>'], list(label ORDER BY begin, label), ['</s>']) AS a FROM ({_SPANS}) GROUP BY user_id) "
    "SELECT x[1] || ' ' || x[2] || ' ' || x[3] AS ngram, count(*) AS n FROM (SELECT unnest(list_zip(a, a[2:], a[3:])) AS x FROM p) WHERE x[3] IS NOT NULL GROUP BY ALL"
)
def phone_trigrams(t):
    """Counts of a phone language model from aligned phones."""
    return lm.label_ngrams(_spans(t).select("user_id", "begin", "label"), "user_id", 3)


@query(
    f"SELECT source, x[1] || ' ' || x[2] AS ngram, count(*) AS n FROM (SELECT source, unnest(list_zip(a, a[2:])) AS x FROM (SELECT source, {_T} AS a FROM documents)) WHERE x[2] IS NOT NULL GROUP BY ALL"
)
def speaker_bigrams(t):
    """Bigram counts of every speaker's own language model."""
    return lm.ngram_counts(t.documents, _text(), 2, "source")


@query(
    "SELECT user_id, n, begin_ AS begin, end_ AS \"end\" FROM (SELECT user_id, count(*) AS n, min(begin) AS begin_, max(\"end\") AS end_ FROM (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY begin, \"end\", event_id) AS r FROM "
    f"(SELECT *, CASE WHEN (label[1] = 'v' OR lag(label) OVER w = 'error') AND begin - lag(\"end\") OVER w < 7200000000 THEN 0 ELSE 1 END AS f FROM ({_SPANS}) WHERE \"end\" > begin WINDOW w AS (PARTITION BY user_id ORDER BY begin, \"end\", event_id))) GROUP BY user_id, r)"
)
def clitic_export(t):
    """Intervals ready for export: clitics (labels in v, and what follows an error) joined to the word before."""
    mark = F.when(F.col("label").startswith("v"), F.concat(F.lit("'"), "label")).when(F.col("label") == "error", F.lit("error'")).otherwise(F.col("label"))
    rows = _spans(t).select(F.col("user_id").alias("file"), F.lit("t").alias("tier"), "begin", "end", mark.alias("label"), F.lit(1).alias("one"))
    out = sinks.export_rows(rows, gap=7_200_000_000)
    n = F.size(F.split(F.regexp_replace("label", "(view|error|click|signup|purchase)", "$1,"), ",")) - 1
    return out.select(F.col("file").alias("user_id"), n.cast("long").alias("n"), F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end"))


@query("SELECT conv_id, n, CASE WHEN n = 1 THEN 'lab' ELSE 'long_textgrid' END AS form FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)")
def export_forms(t):
    """Conversations of one turn go to a plain transcript, the others to interval files."""
    rows = t.conversations.select(F.col("conv_id").alias("file"), (F.col("turn") * 1.0).alias("at"), "text")
    first = F.min("at").over(Window.partitionBy("file"))
    last = F.max("at").over(Window.partitionBy("file")) + 1 - first
    rows = rows.select("file", (F.col("at") - first).alias("begin"), (F.col("at") + 1 - first).alias("end"), last.alias("duration"), "text")
    sizes = rows.groupBy("file").agg(F.count("*").alias("n"))
    return sinks.export_forms(rows).join(sizes, "file").select(F.col("file").alias("conv_id"), "n", "form")


@query(
    "SELECT 'utt2spk' AS name, concat_ws(' ', doc_id, source) AS line FROM documents UNION ALL SELECT 'text', concat_ws(' ', doc_id, coalesce(text, '')) FROM documents "
    "UNION ALL SELECT 'segments', concat_ws(' ', doc_id, lang, '0.0000', printf('%.4f', n_chars::DOUBLE)) FROM documents "
    "UNION ALL SELECT 'spk2utt', concat_ws(' ', source, string_agg(doc_id::VARCHAR, ' ' ORDER BY doc_id::VARCHAR)) FROM documents GROUP BY source"
)
def job_split_files(t):
    """All lines of the table files of a job split."""
    rows = t.documents.select(F.col("doc_id").alias("utterance"), F.col("source").alias("speaker"), F.col("lang").alias("file"), F.lit(0).alias("begin"), F.col("n_chars").alias("end"), "text")
    files = [lines.select(F.lit(name).alias("name"), "line") for name, lines in sinks.split_lines(rows).items()]
    return reduce(DataFrame.unionByName, files)


@query(
    f"SELECT dictionary, row_number() OVER (PARTITION BY dictionary ORDER BY n DESC, encode(word)) AS place, word || chr(9) || n AS line FROM (SELECT lang AS dictionary, word, count(*) AS n FROM (SELECT lang, unnest({_T}) AS word FROM documents) "
    f"WHERE word NOT IN (SELECT unnest({_T}) FROM benchmark) GROUP BY ALL)"
)
def oov_report(t):
    """Words out of vocabulary by dictionary, the most frequent first."""
    words = t.benchmark.select(F.explode(_text()).alias("word"))
    counts = corpus.out_of_vocabulary(corpus.word_counts(t.documents, _text(), "lang"), words)
    return sinks.oov_report(counts.withColumnRenamed("lang", "dictionary"))


@query(f"SELECT doc_id, word FROM (SELECT doc_id, unnest({_T}) AS word FROM documents) WHERE word NOT IN (SELECT unnest({_T}) FROM benchmark)")
def oov_utterances(t):
    """One row a word out of vocabulary (here: of the benchmark's words) of an utterance."""
    vocabulary = t.benchmark.select(F.explode(_text()).alias("word"))
    return corpus.unknown_words(t.documents, _text(), vocabulary, "doc_id")
