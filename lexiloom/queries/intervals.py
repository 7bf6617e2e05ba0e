"""Interval queries: events are intervals of a user (utterance), their type the label (phone)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import intervals as iv
from .base import query

_SPANS = (
    "SELECT event_id, user_id, event_type AS label, value, ts, epoch_us(ts) AS begin, "
    "epoch_us(ts) + CAST(floor(value * 1000000) AS BIGINT) AS \"end\" FROM events"
)
HOUR = 3_600_000_000


def _spans(t):
    begin = iv.micros("ts")
    return t.events.select(
        "event_id", "user_id", F.col("event_type").alias("label"), "value", "ts", begin.alias("begin"),
        (begin + F.floor(F.col("value") * 1_000_000)).alias("end"),
    )


@query(
    "SELECT event_type, count(*) AS n, round(avg(ln(value)), 6) AS mean, round(stddev_samp(ln(value)), 6) AS sd FROM events WHERE value > 0 GROUP BY event_type"
)
def log_duration_stats(t):
    s = iv.statistics(t.events, "event_type", F.col("value"))
    return s.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


_Z = (
    "WITH s AS (SELECT event_type, avg(ln(value)) AS mean, stddev_samp(ln(value)) AS sd FROM events WHERE value > 0 GROUP BY event_type), "
    "z AS (SELECT e.*, (ln(value) - mean) / nullif(sd, 0) AS z FROM events e JOIN s USING (event_type) WHERE value > 0) "
)


@query(_Z + "SELECT event_id, round(z, 5) AS z FROM z")
def duration_zscores(t):
    z = iv.zscores(t.events, "event_type", F.col("value"))
    return z.select("event_id", F.round("z", 5).alias("z"))


@query(
    _Z + "SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean_value, round(max(abs(z)), 5) AS worst, "
    "round(10 * log10(greatest(avg(value) FILTER (event_type <> 'error'), 2.220446049250313e-16)) - 10 * log10(greatest(coalesce(avg(value) FILTER (event_type = 'error'), min(value)), 2.220446049250313e-16)), 5) AS snr "
    "FROM z GROUP BY user_id"
)
def utterance_quality(t):
    """Worst deviation and signal-to-noise ratio of each utterance."""
    z = iv.zscores(t.events, "event_type", F.col("value"))
    loud = F.avg(F.when(F.col("event_type") != "error", F.col("value")))
    quiet = F.coalesce(F.avg(F.when(F.col("event_type") == "error", F.col("value"))), F.min("value"))
    rows = z.groupBy("user_id").agg(
        F.count("*").alias("n"), F.avg("value").alias("m"), F.max(F.abs("z")).alias("w"), loud.alias("l"), quiet.alias("q")
    )
    return rows.select(
        "user_id", "n", F.round("m", 6).alias("mean_value"), F.round("w", 5).alias("worst"),
        F.round(iv.decibel(F.col("l")) - iv.decibel(F.col("q")), 5).alias("snr"),
    )


_RUNS = (
    "SELECT user_id, min(begin) AS first, max(begin) AS last, count(*) AS n FROM (SELECT *, sum(CASE WHEN state THEN 0 ELSE 1 END) "
    "OVER (PARTITION BY user_id ORDER BY begin, event_id) AS run FROM ({rows})) WHERE state GROUP BY user_id, run"
)


@query(
    "WITH s AS (SELECT event_type, avg(ln(value)) AS mean, stddev_samp(ln(value)) AS sd FROM events WHERE value > 0 GROUP BY event_type), "
    "z AS (SELECT user_id, max(abs((ln(value) - mean) / nullif(sd, 0))) AS w FROM events JOIN s USING (event_type) WHERE value > 0 GROUP BY user_id), "
    "r AS (SELECT user_id, max(n) AS longest FROM (" + _RUNS.format(rows=f"SELECT *, value < 25 AS state FROM ({_SPANS})") + ") GROUP BY user_id), "
    "q AS (SELECT user_id, count(*) AS n, avg(CAST(json_extract(props, '$.k') AS DOUBLE)) AS g, 10 * log10(greatest(avg(value) FILTER (event_type <> 'error'), 2.220446049250313e-16)) "
    "- 10 * log10(greatest(coalesce(avg(value) FILTER (event_type = 'error'), min(value)), 2.220446049250313e-16)) AS snr FROM events GROUP BY user_id) "
    "SELECT user_id, n, round(g, 6) AS mean_goodness, round(snr, 5) AS snr, round(w, 5) AS duration_deviation, round(w, 5) AS power_deviation, coalesce(longest, 0) AS longest_short_run FROM q LEFT JOIN z USING (user_id) LEFT JOIN r USING (user_id)"
)
def utterance_quality_in_full(t):
    """Goodness, deviations, signal-to-noise ratio and short runs of each utterance (here: a value is both a duration and a power)."""
    rows = _spans(t).join(t.events.select("event_id", F.get_json_object("props", "$.k").cast("double").alias("goodness")), "event_id")
    out = iv.utterance_quality(rows, "user_id", "label", ["begin", "event_id"], "value", "value", F.col("label") == "error", "goodness", 25)
    rounded = {c: F.round(c, 5) for c in ("snr", "duration_deviation", "power_deviation")}
    return out.withColumns(rounded | {"mean_goodness": F.round("mean_goodness", 6)})


@query("SELECT user_id, max(n) AS longest FROM (" + _RUNS.format(rows=f"SELECT *, value < 25 AS state FROM ({_SPANS})") + ") GROUP BY user_id")
def max_short_run(t):
    runs = iv.runs(_spans(t), ["user_id"], ["begin", "event_id"], F.col("value") < 25)
    return runs.groupBy("user_id").agg(F.max("n").alias("longest"))


@query(_RUNS.format(rows=f"SELECT *, value >= 40 AS state FROM ({_SPANS})"))
def voiced_runs(t):
    return iv.runs(_spans(t), ["user_id"], ["begin", "event_id"], F.col("value") >= 40).drop("_run")


@query(
    _RUNS.format(
        rows="SELECT *, coalesce(last_value(CASE WHEN value > 60 THEN true WHEN value < 20 THEN false END IGNORE NULLS) "
        f"OVER (PARTITION BY user_id ORDER BY begin, event_id), false) AS state FROM ({_SPANS})"
    )
)
def hysteresis_segments(t):
    return iv.hysteresis(_spans(t), ["user_id"], ["begin", "event_id"], F.col("value"), 60, 20).drop("_run")


@query(
    f"SELECT user_id, covered AS begin, begin AS \"end\", 'sil' AS label FROM (SELECT *, max(\"end\") OVER (PARTITION BY user_id ORDER BY begin, \"end\" "
    f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS covered FROM ({_SPANS})) WHERE covered < begin"
)
def gap_fill_intervals(t):
    return iv.fill_gaps(_spans(t), ["user_id"])


@query(
    f"SELECT user_id, min(begin) AS begin, max(\"end\") AS \"end\", string_agg(label, ' ' ORDER BY begin, \"end\", label) AS labels, count(*) AS n FROM ("
    f"SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY begin, \"end\") AS island FROM (SELECT *, CASE WHEN begin - max(\"end\") OVER "
    f"(PARTITION BY user_id ORDER BY begin, \"end\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {HOUR} THEN 0 ELSE 1 END AS fresh FROM ({_SPANS}))) GROUP BY user_id, island"
)
def merge_close_intervals(t):
    """Neighbours with a small gap become one, as clitics do."""
    return iv.merge_close(_spans(t), ["user_id"], HOUR)


@query()
def merge_segments(t):
    return iv.merge_segments(_spans(t), ["user_id"], 24 * HOUR, 72 * HOUR)


_VIEWS = f"(SELECT event_id AS view_id, user_id, begin, begin + {2 * HOUR} AS \"end\" FROM ({_SPANS}) WHERE label = 'view')"


def _views(t):
    return _spans(t).where("label = 'view'").select(
        F.col("event_id").alias("view_id"), "user_id", "begin", (F.col("begin") + 2 * HOUR).alias("end")
    )


@query(
    f"SELECT p.event_id, v.view_id FROM (SELECT event_id, user_id, begin + (\"end\" - begin) // 2 AS mid FROM ({_SPANS}) WHERE label <> 'view') p "
    f"JOIN {_VIEWS} v ON p.user_id = v.user_id AND p.mid >= v.begin AND p.mid < v.\"end\""
)
def interval_containment(t):
    """Intervals whose midpoint lies in an utterance."""
    points = _spans(t).where("label <> 'view'").select(
        "event_id", "user_id", F.expr("begin + (end - begin) DIV 2").alias("mid")
    )
    return iv.contained(points, _views(t), ["user_id"], "mid", 2 * HOUR).select("event_id", "view_id")


@query(
    f"SELECT event_id, user_id, begin, \"end\" FROM ({_SPANS}) c WHERE label = 'click' AND \"end\" > begin AND NOT EXISTS (SELECT 1 FROM {_VIEWS} v WHERE v.user_id = c.user_id AND c.\"end\" > v.begin AND c.begin < v.\"end\")"
)
def overlap_anti_join(t):
    clicks = _spans(t).where("label = 'click' AND end > begin").select("event_id", "user_id", "begin", "end")
    return iv.without_overlap(clicks, _views(t), ["user_id"], 2 * HOUR)


@query(
    f"WITH s AS ({_SPANS}), v AS (SELECT user_id, begin, max(event_id) AS seen FROM s WHERE label = 'view' GROUP BY user_id, begin) "
    "SELECT p.event_id, coalesce(v.seen, -1) AS seen FROM (SELECT * FROM s WHERE label = 'purchase') p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.begin >= v.begin"
)
def asof_lookup(t):
    s = _spans(t)
    left = s.where("label = 'purchase'").select("event_id", "user_id", "begin")
    right = s.where("label = 'view'").groupBy("user_id", "begin").agg(F.max("event_id").alias("seen"))
    found = iv.as_of(left, right, ["user_id"], "begin", "seen")
    return found.select("event_id", F.coalesce("seen", F.lit(-1).cast("long")).alias("seen"))


@query(
    "SELECT date_trunc('minute', ts) AS minute, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"
)
def event_minute_windows(t):
    w = t.events.groupBy(F.window("ts", "1 minute"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("window.start").alias("minute"), "event_type", "n", "total")


@query(
    "WITH k AS (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS pdf, value FROM events), "
    "w AS (SELECT event_type, pdf, count(*) AS n, avg(value) AS score FROM k GROUP BY event_type, pdf) "
    "SELECT event_type, pdf, n, round(n / sum(n) OVER (PARTITION BY event_type), 6) AS weight, round(max(score) OVER (PARTITION BY pdf) - score, 6) AS gap FROM w"
)
def confidence_from_likelihoods(t):
    """Weights of a label's states and each score's gap to the best label of its state."""
    k = t.events.select("event_type", F.get_json_object("props", "$.k").cast("long").alias("pdf"), "value")
    w = k.groupBy("event_type", "pdf").agg(F.count("*").alias("n"), F.avg("value").alias("score"))
    return w.select(
        "event_type", "pdf", "n",
        F.round(F.col("n") / F.sum("n").over(Window.partitionBy("event_type")), 6).alias("weight"),
        F.round(F.max("score").over(Window.partitionBy("pdf")) - F.col("score"), 6).alias("gap"),
    )


@query(
    f"SELECT event_id, user_id, coalesce(lag(\"end\" + 1000) OVER (PARTITION BY user_id ORDER BY event_id), begin) AS begin, \"end\" + 1000 AS \"end\" FROM ({_SPANS})"
)
def boundary_shift(t):
    return iv.shift_boundaries(_spans(t), ["user_id"], "event_id", F.col("end") + 1000).select("event_id", "user_id", "begin", "end")


@query(
    f"SELECT event_id, (begin - min(begin) OVER (PARTITION BY user_id)) // 10000 AS frame, least(\"end\", begin + 30000000) AS clipped FROM ({_SPANS})"
)
def frame_lookup(t):
    """Frame numbers within the utterance, ends clipped to its limit."""
    first = F.min("begin").over(Window.partitionBy("user_id"))
    return _spans(t).select(
        "event_id", iv.frame_index(F.col("begin"), first).alias("frame"), iv.clip(F.col("end"), F.col("begin") + 30_000_000).alias("clipped")
    )


@query(
    f"SELECT user_id, label, row_number() OVER (PARTITION BY user_id, label ORDER BY begin, event_id) AS disambiguation, event_id FROM ({_SPANS})"
)
def disambiguation_numbers(t):
    w = Window.partitionBy("user_id", "label").orderBy("begin", "event_id")
    return _spans(t).select("user_id", "label", F.row_number().over(w).cast("long").alias("disambiguation"), "event_id")
