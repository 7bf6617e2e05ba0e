"""Queries that choose utterances: documents as utterances, source as speaker, quality as made by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import selection
from .base import query, tokens_sql

_T = tokens_sql()
_ROWS = "SELECT d.*, coalesce(quality, 0) AS manual FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id)"


def _rows(t):
    flags = t.labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return t.documents.join(flags, "doc_id", "left").withColumn("manual", F.coalesce("quality", F.lit(0))).drop("quality")


@query(
    "SELECT event_id, coalesce(CASE WHEN event_type = 'signup' THEN value < 20 ELSE value > 150 OR user_id <= 3 END, false) AS wrong FROM events"
)
def likely_errors(t):
    """Events as alignments: a sign-up is by hand, the value its likelihood or deviation, the user its signal to noise."""
    manual, value = F.col("event_type") == "signup", F.col("value")
    wrong = selection.likely_error(manual, value - 1020, value / 15, F.col("user_id") - 2)
    return t.events.select("event_id", wrong.alias("wrong"))


@query(f"SELECT doc_id FROM ({_ROWS}) WHERE manual = 1 OR coalesce(n_chars <= 2000, true)")
def good_enough_utterances(t):
    rows = _rows(t).withColumns({"by_hand": F.col("manual") == 1, "deviation": F.col("n_chars").cast("double")})
    return selection.good_enough(rows, "by_hand", "deviation", 2000.0).select("doc_id")


@query("SELECT page_id, CASE WHEN starts_with(url, 'https://www') THEN 8 ELSE 16 END AS rate FROM pages")
def prefix_override(t):
    """A parameter changed for the files below one path."""
    rows = t.pages.select("page_id", "url", F.lit(16).alias("rate"))
    return selection.override(rows, "url", "https://www", rate=8).select("page_id", "rate")


@query("SELECT count(*) FILTER (trim(coalesce(text, '')) = '') AS n_blank, count(*) FILTER (trim(coalesce(text, '')) <> '') AS n_oov FROM documents")
def ignored_split(t):
    blank, oov = selection.split_ignored(t.documents, "text")
    return blank.agg(F.count("*").alias("n_blank")).crossJoin(oov.agg(F.count("*").alias("n_oov")))  # one row each


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100 OFFSET 100")
def second_page(t):
    return selection.page(t.documents.select("doc_id"), 100, 1, "doc_id")


@query(
    f"SELECT doc_id, manual FROM (SELECT * FROM ({_ROWS}) ORDER BY manual DESC, n_chars, doc_id LIMIT 400) ORDER BY manual DESC, md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT 40"
)
def two_stage_sample(t):
    return selection.two_stage(_rows(t), 40, "manual", "n_chars", "doc_id").select("doc_id", "manual")


_QUOTA = (
    "WITH RECURSIVE e AS (" + _ROWS + "), c AS (SELECT lang, n, row_number() OVER (ORDER BY n, lang) AS i, count(*) OVER () AS m FROM (SELECT lang, count(*) AS n FROM e GROUP BY lang)), "
    "a AS (SELECT i, lang, least(n, 120 // m) AS quota, 120 - least(n, 120 // m) AS rest FROM c WHERE i = 1 UNION ALL "
    "SELECT c.i, c.lang, least(c.n, a.rest // (c.m - c.i + 1)), a.rest - least(c.n, a.rest // (c.m - c.i + 1)) FROM a JOIN c ON c.i = a.i + 1), "
    "p AS (SELECT * FROM (SELECT e.*, quota, row_number() OVER (PARTITION BY lang ORDER BY manual DESC, n_chars, doc_id) AS k FROM e JOIN a USING (lang)) WHERE k <= 10 * quota), "
    "s AS (SELECT * FROM (SELECT * EXCLUDE (k), row_number() OVER (PARTITION BY lang ORDER BY manual DESC, md5(CAST(doc_id AS VARCHAR)), doc_id) AS k FROM p) WHERE k <= quota), "
    "g AS (SELECT source FROM s GROUP BY source HAVING count(*) >= 5), kept AS (SELECT doc_id FROM s WHERE source IN (FROM g)) "
)


@query(
    _QUOTA + "SELECT doc_id FROM kept UNION ALL SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY manual DESC, n_chars, doc_id) AS k FROM e WHERE source IN (FROM g) "
    "AND doc_id NOT IN (FROM kept)) WHERE k <= (SELECT count(*) FROM s) - (SELECT count(*) FROM kept)"
)
def training_subset(t):
    """The whole procedure: quotas, two stages, small speakers out, filled up."""
    return selection.training_subset(_rows(t), 120, "lang", "source", "manual", "n_chars", "doc_id").select("doc_id")


@query(
    f"WITH w AS (SELECT doc_id, {_T} AS a FROM documents), v AS (SELECT DISTINCT unnest({_T}) AS word FROM benchmark) SELECT doc_id FROM w WHERE len(a) >= 3 AND len(list_intersect(a, (SELECT list(word) FROM v))) > 0"
)
def eligible_with_vocabulary(t):
    words = t.benchmark.select(F.explode(tokens(F.col("text"))).alias("word"))
    return selection.eligible_texts(t.documents, tokens(F.col("text")), words, 3, "doc_id").select("doc_id")
