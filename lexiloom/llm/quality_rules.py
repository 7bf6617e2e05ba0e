"""Quality rules with adaptive thresholds (operator 13).

Each language and source gets thresholds from its own distribution. The distributions are quantile sketches that merge: counts of
logarithmic bins (DDSketch), so that a quantile's relative error is at most ACCURACY and merging is adding counts, in any order and with the same
result. Documents then meet their group's thresholds in a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, text_bytes, tidy, unused

_SPACES = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"
#: Bytes 128 to 191 continue a code point.
_NO_START = _SPACES + bytes(range(128, 192))

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

ACCURACY = 0.01
GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
#: The bin of zero, below all others.
ZERO_BIN = -1_000_000

#: Measures: name, numerator, denominator, the least spread, and whether low values fail too.
MEASURES = (
    ("symbols_a_word", "n_symbols", "n_words", 0.03, False),
    ("chars_a_word", "word_chars", "n_words", 0.25, True),
    ("duplicate_lines", "n_dup_lines", "n_lines", 0.06, False),
    ("repeated_words", "n_repeat_words", "n_words", 0.05, False),
)


def repeated_words(tokens: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more, the first one included."""
    if len(tokens) < 4:
        return 0
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(t, len(names)) for t in tokens), np.int64, len(tokens))
    _, pairs = np.unique(ids[:-1] * len(names) + ids[1:], return_inverse=True)
    _, window, times = np.unique(pairs[:-1] * len(names) + ids[2:], return_inverse=True, return_counts=True)
    starts = np.concatenate([times[window] > 1, [False, False]])
    covered = starts.copy()
    covered[1:] |= starts[:-1]
    covered[2:] |= starts[:-2]
    return int(covered.sum())


def text_counts(raw: bytes) -> tuple[int, ...]:
    """COUNTS of a text in UTF-8."""
    tokens = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return (
        len(tokens),
        len(raw.translate(None, _NO_START)),
        len(raw) - len(raw.translate(None, _SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(tokens),
    )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = list(zip(*map(text_counts, batch.column(batch.num_columns - 1).to_pylist()), strict=True))
        columns = [*batch.columns[:-1], *(pa.array(c, pa.int64()) for c in counts or [[]] * len(COUNTS))]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], *COUNTS])


def document_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and COUNTS of every whole text (column text; null: empty)."""
    rows = docs.select(*keep, text_bytes().alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(tidy(_count), schema + "".join(f", {c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _value(numerator: str, denominator: str) -> Column:
    """Null where the denominator is 0."""
    return F.try_divide(F.col(numerator).cast("double"), F.col(denominator).cast("double"))


def sketches(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, measure, bin, n: the sketch of each measure in each group, one row a bin. Counts are summed before the shuffle."""
    values = [F.struct(F.lit(name).alias("measure"), _value(a, b).alias("v")) for name, a, b, _, _ in MEASURES]
    flat = rows.select(*keys, F.inline(F.array(*values))).where(F.col("v").isNotNull())
    bin_ = F.when(F.col("v") > 0, F.ceil(F.log("v") / float(np.log(GAMMA)))).otherwise(F.lit(ZERO_BIN).cast("long"))
    return flat.select(*keys, "measure", bin_.alias("bin")).groupBy(*keys, "measure", "bin").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, *keys: str) -> DataFrame:
    """The sketches of coarser groups."""
    return sketch.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str], *shares: float) -> DataFrame:
    """keys, measure, size and q0, q1, ...: for each share the value whose bin holds the row of rank floor(share * (size - 1)).

    A window is one sketch: no more rows than it has bins, whatever the size of the group.
    """
    group = Window.partitionBy(*keys, "measure")
    upto = F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    rows = sketch.select("*", upto.alias("_upto"), F.sum("n").over(group).alias("size"))
    middle = F.when(F.col("bin") == ZERO_BIN, F.lit(0.0)).otherwise(2 * F.pow(F.lit(GAMMA), F.col("bin").cast("double")) / (GAMMA + 1))
    found = [F.min(F.when(F.col("_upto") > F.floor(F.lit(s) * (F.col("size") - 1)), middle)).alias(f"q{i}") for i, s in enumerate(shares)]
    return rows.groupBy(*keys, "measure", "size").agg(*found)


def thresholds(counts: DataFrame, least: int = 50, reach: float = 8.0) -> DataFrame:
    """lang, source, measure, size, level, low and high: the limits of every group that occurs.

    A group's limits are its median plus and minus ``reach`` times the distance between its tenth and fiftieth hundredth, or the
    measure's least spread where that is larger. The lower half sets the scale, as rubbish with many symbols or long words fills only the upper one. A group of
    fewer than ``least`` rows takes the merged sketch of its language, and that of all rows where the language has fewer too (level 0, 1, 2).
    """
    fine = stored(sketches(counts, "lang", "source"), "sketches")
    levels = [quantiles(s, keys, 0.1, 0.5) for s, keys in ((fine, ["lang", "source"]), (merged(fine, "lang"), ["lang"]), (merged(fine), []))]
    named = [x.select(*x.columns[:-3], F.struct("size", "q0", "q1").alias(f"s{i}")) for i, x in enumerate(levels)]
    same = lambda a, b, *on: [a[c].eqNullSafe(b[c]) for c in on]
    groups, by_lang, whole = named
    rows = groups.join(by_lang, same(groups, by_lang, "lang", "measure"), "left").select(groups["*"], "s1")
    rows = rows.join(F.broadcast(whole), "measure", "left")  # a row a measure
    enough = lambda s: F.col(s)["size"] >= least
    chosen = F.when(enough("s0"), F.col("s0")).when(enough("s1"), F.col("s1")).otherwise(F.col("s2"))
    level = F.when(enough("s0"), 0).when(enough("s1"), 1).otherwise(2)
    slack = F.element_at(F.create_map(*(F.lit(x) for m in MEASURES for x in (m[0], m[3]))), F.col("measure"))
    both = F.element_at(F.create_map(*(F.lit(x) for m in MEASURES for x in (m[0], m[4]))), F.col("measure"))
    rows = rows.select("lang", "source", "measure", chosen.alias("s"), level.alias("level"))
    spread = reach * F.greatest(F.col("s.q1") - F.col("s.q0"), slack)
    low = F.when(both, F.col("s.q1") - spread).otherwise(F.lit(0.0))
    return rows.select("lang", "source", "measure", F.col("s.size").alias("size"), "level", low.alias("low"), (F.col("s.q1") + spread).alias("high"))


#: Groups whose limits may be broadcast; with more, rows and limits meet by a salted shuffle.
BROADCAST_GROUPS = 50_000
SALTS = 16


def within_limits(counts: DataFrame, limits: DataFrame, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """counts with ``within``: whether all measures keep to the limits of the row's group (null where the group has none)."""
    wide = limits.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("measure", F.struct("low", "high")))).alias("_limits"))
    wide = stored(wide.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "_limits"), "limits")
    same = counts["lang"].eqNullSafe(wide["_lang"]) & counts["source"].eqNullSafe(wide["_source"])
    if wide.count() <= broadcast_groups:
        joined = counts.join(F.broadcast(wide), same, "left")
    else:
        salted = counts.withColumn("_salt", F.pmod(F.xxhash64("doc_id", *COUNTS), F.lit(SALTS)))
        copies = wide.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        on = salted["lang"].eqNullSafe(copies["_lang"]) & salted["source"].eqNullSafe(copies["_source"]) & (salted["_salt"] == copies["_copy"])
        joined = salted.join(copies, on, "left")
    kept = F.lit(True)
    for name, a, b, _, _ in MEASURES:
        limit = F.col("_limits")[name]
        kept = kept & F.coalesce(_value(a, b).between(limit["low"], limit["high"]), F.col("_limits").isNotNull())
    return joined.select(*counts.columns, F.when(F.col("_limits").isNotNull(), kept).alias("within"))


def judge(docs: DataFrame, least: int = 50, reach: float = 8.0, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """doc_id, lang, source, COUNTS, base_failed, kept for every row of docs (doc_id, text, lang, source; others are ignored).

    Rows that fail the base rules aren't kept and take no part in the sketches. Null texts count as empty (they fail), a null lang or source is a
    group of its own, repeated rows count each, an empty table gives an empty result. The texts are read once; all else reads the stored counts.
    """
    rows = stored(document_counts(docs, "doc_id", "lang", "source").withColumn("base_failed", base_failed()), "counts")
    passed = rows.where(~F.col("base_failed"))
    kept = within_limits(passed, thresholds(passed, least, reach), broadcast_groups).withColumnRenamed("within", "kept")
    return kept.unionByName(rows.where("base_failed").withColumn("kept", F.lit(False)))


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that are kept, with all their columns; rows of one id and text share their fate (see judge)."""
    key = unused(docs, "_key")
    name = F.sha2(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("doc_id", "lang", "source")), F.sha2(text_bytes(), 256)).cast("binary"), 256)
    tagged = docs.withColumn(key, name)
    judged = judge(tagged.select(F.col(key).alias("doc_id"), "text", "lang", "source"), **options)
    return tagged.join(judged.where("kept").select(F.col("doc_id").alias(key)).distinct(), key, "left_semi").select(*docs.columns)


ORACLE_SQL = f"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS times
  FROM (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM split))
), repeats AS (
  SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM windows WHERE times > 1) GROUP BY r
), counts AS (
  SELECT r, doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) AS n_lines,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM split LEFT JOIN repeats USING (r)
), judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts),
measures(measure, slack, low_too) AS (VALUES {", ".join(f"('{m[0]}', {m[3]}::DOUBLE, {m[4]})" for m in MEASURES)}),
points AS (
  {" UNION ALL ".join(f"SELECT r, lang, source, '{m[0]}' AS measure, {m[1]}::DOUBLE / {m[2]}::DOUBLE AS v FROM judged WHERE NOT base_failed" for m in MEASURES)}
), bins AS (
  SELECT lang, source, measure, CASE WHEN v > 0 THEN ceil(ln(v) / {float(np.log(GAMMA))!r}::DOUBLE)::BIGINT ELSE {ZERO_BIN} END AS bin, count(*) AS n
  FROM points GROUP BY ALL
), levels AS (
  SELECT 0 AS level, lang, source, measure, bin, n FROM bins
  UNION ALL SELECT 1, lang, NULL, measure, bin, sum(n) FROM bins GROUP BY ALL
  UNION ALL SELECT 2, NULL, NULL, measure, bin, sum(n) FROM bins GROUP BY ALL
), placed AS (
  SELECT *, sum(n) OVER (g ORDER BY bin) AS upto, sum(n) OVER g AS size,
         CASE WHEN bin = {ZERO_BIN} THEN 0 ELSE 2 * pow({GAMMA!r}::DOUBLE, bin) / {GAMMA + 1!r}::DOUBLE END AS middle
  FROM levels WINDOW g AS (PARTITION BY level, lang, source, measure)
), sketch AS (
  SELECT level, lang, source, measure, size, min(middle) FILTER (WHERE upto > floor(0.1::DOUBLE * (size - 1))) AS q0,
         min(middle) FILTER (WHERE upto > floor(0.5::DOUBLE * (size - 1))) AS q1
  FROM placed GROUP BY ALL
), verdict AS (
  SELECT r, bool_and(v <= q1 + 8 * greatest(q1 - q0, slack) AND (NOT low_too OR v >= q1 - 8 * greatest(q1 - q0, slack))) AS within
  FROM (SELECT p.r, p.v, m.low_too, m.slack,
               CASE WHEN a.size >= 50 THEN a.q0 WHEN b.size >= 50 THEN b.q0 ELSE c.q0 END AS q0,
               CASE WHEN a.size >= 50 THEN a.q1 WHEN b.size >= 50 THEN b.q1 ELSE c.q1 END AS q1
        FROM points p JOIN measures m USING (measure)
        JOIN sketch a ON a.level = 0 AND a.lang IS NOT DISTINCT FROM p.lang AND a.source IS NOT DISTINCT FROM p.source AND a.measure = p.measure
        JOIN sketch b ON b.level = 1 AND b.lang IS NOT DISTINCT FROM p.lang AND b.measure = p.measure
        JOIN sketch c ON c.level = 2 AND c.measure = p.measure)
  GROUP BY r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(within, true) AS kept
FROM judged LEFT JOIN verdict USING (r)
"""
