"""Secret scanning with multipart credential linking (operator 4). DataFrame functions only.

Strong patterns are reported as they are. Weak candidates (identifiers, short or oddly named secrets,
endpoints) mean little alone; an interval join within a scope of a few hundred characters links them, and
a weak candidate is reported only where the part that completes it stands in its scope.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

_TO_VALUE = r"""["']?\x20*[:=]\x20*["']?"""


@dataclass(frozen=True)
class Kind:
    """A pattern whose matches count if group ``group`` has least..most characters.

    Strong kinds are always reported; the others need one of ``needs`` in their scope. Every match holds one
    of ``signs`` (if there are any), so a text without them needs no scan.
    """

    name: str
    pattern: str
    group: int = 0
    least: int = 1
    most: int = 1 << 30
    needs: tuple[str, ...] = ()
    signs: tuple[str, ...] = ()


# fixed values: the base patterns, in their order
BASE = (
    Kind("assign", r"(?i:(password|passwd|secret|token|api_?key))" + _TO_VALUE + r"([A-Za-z0-9+/_.=-]+)", 2, 12, signs=(":", "=")),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 18, signs=("AKIA",)),
    Kind("hex", r"[0-9a-f]+", 0, 16),
)
_SECRETS = ("assign", "hex", "weak_secret")
WEAK = (
    Kind("weak_id", r"(?i:((?:\b|_)(?:user|login|account)|username|client_?id|\baccess_?key|access_?key_?id|\bkey_?id))" + _TO_VALUE + r"([A-Za-z0-9@_.+-]+)", 2, 3, needs=_SECRETS, signs=(":", "=")),
    Kind("weak_secret", r"(?i:((?:\b|_)(?:pwd|pass)|passphrase|credential|private_?key|secret_?access_?key|password|passwd|secret|token|api_?key))" + _TO_VALUE + r"([A-Za-z0-9+/_.=-]+)", 2, 4, needs=("access", "weak_id", "endpoint"), signs=(":", "=")),
    Kind("endpoint", r"(?i:\b(https?|ftp|sftp|ssh|postgres|postgresql|mysql|mongodb|redis|amqp))://[A-Za-z0-9._~:/?#@%&=+-]+", 0, 10, needs=_SECRETS, signs=("://",)),
)
KINDS = BASE + WEAK


def _lengths(kind: Kind) -> Column:
    """Of each match in order: characters since the last match, of the match and of its group."""
    text, pattern = F.col("text"), F.lit(kind.pattern)
    # a run shorter than the least can't count, so a scan for long runs alone finds the same spans
    if kind.group == 0 and kind.pattern.endswith("]+") and kind.name in ("access", "hex"):
        head = 4 if kind.name == "access" else 0
        pattern = F.lit(kind.pattern[:-1] + "{%d,}" % (kind.least - head))
    gaps = F.split(text, pattern, -1)
    parts = F.arrays_zip(
        gaps.alias("g"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"),
        F.regexp_extract_all(text, pattern, F.lit(kind.group)).alias("v"),
    )
    sizes = F.transform(
        F.slice(parts, 1, F.size(parts) - 1),  # what follows the last match has no match
        lambda x: F.struct(
            F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("size"), F.length(x["v"]).alias("value")
        ),
    )
    none = F.array().cast("array<struct<gap:int,size:int,value:int>>")
    found = F.rlike(text, pattern)
    if kind.signs:
        found = reduce(or_, (F.contains(text, F.lit(x)) for x in kind.signs)) & found
    return F.when(found, sizes).otherwise(none)


def find_parts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, parts): every document as row, doc_id; every counting match as row, kind, start, end."""
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    scanned = stored(
        texts.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", *(_lengths(k).alias(k.name) for k in KINDS)
        ),
        "secret-parts",
    )
    every = [
        scanned.select("row", F.lit(k).alias("kind"), F.posexplode(kind.name).alias("i", "x"))
        for k, kind in enumerate(KINDS)
    ]
    exploded = every[0]
    for more in every[1:]:
        exploded = exploded.unionByName(more)
    upto = Window.partitionBy("row", "kind").orderBy("i")
    end = F.sum(F.col("x.gap") + F.col("x.size")).over(upto)
    placed = exploded.select("row", "kind", (end - F.col("x.size")).alias("start"), end.alias("end"), "x.value")
    good = F.lit(False)
    for k, kind in enumerate(KINDS):
        good = good | ((F.col("kind") == k) & F.col("value").between(kind.least, kind.most))
    return scanned.select("row", "doc_id"), stored(placed.where(good).drop("value"), "secret-spans")


def link_parts(parts: DataFrame, scope: int = 256) -> DataFrame:
    """Strong parts, and weak ones with a complementary part that begins or ends at most ``scope`` characters away.

    A weak part that a strong one covers in part says nothing new and is left out. The join is on the document and
    scope-sized stretches of text: a part stands in every stretch that it covers, a weak one looks a scope further on both
    sides. A stretch holds few parts, as matches of a kind don't overlap, so the rows of a long document or one full of
    credentials spread over many keys.
    """
    number = {kind.name: k for k, kind in enumerate(KINDS)}
    strong = parts.where(F.col("kind") < len(BASE))
    weak = parts.where(F.col("kind") >= len(BASE))
    stretches = lambda margin: F.explode(
        F.sequence(F.floor((F.col("start") - margin) / scope), F.floor((F.col("end") - 1 + margin) / scope))
    )
    others = parts.select(
        F.col("row").alias("r"), F.col("kind").alias("other"), F.col("start").alias("from"), F.col("end").alias("to"), stretches(0).alias("s")
    )
    bases = others.where(F.col("other") < len(BASE))
    covered = (F.col("start") < F.col("to")) & (F.col("from") < F.col("end"))
    on_stretch = (F.col("row") == F.col("r")) & (F.col("stretch") == F.col("s"))
    hidden = weak.withColumn("stretch", stretches(0)).join(bases, on_stretch & covered, "left_semi").select("row", "kind", "start").distinct()
    open_ = weak.join(hidden, ["row", "kind", "start"], "left_anti")
    fits = F.lit(False)
    for kind in WEAK:
        fits = fits | ((F.col("kind") == number[kind.name]) & F.col("other").isin([number[x] for x in kind.needs]))
    gap = F.greatest(F.col("from") - F.col("end"), F.col("start") - F.col("to"))  # negative where they overlap
    linked = open_.withColumn("stretch", stretches(scope)).join(others, on_stretch & fits & gap.between(0, scope), "left_semi")
    return strong.unionByName(linked.drop("stretch").distinct())


def scan(docs: DataFrame, scope: int = 256) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans for every row of docs.

    Null text counts as empty; a document without secrets has zeros, the digest of the empty string
    and empty spans. Rows may repeat, other columns are ignored, an empty table gives an
    empty result. Positions are code points, ends exclusive.
    """
    rows, parts = find_parts(docs)
    found = link_parts(parts, scope)
    names = F.array(*(F.lit(k.name) for k in KINDS))
    listed = found.groupBy("row").agg(
        *(F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{kind.name}") for k, kind in enumerate(BASE)),
        F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("all"),
    )

    def written(items: Column) -> Column:
        return F.array_join(
            F.transform(items, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ","
        )

    base = F.filter("all", lambda x: x["kind"] < len(BASE))
    out = rows.join(listed, "row", "left")
    return out.select(
        "doc_id",
        *(F.coalesce(f"n_{k.name}", F.lit(0).cast("long")).alias(f"n_{k.name}") for k in BASE),
        F.sha2(F.coalesce(written(base), F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce(written(F.col("all")), F.lit("")).alias("spans"),
    )


def _sql_parts() -> str:
    """DuckDB: the matches of every kind as doc_id, kind, name, start, end."""
    selects = []
    for k, kind in enumerate(KINDS):
        p = kind.pattern.replace("'", "''")
        selects.append(
            f"SELECT doc_id, {k} AS kind, '{kind.name}' AS name, {kind.least} AS least, {kind.most} AS most, "
            f"unnest(string_split_regex(t, '{p}')) AS g, unnest(regexp_extract_all(t, '{p}', 0)) AS m, "
            f"unnest(regexp_extract_all(t, '{p}', {kind.group})) AS v, "
            f"unnest(range(len(string_split_regex(t, '{p}')))) AS i FROM docs"
        )
    return " UNION ALL ".join(selects)


def oracle_sql(scope: int = 256) -> str:
    number = {kind.name: k for k, kind in enumerate(KINDS)}
    fits = " OR ".join(
        f"(w.kind = {number[k.name]} AND o.kind IN ({', '.join(str(number[x]) for x in k.needs)}))" for k in WEAK
    )
    counts = ", ".join(f"count(*) FILTER (name = '{k.name}') AS n_{k.name}" for k in BASE)
    zeros = ", ".join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in BASE)
    line = "string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind)"
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
raw AS ({_sql_parts()}),
placed AS (
  SELECT *, CAST(sum(length(g) + coalesce(length(m), 0)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS e
  FROM raw),
parts AS (
  SELECT doc_id, kind, name, e - length(m) AS s, e FROM placed WHERE m IS NOT NULL AND length(v) BETWEEN least AND most),
found AS (
  SELECT * FROM parts WHERE kind < {len(BASE)}
  UNION ALL
  SELECT * FROM parts w WHERE kind >= {len(BASE)}
    AND EXISTS (SELECT 1 FROM parts o WHERE o.doc_id = w.doc_id AND ({fits}) AND greatest(o.s - w.e, w.s - o.e) BETWEEN 0 AND {scope})
    AND NOT EXISTS (SELECT 1 FROM parts o WHERE o.doc_id = w.doc_id AND o.kind < {len(BASE)} AND w.s < o.e AND o.s < w.e)),
listed AS (
  SELECT doc_id, {counts}, {line.replace(" ORDER", " ORDER")} AS spans,
         {line} FILTER (kind < {len(BASE)}) AS base FROM found GROUP BY doc_id)
SELECT d.doc_id, {zeros}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN listed USING (doc_id)
"""
