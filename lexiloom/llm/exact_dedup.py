"""Exact deduplication with a heavy-hitter split (operator 5). DataFrame functions only.

Method: a Misra-Gries summary (Spark's approx_top_k, a mergeable frequent-items sketch of
bounded size) names digests that may be frequent; their true counts and smallest doc_id are counted
in a second pass, and only verified winners are broadcast. Rows of a winner are settled on the map side and
never shuffled; the rest are grouped by an ordinary shuffle on the digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, held, unused

WHITE_SPACE = r"[\x20\x09-\x0D]+"


def normalised(col: str = "text") -> Column:
    """Null as empty; each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(F.col(col), F.lit("")), WHITE_SPACE, " ")


def groups(docs: DataFrame, heavy_rows: int = 64, summary_items: int = 4096, winners: int = 512) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs.

    Of equal normalised texts the smallest doc_id stays (null ids last; of repeated rows with
    the same id one stays). Other columns are ignored; an empty table gives an empty result.
    ``winners`` bounds the broadcast rows, ``summary_items`` the summary.
    """
    rows = held(docs.select("doc_id", F.sha2(normalised().cast("binary"), 256).alias("text_sha256")))
    frequent = rows.agg(F.expr(f"approx_top_k(text_sha256, {winners}, {summary_items})").alias("top"))
    frequent = frequent.select(F.explode("top.item").alias("text_sha256"))
    verified = cut(
        rows.join(F.broadcast(frequent), "text_sha256", "left_semi")
        .groupBy("text_sha256")
        .agg(F.min("doc_id").alias("_keep"), F.count("*").alias("_size"))
        .where(F.col("_size") >= heavy_rows),
        winners,
    )
    marked = rows.join(F.broadcast(verified), "text_sha256", "left")

    # of a winner's rows only those with the smallest id can stay: number them, rarely more than one
    smallest = F.col("doc_id").eqNullSafe(F.col("_keep"))
    heavy = marked.where(F.col("_size").isNotNull())
    first = F.row_number().over(Window.partitionBy("text_sha256").orderBy("doc_id"))
    heavy = heavy.where(~smallest).withColumn("kept", F.lit(False)).unionByName(
        heavy.where(smallest).withColumn("kept", first == 1)
    )
    light = marked.where(F.col("_size").isNull()).drop("_keep", "_size")
    same = Window.partitionBy("text_sha256")
    light = light.select(
        "*",
        F.min("doc_id").over(same).alias("_keep"),
        F.count("*").over(same).alias("_size"),
        (F.row_number().over(same.orderBy(F.col("doc_id").asc_nulls_last())) == 1).alias("kept"),
    )
    return heavy.unionByName(light).select(
        "doc_id", F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), "kept", "text_sha256"
    )


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay, with all their columns: of equal normalised texts the one with the smallest doc_id.

    Null texts count as empty; null ids come last; of rows that share id and text one stays, whichever; columns of any name pass
    through, an empty table stays empty.
    """
    # a row is known by its id and text; of rows that share both, the window leaves one
    key, one = unused(docs, "_key"), unused(docs, "_one")
    name = lambda digest: F.concat_ws(":", F.col("doc_id").cast("string"), digest).alias(key)
    keep = groups(docs, **options).where("kept").select(name(F.col("text_sha256")))
    tagged = docs.select("*", name(F.sha2(normalised().cast("binary"), 256)))
    kept = tagged.join(keep, key, "left_semi")
    kept = kept.withColumn(one, F.row_number().over(Window.partitionBy(key).orderBy(key)))
    return kept.where(F.col(one) == 1).select(*docs.columns)


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM t
"""
