"""Relational queries on the star schema: customers are speakers, orders files, line items utterances."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import corpus
from .base import query


@query(
    "SELECT l_orderkey, l_linenumber, c_name, n_name, r_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey "
    "JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderpriority = '1-URGENT'"
)
def utterance_speaker_file(t):
    """Five-way star; AQE broadcasts the dimensions it finds small."""
    return (
        t.lineitem.join(t.orders.where("o_orderpriority = '1-URGENT'"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("l_orderkey", "l_linenumber", "c_name", "n_name", "r_name")
    )


@query(
    "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')"
)
def empty_speakers(t):
    return corpus.orphans(t.customer, t.orders.where("o_orderpriority = '1-URGENT'"), "c_custkey", "o_custkey").select("c_custkey", "c_name")


@query(
    "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY c_custkey"
)
def speaker_counts(t):
    """Files of each speaker, those without any included."""
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    joined = t.customer.join(urgent, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select("c_custkey", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) >= 10")
def speaker_counts_having(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).where("n >= 10")


@query(
    "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_orderstatus = 'F'"
)
def semi_join_lookup(t):
    found = corpus.lookup(t.orders, o_orderstatus="F", o_orderpriority=None)
    building = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return found.join(building, "o_custkey", "left_semi").select("o_orderkey")


@query(
    "SELECT DISTINCT o_custkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 45"
)
def many_to_many(t):
    rows = t.lineitem.where("l_quantity >= 45").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("o_custkey", "l_suppkey").distinct()


@query(
    "SELECT p_brand, p_type, count(*) AS n, round(avg(p_retailprice), 4) AS mean, round(stddev_samp(p_retailprice), 4) AS sd, min(p_size) AS low, max(p_size) AS high FROM part GROUP BY ALL"
)
def grouped_statistics(t):
    return t.part.groupBy("p_brand", "p_type").agg(
        F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 4).alias("mean"),
        F.round(F.stddev_samp("p_retailprice"), 4).alias("sd"), F.min("p_size").alias("low"), F.max("p_size").alias("high"),
    )


@query(
    "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL"
)
def pricing_summary(t):
    rows = t.lineitem.where("l_shipdate <= TIMESTAMP_NTZ'1998-09-02 00:00:00'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.round(F.avg("l_discount"), 6).alias("discount"),
    )


@query(
    "SELECT s_suppkey, s_name, n_name, row_number() OVER (PARTITION BY n_name ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier JOIN nation ON s_nationkey = n_nationkey QUALIFY rank <= 3"
)
def top_speakers_per_group(t):
    w = Window.partitionBy("n_name").orderBy(F.desc("s_acctbal"), "s_suppkey")
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("s_suppkey", "s_name", "n_name", F.col("rank").cast("long").alias("rank"))


@query(
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 0.5 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)"
)
def conditional_update_delete(t):
    kept = corpus.delete_matching(t.orders, t.lineitem.where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])
    half = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") * 0.5).otherwise(F.col("o_totalprice"))
    return kept.select("o_orderkey", half.alias("o_totalprice"))
