"""Queries of statuses, log lines, thumbnails, flags, ages, id lists and chunks of keys, over made-up columns of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import status
from ..operators import verify
from .tables import table


def q67(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    every = lambda k: n % k == 0
    return table(spark, sf_dir, "events").select(
        "event_id",
        status.experience_status(every(7), F.when(every(5), True), every(3), every(2), F.when(every(11), True)).alias("experience"),
        status.recognition_status(F.when(every(4), n), F.when(every(3), True), F.when(every(5), F.lit("h"))).alias("recognition"),
        status.one_of(F.upper("event_type"), ["click", "purchase"], "other").alias("type"),
    )


def q68(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs with one, two and no entries about videos that can't be had, of other sources too, and missing logs."""
    n = F.col("event_id")
    gone = F.concat(F.lit("ERROR: [youtube] a"), n, F.lit(": Video unavailable \n"))
    private = F.concat(F.lit("error: [youtube:music] b"), n, F.lit(": This is a Private video\n"))
    asked = F.concat(F.lit("ERROR: [youtube] c"), n, F.lit(": Sign in to confirm\n"))
    other = F.lit("ERROR: [vimeo] d: Video unavailable\n")
    log = F.when(n % 4 == 0, F.concat(gone, other)).when(n % 4 == 1, F.concat(gone, asked, private)).when(n % 4 == 2, asked)
    log = F.concat(log, F.when(n % 3 == 0, "[download] x has Already been recorded in the archive").otherwise(""))
    found = status.unavailable_entries(F.col("log"))
    return table(spark, sf_dir, "events").select("event_id", log.alias("log")).select(
        "event_id", F.array_join(F.transform(found, lambda e: e["id"]), ",").alias("ids"),
        F.array_join(F.transform(found, lambda e: e["message"]), "|").alias("messages"), status.already_archived(F.col("log")).alias("archived"),
    )


def q69(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of the largest pictures, one without url aside; parts whose number ends in 0 or 5 have none."""
    p, size = F.col("p_partkey"), F.col("p_size").cast("int")
    shot = lambda url, w, h: F.struct(url.alias("url"), w.cast("int").alias("width"), h.cast("int").alias("height"))
    named = lambda c: F.concat(F.lit(c), p)
    ten = F.lit(10)
    shots = F.array(
        shot(named("a"), size, ten), shot(F.lit(""), F.lit(1000), F.lit(1000)), shot(named("b"), ten, size), shot(named("c"), F.when(p % 2 == 0, 25), ten)
    )
    shots = F.when(p % 5 == 0, F.slice(shots, 1, 0)).otherwise(shots)
    return table(spark, sf_dir, "part").select("p_partkey", status.best_thumbnail(shots, named("d")).alias("url"))


def q70(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.chunks(table(spark, sf_dir, "orders").select("o_orderkey"), [F.col("o_orderkey").desc()], 100)


def q71(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    some = status.id_list(parts, "p_size").select(F.lit("sizes").alias("kind"), "ids")
    return some.unionByName(status.id_list(parts.filter("p_size < 0"), "p_size").select(F.lit("none").alias("kind"), "ids"))


def q72(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey") % 3
    saved = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("id"), F.when(n == 0, True).when(n == 1, False).alias("enabled"))
    return status.saved_flags(saved, ["BUILDING", "MACHINERY"])


def q73(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    version = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(day, "yyyy-MM-dd")).otherwise(F.concat(F.date_format(day, "yyyy.MM.dd"), F.lit(" ")))
    age = status.freshness(version, F.lit("1998-08-02").cast("date"), 900)
    return table(spark, sf_dir, "orders").select("o_orderkey", age.alias("a")).select("o_orderkey", F.coalesce("a.age_days", F.lit(-1)).alias("age_days"), "a.ok")


QUERIES = {
    "q67_statuses": q67, "q68_log_entries": q68, "q69_largest_thumbnail": q69, "q70_key_chunks": q70, "q71_id_lists": q71, "q72_saved_flags": q72,
    "q73_version_age": q73,
}
ORACLE_SQL = {
    "q67_statuses": """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'error' WHEN event_id % 5 = 0 THEN 'switch-available' WHEN event_id % 3 = 0 THEN 'playing' WHEN event_id % 2 = 0 THEN 'ready'
          WHEN event_id % 11 = 0 THEN 'paused' ELSE 'idle' END AS experience,
        CASE WHEN event_id % 4 = 0 THEN 'RECOGNIZED' WHEN event_id % 3 = 0 THEN 'MATCHING' WHEN event_id % 5 = 0 THEN 'CHECKING' ELSE 'IDLE' END AS recognition,
        CASE WHEN event_type IN ('click', 'purchase') THEN event_type ELSE 'other' END AS type FROM events""",
    "q68_log_entries": """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'a' || event_id WHEN 1 THEN 'a' || event_id || ',b' || event_id WHEN 2 THEN '' END AS ids,
        CASE event_id % 4 WHEN 0 THEN 'Video unavailable' WHEN 1 THEN 'Video unavailable|This is a Private video' WHEN 2 THEN '' END AS messages,
        event_id % 4 <> 3 AND event_id % 3 = 0 AS archived FROM events""",
    "q69_largest_thumbnail": "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'd' WHEN p_partkey % 2 = 0 AND p_size < 25 THEN 'c' ELSE 'a' END || p_partkey AS url FROM part",
    "q70_key_chunks": "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey DESC) - 1) // 100 AS chunk FROM orders",
    "q71_id_lists": "SELECT 'sizes' AS kind, array_to_string(list_sort(list(DISTINCT p_size)), ',') AS ids FROM part UNION ALL SELECT 'none', NULL",
    "q72_saved_flags": "SELECT c_mktsegment AS id, c_custkey % 3 = 0 AS enabled FROM customer WHERE c_custkey % 3 <> 2 AND c_mktsegment IN ('BUILDING', 'MACHINERY')",
    "q73_version_age": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN date_diff('day', o_orderdate::DATE, DATE '1998-08-02') ELSE -1 END::INT AS age_days,
        o_orderkey % 3 <> 0 AND date_diff('day', o_orderdate::DATE, DATE '1998-08-02') <= 900 AS ok FROM orders""",
}
