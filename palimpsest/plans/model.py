"""The archive's tables, drawn from the driver's: views in Spark and in SQL alike.

sites, folders      customer, region and nation (two levels)
captures, urls      orders, lineitem
tags, site_tags     part brands, and the brands a site's captures hold
observations        events: polls, health checks and job progress
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt out evenly if a scan gives fewer partitions than there are cores, before costly work on each row.

    A large table has more splits than that and is left as it is.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows._jdf.queryExecution().toRdd().getNumPartitions() < cores else rows


def folders(spark, d: str) -> DataFrame:
    """``id``, ``path``; regions are roots, nations lie below them."""
    region, nation = table(spark, d, "region"), table(spark, d, "nation")
    roots = region.select((F.col("r_regionkey") + 1000).cast("long").alias("id"), F.col("r_name").alias("path"))
    below = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("long").alias("id"), F.concat_ws("/", "r_name", "n_name").alias("path"))
    return roots.unionByName(below)


def sites(spark, d: str) -> DataFrame:
    """``id``, ``title``, ``folder_id``, ``status``, ``size_bytes`` (cents of the balance; below zero counts as deleted)."""
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("title"),
        F.col("c_nationkey").cast("long").alias("folder_id"),
        F.col("c_mktsegment").alias("status"),
        F.greatest(F.round(F.col("c_acctbal") * 100), F.lit(0)).cast("long").alias("size_bytes"),
        (F.col("c_acctbal") < 0).alias("deleted"),
    )


def captures(spark, d: str) -> DataFrame:
    """``id``, ``site_id``, ``started_at``, ``status``, ``bytes``, ``priority``."""
    status = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "partial").otherwise("running")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("site_id"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("started_at"),
        status.alias("status"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("bytes"),
        F.col("o_orderpriority").alias("priority"),
    )


def capture_urls(spark, d: str) -> DataFrame:
    """``capture_id``, ``line``, ``url``, ``host``, ``bytes``, ``status_code``, ``error``, ``digest``."""
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("capture_id"),
        F.col("l_linenumber").cast("long").alias("line"),
        F.concat(F.lit("https://h"), (F.col("l_suppkey") % 10).cast("string"), F.lit(".example.org/p/"), F.col("l_partkey").cast("string")).alias("url"),
        F.concat(F.lit("h"), (F.col("l_suppkey") % 10).cast("string"), F.lit(".example.org")).alias("host"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("bytes"),
        F.when(F.col("l_linestatus") == "O", 404).otherwise(200).alias("status_code"),
        F.when(F.col("l_returnflag") == "R", "timeout").alias("error"),
        F.concat_ws("-", F.col("l_partkey").cast("string"), (F.col("l_quantity").cast("long") % 3).cast("string")).alias("digest"),
    )


def tags(spark, d: str) -> DataFrame:
    """``slug`` of every tag, one of them without a site."""
    return table(spark, d, "part").select(F.col("p_brand").alias("slug")).distinct().unionByName(spark.sql("SELECT 'unused' AS slug"))


def site_tags(spark, d: str) -> DataFrame:
    """``site_id``, ``slug``: the brands of each site's captures."""
    orders, lines, part = table(spark, d, "orders"), table(spark, d, "lineitem"), table(spark, d, "part")
    rows = lines.select("l_orderkey", "l_partkey").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.col("o_custkey").alias("site_id"), F.col("p_brand").alias("slug")).distinct()


def observations(spark, d: str) -> DataFrame:
    """``id``, ``ts``, ``key``, ``kind``, ``value``."""
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("user_id").alias("key"), F.col("event_type").alias("kind"), "value")


#: The same views for DuckDB; queries go on with a SELECT.
SQL = """WITH folders AS (
  SELECT CAST(r_regionkey + 1000 AS BIGINT) AS id, r_name AS path FROM region
  UNION ALL SELECT CAST(n_nationkey AS BIGINT), r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey
), sites AS (
  SELECT c_custkey AS id, c_name AS title, CAST(c_nationkey AS BIGINT) AS folder_id, c_mktsegment AS status,
    CAST(greatest(round(c_acctbal * 100), 0) AS BIGINT) AS size_bytes, c_acctbal < 0 AS deleted FROM customer
), captures AS (
  SELECT o_orderkey AS id, o_custkey AS site_id, o_orderdate AS started_at,
    CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'partial' ELSE 'running' END AS status,
    CAST(round(o_totalprice * 100) AS BIGINT) AS bytes, o_orderpriority AS priority FROM orders
), capture_urls AS (
  SELECT l_orderkey AS capture_id, CAST(l_linenumber AS BIGINT) AS line,
    'https://h' || (l_suppkey % 10) || '.example.org/p/' || l_partkey AS url, 'h' || (l_suppkey % 10) || '.example.org' AS host,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS bytes, CASE WHEN l_linestatus = 'O' THEN 404 ELSE 200 END AS status_code,
    CASE WHEN l_returnflag = 'R' THEN 'timeout' END AS error, l_partkey || '-' || (CAST(l_quantity AS BIGINT) % 3) AS digest FROM lineitem
), tags AS (SELECT DISTINCT p_brand AS slug FROM part UNION ALL SELECT 'unused'
), site_tags AS (
  SELECT DISTINCT o_custkey AS site_id, p_brand AS slug FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
), observations AS (SELECT event_id AS id, ts, user_id AS key, event_type AS kind, value FROM events)
"""
