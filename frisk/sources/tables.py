"""Existing warehouse tables read as account events (fixed mapping, see SURVEY 7.2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frisk.schema import canonical


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_as_account_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events``: views, clicks and purchases are payments; signups and errors are logins."""
    return map_events(read(spark, sf_dir, "events"))


PAYMENT_TYPES = ("view", "click", "purchase")


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the payments of ``events``; filtered on the raw column, so the filter reaches the scan."""
    return map_events(read(spark, sf_dir, "events").filter(F.col("event_type").isin(*PAYMENT_TYPES)))


def map_events(e: DataFrame) -> DataFrame:
    """The same mapping for any frame (or stream) with the columns of ``events``."""
    k = F.col("k")
    user, kind = F.col("user_id"), F.col("event_type")
    txn = kind.isin(*PAYMENT_TYPES)
    on = lambda c: F.when(txn, c)
    e = e.withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))
    away = k % 17 == 0
    return canonical(e.select(
        F.when(txn, "txn").otherwise("login").alias("type"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.concat(F.lit("u"), user).alias("cust_id"),
        on(F.col("value") * F.lit(100.0)).alias("amount"),
        on(F.when(k % 11 == 0, "wire_transfer").when(k % 13 == 0, "crypto")
           .when(k % 3 == 0, "grocery").otherwise("retail")).alias("mcc"),
        on(F.when(kind == "view", "pos").when(kind == "click", "online").otherwise("transfer")).alias("channel"),
        on(F.concat(F.lit("m"), k % 40)).alias("merchant_id"),
        F.when(kind == "purchase", F.concat(F.lit("b"), user % 25, F.lit("_"), k % 4)).otherwise("").alias("beneficiary"),
        on(F.when(away, "XX").otherwise("IN")).alias("country"),
        on(F.when(away, 50.0).otherwise(19.0) + (k % 5) * F.lit(0.1)).alias("lat"),
        on(F.lit(72.0) + (k % 7) * F.lit(0.1)).alias("lon"),
        F.concat(F.lit("d"), F.when(k % 10 == 0, user % 15).otherwise(user + 1000)).alias("device_id"),
        F.concat(F.lit("c"), user).alias("card_bin"),
        F.when(txn & (((k % 10 == 0) & (user % 15 < 3)) | (F.col("value") > 250.0)), 1).otherwise(0).alias("label"),
        F.when(kind == "signup", 1).when(kind == "error", 0).alias("success"),
    ))


_BLOCK_US = 10 * 86400 * 1_000_000


def busy(e: DataFrame) -> DataFrame:
    """``events`` with bursts and a wide range of values, so that every rule meets rows; columns stay.

    Each customer's ten-day blocks are squeezed to start at the block's beginning: the first block of every fourth to an hour, the later ones to five
    minutes; every third customer keeps the times.  Values of some rows are multiplied, by what the row's number says.
    """
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    block, inside = F.floor(t / _BLOCK_US), F.pmod(t, F.lit(_BLOCK_US))
    squeeze = F.when(F.col("user_id") % 3 == 2, 1).when(block % 4 == 3, 240).otherwise(2880)
    times = F.when(k % 23 == 0, 200.0).when(k % 20 == 0, 100.0).when(k % 20 == 10, 15.0).when(k % 5 == 1, 0.02).otherwise(1.0)
    return e.withColumns({"ts": F.timestamp_micros(block * _BLOCK_US + F.floor(inside / squeeze)), "value": F.col("value") * times})


def busy_account_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_events(busy(read(spark, sf_dir, "events")))


def event_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer dimension of the same mapping."""
    e = read(spark, sf_dir, "events").select("user_id").distinct()
    return e.select(
        F.concat(F.lit("u"), F.col("user_id")).alias("cust_id"),
        (F.lit(18) + F.col("user_id") % 70).cast("int").alias("age"),
        F.lit("IN").alias("home_country"),
        F.lit("2023-01-01 00:00:00").cast("timestamp").alias("account_open"),
    )


def shipments_as_account_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` joined to ``orders``: the volume test, and the tie test (ts is a date)."""
    li = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag",
        "l_linestatus", "l_shipdate", "l_quantity")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return canonical(j.select(
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        # (l_orderkey, l_linenumber) repeats in the test tables: number rows by their content
        F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice",
                   "l_quantity").alias("seq"),
        F.concat(F.lit("u"), F.col("o_custkey")).alias("cust_id"),
        F.col("l_extendedprice").alias("amount"),
        F.when(F.col("l_linestatus") == "F", "retail").otherwise("grocery").alias("mcc"),
        F.when(F.col("l_quantity") < 20, "pos").when(F.col("l_quantity") < 40, "online").otherwise("transfer").alias("channel"),
        F.concat(F.lit("m"), F.col("l_suppkey")).alias("merchant_id"),
        F.concat(F.lit("b"), F.col("l_partkey")).alias("beneficiary"),
        F.lit("IN").alias("country"),
        F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"),
        F.concat(F.lit("d"), F.substring("o_orderpriority", 1, 1)).alias("device_id"),
        F.concat(F.lit("c"), F.col("o_custkey")).alias("card_bin"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
    ))
