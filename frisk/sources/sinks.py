"""Where results go: case tables by day, the feedback log, report tables, state snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frisk.config import DEFAULT, Settings


def append_cases(cases: DataFrame, path: str) -> None:
    """Append scored cases, one folder per event day, so time filters prune partitions."""
    cases.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def recent_cases(cases: DataFrame, limit: int = 60, only_alerts: bool = False, s: Settings = DEFAULT) -> DataFrame:
    """Newest cases out of the last ``case_buffer``; both limits are top-k, not a global sort."""
    ring = cases.orderBy(F.desc("ts"), F.desc("seq")).limit(s.case_buffer)
    if only_alerts:
        ring = ring.filter(F.col("action").isin("BLOCK", "CHALLENGE", "REVIEW"))
    return ring.orderBy(F.desc("ts"), F.desc("seq")).limit(limit)


def case_by_id(cases: DataFrame, case_id: int) -> DataFrame:
    return cases.filter(F.col("seq") == case_id)


def append_feedback(rows: DataFrame, path: str) -> None:
    """The log is append-only; ``labels.latest_feedback`` reads the last write per key."""
    rows.write.mode("append").json(path)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(
        "log_id long, cust_id string, ts timestamp, amount double, label int, kind string, note string, "
        "analyst string, recorded_at timestamp").json(path)


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)


def markdown_table(report: DataFrame, most: int = 10_000) -> str:
    """A report table (tens of rows) as Markdown text; a table of more than ``most`` rows is no report and raises."""
    rows = report.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows; write it as a table instead")
    cell = lambda v: "n/a" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    head = report.columns
    lines = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    return "\n".join(lines + ["| " + " | ".join(cell(r[c]) for c in head) + " |" for r in rows])


def save_snapshot(profiles: DataFrame, entities: DataFrame, path: str) -> None:
    """Profile and entity state as tables a later run can start from."""
    profiles.write.mode("overwrite").parquet(f"{path}/profiles")
    entities.write.mode("overwrite").parquet(f"{path}/entities")


def profile_snapshot(txns: DataFrame) -> DataFrame:
    """Per customer state after the last accepted transaction: one aggregation."""
    acc = txns.filter("label = 0")
    at = F.struct("ts", "seq")
    return acc.groupBy("cust_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("amount").alias("mean_amount"), F.stddev_samp("amount").alias("sd_amount"),
        F.max("amount").alias("max_amount"), F.max("ts").alias("last_ts"), F.max_by("country", at).alias("last_country"),
        F.max_by("lat", at).alias("last_lat"), F.max_by("lon", at).alias("last_lon"))
