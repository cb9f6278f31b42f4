"""Scoring a stream in micro-batches with the batch operators.

Each batch is joined to the history of the customers and entities it touches, features and
decisions are computed by the same windows and gate, and only the batch's rows are written.  All
writes are overwrites of a folder named after the batch id, so a replayed batch changes nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frisk.config import DEFAULT, Settings
from frisk.ml.scorers import Scorer
from frisk.operators.entity import entity_features
from frisk.plans.features import kept
from frisk.plans.gate import run_gate
from frisk.schema import EVENT


class MicroBatchScorer:
    """Pass an instance to ``writeStream.foreachBatch``."""

    def __init__(self, path: str, scorer: Scorer, threshold: float, customers: DataFrame | None = None,
                 settings: Settings = DEFAULT, lateness: str | None = None):
        self.path, self.scorer, self.threshold = path, scorer, threshold
        self.customers, self.settings, self.lateness = customers, settings, lateness

    def _history(self, spark: SparkSession, batch_id: int) -> DataFrame | None:
        try:
            return spark.read.parquet(f"{self.path}/history").filter(F.col("batch") < batch_id)
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None  # nothing written yet, or a first batch that did not finish
            raise

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = kept(batch.select(*[f.name for f in EVENT.fields]))
        history = self._history(spark, batch_id)
        if history is not None and self.lateness is not None:
            high = history.agg((F.max("ts") - F.expr(f"interval {self.lateness}")).alias("_low"))
            marked = batch.crossJoin(F.broadcast(high))  # one row
            late = marked.filter(F.col("ts") < F.col("_low")).drop("_low")
            late.write.mode("overwrite").parquet(f"{self.path}/late/batch={batch_id}")
            batch = marked.filter(F.col("_low").isNull() | (F.col("ts") >= F.col("_low"))).drop("_low")
        now = batch.withColumn("settled", F.lit(None).cast("boolean"))
        events, txns = now, batch.filter("type = 'txn'")
        entities = None
        if history is not None:
            mine = history.join(batch.select("cust_id").distinct(), "cust_id", "left_semi").select(*now.columns)
            events = mine.unionByName(now)
            past = history.filter("type = 'txn'").select(*batch.columns)
            new = entity_features(past.unionByName(txns), self.settings, only=txns)
            # history rows only feed the windows; their entity columns are never read again
            idle = mine.filter("type = 'txn'").select("seq")
            entities = new.unionByName(idle, allowMissingColumns=True)
        cases = run_gate(events, self.scorer, self.threshold, self.customers, self.settings, entities=entities)
        fresh = kept(cases.join(batch.select("seq"), "seq", "left_semi"))
        learned = batch.join(fresh.select("seq", F.col("accepted").alias("settled")), "seq", "left")
        fresh.drop("settled").write.mode("overwrite").parquet(f"{self.path}/cases/batch={batch_id}")
        learned.write.mode("overwrite").parquet(f"{self.path}/history/batch={batch_id}")


def score_stream(stream: DataFrame, scorer: MicroBatchScorer, checkpoint: str):
    """Start the stream over what is available now; the checkpoint makes a restart continue."""
    return (stream.writeStream.foreachBatch(scorer).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def event_stream(spark: SparkSession, path: str, fmt: str = "parquet", files_per_batch: int = 1) -> DataFrame:
    """Canonical events from a folder that keeps receiving files."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def action_counts(cases: DataFrame, watermark: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Running counts per action and event-time window, for an update-mode sink."""
    return cases.withWatermark("ts", watermark).groupBy(F.window("ts", window), "action").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("fraud"), F.sum("amount").alias("amount"))


def verification_outcomes(challenges: DataFrame, verifications: DataFrame, within: str = "1 day") -> DataFrame:
    """Each challenged case with its step-up result; NULL once ``within`` has passed without one.

    A stream-stream left outer join: both watermarks bound how long a pending case is held.
    """
    c = challenges.select(F.col("seq").alias("case_id"), F.col("ts").alias("challenged_at")).withWatermark("challenged_at", "1 hour")
    v = verifications.select(F.col("case_id").alias("v_case"), "passed", "verified_at").withWatermark("verified_at", "1 hour")
    cond = F.expr(f"case_id = v_case AND verified_at >= challenged_at AND verified_at <= challenged_at + interval {within}")
    out = c.join(v, cond, "leftOuter")
    status = F.when(F.col("passed").isNull(), "expired").when(F.col("passed"), "passed").otherwise("failed")
    return out.select("case_id", "challenged_at", "verified_at", status.alias("verification"))


def apply_verifications(log: DataFrame, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved, refused): the first report per pending challenge counts, the rest are errors.

    ``log``: case_id, passed, at, n.
    """
    from pyspark.sql import Window
    w = Window.partitionBy("case_id").orderBy("at", "n")
    pending = cases.filter("action = 'CHALLENGE'").select(F.col("seq").alias("case_id"), F.lit(True).alias("pending"))
    known = cases.select(F.col("seq").alias("case_id"), "action")
    d = log.withColumn("turn", F.row_number().over(w)).join(pending, "case_id", "left").join(known, "case_id", "left")
    ok = F.col("pending").isNotNull() & (F.col("turn") == 1)
    resolved = d.filter(ok).select("case_id", "at", F.when(F.col("passed"), "passed").otherwise("failed").alias("verification"))
    refused = d.filter(~ok).select("case_id", "at", F.when(F.col("action").isNull(), "no such case").otherwise(
        F.concat(F.lit("this case is not awaiting verification (action "), "action", F.lit(", or already resolved)"))).alias("error"))
    return resolved, refused
