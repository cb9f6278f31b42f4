"""A small, capped risk correction learned from analyst feedback on matched cases.

Two learners.  ``fit_adjustment`` refits once over a closed log.  ``weight_versions`` replays the log: every verdict that matches a case is one
gradient step, in the order in which verdicts arrived, and each case is read under the weights that stood when it came
(``with_online_adjustment``), so a replay of a month corrects each case as the live desk would have.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml import Pipeline
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frisk.config import DEFAULT, US, Settings
from frisk.functions.keep import kept
from frisk.ml.scorers import Scorer
from frisk.operators.labels import latest_feedback, match_feedback
from frisk.operators.running import global_running
from frisk.plans.features import scored_cases

# fixed values: the features the correction may look at
ADJUST_COLUMNS = (
    "amount_z", "new_device", "new_country", "new_beneficiary",
    "impossible_travel", "merchant_fraud_rate", "device_fraud_rate",
    "beneficiary_fraud_rate", "entity_max_fraud_rate", "seq_surprise",
)


def fit_adjustment(log: DataFrame, cases: DataFrame, s: Settings = DEFAULT):
    """A pipeline over feedback joined to cases, or None below ``feedback_min_labels``."""
    fb = latest_feedback(log)
    hit = match_feedback(fb, cases).join(fb.select("log_id", F.col("label").cast("double").alias("_fb")), "log_id")
    d = hit.join(cases.withColumnRenamed("seq", "case_id").select("case_id", *ADJUST_COLUMNS), "case_id")
    r = d.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_fb").alias("k")).first()
    if r["n"] < s.feedback_min_labels or r["k"] < 2:
        return None
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(ADJUST_COLUMNS), outputCol="_av", handleInvalid="keep"),
        StandardScaler(inputCol="_av", outputCol="_as", withMean=True),
        LogisticRegression(featuresCol="_as", labelCol="_fb", regParam=1e-4, maxIter=100, probabilityCol="_ap",
                           rawPredictionCol="_ar", predictionCol="_ad"),
    ]).fit(d)


def with_adjustment(df: DataFrame, fitted, s: Settings = DEFAULT) -> DataFrame:
    """Adds ``online_adjustment`` in [-cap, +cap]; 0 while there is no fitted correction."""
    if fitted is None:
        return df.withColumn("online_adjustment", F.lit(0.0))
    p = vector_to_array("_ap")[1]
    cap = s.feedback_cap
    adj = F.greatest(F.lit(-cap), F.least(F.lit(cap), (p - 0.5) * 2 * cap))
    return fitted.transform(df).withColumn("online_adjustment", adj).drop("_av", "_as", "_ap", "_ar", "_ad")


# --- one gradient step a verdict -----------------------------------------------------------------------------------

_ALPHA = 1e-4  # weight decay
_FIRST_RATE_AT = 1000.0  # the step size is 1 / (alpha * (this + steps before))
_BROADCAST_VERSIONS = 100_000  # 23 numbers each; more are joined by shuffle
_VERSION = "version long, weights array<double>, bias double, center array<double>"


def _vector() -> Column:
    """The ten features as an array; a missing one is 0."""
    return F.array(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in ADJUST_COLUMNS])


def feedback_steps(log: DataFrame, features: DataFrame) -> DataFrame:
    """(recorded_at, log_id, x, label) of every verdict that matches a case which had come by then.

    ``log`` may hold several verdicts on one case: each is a step of its own.  ``features`` needs seq, cust_id, ts, amount and the ten features.
    """
    hit = match_feedback(log, features).join(log.select("log_id", "recorded_at", F.col("label").cast("int").alias("label")), "log_id")
    at = features.select(F.col("seq").alias("case_id"), F.col("ts").alias("_ts"), _vector().alias("x"))
    return hit.join(at, "case_id").filter("_ts <= recorded_at AND label IS NOT NULL").select("recorded_at", "log_id", "x", "label")


def _descend(batches: Iterator) -> Iterator:
    """Weights after each step; features are taken relative to the first verdict's."""
    import pandas as pd
    size = len(ADJUST_COLUMNS)
    center, w, b, k = None, [0.0] * size, 0.0, 0
    for pdf in batches:
        out = []
        for x, label in zip(pdf["x"], pdf["label"]):
            x = [float(v) for v in x]
            center = center or x
            z = [v - c for v, c in zip(x, center)]
            p = b
            for wi, zi in zip(w, z):
                p += wi * zi
            chance = 1.0 / (1.0 + math.exp(-p)) if p >= 0 else math.exp(max(p, -700.0)) / (1.0 + math.exp(max(p, -700.0)))
            rate = 1.0 / (_ALPHA * (_FIRST_RATE_AT + k))
            step, shrink = rate * ((1.0 if label == 1 else 0.0) - chance), 1.0 - rate * _ALPHA
            w, b, k = [wi * shrink + step * zi for wi, zi in zip(w, z)], b + step, k + 1
            out.append((k, w, b, center))
        yield pd.DataFrame(out, columns=["version", "weights", "bias", "center"])


def weight_versions(steps: DataFrame) -> DataFrame:
    """(version, weights, bias, center): the weights after the first, second, ... verdict.

    A step needs the weights the one before left, so the verdicts stream, in Arrow batches, through one sorted partition; it holds one
    set of weights.  Verdicts are written by analysts: their number follows the desk, not the transactions.
    """
    return steps.repartition(1).sortWithinPartitions("recorded_at", "log_id").select("x", "label").mapInPandas(_descend, _VERSION)


def with_online_adjustment(rows: DataFrame, log: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Adds ``updates`` (verdicts learned when the row came) and ``online_adjustment`` in [-cap, +cap].

    A verdict counts for rows at its arrival or later; below ``feedback_min_labels`` verdicts the adjustment is 0.  Which version a row
    meets is a running count over verdicts and rows in time order, summed by time buckets: no task sees the whole table.
    """
    steps = kept(feedback_steps(log, rows))
    versions = kept(weight_versions(steps))
    learned = versions.count()
    marks = steps.select(F.col("recorded_at").alias("ts"), F.lit(0).alias("is_row"), F.col("log_id").alias("seq")).unionByName(
        rows.select("ts", F.lit(1).alias("is_row"), "seq"))
    bucket = F.floor(F.unix_micros("ts") / (s.prior_bucket_s * US))
    counted = global_running(marks, bucket, [F.col("ts"), F.col("is_row"), F.col("seq")], {"updates": 1 - F.col("is_row")})
    known = counted.filter("is_row = 1").select("seq", F.col("updates").cast("long").alias("updates"))
    versions = versions.filter(F.col("version") >= s.feedback_min_labels).withColumnRenamed("version", "updates")
    versions = F.broadcast(versions) if learned <= _BROADCAST_VERSIONS else versions
    d = rows.join(known, "seq").join(versions, "updates", "left")
    z = F.zip_with(_vector(), "center", lambda x, c: x - c)
    p = F.aggregate(F.zip_with("weights", z, lambda w, v: w * v), F.col("bias"), lambda acc, v: acc + v)
    cap = s.feedback_cap
    adjustment = F.greatest(F.lit(-cap), F.least(F.lit(cap), (1.0 / (1.0 + F.exp(-p)) - 0.5) * 2 * cap))
    return d.withColumn("online_adjustment", F.when(F.col("weights").isNull(), 0.0).otherwise(adjustment)).drop("weights", "bias", "center")


def adjusted_cases(rows: DataFrame, scorer: Scorer, threshold: float, log: DataFrame, s: Settings = DEFAULT,
                   features: DataFrame | None = None) -> DataFrame:
    """Feature rows through scorer, rules and decision, each risk corrected by what analysts had taught until then.

    ``features`` (default: ``rows``) holds, by seq, the case keys and the ten features that the correction reads; only these pass its window.
    """
    told = (rows if features is None else features).select("seq", "cust_id", "ts", "amount", *ADJUST_COLUMNS)
    learnt = with_online_adjustment(told, log, s).select("seq", "updates", "online_adjustment")
    return scored_cases(rows.join(learnt, "seq"), scorer, threshold, s)
