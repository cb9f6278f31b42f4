"""The decision gate in batch.

A profile learns from a transaction only if the decision on it let it through, and that decision
depends on the profile.  Decisions of a customer depend only on that customer's earlier ones, so
repeating the window pass with the last pass's gate fixes at least one more row per customer each
time and ends at the sequential answer.  Only customers that changed enter the next pass.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frisk.config import DEFAULT, Settings
from frisk.ml.scorers import Scorer
from frisk.operators.entity import entity_features
from frisk.operators.profile import profile_features
from frisk.plans.features import kept, scored_cases


def let_through(label_known: Column | None = None, verified: Column | None = None) -> Column:
    """Accepted = allowed or under review, or challenged and known (or verified) to be genuine."""
    known = F.lit(True) if label_known is None else label_known
    passed = known & (F.col("label") == 0)
    if verified is not None:
        passed = passed | F.coalesce(verified, F.lit(False))
    return F.col("action").isin("ALLOW", "REVIEW") | ((F.col("action") == "CHALLENGE") & passed)


def run_gate(events: DataFrame, scorer: Scorer, threshold: float, customers: DataFrame | None = None,
             s: Settings = DEFAULT, max_passes: int | None = None, accepted_rule: Column | None = None,
             confirms: DataFrame | None = None, entities: DataFrame | None = None) -> DataFrame:
    """Scored cases under the engine's own gate, plus ``accepted``.

    Rows of ``events`` with a non-NULL ``settled`` column keep that decision (earlier batches).
    Every pass settles at least one more row of each moving customer, so passes end by themselves; only moving customers are
    computed again.  A given ``max_passes`` raises when it is reached: a half-settled table is not a result.
    """
    rule = let_through() if accepted_rule is None else accepted_rule
    entities = kept(entity_features(events.filter("type = 'txn'"), s, confirms) if entities is None else entities)
    if "settled" not in events.columns:
        events = events.withColumn("settled", F.lit(None).cast("boolean"))
    start = F.coalesce("settled", F.col("label") == 0)
    open_events = kept(events.withColumn("_accepted", F.when(F.col("type") == "txn", start)))
    done = None
    for _ in count() if max_passes is None else range(max_passes):
        rows = profile_features(open_events, customers, F.col("_accepted"), s).join(entities, "seq")
        cases = scored_cases(rows, scorer, threshold, s).withColumn("accepted", F.coalesce("settled", rule))
        cases = kept(cases)
        moved = cases.filter(F.col("accepted") != F.col("_accepted")).select("cust_id").distinct()
        moved = kept(moved)
        changing = moved.count()
        settled = cases if changing == 0 else cases.join(moved, "cust_id", "left_anti")
        settled = settled.drop("_accepted")
        done = settled if done is None else done.unionByName(settled)
        if changing == 0:
            return done
        new = cases.join(moved, "cust_id", "left_semi").select("seq", F.col("accepted").alias("_new"))
        open_events = kept(
            open_events.join(moved, "cust_id", "left_semi").join(new, "seq", "left")
            .withColumn("_accepted", F.col("_new")).drop("_new"))
    raise RuntimeError(f"decision gate not settled after {max_passes} passes")
