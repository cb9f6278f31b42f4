"""Evaluation of scored cases: the full report, operating points and label-timing bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frisk.config import DEFAULT, Settings
from frisk.functions.keep import kept
from frisk.ml.scorers import Scorer
from frisk.operators import drift, metrics
from frisk.operators.decision import with_decision
from frisk.plans.features import feature_rows, scored_cases
from frisk.plans.gate import run_gate


def report_tables(cases: DataFrame, s: Settings = DEFAULT, n_boot: int = 500, reference: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every report as a small table over one stored case table."""
    out = {
        "confusion": metrics.expected_cost(metrics.both_views(cases), s),
        "confidence_intervals": metrics.bootstrap_ci(cases, metrics.stopped(), n_boot),
        "threshold_free": metrics.ranking_quality(cases, "fraud_proba", s),
        "calibration": metrics.calibration_table(cases),
        "calibration_error": metrics.calibration_error(cases),
        "per_scenario": metrics.by_scenario(cases),
        "per_age": metrics.fairness_by_age(cases),
        "decision_mix": metrics.decision_mix(cases),
        "policies": metrics.policy_comparison(cases),
        "money": metrics.money(cases),
    }
    if reference is not None:
        out["psi"] = drift.psi(reference, cases, "risk", s)
        out["psi_after_warmup"] = drift.psi(reference, drift.second_half(cases, s), "risk", s)
    return out


def report_json(tables: dict[str, DataFrame]) -> DataFrame:
    """(section, rows as one JSON array): the whole report as one small frame."""
    parts = [t.select(F.lit(name).alias("section"), F.to_json(F.struct("*")).alias("row")) for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("section").agg(F.array_join(F.array_sort(F.collect_list("row")), ",").alias("rows"))


def operating_points(rows: DataFrame, scorer: Scorer, thresholds: list[float], s: Settings = DEFAULT) -> DataFrame:
    """Confusion and cost per threshold from one scoring pass (profiles gated by label)."""
    scored = scored_cases(rows, scorer, thresholds[0], s).drop("risk", "action", "model_says_fraud", "rules_only", "model_only", "full")
    each = scored.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    acted = with_decision(each, F.col("threshold"), s)
    return metrics.expected_cost(metrics.with_rates(metrics.confusion(acted, metrics.stopped(), ["threshold"])), s)


def gated_operating_points(events: DataFrame, scorer: Scorer, thresholds: list[float], customers: DataFrame | None = None,
                           s: Settings = DEFAULT) -> DataFrame:
    """The same with each threshold's decisions feeding back into the profiles (one gate run each)."""
    out = None
    for t in thresholds:
        cm = metrics.confusion(run_gate(events, scorer, t, customers, s), metrics.stopped()).withColumn("threshold", F.lit(float(t)))
        out = cm if out is None else out.unionByName(cm)
    return metrics.expected_cost(metrics.with_rates(out), s)


def label_timing(events: DataFrame, scorer: Scorer, threshold: float, customers: DataFrame | None = None, s: Settings = DEFAULT,
                 delays: tuple[tuple[str, float], ...] = (("instant", 0.0), ("delayed", 72.0), ("never", -1.0))) -> DataFrame:
    """Rates and average precision when outcomes are known at once, late, or never."""
    out = None
    for name, hours in delays:
        c = scored_cases(feature_rows(events, customers, s=s.with_(label_delay_hours=hours)), scorer, threshold, s)
        c = kept(c.select("label", "action", "fraud_proba"))
        r = metrics.with_rates(metrics.confusion(c, metrics.stopped())).crossJoin(metrics.ranking_quality(c, "fraud_proba", s))  # one row each
        r = r.select(F.lit(name).alias("outcomes_known"), "recall", "precision", "false_positive_rate", "pr_auc")
        out = r if out is None else out.unionByName(r)
    return out
