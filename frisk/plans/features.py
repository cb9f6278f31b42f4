"""Whole feature rows and cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frisk.config import DEFAULT, Settings
from frisk.functions.expr import age_bracket, age_from_id
from frisk.functions.keep import kept
from frisk.ml.scorers import Scorer
from frisk.operators.decision import customer_alert, is_correct, reasons, with_decision
from frisk.operators.entity import entity_features
from frisk.operators.profile import profile_features
from frisk.operators.rules import with_rules


def with_age(txns: DataFrame, customers: DataFrame | None) -> DataFrame:
    """Stated age, else the dimension's, else a stable one from the id; and its bracket."""
    if customers is not None and "age" in customers.columns:
        txns = txns.join(customers.select("cust_id", F.col("age").alias("_dim_age")), "cust_id", "left")
    else:
        txns = txns.withColumn("_dim_age", F.lit(None).cast("int"))
    age = F.coalesce("cust_age", "_dim_age", age_from_id(F.col("cust_id")))
    return txns.withColumn("cust_age", age).withColumn("age_bracket", age_bracket(F.col("cust_age"))).drop("_dim_age")


def feature_rows(events: DataFrame, customers: DataFrame | None = None, accepted: Column | None = None,
                 s: Settings = DEFAULT, confirms: DataFrame | None = None, entities: DataFrame | None = None,
                 early_logins: bool = True) -> DataFrame:
    """Every transaction with all 48 features and its velocity baseline."""
    prof = profile_features(events, customers, accepted, s, early_logins)
    ent = entities if entities is not None else entity_features(events.filter("type = 'txn'"), s, confirms)
    return prof.join(ent, "seq")


def scored_cases(rows: DataFrame, scorer: Scorer, threshold: float, s: Settings = DEFAULT) -> DataFrame:
    """Feature rows through scorer, rules and decision."""
    return with_decision(with_rules(scorer(rows), s), threshold, s)


def case_table(cases: DataFrame, explanation: DataFrame | None = None) -> DataFrame:
    """Reasons, alert, rule codes and correctness added; explanation joined where computed."""
    kind = "array<struct<feature:string,value:double,contribution:double>>"
    if explanation is None:
        cases = cases.withColumn("explanation", F.array().cast(kind))
    else:
        cases = cases.join(explanation, "seq", "left").withColumn(
            "explanation", F.coalesce("explanation", F.array().cast(kind)))
    return cases.withColumns({
        "reasons": reasons(F.col("explanation")), "customer_alert": customer_alert(),
        "rule_hits": F.transform("hits", lambda h: h["code"]), "correct": is_correct()})


__all__ = ["kept", "with_age", "feature_rows", "scored_cases", "case_table"]
