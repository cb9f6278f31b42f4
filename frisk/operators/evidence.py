"""Evidence for a scored case: probes, counterfactual path, what-if and robustness sweep.

Everything is rescoring: rows are multiplied by a small constant (48 probes, 8 groups, 21
points), scored in one distributed pass, and folded back per case.  Callers filter first
(``needs_evidence``), so only reviewable cases are multiplied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frisk.config import DEFAULT, FEATURE_COLUMNS, Settings
from frisk.ml.scorers import Scorer
from frisk.operators.decision import with_decision
from frisk.operators.rules import with_rules

# fixed values: features that change together in a counterfactual
GROUPS = (
    ("transaction amount", ("amount", "amount_log", "amount_z", "amount_to_max")),
    ("spending velocity", ("txn_count_5m", "txn_count_1h", "txn_count_24h", "amt_sum_1h", "amt_sum_24h")),
    ("customer and channel context", (
        "new_merchant", "new_device", "new_beneficiary", "is_foreign", "high_risk_mcc",
        "channel_pos", "channel_online", "channel_atm", "channel_transfer")),
    ("location and travel", (
        "new_country", "dist_from_last_km", "speed_kmh", "impossible_travel", "distinct_countries_24h")),
    ("authentication", ("failed_logins_1h", "logins_1h")),
    ("behaviour sequence", ("seq_surprise", "seq_new_token", "seq_repeat_5", "seq_regime_kl")),
    ("merchant and network history", (
        "merchant_fraud_rate", "merchant_txn_count", "merchant_age_days", "bin_fraud_rate",
        "device_fraud_rate", "device_customer_fanout", "device_is_global_new", "beneficiary_fraud_rate",
        "beneficiary_customer_fanin", "beneficiary_is_global_new", "beneficiary_txn_count",
        "entity_max_fraud_rate", "ring_size")),
    ("timing and customer history", (
        "hour", "is_night", "is_weekend", "secs_since_last", "distinct_merchants_24h", "account_age_days")),
)

# fixed values: plausible range per swept feature
SWEEP_RANGES = {
    "amount": (1.0, 5000.0),
    "amount_z": (-2.0, 8.0),
    "new_device": (0.0, 1.0),
    "new_merchant": (0.0, 1.0),
    "new_beneficiary": (0.0, 1.0),
    "new_country": (0.0, 1.0),
    "is_foreign": (0.0, 1.0),
    "is_night": (0.0, 1.0),
    "txn_count_1h": (0.0, 25.0),
    "txn_count_5m": (0.0, 15.0),
    "failed_logins_1h": (0.0, 8.0),
    "merchant_fraud_rate": (0.0, 0.6),
    "device_fraud_rate": (0.0, 0.6),
    "beneficiary_fraud_rate": (0.0, 0.6),
    "ring_size": (0.0, 8.0),
    "speed_kmh": (0.0, 2000.0),
}
_GROUP_OF = {name: g for g, (_, names) in enumerate(GROUPS) for name in names}
_AMOUNT_LINKED = ("amount_z", "amount_to_max", "amt_sum_1h", "amt_sum_24h")


def feature_probes(cases: DataFrame, scorer: Scorer, reference: dict[str, float], top: int = 5) -> DataFrame:
    """(seq, explanation): the features whose reference value moves the probability most."""
    cols = [c for c in FEATURE_COLUMNS if c in reference]
    own = F.array(*[F.col(c) for c in cols])
    grid = cases.select("seq", own.alias("_own"), *cols, F.explode(F.sequence(F.lit(-1), F.lit(len(cols) - 1))).alias("_i"))
    grid = grid.withColumns({c: F.when(F.col("_i") == i, F.lit(float(reference[c]))).otherwise(F.col(c))
                             for i, c in enumerate(cols)})
    p = scorer(grid).select("seq", "_i", "_own", "fraud_proba")
    folded = p.groupBy("seq").agg(
        F.max(F.when(F.col("_i") == -1, F.col("fraud_proba"))).alias("base"),
        F.collect_list(F.when(F.col("_i") >= 0, F.struct(
            F.col("_i").alias("i"), F.col("fraud_proba").alias("p"), F.col("_own")[F.col("_i")].alias("v")))).alias("probes"))
    names = F.array(*[F.lit(c) for c in cols])
    ranked = F.array_sort(F.transform("probes", lambda x: F.struct(
        (-F.abs(F.col("base") - x["p"])).alias("rank"), x["i"].alias("i"),
        F.get(names, x["i"]).alias("feature"), x["v"].alias("value"), (F.col("base") - x["p"]).alias("contribution"))))
    return folded.select("seq", F.transform(F.slice(ranked, 1, top), lambda x: F.struct(
        x["feature"].alias("feature"), x["value"].alias("value"), x["contribution"].alias("contribution"))).alias("explanation"))


def _with_mask(df: DataFrame, mask: Column, reference: dict[str, float]) -> DataFrame:
    """Feature columns rebuilt from ``_own`` with the masked groups at their reference."""
    bit = lambda g: F.shiftright(mask, g).bitwiseAND(F.lit(1)) == 1
    cols = {}
    for i, c in enumerate(FEATURE_COLUMNS):
        own = F.get(F.col("_own"), F.lit(i))
        g = _GROUP_OF.get(c)
        cols[c] = own if g is None else F.when(bit(g), F.lit(float(reference[c]))).otherwise(own)
    return df.withColumns(cols)


def counterfactual(cases: DataFrame, scorer: Scorer, reference: dict[str, float], threshold: float) -> DataFrame:
    """Greedy group path below ``threshold``, then pruned; one row per case.

    Eight rounds unrolled into one linear plan: each tries every unused group of each open case
    and keeps the best, partitioned by case from the first round on.  Closed cases pass through.
    """
    keep = ("_own", "base", "mask", "p", "open", "chosen")
    d = scorer(cases.select("seq", *FEATURE_COLUMNS))
    d = d.select("seq", F.array(*[F.col(c) for c in FEATURE_COLUMNS]).alias("_own"), F.col("fraud_proba").alias("base"),
                 F.lit(0).alias("mask"), F.col("fraud_proba").alias("p"),
                 (F.col("fraud_proba") >= threshold).alias("open"), F.array().cast("array<int>").alias("chosen"))
    every = F.array(*[F.lit(g) for g in range(len(GROUPS))])
    for _ in GROUPS:
        left = F.filter(every, lambda g: ~F.array_contains(F.col("chosen"), g))
        tried = d.withColumn("g", F.explode(F.when(F.col("open"), left).otherwise(F.array(F.lit(-1)))))
        power = F.when(F.col("g") >= 0, F.expr("shiftleft(1, greatest(g, 0))")).otherwise(0)
        tried = tried.withColumn("try", F.col("mask") + power)
        scored = scorer(_with_mask(tried, F.col("try"), reference)).select(
            "seq", *keep, "g", "try", F.col("fraud_proba").alias("q"))
        best = scored.groupBy("seq").agg(
            F.min_by(F.struct("g", "try", "q"), F.struct("q", "g")).alias("b"), *[F.first(c).alias(c) for c in keep])
        better = F.col("open") & (F.col("b.q") < F.col("p"))
        d = best.select(
            "seq", "_own", "base",
            F.when(better, F.col("b.try")).otherwise(F.col("mask")).alias("mask"),
            F.when(better, F.col("b.q")).otherwise(F.col("p")).alias("p"),
            (better & (F.col("b.q") >= threshold) & (F.size("chosen") < len(GROUPS) - 1)).alias("open"),
            F.when(better, F.concat("chosen", F.array("b.g"))).otherwise(F.col("chosen")).alias("chosen"))
    # prune from the last chosen group back: score every subset of the (few) chosen groups once
    d = d.withColumn("found", (F.col("base") >= threshold) & (F.col("p") < threshold))
    bits = F.transform("chosen", lambda g: F.call_function("shiftleft", F.lit(1), g))
    subset = lambda acc, b: F.concat(acc, F.transform(acc, lambda m: m.bitwiseOR(b)))
    subsets = F.aggregate(bits, F.array(F.lit(0)), subset)
    tried = d.withColumn("try", F.explode(F.when(F.col("found"), subsets).otherwise(F.array(F.col("mask")))))
    scored = scorer(_with_mask(tried, F.col("try"), reference)).select(
        "seq", *keep, "found", F.struct("try", F.col("fraud_proba").alias("q")).alias("s"))
    d = scored.groupBy("seq").agg(
        F.map_from_entries(F.collect_list("s")).alias("probs"), *[F.first(c).alias(c) for c in (*keep, "found")])

    def prune(state, bit):
        less = state["mask"].bitwiseAND(F.bitwise_not(bit))
        q = F.try_element_at(F.col("probs"), less)
        return F.when(q < threshold, F.struct(less.alias("mask"), q.alias("p"))).otherwise(state)

    bits = F.transform(F.reverse("chosen"), lambda g: F.call_function("shiftleft", F.lit(1), g))
    end = F.aggregate(bits, F.struct(F.col("mask").alias("mask"), F.col("p").alias("p")), prune)
    d = d.withColumn("end", F.when(F.col("found"), end).otherwise(F.struct(F.col("mask").alias("mask"), F.col("p").alias("p"))))
    d = d.select("seq", "_own", "base", "chosen", "found", "end.*")
    labels = F.array(*[F.lit(name) for name, _ in GROUPS])
    kept = F.filter("chosen", lambda g: F.col("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1), g)) != 0)

    changes = []
    for g, (_, names) in enumerate(GROUPS):
        per = []
        for c in names:
            before, after = F.get(F.col("_own"), F.lit(FEATURE_COLUMNS.index(c))), F.lit(float(reference[c]))
            moved = F.abs(before - after) > 1e-8 + 1e-6 * F.abs(after)
            per.append(F.when(moved, F.struct(F.lit(c).alias("feature"), F.round(before, 4).alias("from"), F.round(after, 4).alias("to"))))
        changes.append(F.filter(F.array(*per), lambda x: x.isNotNull()))
    table = F.array(*changes)
    groups = F.filter(F.transform(kept, lambda g: F.struct(F.get(labels, g).alias("label"), F.get(table, g).alias("changes"))),
                      lambda x: F.size(x["changes"]) > 0)
    none = F.array().cast("array<struct<label:string,changes:array<struct<feature:string,from:double,to:double>>>>")
    low = F.col("base") < threshold
    return d.select(
        "seq", "found", F.round("base", 4).alias("base_probability"), F.lit(round(threshold, 4)).alias("target_probability"),
        F.when(F.col("found"), groups).otherwise(none).alias("groups"),
        F.when(~low, F.round("p", 4)).alias("counterfactual_probability"),
        F.when(low, "The calibrated fraud probability is already below the model threshold.")
        .when(F.col("found"), "A below-threshold reference path was found.")
        .otherwise("No below-threshold path was found using the configured reference groups.").alias("message"))


def stored_features(cases: DataFrame) -> DataFrame:
    """Case features as kept for later questions: three places."""
    return cases.withColumns({c: F.round(c, 3) for c in FEATURE_COLUMNS})


def _rescore(df: DataFrame, scorer: Scorer, threshold: float, s: Settings) -> DataFrame:
    drop = [c for c in ("fraud_proba", "anomaly", "hits", "severity", "risk", "action", "model_says_fraud",
                        "rules_only", "model_only", "full", "online_adjustment") if c in df.columns]
    return with_decision(with_rules(scorer(df.drop(*drop)), s), threshold, s)


def what_if(cases: DataFrame, overrides: DataFrame, scorer: Scorer, threshold: float, s: Settings = DEFAULT) -> DataFrame:
    """Rescore cases under overrides (seq, amount_mult, changes map) with the case's own baseline."""
    base = stored_features(cases).withColumns({"base_action": F.col("action"), "base_risk": F.round("risk", 4)})
    d = base.join(overrides, "seq")
    mult = F.coalesce(F.nullif(F.col("amount_mult"), F.lit(0.0)), F.lit(1.0))
    scaled = F.abs(mult - 1.0) > 1e-6
    amount = F.when(scaled, F.greatest(F.col("amount") * mult, F.lit(0.01))).otherwise(F.col("amount"))
    new = {"amount": amount, "amount_log": F.when(scaled, F.log1p(amount)).otherwise(F.col("amount_log"))}
    new |= {c: F.when(scaled, F.col(c) * mult).otherwise(F.col(c)) for c in _AMOUNT_LINKED}
    d = d.withColumns(new)
    d = d.withColumns({c: F.coalesce(F.try_element_at("changes", F.lit(c)), F.col(c)) for c in FEATURE_COLUMNS})
    out = _rescore(d, scorer, threshold, s)
    return out.select("seq", "base_action", "base_risk", "action", F.round("risk", 4).alias("risk"),
                      F.round("fraud_proba", 4).alias("fraud_proba"), F.transform("hits", lambda h: h["code"]).alias("rule_hits"),
                      (F.col("action") != F.col("base_action")).alias("flipped"))


def sweep_points(cases: DataFrame, features: list[str], scorer: Scorer, threshold: float, steps: int = 21,
                 s: Settings = DEFAULT) -> DataFrame:
    """(seq, feature, i, value, risk, action, rule_hits) across each feature's range."""
    unknown = set(features) - set(FEATURE_COLUMNS)
    if unknown:
        raise ValueError(f"unknown feature: {', '.join(sorted(unknown))}")
    base = stored_features(cases)

    def span(c: str) -> Column:
        if c in SWEEP_RANGES:
            lo, hi = (F.lit(x) for x in SWEEP_RANGES[c])
        else:  # a flag sweeps 0..1, anything else a wide band around its value
            reach = F.greatest(F.abs(F.col(c)), F.lit(1.0)) * 3
            is_flag = F.col(c).between(0.0, 1.0)
            lo = F.when(is_flag, 0.0).otherwise(F.greatest(F.lit(0.0), F.col(c) - reach))
            hi = F.when(is_flag, 1.0).otherwise(F.col(c) + reach)
        return F.struct(F.lit(c).alias("feature"), lo.alias("lo"), hi.alias("hi"), F.col(c).alias("at"))

    d = base.withColumn("f", F.explode(F.array(*[span(c) for c in features])))
    d = d.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    v = F.col("f.lo") + (F.col("f.hi") - F.col("f.lo")) * F.col("i") / max(steps - 1, 1)
    d = d.withColumn("value", v)
    mult = F.greatest(F.col("value"), F.lit(0.01)) / F.greatest(F.col("amount"), F.lit(0.01))
    on_amount = F.col("f.feature") == "amount"
    linked = {c: F.when(on_amount, F.col(c) * mult).otherwise(F.col(c)) for c in _AMOUNT_LINKED}
    linked["amount_log"] = F.when(on_amount, F.log1p(F.greatest(F.col("value"), F.lit(0.0)))).otherwise(F.col("amount_log"))
    d = d.withColumns(linked)
    d = d.withColumns({c: F.when(F.col("f.feature") == c, F.col("value")).otherwise(F.col(c)) for c in features})
    d = d.withColumns({"feature": F.col("f.feature"), "base_value": F.col("f.at"), "base_action": F.col("action")})
    out = _rescore(d, scorer, threshold, s)
    return out.select("seq", "feature", "base_value", "base_action", "i", F.round("value", 4).alias("value"),
                      F.round("risk", 4).alias("risk"), "action", F.size("hits").alias("rule_hits"))


def sweep_summary(points: DataFrame) -> DataFrame:
    """Decision flips along each curve; at most one flip is a clean threshold."""
    w = Window.partitionBy("seq", "feature").orderBy("i")
    flip = F.lag("action").over(w) != F.col("action")
    g = points.withColumn("flip", F.coalesce(flip, F.lit(False))).groupBy("seq", "feature").agg(
        F.first("base_action").alias("base_action"), F.count_if("flip").alias("n_decision_flips"),
        F.min("risk").alias("min_risk"), F.max("risk").alias("max_risk"))
    return g.withColumn("monotonic", F.col("n_decision_flips") <= 1)
