"""Score and rules to action, shadow policies, reasons and the customer alert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frisk.config import DEFAULT, STOPPED, Settings
from frisk.functions.expr import lookup, number

# fixed values: readable feature names
PRETTY = {
    "amount_z": "amount vs. personal norm",
    "amount_to_max": "amount vs. personal record",
    "speed_kmh": "travel speed since last txn",
    "impossible_travel": "impossible-travel flag",
    "new_country": "first time in this country",
    "new_device": "unrecognised device",
    "new_merchant": "never-used merchant",
    "new_beneficiary": "never-used payee",
    "failed_logins_1h": "recent failed logins",
    "txn_count_1h": "transactions in last hour",
    "txn_count_5m": "transactions in last 5 min",
    "amt_sum_1h": "amount spent in last hour",
    "distinct_merchants_24h": "distinct merchants in 24 h",
    "high_risk_mcc": "high-risk merchant category",
    "is_night": "overnight timing",
    "secs_since_last": "time since last txn",
    "seq_surprise": "behaviour-sequence surprise",
    "seq_new_token": "never-seen behaviour pattern",
    "seq_repeat_5": "same pattern repeated rapidly",
    "seq_regime_kl": "sudden shift in behaviour mix",
    "merchant_fraud_rate": "merchant historical fraud rate",
    "device_fraud_rate": "device historical fraud rate",
    "bin_fraud_rate": "card-BIN historical fraud rate",
    "beneficiary_fraud_rate": "payee historical fraud rate",
    "entity_max_fraud_rate": "worst entity fraud rate",
    "device_customer_fanout": "accounts using this device",
    "beneficiary_customer_fanin": "accounts paying this payee",
    "ring_size": "fraud-ring size",
}


def action_for(risk: Column, severity: Column, model_says_fraud: Column, s: Settings = DEFAULT) -> Column:
    sev = F.coalesce(severity, F.lit("none"))
    return (
        F.when((sev == "block") | (risk >= s.risk_block), "BLOCK")
        .when((sev == "challenge") | (risk >= s.risk_challenge) | model_says_fraud, "CHALLENGE")
        .when((sev == "flag") | (risk >= s.risk_review), "REVIEW")
        .otherwise("ALLOW")
    )


def rules_only_action(severity: Column, s: Settings = DEFAULT) -> Column:
    return action_for(F.lit(0.0), severity, F.lit(False), s)


def blend(proba: Column, novelty: Column, s: Settings = DEFAULT) -> Column:
    """Risk = weighted calibrated probability and novelty, kept in [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s.w_supervised * proba + s.w_anomaly * novelty))


def with_decision(df: DataFrame, threshold: float | Column, settings: Settings = DEFAULT) -> DataFrame:
    """Needs fraud_proba, anomaly, severity; adds risk, action and the three shadow actions."""
    s = settings
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    adj = F.col("online_adjustment") if "online_adjustment" in df.columns else F.lit(0.0)
    risk = F.greatest(F.lit(0.0), F.least(F.lit(1.0), blend(F.col("fraud_proba"), F.col("anomaly"), s) + adj))
    d = df.withColumn("risk", risk).withColumn("model_says_fraud", F.col("fraud_proba") >= thr)
    says, sev = F.col("model_says_fraud"), F.col("severity")
    return d.withColumns({
        "action": action_for(F.col("risk"), sev, says, s),
        "rules_only": rules_only_action(sev, s),
        "model_only": action_for(F.col("risk"), F.lit(None).cast("string"), says, s),
    }).withColumn("full", F.col("action"))


def needs_evidence(threshold: float | Column, s: Settings = DEFAULT) -> Column:
    """Only cases an analyst may look at are worth the probes and the path search."""
    return (F.size("hits") > 0) | (F.col("risk") >= s.risk_review) | (F.col("fraud_proba") >= threshold)


def _percent(c: Column) -> Column:
    return F.concat(number(c * 100, "0"), F.lit("%"))


def reasons(top: Column | None = None) -> Column:
    """Headline, rule messages, then model contrasts where there is no rule or the txn is stopped.

    ``top`` is an array of (feature, value, contribution).
    """
    head = F.concat(F.lit("Risk "), _percent(F.col("risk")), F.lit(" — calibrated fraud probability "),
                    _percent(F.col("fraud_proba")), F.lit(", novelty "), _percent(F.col("anomaly")))
    out = F.concat(F.array(head), F.transform("hits", lambda h: h["message"]))
    if top is None:
        return out

    def line(x):
        sign = F.when(x["contribution"] >= 0, "+").otherwise("")
        name = F.coalesce(lookup(PRETTY, x["feature"]), F.replace(x["feature"], F.lit("_"), F.lit(" ")))
        return F.concat(name, F.lit(": "), number(x["value"], "0.00"), F.lit(" ("), sign,
                        number(x["contribution"] * 100, "0"), F.lit(" pp calibrated-probability contrast vs reference)"))

    strong = F.filter(F.coalesce(top, F.array().cast("array<struct<feature:string,value:double,contribution:double>>")),
                      lambda x: F.abs(x["contribution"]) >= 1e-4)
    show = (F.size("hits") == 0) | F.col("action").isin(*STOPPED)
    return F.when(show, F.concat(out, F.transform(strong, line))).otherwise(out)


def customer_alert() -> Column:
    what = F.concat(F.lit("₹"), number(F.col("amount"), "#,##0.00"), F.lit(" "), F.col("channel"), F.lit(" transaction"))
    return (
        F.when(F.col("action") == "BLOCK", F.concat(
            F.lit("We blocked a suspicious "), what,
            F.lit(" on your account. If this was you, reply YES or approve it in the app.")))
        .when(F.col("action") == "CHALLENGE", F.concat(
            F.lit("Please verify it's you: we've paused a "), what, F.lit(" pending a one-time passcode.")))
    )


def result_reason(reason_list: Column) -> Column:
    """The line shown in a result table: the first reason after the headline, if any."""
    return F.coalesce(F.get(reason_list, F.lit(1)), F.get(reason_list, F.lit(0)))


def is_correct() -> Column:
    return F.col("action").isin(*STOPPED) == (F.col("label") == 1)
