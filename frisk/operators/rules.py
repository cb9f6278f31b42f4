"""Deterministic tripwires over a feature row: one struct per hit, in policy order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frisk.config import DEFAULT, Settings
from frisk.functions.expr import as_int_text, number

SEVERITY = {"flag": 1, "challenge": 2, "block": 3}


def _hit(code: str, severity: str, *message) -> Column:
    text = F.concat(*[m if isinstance(m, Column) else F.lit(m) for m in message])
    return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), text.alias("message"))


def is_cold(s: Settings = DEFAULT) -> Column:
    """No established history for this customer."""
    return F.coalesce(F.col("history_n"), F.lit(0.0)) < s.velocity_min_history


def faster_than_usual(count: str, peak: str, s: Settings = DEFAULT) -> Column:
    """Above the customer's own busiest spell; with no history any burst is."""
    return is_cold(s) | (F.col(count) > s.velocity_multiple * F.col(peak))


def rule_structs(s: Settings = DEFAULT) -> list[Column]:
    """One nullable struct column per rule.  Codes, severities and texts are fixed values."""
    c = F.col
    on = lambda name: c(name) >= 1.0
    money = F.concat(F.lit("₹"), number(c("amount"), "#,##0"))
    sigma = F.concat(number(c("amount_z"), "0.0"), F.lit("σ"))
    cold = is_cold(s)
    abroad_large = on("new_country") & (c("amount_z") > 4.0)
    burst = (c("txn_count_5m") >= s.card_testing_count_5m) & faster_than_usual("txn_count_5m", "peak_5m", s)
    tiny_new = (c("amount") <= s.card_testing_max_amount) & on("new_merchant")
    unusual_place = on("new_merchant") | on("is_foreign") | on("high_risk_mcc")
    return [
        F.when(c("amount") >= s.amount_hard_limit, _hit(
            "amount_hard_limit", "block", "Amount ", money, " exceeds the ₹10,00,000 single-transaction hard limit"))
        .when((c("amount") >= s.amount_high) & on("new_device") & cold, _hit(
            "large_new_device_no_history", "block", money, " from an unrecognised device on an account with no history"))
        .when(c("amount") >= s.amount_high, _hit(
            "amount_high", "challenge", "Amount ", money, " is above the ₹2,00,000 verification threshold"))
        .when(on("new_device") & (c("amount") >= s.amount_new_device), _hit(
            "new_device_high_amount", "challenge", money, " from a device this customer has never used"))
        .when(cold & (c("amount") >= s.amount_first_time), _hit(
            "first_time_large", "flag", "First-time customer with no history making a ", money, " payment")),
        F.when(on("impossible_travel"), _hit(
            "impossible_travel", "block", "Impossible travel: ", number(c("dist_from_last_km"), "0"), " km in ",
            number(c("secs_since_last") / 3600, "0.0"), " h (~", number(c("speed_kmh"), "0"),
            " km/h) since the last transaction")),
        F.when(burst & tiny_new, _hit(
            "card_testing", "block", "Card-testing pattern: ", as_int_text(c("txn_count_5m")),
            " small payments to new merchants in 5 minutes"))
        .when(burst, _hit(
            "rapid_burst", "challenge", "Rapid burst: ", as_int_text(c("txn_count_5m")),
            " transactions in 5 minutes — faster than this customer's usual pace")),
        F.when((c("failed_logins_1h") >= s.ato_failed_logins) & (c("amount_to_max") > 1.0), _hit(
            "ato_login_then_spend", "block", "High-value ", c("channel"), " transaction right after ",
            as_int_text(c("failed_logins_1h")), " failed logins — possible account takeover")),
        F.when(abroad_large, _hit(
            "new_country_large_amount", "block", "First-ever transaction in ", c("country"), " at ", sigma,
            " above this customer's normal spend")),
        F.when(on("new_device") & on("channel_online") & (c("amount") > 5000) & (c("failed_logins_1h") >= 1.0), _hit(
            "new_device_online_spend", "challenge",
            "Large online purchase from an unrecognised device after a failed login")),
        F.when(on("high_risk_mcc") & on("new_merchant") & (c("amount_z") > 2.0), _hit(
            "high_risk_new_merchant", "challenge", "Large payment to a new ", F.replace(c("mcc"), F.lit("_"), F.lit(" ")),
            " merchant (", sigma, " above normal)")),
        F.when((c("txn_count_1h") >= s.velocity_count_1h) & faster_than_usual("txn_count_1h", "peak_1h", s), _hit(
            "velocity_1h", "challenge", "Unusual velocity: ", as_int_text(c("txn_count_1h")), " transactions in the past hour")),
        F.when(c("entity_max_fraud_rate") >= s.entity_block_rate, _hit(
            "known_bad_entity", "block", "Merchant / device / payee on this transaction has a ",
            number(c("entity_max_fraud_rate") * 100, "0"), "% historical fraud rate")),
        F.when(c("ring_size") >= s.ring_size_challenge, _hit(
            "fraud_ring", "challenge", "Device or beneficiary is shared across ", as_int_text(c("ring_size")),
            " different customers — likely a fraud ring / mule account")),
        F.when(on("new_beneficiary") & on("channel_transfer") & (c("amount_z") > 1.5), _hit(
            "new_payee_large_transfer", "flag", "Large transfer to a payee this customer has never sent to before")),
        F.when((c("amount_z") > 4.0) & (c("amount") > 1500) & unusual_place & ~abroad_large, _hit(
            "amount_spike", "flag", "Amount is ", sigma,
            " above this customer's usual spend, at a new/foreign/high-risk merchant")),
        F.when(on("is_foreign") & on("new_country") & on("channel_pos"), _hit(
            "foreign_pos_first_visit", "flag", "In-person spend in ", c("country"), " for the first time")),
    ]


def worst_severity(hits: Column) -> Column:
    """The highest severity among hits, NULL when there are none."""
    rank = F.array_max(F.transform(hits, lambda h: F.when(h["severity"] == "block", 3)
                                   .when(h["severity"] == "challenge", 2).otherwise(1)))
    return F.when(rank == 3, "block").when(rank == 2, "challenge").when(rank == 1, "flag")


def with_rules(df: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Add ``hits`` (array of code, severity, message) and ``severity``."""
    hits = F.filter(F.array(*rule_structs(settings)), lambda h: h.isNotNull())
    return df.withColumn("hits", hits).withColumn("severity", worst_severity(F.col("hits")))
