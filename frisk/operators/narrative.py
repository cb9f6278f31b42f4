"""The analyst note of a case, composed from its probes, rules and feature values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frisk.functions.expr import as_int_text, lookup, number

# fixed values: texts per action
HEADLINE = {
    "BLOCK": "Blocked",
    "CHALLENGE": "Step-up verification required",
    "REVIEW": "Flagged for analyst review",
    "ALLOW": "Cleared",
}
RECOMMENDATION = {
    "BLOCK": "Hold the transaction and notify the customer; open a case for confirmation.",
    "CHALLENGE": "Pause and require a one-time passcode / passkey before releasing.",
    "REVIEW": "Allow now, but queue for an analyst to look at within SLA.",
    "ALLOW": "No action — let it through.",
}
VERB = {
    "BLOCK": "was blocked",
    "CHALLENGE": "was paused for verification",
    "REVIEW": "was allowed but flagged",
    "ALLOW": "was allowed",
}
# fixed values: features that only ever raise suspicion, and rules that make a block decisive
RISK_ONLY = (
    "impossible_travel", "speed_kmh", "failed_logins_1h", "new_beneficiary",
    "new_country", "high_risk_mcc", "ring_size", "beneficiary_customer_fanin",
    "seq_regime_kl", "seq_repeat_5", "seq_surprise", "seq_new_token",
    "merchant_fraud_rate", "device_fraud_rate", "beneficiary_fraud_rate",
    "entity_max_fraud_rate", "txn_count_5m", "txn_count_1h", "distinct_countries_24h",
)
DECISIVE_RULES = ("impossible_travel", "known_bad_entity", "card_testing", "ato_login_then_spend")


def clause(name: Column, v: Column) -> Column:
    """The sentence part a feature value stands for, NULL when it says nothing."""
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    whole, pct = as_int_text(v), number(v * 100, "0")
    history = lambda who: F.when(v > 0.05, say(f"the {who} has a ", pct, "% historical fraud rate"))
    on = lambda text: F.when(v >= 1, text)
    # fixed values: one text per feature
    table = {
        "amount_z": say("the amount is ", number(F.abs(v), "0.0"), "σ ", F.when(v >= 0, "above").otherwise("below"),
                        " this customer's usual spend"),
        "amount_to_max": F.when(v >= 1, say("it is ", number(v, "0.0"), "× the customer's previous largest transaction"))
        .otherwise("the amount is within the customer's normal range"),
        "new_beneficiary": on("the payee has never been paid before"),
        "new_merchant": on("the merchant is new to this customer"),
        "new_device": F.when(v >= 1, "the device is unrecognised").otherwise("the device is known"),
        "new_country": on("it is the first transaction ever in this country"),
        "is_foreign": on("it is a foreign transaction"),
        "impossible_travel": on("the location is physically unreachable from the previous transaction"),
        "speed_kmh": F.when(v > 900, say("implied travel speed since the last transaction is ", number(v, "#,##0"), " km/h")),
        "failed_logins_1h": F.when(v >= 1, say(whole, " failed logins preceded it")),
        "txn_count_5m": F.when(v >= 3, say(whole, " transactions in the last 5 minutes")),
        "txn_count_1h": F.when(v >= 6, say(whole, " transactions in the last hour")),
        "amt_sum_1h": F.when(v > 0, say("₹", number(v, "#,##0"), " spent in the last hour")),
        "high_risk_mcc": on("it is a high-risk category (crypto / gift card / wire)"),
        "is_night": on("it happened overnight"),
        "merchant_fraud_rate": history("merchant"),
        "device_fraud_rate": history("device"),
        "beneficiary_fraud_rate": history("payee"),
        "entity_max_fraud_rate": F.when(v > 0.05, say(
            "a merchant / device / payee on this transaction has a ", pct, "% fraud history")),
        "ring_size": F.when(v >= 3, say(
            "the device or payee is shared across ", whole, " different customers (fraud-ring pattern)")),
        "beneficiary_customer_fanin": F.when(v >= 3, say(whole, " different customers pay this same payee")),
        "seq_regime_kl": F.when(v > 0.3, "the customer's behaviour pattern shifted abruptly"),
        "seq_repeat_5": F.when(v > 0.5, "the same behaviour pattern is being repeated rapidly"),
        "seq_surprise": F.when(v > 0.5, "this behaviour is unusual for the customer's history"),
        "seq_new_token": on("the customer has never produced this pattern of behaviour"),
        "account_age_days": F.when(v > 400, say("the account is well established (", number(F.floor(v), "#,##0"), " days old)"))
        .otherwise(say("the account is only ", whole, " days old")),
        "distinct_countries_24h": F.when(v >= 3, say("transactions in ", whole, " countries in 24 h")),
    }
    out = F.lit(None).cast("string")
    for key, text in table.items():
        out = F.when(name == key, text).otherwise(out)
    return out


def _sentence_list(items: Column) -> Column:
    n = F.size(items)
    joined = F.concat(F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(" and "), F.get(items, n - 1))
    return F.when(n == 1, F.get(items, F.lit(0))).otherwise(joined)


def with_narrative(cases: DataFrame) -> DataFrame:
    """Add headline, summary, drivers, mitigators, recommendation and ground_truth.

    Needs action, risk, hits, reasons, explanation and the case's own columns.
    """
    c = F.col
    said = F.filter(F.transform("explanation", lambda x: F.struct(
        clause(x["feature"], F.round(x["value"], 3)).alias("text"), (F.round(x["contribution"], 4) >= 0).alias("up"),
        x["feature"].isin(*RISK_ONLY).alias("risk_only"))), lambda x: x["text"].isNotNull())
    pick = lambda keep, k: F.slice(F.transform(F.filter(c("_said"), keep), lambda x: x["text"]), 1, k)
    d = cases.withColumn("_said", F.coalesce(said, F.array().cast("array<struct<text:string,up:boolean,risk_only:boolean>>")))
    d = d.withColumns({"drivers": pick(lambda x: x["up"], 3), "mitigators": pick(lambda x: ~x["up"] & ~x["risk_only"], 2)})
    decisive = (c("action") == "BLOCK") & ((c("risk") >= 0.9) | F.exists("hits", lambda h: h["code"].isin(*DECISIVE_RULES)))
    payee = F.coalesce(c("beneficiary"), F.lit(""))
    place = F.coalesce(F.nullif(c("city"), F.lit("")), F.nullif(c("country"), F.lit("")))
    dest = (F.when((payee != "") & (c("new_beneficiary") >= 1), F.concat(F.lit(" to new payee "), payee))
            .when(payee != "", F.concat(F.lit(" to "), payee)).otherwise(F.concat(F.lit(" at "), c("merchant_id"))))
    noun = (F.when(c("channel") == "transfer", "transfer").when(c("channel") == "atm", "ATM withdrawal")
            .otherwise(F.replace(F.concat_ws(" ", "mcc", "channel"), F.lit("_"), F.lit(" "))))
    opening = F.concat(F.lit("This ₹"), number(c("amount"), "#,##0.00"), F.lit(" "), noun, dest,
                       F.coalesce(F.concat(F.lit(" in "), place), F.lit(" in")), F.lit(" by "), c("cust_id"), F.lit(" "),
                       lookup(VERB, c("action")), F.lit("."))
    rule = F.when((F.size("hits") > 0) & c("action").isin("BLOCK", "CHALLENGE"), F.coalesce(
        F.get(c("reasons"), F.lit(1)),
        F.concat(F.lit("A hard rule fired ("), F.replace(F.get(c("hits"), F.lit(0))["code"], F.lit("_"), F.lit(" ")), F.lit(")."))))
    has = lambda name: F.size(name) > 0
    parts = F.array(
        opening, rule,
        F.when(has("drivers"), F.concat(F.lit("Key signals: "), _sentence_list(c("drivers")), F.lit("."))),
        F.when(has("mitigators"), F.concat(F.lit("Lowering concern: "), _sentence_list(c("mitigators")), F.lit("."))),
        F.when(~has("drivers") & ~has("mitigators") & (c("action") == "ALLOW"), F.lit(
            "Amount, merchant, location, device and timing are all consistent with this customer's history.")))
    truth = F.when(c("label") == 1, F.concat(F.lit("fraud ("), F.coalesce(c("scenario"), F.lit("fraud")), F.lit(")"))).otherwise("legitimate")
    right = c("action").isin("BLOCK", "CHALLENGE") == (c("label") == 1)
    return d.withColumns({
        "headline": F.when(decisive, "High-confidence block")
        .when((c("action") == "ALLOW") & (c("risk") < 0.15), "Cleared — looks normal").otherwise(lookup(HEADLINE, c("action"))),
        "summary": F.array_join(F.filter(parts, lambda x: x.isNotNull()), " "),
        "recommendation": lookup(RECOMMENDATION, c("action")),
        "ground_truth": F.concat(F.lit("Ground truth: "), truth, F.lit(" — the model was "),
                                 F.when(right, "correct").otherwise("wrong"), F.lit(".")),
    }).drop("_said")
