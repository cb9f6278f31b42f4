"""Every operator as a named query over the warehouse tables, most with an SQL statement to match."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frisk.config import ACTIONS, DEFAULT
from frisk.functions.expr import rounded
from frisk.functions.keep import kept, stored
from frisk.ml.scorers import COEFFICIENTS, fixed_scorer
from frisk.operators import drift, evidence, graph, labels, metrics, review_queue
from frisk.operators.decision import customer_alert, reasons, result_reason, rules_only_action
from frisk.operators.entity import entity_features, entity_snapshot, outcome_rows, running_prior
from frisk.operators.profile import profile_features
from frisk.operators.rules import with_rules
from frisk.plans import oracle_sql as Q
from frisk.plans.features import case_table, feature_rows, scored_cases, with_age
from frisk.sources.tables import busy_account_events, event_customers, events_as_account_events, payments, read, shipments_as_account_events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
THRESHOLD = 0.3


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


# --- shared inputs ------------------------------------------------------------------------

def _events(spark, d):
    return events_as_account_events(spark, d)


def _txns(spark, d):
    return payments(spark, d)


def _profile(spark, d):
    return profile_features(_events(spark, d), event_customers(spark, d))


def _features(spark, d):
    return feature_rows(_events(spark, d), event_customers(spark, d), entities=entity_features(_txns(spark, d)))


def cases(spark, d, s=DEFAULT, threshold=THRESHOLD):
    """Scored cases with the fixed scorer and the label gate (decisions do not feed back)."""
    rows = with_age(_features(spark, d), event_customers(spark, d))
    return scored_cases(rows, fixed_scorer, threshold, s)


def _cols(df: DataFrame, *names: str, places: int = 4) -> DataFrame:
    return df.select("seq", *[rounded(F.col(n), places).alias(n) for n in names])


def _r(*names: str, places: int = 4) -> str:
    return ", ".join(f"round({n}, {places}) + 0e0 AS {n}" for n in names)


# --- profile features -----------------------------------------------------------------------

PROFILE_QUERIES = {
    "profile_amount": ("amount", "amount_log", "amount_z", "amount_to_max"),
    "profile_calendar": ("hour", "is_night", "is_weekend", "account_age_days", "high_risk_mcc",
                         "channel_pos", "channel_online", "channel_atm", "channel_transfer"),
    "profile_novelty": ("new_merchant", "new_country", "new_device", "new_beneficiary", "is_foreign"),
    "profile_geo": ("dist_from_last_km", "speed_kmh", "impossible_travel", "secs_since_last"),  # whole micros: six places
    "profile_velocity": ("txn_count_5m", "txn_count_1h", "txn_count_24h", "amt_sum_1h", "amt_sum_24h",
                         "distinct_merchants_24h", "distinct_countries_24h"),
    "profile_logins": ("failed_logins_1h", "logins_1h"),
    "sequence_signals": ("seq_surprise", "seq_new_token", "seq_repeat_5", "seq_regime_kl"),
    "velocity_baseline": ("peak_5m", "peak_1h", "history_n"),
}
for _name, _names in PROFILE_QUERIES.items():
    query(_name, f"{Q.P} SELECT seq, {_r(*_names, places=6)} FROM prof")(
        lambda spark, d, names=_names: _cols(_profile(spark, d), *names, places=6))

# --- entity features ------------------------------------------------------------------------

ENTITY_QUERIES = {
    "entity_rates": ("merchant_fraud_rate", "beneficiary_fraud_rate", "entity_max_fraud_rate"),
    "entity_rates_excluding": ("bin_fraud_rate", "device_fraud_rate"),
    "entity_txn_count": ("merchant_txn_count", "beneficiary_txn_count", "merchant_age_days"),
    "entity_fanout": ("device_customer_fanout", "beneficiary_customer_fanin", "device_is_global_new", "beneficiary_is_global_new"),
    "ring_size": ("ring_size",),
}
for _name, _names in ENTITY_QUERIES.items():
    query(_name, f"{Q.E} SELECT seq, {_r(*_names, places=6)} FROM ent")(
        lambda spark, d, names=_names: _cols(entity_features(_txns(spark, d)), *names, places=6))


@query("entity_rates_instant", f"{Q.with_(Q.BASE, Q.entity_ctes('0'))} SELECT seq, "
       + _r("merchant_fraud_rate", "device_fraud_rate", "beneficiary_fraud_rate", "prior", places=10) + " FROM ent")
def entity_rates_instant(spark, d):
    s = DEFAULT.with_(label_delay_hours=0)
    return _cols(entity_features(_txns(spark, d), s), "merchant_fraud_rate", "device_fraud_rate", "beneficiary_fraud_rate", "prior", places=10)


@query("running_prior", f"{Q.E} SELECT seq, {_r('prior', places=8)} FROM pr")
def running_prior_query(spark, d):
    return _cols(running_prior(outcome_rows(_txns(spark, d))), "prior", places=8)


@query("entity_snapshot", f"""{Q.E},
 upto AS (SELECT max(t) AS a FROM txn),
 pc AS (SELECT kind, key, cust_id, sum(w * obs) AS wn, sum(w * con) AS wf, sum(obs) AS c, min(CASE WHEN obs = 1 THEN t END) AS ft, max(t) AS lt
        FROM ew, upto WHERE t <= a GROUP BY kind, key, cust_id),
 sn AS (SELECT kind, key, sum(wn) / pow(2e0, (max(lt) - {Q.ANCHOR}) / {Q.HALF_LIFE}) AS n, sum(wf) / pow(2e0, (max(lt) - {Q.ANCHOR}) / {Q.HALF_LIFE}) AS f,
        count(CASE WHEN c > 0 THEN 1 END) AS customers, max(lt) AS lt FROM pc GROUP BY kind, key)
 SELECT kind, key, round(n, 6) AS n, round(f, 6) AS f, customers FROM sn, upto WHERE NOT ((a - lt) / 86400e6 > 5 AND n < 1 AND NOT f > 0)""")
def entity_snapshot_query(spark, d):
    snap = entity_snapshot(_txns(spark, d), DEFAULT.with_(prune_idle_days=5.0))
    return snap.select("kind", "key", rounded(F.col("n"), 6).alias("n"), rounded(F.col("f"), 6).alias("f"), "customers")


_EDGE_SQL = """ edges AS (
  SELECT DISTINCT cust_id, kind, key FROM (
    SELECT cust_id, 'merchant' AS kind, merchant_id AS key FROM txn UNION ALL SELECT cust_id, 'bin', card_bin FROM txn
    UNION ALL SELECT cust_id, 'device', device_id FROM txn UNION ALL SELECT cust_id, 'beneficiary', beneficiary FROM txn) WHERE key NOT IN ('', '?'))"""


@query("entity_edges", f"{Q.with_(Q.BASE, _EDGE_SQL)} SELECT kind, key, count(*) AS customers FROM edges GROUP BY kind, key")
def entity_edges(spark, d):
    return graph.entity_edges(_txns(spark, d)).groupBy("kind", "key").agg(F.count(F.lit(1)).alias("customers"))


@query("entity_connections", f"""{Q.with_(Q.BASE, _EDGE_SQL)}, few AS (
   SELECT kind, key, list_sort(list(cust_id)) AS custs, count(*) AS total_customers FROM edges GROUP BY kind, key),
 foc AS (SELECT seq, cust_id, 'merchant' AS kind, merchant_id AS key FROM txn UNION ALL SELECT seq, cust_id, 'bin', card_bin FROM txn
    UNION ALL SELECT seq, cust_id, 'device', device_id FROM txn UNION ALL SELECT seq, cust_id, 'beneficiary', beneficiary FROM txn)
 SELECT seq, f.kind, f.key, array_to_string(list_filter(custs, lambda x: x <> f.cust_id)[1:8], ',') AS shared_with, total_customers
 FROM foc f JOIN few ON few.kind = f.kind AND few.key = f.key WHERE total_customers > 1""")
def entity_connections(spark, d):
    t = _txns(spark, d)
    out = graph.connections(t, t)
    return out.select("seq", "kind", "key", F.array_join("shared_with", ",").alias("shared_with"), "total_customers")


@query("case_graph_size", f"""{Q.with_(Q.BASE, _EDGE_SQL)}, few AS (
   SELECT kind, key, list_sort(list(cust_id)) AS custs FROM edges GROUP BY kind, key),
 foc AS (SELECT seq, cust_id, 'merchant' AS kind, merchant_id AS key FROM txn UNION ALL SELECT seq, cust_id, 'bin', card_bin FROM txn
    UNION ALL SELECT seq, cust_id, 'device', device_id FROM txn UNION ALL SELECT seq, cust_id, 'beneficiary', beneficiary FROM txn),
 ln AS (SELECT seq, cust_id, concat(f.kind, ':', f.key) AS e, unnest(list_filter(custs, lambda x: x <> f.cust_id)[1:8]) AS o
        FROM foc f JOIN few ON few.kind = f.kind AND few.key = f.key WHERE len(custs) > 1)
 SELECT seq, count(DISTINCT e) + count(DISTINCT o) + 1 AS nodes, count(DISTINCT concat(o, '|', e)) + count(DISTINCT e) AS edges FROM ln GROUP BY seq""")
def case_graph_size(spark, d):
    t = _txns(spark, d)
    nodes, edges = graph.case_graph(graph.connections(t, t))
    n = nodes.groupBy("seq").agg(F.count(F.lit(1)).alias("nodes"))
    return n.join(edges.groupBy("seq").agg(F.count(F.lit(1)).alias("edges")), "seq")


# --- the same over bursts and large amounts -------------------------------------------------

def _busy_profile(spark, d, s=DEFAULT):
    return profile_features(busy_account_events(spark, d), event_customers(spark, d), None, s)


def _busy_features(spark, d):
    events = busy_account_events(spark, d)
    return feature_rows(events, event_customers(spark, d), entities=entity_features(events.filter("type = 'txn'")))


_BUSY_COLUMNS = (*PROFILE_QUERIES["profile_velocity"], *PROFILE_QUERIES["profile_logins"], *PROFILE_QUERIES["profile_novelty"], *PROFILE_QUERIES["velocity_baseline"],
                 "amount_z", "amount_to_max", "speed_kmh", "secs_since_last", "seq_surprise", "seq_new_token", "seq_regime_kl")
for _name, _s in (("busy_profile", DEFAULT), ("busy_profile_hot_keys", DEFAULT.with_(hot_rows=40))):
    query(_name, Q.on_busy(f"{Q.P} SELECT seq, {_r(*_BUSY_COLUMNS, places=6)} FROM prof"))(
        lambda spark, d, s=_s: _cols(_busy_profile(spark, d, s), *_BUSY_COLUMNS, places=6))  # whole micros: six places


@query("busy_rule_hits", Q.on_busy(f"{Q.X} SELECT seq, code, severity, message FROM hits"))
def busy_rule_hits(spark, d):
    """Every rule meets rows that fire it."""
    return with_rules(_busy_features(spark, d)).select("seq", F.explode("hits").alias("h")).select("seq", "h.code", "h.severity", "h.message")


@query("busy_scores_and_actions", Q.on_busy(f"{Q.C} SELECT seq, {_r('fraud_proba', 'anomaly', 'risk', places=8)}, action FROM cases"))
def busy_scores_and_actions(spark, d):
    c = scored_cases(with_age(_busy_features(spark, d), event_customers(spark, d)), fixed_scorer, THRESHOLD, DEFAULT)
    return _cols(c, "fraud_proba", "anomaly", "risk", places=8).join(c.select("seq", "action"), "seq")


# --- rules and decisions --------------------------------------------------------------------

@query("rules_only_mix", f"""{Q.with_(Q.BASE, Q.PROFILE, "prof_ AS (SELECT prof.*, 0e0 AS entity_max_fraud_rate, 0e0 AS ring_size FROM prof)",
        Q.rules_ctes("prof_"))}, acted AS (SELECT p.channel, p.label, p.amount, {Q.action_sql("0", "coalesce(s.rank, 0)", "false")} AS action
        FROM prof p LEFT JOIN sev s ON s.seq = p.seq)
 SELECT channel, count(*) AS processed, """ + ", ".join(f"count(CASE WHEN action = '{a}' THEN 1 END) AS n_{a.lower()}" for a in ACTIONS) + """,
 count(CASE WHEN label = 1 AND action IN ('BLOCK','CHALLENGE') THEN 1 END) AS fraud_stopped,
 round(coalesce(sum(CASE WHEN label = 1 AND action IN ('BLOCK','CHALLENGE') THEN amount END), 0e0), 2) AS amount_saved FROM acted GROUP BY channel""")
def rules_only_mix(spark, d):
    """Profile features, behavioural rules, rules-only action, counted per channel."""
    rows = _profile(spark, d).withColumns({"entity_max_fraud_rate": F.lit(0.0), "ring_size": F.lit(0.0)})
    acted = with_rules(rows).withColumn("action", rules_only_action(F.col("severity")))
    hit = (F.col("label") == 1) & metrics.stopped()
    return acted.groupBy("channel").agg(
        F.count(F.lit(1)).alias("processed"), *[F.count_if(F.col("action") == a).alias("n_" + a.lower()) for a in ACTIONS],
        F.count_if(hit).alias("fraud_stopped"),
        F.round(F.coalesce(F.sum(F.when(hit, F.col("amount"))), F.lit(0.0)), 2).alias("amount_saved"))


@query("rule_hits", f"{Q.X} SELECT seq, code, severity, message FROM hits")
def rule_hits(spark, d):
    return with_rules(_features(spark, d)).select("seq", F.explode("hits").alias("h")).select("seq", "h.code", "h.severity", "h.message")


@query("worst_severity", f"""{Q.X} SELECT f.seq, CASE s.rank WHEN 3 THEN 'block' WHEN 2 THEN 'challenge' WHEN 1 THEN 'flag' END AS severity,
  coalesce(s.n_hits, 0) AS n_hits FROM feat f LEFT JOIN sev s ON s.seq = f.seq""")
def worst_severity(spark, d):
    return with_rules(_features(spark, d)).select("seq", "severity", F.size("hits").cast("long").alias("n_hits"))


@query("scores_and_actions", f"{Q.C} SELECT seq, {_r('fraud_proba', 'anomaly', 'risk', places=8)}, action FROM cases")
def scores_and_actions(spark, d):
    c = cases(spark, d)
    return c.select("seq", *[rounded(F.col(n), 8).alias(n) for n in ("fraud_proba", "anomaly", "risk")], "action")


@query("shadow_policies", f'{Q.C} SELECT seq, rules_only, model_only, "full" FROM cases')
def shadow_policies(spark, d):
    return cases(spark, d).select("seq", "rules_only", "model_only", "full")


@query("customer_alerts", f"""{Q.C} SELECT seq, CASE action
   WHEN 'BLOCK' THEN concat('We blocked a suspicious ₹', format('{{:,.2f}}', amount), ' ', channel, ' transaction on your account. If this was you, reply YES or approve it in the app.')
   ELSE concat('Please verify it''s you: we''ve paused a ₹', format('{{:,.2f}}', amount), ' ', channel, ' transaction pending a one-time passcode.') END AS customer_alert
 FROM cases WHERE action IN ('BLOCK','CHALLENGE')""")
def customer_alerts(spark, d):
    return cases(spark, d).filter(metrics.stopped()).select("seq", customer_alert().alias("customer_alert"))


@query("result_reasons", f"""{Q.C} SELECT c.seq, coalesce(h.message, concat('Risk ', format('{{:.0f}}', risk * 100), '% — calibrated fraud probability ',
   format('{{:.0f}}', fraud_proba * 100), '%, novelty ', format('{{:.0f}}', anomaly * 100), '%')) AS reason
 FROM cases c LEFT JOIN (SELECT seq, arg_min(message, pos) AS message FROM hits GROUP BY seq) h ON h.seq = c.seq""")
def result_reasons(spark, d):
    return cases(spark, d).select("seq", result_reason(reasons()).alias("reason"))


# --- reports ----------------------------------------------------------------------------------

_STOP = "action IN ('BLOCK','CHALLENGE')"
_CELLS = ", ".join(f"count(CASE WHEN {c} THEN 1 END) AS {n}" for n, c in (
    ("tp", "label = 1 AND hit"), ("fp", "label = 0 AND hit"), ("tn", "label = 0 AND NOT hit"), ("fn", "label = 1 AND NOT hit")))
_RATES = """round(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 6) AS precision, round(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 6) AS recall,
 round(tn / nullif(CAST(tn + fp AS DOUBLE), 0), 6) AS specificity, round(fp / nullif(CAST(fp + tn AS DOUBLE), 0), 6) AS false_positive_rate,
 round(fn / nullif(CAST(fn + tp AS DOUBLE), 0), 6) AS false_negative_rate,
 round(2 * (tp / nullif(CAST(tp + fp AS DOUBLE), 0)) * (tp / nullif(CAST(tp + fn AS DOUBLE), 0)) / nullif(tp / nullif(CAST(tp + fp AS DOUBLE), 0) + tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0), 6) AS f1,
 round((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / nullif(sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 6) AS mcc,
 round((tp / nullif(CAST(tp + fn AS DOUBLE), 0) + tn / nullif(CAST(tn + fp AS DOUBLE), 0)) / 2, 6) AS balanced_accuracy,
 round((tp + tn) / nullif(CAST(tp + fp + tn + fn AS DOUBLE), 0), 6) AS accuracy"""
_RATE_NAMES = ("precision", "recall", "specificity", "false_positive_rate", "false_negative_rate", "f1", "mcc", "balanced_accuracy", "accuracy")


@query("confusion_views", f"""{Q.C}, long AS (SELECT 'stopped' AS view, label, {_STOP} AS hit FROM cases UNION ALL SELECT 'block_only', label, action = 'BLOCK' FROM cases),
 cm AS (SELECT view, {_CELLS} FROM long GROUP BY view)
 SELECT view, tp, fp, tn, fn, {_RATES}, round(fp / nullif(CAST(tp AS DOUBLE), 0), 6) AS false_alarms_per_fraud, round(1e0 * fn + 4e-2 * fp, 6) AS expected_cost FROM cm""")
def confusion_views(spark, d):
    v = metrics.expected_cost(metrics.both_views(cases(spark, d)))
    return v.select("view", *metrics.CELLS, *[rounded(F.col(n), 6).alias(n) for n in (*_RATE_NAMES, "false_alarms_per_fraud", "expected_cost")])


@query("live_counters", f"""{Q.C}, a AS (SELECT count(*) AS processed, """ + ", ".join(f"count(CASE WHEN action = '{a}' THEN 1 END) AS n_{a.lower()}" for a in ACTIONS) + f""",
  count(CASE WHEN label = 1 THEN 1 END) AS fraud_total, count(CASE WHEN label = 1 AND {_STOP} THEN 1 END) AS fraud_stopped,
  count(CASE WHEN label = 1 AND NOT {_STOP} THEN 1 END) AS fraud_missed, count(CASE WHEN label = 0 AND action = 'BLOCK' THEN 1 END) AS false_positives,
  round(coalesce(sum(CASE WHEN label = 1 AND {_STOP} THEN amount END), 0e0), 2) AS amount_saved FROM cases)
 SELECT *, coalesce(round(fraud_stopped / nullif(CAST(fraud_total AS DOUBLE), 0), 4), 0e0) AS detection_rate,
  coalesce(round(false_positives / nullif(CAST(processed - fraud_total AS DOUBLE), 0), 5), 0e0) AS false_positive_rate FROM a""")
def live_counters(spark, d):
    return metrics.live_counters(cases(spark, d))


@query("decision_mix", f"{Q.C} SELECT channel, " + ", ".join(f"count(CASE WHEN action = '{a}' THEN 1 END) AS n_{a.lower()}" for a in ACTIONS) + " FROM cases GROUP BY channel")
def decision_mix(spark, d):
    return metrics.decision_mix(cases(spark, d), ["channel"])


@query("by_scenario", f"""{Q.C} SELECT mcc AS scenario, count(*) AS fraud, count(CASE WHEN {_STOP} THEN 1 END) AS caught,
  round(count(CASE WHEN {_STOP} THEN 1 END) / CAST(count(*) AS DOUBLE), 4) AS recall, false AS adversarial FROM cases WHERE label = 1 GROUP BY mcc""")
def by_scenario(spark, d):
    return metrics.by_scenario(cases(spark, d).withColumn("scenario", F.col("mcc")))


@query("policy_comparison", f"""{Q.C}, long AS (SELECT 'rules_only' AS policy, rules_only AS act, label FROM cases UNION ALL SELECT 'model_only', model_only, label FROM cases
   UNION ALL SELECT 'full', "full", label FROM cases),
 g AS (SELECT policy, count(CASE WHEN label = 1 AND act IN ('BLOCK','CHALLENGE') THEN 1 END) AS caught, count(CASE WHEN label = 0 AND act = 'BLOCK' THEN 1 END) AS fp,
   count(CASE WHEN label = 1 THEN 1 END) AS ft, count(*) AS n FROM long GROUP BY policy)
 SELECT policy, caught, fp, coalesce(round(caught / nullif(CAST(ft AS DOUBLE), 0), 4), 0e0) AS detection_rate,
   coalesce(round(fp / nullif(CAST(n - ft AS DOUBLE), 0), 5), 0e0) AS false_positive_rate FROM g""")
def policy_comparison(spark, d):
    return metrics.policy_comparison(cases(spark, d))


_BRACKETS = "br AS (SELECT unnest(['18-25','26-40','41-60','60+']) AS age_bracket)"


@query("age_breakdown", f"""{Q.C}, {_BRACKETS}, g AS (SELECT b.age_bracket, count(c.seq) AS transactions, count(CASE WHEN label = 1 THEN 1 END) AS fraud,
   count(CASE WHEN label = 0 THEN 1 END) AS legit, count(CASE WHEN {_STOP} THEN 1 END) AS stopped, count(CASE WHEN label = 1 AND {_STOP} THEN 1 END) AS fraud_caught,
   count(CASE WHEN label = 0 AND {_STOP} THEN 1 END) AS legit_stopped, round(coalesce(sum(amount), 0e0), 2) AS amount,
   round(coalesce(sum(CASE WHEN {_STOP} THEN amount END), 0e0), 2) AS amount_stopped
   FROM br b LEFT JOIN cases c ON c.age_bracket = b.age_bracket GROUP BY b.age_bracket)
 SELECT *, fraud_caught / nullif(CAST(fraud AS DOUBLE), 0) AS detection_rate, legit_stopped / nullif(CAST(legit AS DOUBLE), 0) AS false_positive_rate,
   fraud / nullif(CAST(transactions AS DOUBLE), 0) AS fraud_rate, round(amount / nullif(CAST(transactions AS DOUBLE), 0), 2) AS avg_amount FROM g""")
def age_breakdown(spark, d):
    return metrics.age_breakdown(cases(spark, d))


@query("fairness_by_age", f"""{Q.C}, long AS (SELECT age_bracket, label, {_STOP} AS hit FROM cases), cm AS (SELECT age_bracket, {_CELLS} FROM long GROUP BY age_bracket),
 r AS (SELECT *, round(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 4) AS recall, round(fp / nullif(CAST(fp + tn AS DOUBLE), 0), 5) AS false_positive_rate,
   round(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 4) AS precision FROM cm)
 SELECT *, CASE WHEN count(false_positive_rate) OVER () >= 2 THEN round(max(false_positive_rate) OVER () - min(false_positive_rate) OVER (), 5) END AS fpr_gap,
   CASE WHEN count(recall) OVER () >= 2 THEN round(max(recall) OVER () - min(recall) OVER (), 4) END AS recall_gap FROM r""")
def fairness_by_age(spark, d):
    return metrics.fairness_by_age(cases(spark, d))


@query("money", f"""{Q.C} SELECT round(sum(CASE WHEN label = 1 THEN amount ELSE 0e0 END), 2) AS fraud_amount,
   round(sum(CASE WHEN label = 1 AND {_STOP} THEN amount ELSE 0e0 END), 2) AS prevented,
   round(sum(CASE WHEN label = 1 AND {_STOP} THEN amount ELSE 0e0 END) / nullif(sum(CASE WHEN label = 1 THEN amount ELSE 0e0 END), 0), 4) AS prevented_share FROM cases""")
def money(spark, d):
    return metrics.money(cases(spark, d))


_CUM = f"""{Q.C}, g AS (SELECT fraud_proba AS score, CAST(count(CASE WHEN label = 1 THEN 1 END) AS DOUBLE) AS pos, CAST(count(CASE WHEN label = 0 THEN 1 END) AS DOUBLE) AS neg FROM cases GROUP BY fraud_proba),
 cu AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g)"""


@query("ranking_quality", f"{_CUM} SELECT round(sum(neg * (tp - pos / 2)) / (max(p) * max(n)), 8) AS roc_auc, round(sum(pos * tp / (tp + fp)) / max(p), 8) AS pr_auc FROM cu")
def ranking_quality(spark, d):
    r = metrics.ranking_quality(cases(spark, d), "fraud_proba")
    return r.select(F.round("roc_auc", 8).alias("roc_auc"), F.round("pr_auc", 8).alias("pr_auc"))


@query("cost_threshold", f"""{_CUM}, b AS (SELECT arg_min(score, (cost, -score)) AS score, min(cost) AS cost, max(p) AS p FROM (SELECT *, 4e-2 * fp + 1e0 * (p - tp) AS cost FROM cu))
 SELECT CASE WHEN p <= cost THEN 1e0 ELSE score END AS threshold, round(CASE WHEN p <= cost THEN p ELSE cost END, 6) AS cost, CAST(p AS BIGINT) AS positives FROM b""")
def cost_threshold(spark, d):
    from frisk.ml.threshold import exact_cost_threshold
    t = exact_cost_threshold(cases(spark, d), "fraud_proba")
    return t.select("threshold", F.round("cost", 6).alias("cost"), "positives")


_EDGES = [i * (1 / 10) for i in range(10)] + [1.0]
_BIN = "CASE " + " ".join(
    f"WHEN fraud_proba >= {_EDGES[i]!r}e0 AND fraud_proba {'<=' if i == 9 else '<'} {_EDGES[i + 1]!r}e0 THEN {i + 1}" for i in range(10)) + " END"


@query("calibration_table", f"""{Q.C} SELECT {_BIN} AS bin, count(*) AS n, round(avg(fraud_proba), 4) AS predicted, round(avg(label), 4) AS observed FROM cases GROUP BY 1""")
def calibration_table(spark, d):
    return metrics.calibration_table(cases(spark, d)).select("bin", "n", "predicted", "observed")


@query("calibration_error", f"""{Q.C}, b AS (SELECT {_BIN} AS bin, count(*) AS n, avg(fraud_proba) AS c, avg(label) AS a FROM cases GROUP BY 1)
 SELECT (SELECT round(sum(n * abs(a - c)) / sum(n), 6) FROM b) AS ece, (SELECT round(avg(pow(fraud_proba - label, 2)), 6) FROM cases) AS brier""")
def calibration_error(spark, d):
    return metrics.calibration_error(cases(spark, d)).select(F.round("ece", 6).alias("ece"), F.round("brier", 6).alias("brier"))


@query("cohort_audit", f"""{Q.C}, tiers AS (SELECT cust_id, CASE WHEN avg(amount) < 280 THEN 'low' WHEN avg(amount) < 530 THEN 'mid' ELSE 'high' END AS tier FROM txn GROUP BY cust_id),
 c AS (SELECT cases.*, tier FROM cases JOIN tiers ON tiers.cust_id = cases.cust_id),
 long AS (SELECT 'country' AS dimension, country AS slice, label, action FROM c UNION ALL SELECT 'tier', tier, label, action FROM c
   UNION ALL SELECT 'age_bracket', age_bracket, label, action FROM c UNION ALL SELECT 'channel', channel, label, action FROM c),
 g AS (SELECT dimension, slice, count(*) AS n, count(CASE WHEN label = 1 THEN 1 END) AS fraud, count(CASE WHEN label = 1 AND {_STOP} THEN 1 END) AS caught,
   count(CASE WHEN label = 0 AND action = 'BLOCK' THEN 1 END) AS wrong FROM long GROUP BY 1, 2),
 r AS (SELECT dimension, slice, n, fraud, caught / nullif(CAST(fraud AS DOUBLE), 0) AS detection, coalesce(wrong / nullif(CAST(n - fraud AS DOUBLE), 0), 0e0) AS fp_rate FROM g),
 b AS (SELECT *, coalesce(min(CASE WHEN n > 50 THEN fp_rate END) OVER (PARTITION BY dimension), 0e0) AS best FROM r)
 SELECT dimension, slice, n, fraud, round(detection, 6) AS detection, round(fp_rate, 6) AS fp_rate,
   n > 50 AND (CASE WHEN best > 1e-9 THEN fp_rate / best ELSE 1e0 END) > 125e-2 AND fp_rate > 2e-3 AS disparate FROM b""")
def cohort_audit(spark, d):
    tier = _txns(spark, d).groupBy("cust_id").agg(metrics.spend_tier(F.avg("amount")).alias("tier"))
    a = metrics.cohort_audit(cases(spark, d).join(tier, "cust_id"))
    return a.select("dimension", "slice", "n", "fraud", rounded(F.col("detection"), 6).alias("detection"),
                    rounded(F.col("fp_rate"), 6).alias("fp_rate"), "disparate")


@query("bootstrap_ci")
def bootstrap_ci(spark, d):
    return metrics.bootstrap_ci(cases(spark, d), metrics.stopped())


# --- drift --------------------------------------------------------------------------------------

_PBIN = "CASE " + " ".join(f"WHEN risk < {0.05 * (i + 1)!r}e0 THEN {i}" for i in range(9)) + " ELSE 9 END"


@query("psi_second_half", f"""{Q.C}, rk AS (SELECT *, row_number() OVER (ORDER BY t, seq) AS r, count(*) OVER () AS n FROM cases),
 bins AS (SELECT CAST(range AS INT) AS bin FROM range(10)),
 h AS (SELECT b.bin, coalesce(count(k.seq), 0) + 1e-6 AS h FROM bins b LEFT JOIN (SELECT {_PBIN} AS bin, seq FROM rk WHERE r <= n // 2) k ON k.bin = b.bin GROUP BY b.bin),
 o AS (SELECT b.bin, CAST(count(k.seq) AS DOUBLE) AS o FROM bins b LEFT JOIN (SELECT {_PBIN} AS bin, seq FROM rk WHERE r > n // 2) k ON k.bin = b.bin GROUP BY b.bin),
 f AS (SELECT h.bin, greatest(h / sum(h) OVER (), 5e-3) AS rf, greatest(o / sum(o) OVER (), 5e-3) AS of_ FROM h JOIN o ON o.bin = h.bin),
 z AS (SELECT rf / sum(rf) OVER () AS rr, of_ / sum(of_) OVER () AS oo FROM f)
 SELECT round(sum((oo - rr) * ln(oo / rr)), 6) AS psi, (SELECT CAST(sum(o) AS BIGINT) FROM o) AS n FROM z""")
def psi_second_half(spark, d):
    c = kept(cases(spark, d).select("ts", "seq", "risk"))
    ranked = drift.with_rank(c)
    total = c.agg(F.count(F.lit(1)).alias("n"))
    first = ranked.crossJoin(F.broadcast(total)).filter(F.col("rank") <= F.floor(F.col("n") / 2)).drop("n")  # one row
    p = drift.psi(drift.score_histogram(first, "risk"), drift.second_half(c), "risk")
    return p.select(rounded(F.col("psi"), 6).alias("psi"), "n")


def _bin_sql(score: str) -> str:
    step = DEFAULT.psi_range_hi / DEFAULT.psi_bins
    return f"CASE WHEN {score} IS NULL THEN NULL " + " ".join(f"WHEN {score} < {step * (i + 1)!r}e0 THEN {i}" for i in range(9)) + " ELSE 9 END"


# every window of the last 2,000 allowed risks; smoothing as a weighted sum over the last 400 indices
_ROLL = f"""{Q.C}, rf AS (SELECT [{", ".join(f"count(CASE WHEN bin = {i} THEN 1 END) + 1e-6" for i in range(10))}] AS r FROM (SELECT {_bin_sql('risk')} AS bin FROM cases)),
 o AS (SELECT seq, t, risk, action, row_number() OVER (ORDER BY t, seq) AS seen FROM cases),
 a AS (SELECT *, row_number() OVER (ORDER BY t, seq) AS k, {_bin_sql('risk')} AS bin FROM o WHERE action = 'ALLOW'),
 h AS (SELECT seq, seen, k, least(k, 2000) AS win, [{", ".join(f"count(CASE WHEN bin = {i} THEN 1 END) OVER w" for i in range(10))}] AS c
   FROM a WINDOW w AS (ORDER BY k ROWS BETWEEN 1999 PRECEDING AND CURRENT ROW)),
 b AS (SELECT min(k) AS bk FROM h WHERE seen >= 2500 AND win >= 800), bc AS (SELECT [y + 1e-6 for y in c] AS r FROM h, b WHERE k = bk),
 x AS (SELECT h.*, coalesce(k >= bk, false) AS moved, CASE WHEN coalesce(k >= bk, false) THEN bc.r ELSE rf.r END AS ref, CASE WHEN coalesce(k >= bk, false) THEN greatest(bk, 400) ELSE 400 END AS start
   FROM h CROSS JOIN b CROSS JOIN rf LEFT JOIN bc ON true),
 f AS (SELECT *, [greatest(y / list_sum(ref), 5e-3) for y in ref] AS rl, [greatest(y / greatest(list_sum(c), 1), 5e-3) for y in c] AS ol FROM x),
 g AS (SELECT * EXCLUDE (rl, ol), [y / list_sum(rl) for y in rl] AS rl, [y / list_sum(ol) for y in ol] AS ol FROM f),
 ix AS (SELECT seq, k, win, moved, k - start AS i, CASE WHEN k >= start THEN list_sum([(z[1] - z[2]) * ln(z[1] / z[2]) for z in list_zip(ol, rl)]) ELSE 0e0 END AS raw FROM g),
 sm AS (SELECT p.seq, sum(CASE WHEN q.i = 0 THEN 1e0 ELSE 1e-1 END * pow(9e-1, p.i - q.i) * q.raw) AS psi FROM ix p JOIN ix q ON q.moved = p.moved AND q.i BETWEEN greatest(p.i - 400, 0) AND p.i
   WHERE p.i >= 0 GROUP BY p.seq),
 roll AS (SELECT ix.seq, ix.k, ix.win AS "window", ix.raw AS psi_raw, coalesce(sm.psi, 0e0) AS psi, CASE WHEN sm.psi IS NULL THEN 'warming' WHEN sm.psi > 35e-2 THEN 'alert' WHEN sm.psi > 18e-2 THEN 'watch'
   ELSE 'stable' END AS state, CAST(moved AS INT) AS segment FROM ix LEFT JOIN sm ON sm.seq = ix.seq)"""
_ROLL_COLS = ("seq", "k", "window", "state", "segment")


@query("rolling_psi")
def rolling_psi(spark, d):
    c = kept(cases(spark, d).select("ts", "seq", "risk", "action"))
    return drift.rolling_psi(c, drift.score_histogram(c, "risk"))


@query("rolling_psi_rows", f'{_ROLL} SELECT seq, k, "window", state, segment, {_r("psi_raw", "psi", places=6)} FROM roll')
def rolling_psi_rows(spark, d):
    """Every row of rolling_psi, rounded."""
    return rolling_psi(spark, d).select(*_ROLL_COLS, *[rounded(F.col(c), 6).alias(c) for c in ("psi_raw", "psi")])


# --- feedback and queue ---------------------------------------------------------------------------

def feedback_log(spark, d) -> DataFrame:
    """A feedback log out of the tables: purchases get a verdict, some of them twice."""
    e = read(spark, d, "events").filter("event_type = 'purchase'")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    base = e.select(F.col("event_id").alias("id"), F.concat(F.lit("u"), F.col("user_id")).alias("cust_id"), F.col("ts").cast("timestamp").alias("ts"),
                    (F.col("value") * 100.0).alias("amount"), k.alias("k"))
    first = base.select((F.col("id") * 2).alias("log_id"), "cust_id", "ts", "amount", F.when(F.col("k") % 3 == 0, 1).otherwise(0).alias("label"),
                        (F.col("ts") + F.expr("interval 1 day")).alias("recorded_at"))
    again = base.filter("k % 2 = 0").select(
        (F.col("id") * 2 + 1).alias("log_id"), "cust_id", "ts", "amount", F.when(F.col("k") % 4 == 0, 1).otherwise(0).alias("label"),
        (F.col("ts") + F.expr("interval 2 days")).alias("recorded_at"))
    return first.unionByName(again)


_FB = """fbb AS (SELECT seq AS id, cust_id, ts, amount, CAST(substr(merchant_id, 2) AS INT) AS m, base_k AS k FROM (
   SELECT txn.*, base.k AS base_k FROM txn JOIN base ON base.seq = txn.seq WHERE channel = 'transfer')),
 fb AS (SELECT id * 2 AS log_id, cust_id, ts, amount, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS label, ts + INTERVAL 1 DAY AS recorded_at FROM fbb
   UNION ALL SELECT id * 2 + 1, cust_id, ts, amount, CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END, ts + INTERVAL 2 DAY FROM fbb WHERE k % 2 = 0),
 lf AS (SELECT cust_id, ts, round(amount, 2) AS amount, arg_max(label, (recorded_at, log_id)) AS label, max(log_id) AS log_id FROM fb GROUP BY 1, 2, 3)"""


@query("feedback_latest", f"{Q.with_(Q.BASE, _FB)} SELECT cust_id, epoch_us(ts) AS t, amount, label, log_id FROM lf")
def feedback_latest(spark, d):
    f = labels.latest_feedback(feedback_log(spark, d))
    return f.select("cust_id", F.unix_micros("ts").alias("t"), "amount", "label", "log_id")


@query("feedback_merge", f"""{Q.with_(Q.BASE, _FB)} SELECT ev.seq, CAST(coalesce(CASE WHEN ev.type = 'txn' THEN lf.label END, ev.label) AS INT) AS label,
   coalesce(ev.type = 'txn' AND lf.label <> ev.label, false) AS label_changed
 FROM ev LEFT JOIN lf ON lf.cust_id = ev.cust_id AND lf.ts = ev.ts AND lf.amount = round(ev.amount, 2)""")
def feedback_merge(spark, d):
    return labels.merge_labels(_events(spark, d), feedback_log(spark, d)).select("seq", "label", "label_changed")


@query("feedback_near_join", f"""{Q.with_(Q.BASE, _FB)} SELECT s.log_id, max(txn.seq) AS case_id FROM
   (SELECT log_id, cust_id, epoch_us(ts) + 1500000 AS ft, round(amount + 4e-3, 2) AS fa FROM fb) s
   JOIN txn ON txn.cust_id = s.cust_id AND abs(s.ft - txn.t) < 2000000 AND abs(s.fa - round(txn.amount, 2)) < 1e-2 GROUP BY s.log_id""")
def feedback_near_join(spark, d):
    f = feedback_log(spark, d)
    shifted = f.withColumns({"ts": F.timestamp_micros(F.unix_micros("ts") + 1_500_000), "amount": F.col("amount") + 0.004})
    return labels.match_feedback(shifted, _txns(spark, d))


_SIGMOID = "CASE WHEN p >= 0 THEN 1e0 / (1e0 + exp(-p)) ELSE exp(greatest(p, -7e2)) / (1e0 + exp(greatest(p, -7e2))) END"
_ADJUST = ("amount_z", "new_device", "new_country", "new_beneficiary", "impossible_travel", "merchant_fraud_rate", "device_fraud_rate", "beneficiary_fraud_rate",
           "entity_max_fraud_rate", "seq_surprise")
# one row a step: the weights after it; features relative to the first verdict's
_LEARN = f"""{Q.C.replace("WITH ", "WITH RECURSIVE ", 1)}, {_FB}, vec AS (SELECT seq, cust_id, t, amount, {", ".join(f"round({c}, 6) + 0e0 AS x{i}" for i, c in enumerate(_ADJUST))} FROM cases),
 hit AS (SELECT fb.log_id, max(vec.seq) AS seq FROM fb JOIN vec ON vec.cust_id = fb.cust_id AND abs(epoch_us(fb.ts) - vec.t) < 2000000 AND abs(round(fb.amount, 2) - round(vec.amount, 2)) < 1e-2 GROUP BY 1),
 stp0 AS (SELECT epoch_us(fb.recorded_at) AS rec, fb.log_id, fb.label, vec.*, row_number() OVER (ORDER BY fb.recorded_at, fb.log_id) AS k FROM hit JOIN fb ON fb.log_id = hit.log_id JOIN vec ON vec.seq = hit.seq
   WHERE vec.t <= epoch_us(fb.recorded_at)),
 mid AS (SELECT {", ".join(f"x{i} AS m{i}" for i in range(10))} FROM stp0 WHERE k = 1),
 stp AS (SELECT k, rec, label, {", ".join(f"x{i} - m{i} AS z{i}" for i in range(10))} FROM stp0, mid),
 lrn AS (SELECT CAST(0 AS BIGINT) AS k, {", ".join(f"CAST(0 AS DOUBLE) AS w{i}" for i in range(10))}, CAST(0 AS DOUBLE) AS b
  UNION ALL SELECT k1, {", ".join(f"w{i} * (1e0 - eta * 1e-4) + stepped * z{i}" for i in range(10))}, b + stepped
   FROM (SELECT *, eta * (label - {_SIGMOID}) AS stepped FROM (SELECT lrn.*, stp.k AS k1, stp.label, {", ".join(f"stp.z{i}" for i in range(10))},
     lrn.b + {" + ".join(f"lrn.w{i} * stp.z{i}" for i in range(10))} AS p, 1e0 / (1e-4 * (1e3 + lrn.k)) AS eta FROM lrn JOIN stp ON stp.k = lrn.k + 1))),
 cnt AS (SELECT seq, count(*) FILTER (WHERE NOT is_row) OVER (ORDER BY t, is_row, seq ROWS UNBOUNDED PRECEDING) AS updates, is_row
   FROM (SELECT seq, t, true AS is_row FROM vec UNION ALL SELECT k, rec, false FROM stp)),
 adj AS (SELECT c.seq, c.updates, CASE WHEN c.updates < 5 THEN 0e0 ELSE greatest(-15e-2, least(15e-2, ({_SIGMOID} - 5e-1) * 3e-1)) END AS adjustment
   FROM (SELECT cnt.*, b + {" + ".join(f"w{i} * (x{i} - m{i})" for i in range(10))} AS p FROM cnt JOIN vec ON vec.seq = cnt.seq CROSS JOIN mid JOIN lrn ON lrn.k = cnt.updates WHERE is_row) c)"""


def _rounded_features(spark, d):
    """The feature table with the learner's ten columns at six places, as the statement has them: equal steps need equal inputs."""
    rows = with_age(_features(spark, d), event_customers(spark, d))
    return rows.withColumns({c: rounded(F.col(c), 6) for c in _ADJUST})


@query("online_adjustments", f"{_LEARN} SELECT seq, updates, round(adjustment, 5) + 0e0 AS online_adjustment FROM adj")
def online_adjustments(spark, d):
    """The correction each case gets from the verdicts that had come by its time."""
    from frisk.ml.feedback_adjust import with_online_adjustment
    rows = kept(_rounded_features(spark, d).select("seq", "cust_id", "ts", "amount", *_ADJUST))
    return with_online_adjustment(rows, feedback_log(spark, d)).select("seq", "updates", rounded(F.col("online_adjustment"), 5).alias("online_adjustment"))


@query("adjusted_actions", f"""{_LEARN} SELECT seq, updates, round(risk, 8) + 0e0 AS risk, {Q.action_sql('risk', 'rank', f'fraud_proba >= {Q.THRESHOLD}')} AS action
 FROM (SELECT c.seq, updates, rank, fraud_proba, greatest(0e0, least(1e0, c.risk + adjustment)) AS risk FROM cases c JOIN adj ON adj.seq = c.seq)""")
def adjusted_actions(spark, d):
    """Every decision with its risk corrected by the verdicts that had come by its time."""
    from frisk.ml.feedback_adjust import adjusted_cases
    rows = kept(with_age(_features(spark, d), event_customers(spark, d)))
    told = rows.withColumns({c: rounded(F.col(c), 6) for c in _ADJUST})
    return adjusted_cases(rows, fixed_scorer, THRESHOLD, feedback_log(spark, d), features=told).select("seq", "updates", rounded(F.col("risk"), 8).alias("risk"), "action")


@query("maturity_weights", f"""{Q.with_(Q.BASE)}, m AS (SELECT max(t) AS now FROM txn)
 SELECT seq, round(CASE WHEN label = 1 THEN 3e0 ELSE 1e0 END * CASE WHEN (now - t) / 86400e6 < 45 THEN 3e-1 + 7e-1 * greatest((now - t) / 86400e6, 0e0) / 45e0 ELSE 1e0 END, 6) AS weight FROM txn, m""")
def maturity_weights(spark, d):
    return _cols(labels.with_training_weights(_txns(spark, d)), "weight", places=6)


def action_log(spark, d) -> DataFrame:
    """A queue log out of the tables: every event is one analyst action on one of many cases."""
    e = read(spark, d, "events")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    act = F.when(F.col("event_type").isin("view", "click"), "claim").when(F.col("event_type") == "purchase", "resolve").otherwise("release")
    return e.select(
        (F.col("user_id") * 10 + k % 10).alias("case_id"), F.col("event_id").alias("n"), F.col("ts").cast("timestamp").alias("at"), act.alias("action"),
        F.concat(F.lit("a"), k % 3).alias("analyst"), F.when(k % 2 == 0, "fraud").otherwise("legitimate").alias("resolution"))


_QUEUE = """WITH RECURSIVE base AS (
  SELECT event_id AS n, user_id, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, ts FROM events),
lg AS (SELECT user_id * 10 + k % 10 AS case_id, CASE WHEN event_type IN ('view','click') THEN 'claim' WHEN event_type = 'purchase' THEN 'resolve' ELSE 'release' END AS act,
   concat('a', k % 3) AS who, row_number() OVER (PARTITION BY user_id * 10 + k % 10 ORDER BY ts, n) AS i FROM base),
st AS (
  SELECT case_id, CAST(0 AS BIGINT) AS i, 'open' AS status, CAST(NULL AS VARCHAR) AS holder, CAST(NULL AS VARCHAR) AS solver, 0 AS refused, 0 AS accepted FROM (SELECT DISTINCT case_id FROM lg)
  UNION ALL
  SELECT s.case_id, s.li,
    CASE WHEN act = 'resolve' THEN 'resolved' WHEN no THEN status WHEN act = 'claim' THEN 'claimed' ELSE 'open' END,
    CASE WHEN act = 'resolve' OR no THEN holder WHEN act = 'claim' THEN who END,
    CASE WHEN act = 'resolve' THEN who ELSE solver END,
    refused + CASE WHEN no THEN 1 ELSE 0 END, accepted + CASE WHEN no THEN 0 ELSE 1 END
  FROM (SELECT s.*, l.act AS act, l.who AS who, l.i AS li, (l.act <> 'resolve' AND s.status = 'claimed' AND s.holder <> l.who) OR (l.act = 'claim' AND s.status = 'resolved') AS no
        FROM st s JOIN lg l ON l.case_id = s.case_id AND l.i = s.i + 1) s),
fin AS (SELECT st.* FROM st JOIN (SELECT case_id, max(i) AS i FROM lg GROUP BY 1) m ON m.case_id = st.case_id AND m.i = st.i)"""


@query("queue_state", f"{_QUEUE} SELECT case_id, status, holder AS claimed_by, solver AS resolved_by, CAST(accepted AS BIGINT) AS accepted, CAST(refused AS BIGINT) AS refused FROM fin")
def queue_state(spark, d):
    return review_queue.queue_state(action_log(spark, d)).drop("resolution")


@query("queue_counts", f"{_QUEUE} SELECT count(CASE WHEN status = 'open' THEN 1 END) AS open, count(CASE WHEN status = 'claimed' THEN 1 END) AS claimed, count(CASE WHEN status = 'resolved' THEN 1 END) AS resolved FROM fin")
def queue_counts(spark, d):
    log = action_log(spark, d)
    return review_queue.queue_counts(log.select("case_id").distinct(), review_queue.queue_state(log))


@query("queue_enqueue", f"""{Q.C} SELECT c.seq AS case_id, action, round(risk, 4) AS risk, c.cust_id FROM cases c WHERE action IN ('REVIEW','CHALLENGE')
   AND c.seq NOT IN (SELECT seq FROM base WHERE k % 5 = 0)""")
def queue_enqueue(spark, d):
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    known = read(spark, d, "events").filter(k % 5 == 0).select(F.col("event_id").alias("case_id"))
    q = review_queue.enqueue(cases(spark, d), known)
    return q.select("case_id", "action", F.round("risk", 4).alias("risk"), "cust_id")


@query("recent_alerts", f"""{Q.C}, ring AS (SELECT * FROM cases ORDER BY t DESC, seq DESC LIMIT 500)
 SELECT seq, action FROM ring WHERE action IN ('BLOCK','CHALLENGE','REVIEW') ORDER BY t DESC, seq DESC LIMIT 60""")
def recent_alerts(spark, d):
    from frisk.sources.sinks import recent_cases
    return recent_cases(cases(spark, d), 60, only_alerts=True).select("seq", "action")


# --- evidence ---------------------------------------------------------------------------------------

_STORED = "stored AS (SELECT * REPLACE (" + ", ".join(
    f"round({c}, 3) AS {c}" for c in ("amount", "amount_log", "amount_z", "amount_to_max", "dist_from_last_km", "speed_kmh", "secs_since_last",
                                     "amt_sum_1h", "amt_sum_24h", "seq_surprise", "seq_regime_kl", "entity_max_fraud_rate", "ring_size")) + ") FROM cases)"
_RESCORE = f"""sc AS (SELECT v.*, coalesce(s.rank, 0) AS rank2, coalesce(s.n_hits, 0) AS hits2, {Q.PROBA} AS p2, {Q.NOVELTY} AS a2
   FROM v LEFT JOIN sev2 s ON s.seq = v.seq AND s.i = v.i),
 rs AS (SELECT *, greatest(0e0, least(1e0, 75e-2 * p2 + 25e-2 * a2)) AS r2 FROM sc),
 act AS (SELECT *, {Q.action_sql('r2', 'rank2', f'p2 >= {Q.THRESHOLD}')} AS action2 FROM rs)"""


@query("sweep_flips", f"""{Q.C}, {_STORED},
 v AS (SELECT s.* EXCLUDE (amount, amount_log, amount_z, amount_to_max, amt_sum_1h, amt_sum_24h, rank, n_hits), i,
     1e0 + 4999e0 * i / 20 AS amount, ln(1e0 + 1e0 + 4999e0 * i / 20) AS amount_log, amount_z * m AS amount_z, amount_to_max * m AS amount_to_max,
     amt_sum_1h * m AS amt_sum_1h, amt_sum_24h * m AS amt_sum_24h
   FROM (SELECT stored.*, r.i, (1e0 + 4999e0 * r.i / 20) / greatest(stored.amount, 1e-2) AS m FROM stored, (SELECT CAST(range AS INT) AS i FROM range(21)) r WHERE stored.action <> 'ALLOW') s),
 {Q.rules_ctes('v', '2', 'seq, i').strip()}, {_RESCORE},
 fl AS (SELECT seq, action, action2, lag(action2) OVER (PARTITION BY seq ORDER BY i) AS prev FROM act)
 SELECT seq, 'amount' AS feature, any_value(action) AS base_action, count(CASE WHEN prev <> action2 THEN 1 END) AS n_decision_flips,
   count(CASE WHEN prev <> action2 THEN 1 END) <= 1 AS monotonic FROM fl GROUP BY seq""")
def sweep_flips(spark, d):
    c = cases(spark, d).filter("action <> 'ALLOW'")
    s = evidence.sweep_summary(evidence.sweep_points(c, ["amount"], fixed_scorer, THRESHOLD))
    return s.select("seq", "feature", "base_action", "n_decision_flips", "monotonic")


@query("what_if", f"""{Q.C}, {_STORED},
 v AS (SELECT s.* REPLACE (greatest(amount * 2, 1e-2) AS amount, ln(1e0 + greatest(amount * 2, 1e-2)) AS amount_log, amount_z * 2 AS amount_z,
     amount_to_max * 2 AS amount_to_max, amt_sum_1h * 2 AS amt_sum_1h, amt_sum_24h * 2 AS amt_sum_24h, 1e0 AS new_device), 0 AS i FROM (SELECT * EXCLUDE (rank, n_hits) FROM stored) s),
 {Q.rules_ctes('v', '2', 'seq, i').strip()}, {_RESCORE}
 SELECT seq, action AS base_action, action2 AS action, round(r2, 4) AS risk, action <> action2 AS flipped FROM act""")
def what_if(spark, d):
    c = cases(spark, d)
    over = _txns(spark, d).select("seq", F.lit(2.0).alias("amount_mult"), F.create_map(F.lit("new_device"), F.lit(1.0)).alias("changes"))
    w = evidence.what_if(c, over, fixed_scorer, THRESHOLD)
    return w.select("seq", "base_action", "action", "risk", "flipped")


_PROBED = tuple(COEFFICIENTS)
_REF = {"amount_log": 7.0, "seq_surprise": 0.25, "entity_max_fraud_rate": 0.01, "ring_size": 1.0}


def _reference() -> dict[str, float]:
    from frisk.config import FEATURE_COLUMNS
    return {c: _REF.get(c, 0.0) for c in FEATURE_COLUMNS}


@query("feature_probes", f"""{Q.C}, gated AS (SELECT * FROM cases WHERE n_hits > 0 OR risk >= 28e-2 OR fraud_proba >= {Q.THRESHOLD}),
 pr2 AS ({' UNION ALL '.join(f"SELECT seq, '{c}' AS feature, fraud_proba AS base, {Q.PROBA.replace(c, f'{_REF.get(c, 0.0)!r}e0')} AS p FROM gated" for c in _PROBED)})
 SELECT seq, round(max(abs(base - p)), 6) AS strongest, round(sum(CASE WHEN rk <= 5 THEN abs(base - p) END), 6) AS top5 FROM (
   SELECT *, row_number() OVER (PARTITION BY seq ORDER BY abs(base - p) DESC) AS rk FROM pr2) GROUP BY seq""")
def feature_probes(spark, d):
    from frisk.operators.decision import needs_evidence
    c = cases(spark, d).filter(needs_evidence(THRESHOLD))
    e = evidence.feature_probes(c, fixed_scorer, _reference())
    size = F.transform("explanation", lambda x: F.abs(x["contribution"]))
    return e.select("seq", rounded(F.array_max(size), 6).alias("strongest"),
                    rounded(F.aggregate(size, F.lit(0.0), lambda a, x: a + x), 6).alias("top5"))


@query("counterfactuals")
def counterfactuals(spark, d):
    c = cases(spark, d).filter(F.col("fraud_proba") >= THRESHOLD)
    out = evidence.counterfactual(c, fixed_scorer, _reference(), THRESHOLD)
    return out.withColumn("groups", F.array_join(F.transform("groups", lambda g: g["label"]), "; "))


@query("narratives")
def narratives(spark, d):
    from frisk.operators.decision import needs_evidence
    from frisk.operators.narrative import with_narrative
    c = cases(spark, d)
    e = evidence.feature_probes(c.filter(needs_evidence(THRESHOLD)), fixed_scorer, _reference())
    n = with_narrative(case_table(c, e))
    return n.select("seq", "headline", "summary", F.array_join("drivers", "; ").alias("drivers"),
                    F.array_join("mitigators", "; ").alias("mitigators"), "recommendation", "ground_truth")


# --- volume -------------------------------------------------------------------------------------------

@query("shipment_risk_mix")
def shipment_risk_mix(spark, d):
    """The large table end to end: lineitem x orders through features, rules and decision."""
    # read by a dozen branches: joined once, or each of them would shuffle both tables again
    rows = feature_rows(stored(shipments_as_account_events(spark, d)))
    c = scored_cases(rows, fixed_scorer, THRESHOLD)
    return metrics.decision_mix(c, ["channel"])


@query("shipment_volumes", """SELECT channel, count(*) AS n, count(DISTINCT o_custkey) AS customers, sum(label) AS fraud, round(sum(l_extendedprice), 2) AS amount FROM (
   SELECT CASE WHEN l_quantity < 20 THEN 'pos' WHEN l_quantity < 40 THEN 'online' ELSE 'transfer' END AS channel, o_custkey,
     CASE WHEN l_returnflag = 'R' THEN CAST(1 AS BIGINT) ELSE 0 END AS label, CAST(l_extendedprice AS DECIMAL(18,2)) AS l_extendedprice
   FROM lineitem JOIN orders ON o_orderkey = l_orderkey) GROUP BY channel""".replace("sum(label)", "CAST(sum(label) AS BIGINT)").replace(
    "round(sum(l_extendedprice), 2)", "CAST(sum(l_extendedprice) AS DOUBLE)"))
def shipment_volumes(spark, d):
    e = shipments_as_account_events(spark, d)
    return e.groupBy("channel").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("cust_id").alias("customers"), F.sum(F.col("label").cast("long")).alias("fraud"),
        F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("amount"))




# --- operating points and label timing ----------------------------------------------------------------

_POINTS = (0.08, 0.15, 0.3, 0.5)


@query("operating_points", f"""{Q.with_(Q.BASE, Q.PROFILE, Q.ENTITY, Q.FEAT, Q.RULES, Q.cases_ctes())}, th AS (SELECT unnest([8e-2, 15e-2, 3e-1, 5e-1]) AS threshold),
 a AS (SELECT threshold, label, {Q.action_sql('risk', 'rank', 'fraud_proba >= threshold')} IN ('BLOCK','CHALLENGE') AS hit FROM cases, th),
 cm AS (SELECT threshold, {_CELLS} FROM a GROUP BY threshold)
 SELECT threshold, tp, fp, tn, fn, round(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 6) AS recall, round(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 6) AS precision,
   round(1e0 * fn + 4e-2 * fp, 6) AS expected_cost FROM cm""")
def operating_points(spark, d):
    from frisk.plans.evaluate import operating_points as points
    r = points(_features(spark, d), fixed_scorer, list(_POINTS))
    return r.select("threshold", *metrics.CELLS, *[rounded(F.col(n), 6).alias(n) for n in ("recall", "precision", "expected_cost")])


def _timing(name: str, delay: str | None) -> str:
    return f"""SELECT '{name}' AS outcomes_known, (SELECT round(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 6) FROM cm) AS recall,
 (SELECT round(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 6) FROM cm) AS precision, (SELECT round(fp / nullif(CAST(fp + tn AS DOUBLE), 0), 6) FROM cm) AS false_positive_rate,
 (SELECT round(sum(pos * tp / (tp + fp)) / max(p), 6) FROM cu) AS pr_auc"""


def _timing_sql() -> str:
    parts = []
    for name, delay in (("instant", "0"), ("delayed", "259200000000"), ("never", None)):
        body = Q.with_(Q.BASE, Q.PROFILE, Q.entity_ctes(delay), Q.FEAT, Q.RULES, Q.cases_ctes()) + _CUM[len(Q.C):]
        body += f", lg AS (SELECT label, {_STOP} AS hit FROM cases), cm AS (SELECT {_CELLS} FROM lg)"
        parts.append(f"SELECT * FROM ({body} {_timing(name, delay)})")
    return " UNION ALL ".join(parts)


@query("label_timing", _timing_sql())
def label_timing(spark, d):
    from frisk.plans.evaluate import label_timing as timing
    r = timing(_events(spark, d), fixed_scorer, THRESHOLD, event_customers(spark, d))
    return r.select("outcomes_known", *[rounded(F.col(n), 6).alias(n) for n in ("recall", "precision", "false_positive_rate", "pr_auc")])


@query("evaluation_report")
def evaluation_report(spark, d):
    from frisk.plans.evaluate import report_json, report_tables
    c = kept(cases(spark, d).withColumn("scenario", F.col("mcc")))
    return report_json(report_tables(c, reference=drift.score_histogram(c, "risk")))


# --- sources: the tables re-read in each public layout ---------------------------------------------------

_SOURCE_COLS = ("cust_id", "amount", "mcc", "channel", "merchant_id", "beneficiary", "country", "device_id", "card_bin", "label")


def _source(df: DataFrame, layout: str, *extra: str, ages: DataFrame | None = None) -> DataFrame:
    from frisk.sources.layouts import to_events
    e = to_events(df, layout, ages=ages)
    return e.select(F.unix_seconds("ts").alias("t"), *_SOURCE_COLS, *extra)


def _s(c):
    return c.cast("string")


@query("source_sparkov", """SELECT CAST(epoch(l_shipdate) AS BIGINT) AS t, concat('cc_', l_orderkey + 4000000) AS cust_id, l_extendedprice AS amount,
  CASE l_linenumber % 5 WHEN 0 THEN 'grocery' ELSE 'retail' END AS mcc, CASE WHEN l_linenumber % 5 IN (1, 2) THEN 'online' ELSE 'pos' END AS channel,
  concat('m', l_suppkey) AS merchant_id, '' AS beneficiary, 'US' AS country, concat('card_', l_orderkey + 4000000) AS device_id,
  substr(CAST(l_orderkey + 4000000 AS VARCHAR), 1, 6) AS card_bin, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem""")
def source_sparkov(spark, d):
    li, k = read(spark, d, "lineitem"), F.col("l_linenumber") % 5
    return _source(li.select(
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("trans_date_trans_time"), _s(F.col("l_orderkey") + 4_000_000).alias("cc_num"),
        F.concat(F.lit("fraud_m"), "l_suppkey").alias("merchant"),
        F.when(k == 0, "grocery_pos").when(k == 1, "misc_net").when(k == 2, "shopping_net").when(k == 3, "gas_transport").otherwise("food_dining").alias("category"),
        _s(F.col("l_extendedprice")).alias("amt"), F.when(F.col("l_returnflag") == "R", "1").otherwise("0").alias("is_fraud")), "sparkov")


@query("source_ieee", """SELECT o_orderkey * 60 + 1577836800 AS t, concat('ic_', o_custkey, '_', substr(o_orderpriority, 1, 1)) AS cust_id, o_totalprice AS amount,
  concat('pcd_', lower(substr('WCRHSX', CAST(o_custkey % 6 + 1 AS INT), 1))) AS mcc, CASE o_custkey % 6 WHEN 0 THEN 'pos' WHEN 4 THEN 'transfer' ELSE 'online' END AS channel,
  concat(o_custkey, '_', substr('WCRHSX', CAST(o_custkey % 6 + 1 AS INT), 1)) AS merchant_id, CASE WHEN o_custkey % 3 = 0 THEN '' ELSE concat('mail', o_custkey % 3) END AS beneficiary,
  'US' AS country, CASE WHEN o_custkey % 2 = 0 THEN concat('card_', o_custkey) ELSE 'phone' END AS device_id, CAST(o_custkey AS VARCHAR) AS card_bin,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label FROM orders""")
def source_ieee(spark, d):
    o, c = read(spark, d, "orders"), F.col("o_custkey")
    return _source(o.select(
        _s(F.col("o_orderkey") * 60).alias("TransactionDT"), _s(F.col("o_totalprice")).alias("TransactionAmt"),
        F.substring(F.lit("WCRHSX"), (c % 6 + 1).cast("int"), F.lit(1)).alias("ProductCD"), _s(c).alias("card1"),
        F.substring("o_orderpriority", 1, 1).alias("addr1"), F.when(c % 3 == 0, "").otherwise(F.concat(F.lit("mail"), c % 3)).alias("P_emaildomain"),
        F.when(c % 2 == 0, "").otherwise("phone").alias("DeviceInfo"), F.when(F.col("o_orderstatus") == "F", "1").otherwise("NaN").alias("isFraud")), "ieee")


@query("source_upi", """SELECT CAST(floor(epoch(ts)) AS BIGINT) AS t, concat('upi_d', user_id) AS cust_id, value AS amount, 'upi_transfer' AS mcc, 'transfer' AS channel,
  concat('bank', user_id % 5, '_app', user_id % 3) AS merchant_id, '' AS beneficiary, 'IN' AS country, concat('d', user_id) AS device_id,
  substr(sha1(concat('bank', user_id % 5)), 1, 6) AS card_bin, CASE WHEN value > 25e1 THEN 1 ELSE 0 END AS label FROM events WHERE event_type IN ('view', 'purchase')""")
def source_upi(spark, d):
    e, u = read(spark, d, "events"), F.col("user_id")
    return _source(e.select(
        _s(F.col("ts")).alias("timestamp"), _s(F.col("value")).alias("amount"), F.concat(F.lit("d"), u).alias("device_fingerprint"),
        F.concat(F.lit("bank"), u % 5).alias("bank"), F.concat(F.lit("app"), u % 3).alias("upi_app"),
        F.when(F.col("event_type").isin("view", "purchase"), "Success").otherwise("failed").alias("status"),
        F.when(F.col("value") > 250, "True").otherwise("False").alias("is_suspicious")), "upi")


@query("source_paysim", """SELECT o_orderkey % 743 * 3600 + 1577836800 AS t, concat('ps_C', o_custkey) AS cust_id,
  round(exp(ln(50e0) + greatest(-2e-1, least(12e-1, (ln(1 + o_totalprice) - 5) / 11)) * (ln(20000e0) - ln(50e0))), 2) AS amount,
  CASE o_custkey % 6 WHEN 0 THEN 'bank_transfer' WHEN 1 THEN 'atm_withdrawal' WHEN 4 THEN 'wire_transfer' ELSE 'retail' END AS mcc,
  CASE o_custkey % 6 WHEN 0 THEN 'transfer' WHEN 1 THEN 'atm' WHEN 2 THEN 'pos' WHEN 4 THEN 'transfer' ELSE 'online' END AS channel,
  CASE WHEN o_custkey % 4 = 0 THEN concat('ps_merchant_', lower(ty)) ELSE concat('M', o_custkey % 50) END AS merchant_id,
  CASE WHEN o_custkey % 6 IN (0, 4) AND o_custkey % 4 <> 0 THEN concat('M', o_custkey % 50) ELSE '' END AS beneficiary, 'IN' AS country,
  concat('ps_dev_C', o_custkey) AS device_id, substr(sha1(concat('C', o_custkey)), 1, 6) AS card_bin, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label
  FROM (SELECT *, ['CASH_IN','CASH_OUT','DEBIT','PAYMENT','TRANSFER','OTHER'][CAST(o_custkey % 6 + 1 AS INT)] AS ty FROM orders)""")
def source_paysim(spark, d):
    o, c = read(spark, d, "orders"), F.col("o_custkey")
    kinds = F.array(*[F.lit(x) for x in ("CASH_IN", "CASH_OUT", "DEBIT", "PAYMENT", "TRANSFER", "OTHER")])
    return _source(o.select(
        _s(F.col("o_orderkey") % 743).alias("step"), F.get(kinds, (c % 6).cast("int")).alias("type"), _s(F.col("o_totalprice")).alias("amount"),
        F.concat(F.lit("C"), c).alias("nameOrig"), F.when(c % 4 == 0, "").otherwise(F.concat(F.lit("M"), c % 50)).alias("nameDest"),
        F.when(F.col("o_orderstatus") == "F", "1").otherwise("0").alias("isFraud")), "paysim")


@query("source_india_bank", """SELECT CAST(epoch(o_orderdate) AS BIGINT) + 36000 AS t, concat('ib_', o_custkey) AS cust_id, o_totalprice AS amount,
  CASE o_custkey % 4 WHEN 0 THEN 'transport' WHEN 1 THEN 'travel' WHEN 2 THEN 'retail' ELSE 'restaurant' END AS mcc,
  CASE o_custkey % 5 WHEN 0 THEN 'atm' WHEN 1 THEN 'pos' WHEN 2 THEN 'transfer' ELSE 'online' END AS channel, concat('ME', o_custkey % 90) AS merchant_id, '' AS beneficiary,
  CASE WHEN o_custkey % 9 = 0 THEN 'XX' ELSE 'IN' END AS country, concat('ib_', o_custkey, '_Android_Phone') AS device_id, concat('CA', o_custkey) AS card_bin,
  CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END AS label, CASE WHEN c_custkey % 7 <> 0 THEN CAST(18 + c_custkey % 60 AS INT) END AS cust_age
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'P'""")
def source_india_bank(spark, d):
    o, c = read(spark, d, "orders"), F.col("o_custkey")
    k = F.col("c_custkey")
    ages = read(spark, d, "customer").select(_s(k).alias("Customer_ID"), F.when(k % 7 == 0, "old").otherwise(F.concat(18 + k % 60, F.lit(".0"))).alias("Age"))
    return _source(o.select(
        _s(c).alias("Customer_ID"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("Transaction_Date"), F.lit("10:00:00").alias("Transaction_Time"),
        _s(F.col("o_totalprice")).alias("Transaction_Amount"), F.when(c % 5 == 2, "UPI").otherwise("Card").alias("Payment_Method"),
        F.when(c % 5 == 0, "ATM").when(c % 5 == 1, "POS").otherwise("Mobile App").alias("Transaction_Channel"), F.lit("Android Phone").alias("Device_Type"),
        F.when(F.col("o_orderstatus") == "P", "Declined").otherwise("Successful").alias("Transaction_Status"), F.when(c % 9 == 0, "1").otherwise("0").alias("Is_International"),
        F.when(F.col("o_orderpriority").startswith("1"), "1").otherwise("0").alias("Fraud_Flag"),
        F.when(c % 4 == 0, "Fuel").when(c % 4 == 1, "Hotel").when(c % 4 == 2, "Space").otherwise("Food Delivery").alias("Merchant_Category"),
        F.concat(F.lit("ME"), c % 90).alias("Merchant_ID"), F.concat(F.lit("CA"), c).alias("Card_ID")), "india_bank", "cust_age", ages=ages)


@query("source_ulb", """SELECT vec_id * 10 + 1577836800 AS t, CAST(vec_id AS DOUBLE) / 4 AS amount, CASE WHEN label % 2 = 1 THEN 1 ELSE 0 END AS label,
  round(CAST(embedding[1] AS DOUBLE), 6) AS v1, round(CAST(embedding[28] AS DOUBLE), 6) AS v28 FROM embeddings""")
def source_ulb(spark, d):
    from frisk.sources.layouts import to_events
    e = read(spark, d, "embeddings")
    raw = e.select(
        _s(F.col("vec_id") * 10).alias("Time"), _s(F.col("vec_id") / 4).alias("Amount"), F.when(F.col("label") % 2 == 1, "1").otherwise("0").alias("Class"),
        *[_s(F.col("embedding")[i].cast("double")).alias(f"V{i + 1}") for i in range(28)])
    u = to_events(raw, "ulb")
    return u.select(F.unix_seconds("ts").alias("t"), "amount", "label", F.round(F.col("raw_features")["V1"], 6).alias("v1"),
                    F.round(F.col("raw_features")["V28"], 6).alias("v28"))


_UPLOAD = """up AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) + 1 AS row_no, o_custkey, o_totalprice, o_orderdate, o_orderkey % 11 AS k FROM orders)"""


def _upload(spark, d) -> DataFrame:
    """Orders as an analyst's export, with every kind of bad row in it."""
    from frisk.sources.upload import validate
    o = drift.with_rank(read(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), "o_custkey", "o_totalprice", "o_orderdate").withColumn(
        "ts", F.timestamp_seconds(F.col("seq"))))
    k = F.col("seq") % 11
    raw = o.select(
        (F.col("rank") + 1).alias("row_no"), F.when(k == 1, "").otherwise(F.concat(F.lit("a"), "o_custkey")).alias("Customer ID"),
        F.when(k == 2, "much").when(k == 3, "-5").otherwise(F.concat(F.lit("₹"), F.col("o_totalprice").cast("string"))).alias("Amount"),
        F.when(k == 4, "soon").when(k == 9, F.date_format("o_orderdate", "dd/MM/yyyy HH:mm")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("Date"),
        F.when(k == 5, "fax").when(k == 9, "UPI").otherwise("").alias("Mode"), F.when(k == 6, "Space Ship").when(k == 10, "Gift Card").otherwise("").alias("Category"),
        F.when(k == 7, "12").when(k == 10, "44").otherwise("").alias("Age"), F.when(k == 8, "perhaps").when(k == 10, "yes").otherwise("unknown").alias("is_fraud"))
    return validate(raw)


@query("upload_errors", f"""WITH {_UPLOAD} SELECT row_no AS row, CASE k WHEN 1 THEN 'cust_id is empty' WHEN 2 THEN 'amount ''much'' is not a number' WHEN 3 THEN 'amount must be greater than 0 (got -5)'
  WHEN 4 THEN 'timestamp ''soon'' not recognised — use YYYY-MM-DD HH:MM:SS' WHEN 5 THEN 'channel ''fax'' must be one of pos, online, atm, transfer'
  WHEN 6 THEN 'category ''Space Ship'' is not recognised — use one of: atm_withdrawal, bank_transfer, crypto, electronics, entertainment, gift_card, grocery, restaurant, retail, transport, travel, upi_transfer, utilities, wire_transfer'
  WHEN 7 THEN 'age 12 is outside 18-120' WHEN 8 THEN 'is_fraud must be 0/1, yes/no or true/false (got ''perhaps'')' END AS error FROM up WHERE k BETWEEN 1 AND 8""")
def upload_errors(spark, d):
    from frisk.sources.upload import split
    return split(_upload(spark, d))[1]


@query("upload_valid", f"""WITH {_UPLOAD} SELECT row_no, concat('a', o_custkey) AS cust_id, o_totalprice AS amount, CAST(epoch(o_orderdate) AS BIGINT) AS t,
  CASE WHEN k = 9 THEN 'transfer' ELSE 'online' END AS channel, CASE WHEN k = 10 THEN 'gift_card' ELSE 'retail' END AS mcc,
  CASE WHEN k = 10 THEN 'merchant_gift_card' ELSE 'merchant_retail' END AS merchant_id, concat('dev_a', o_custkey) AS device_id,
  CASE WHEN k = 10 THEN 44 END AS cust_age, CASE WHEN k = 10 THEN 1 ELSE 0 END AS label, k = 10 AS labelled FROM up WHERE k IN (0, 9, 10)""")
def upload_valid(spark, d):
    from frisk.sources.upload import split
    e = split(_upload(spark, d))[0]
    return e.select(F.col("seq").alias("row_no"), "cust_id", "amount", F.unix_seconds("ts").alias("t"), "channel", "mcc", "merchant_id",
                    "device_id", "cust_age", "label", "labelled")


@query("upload_counts", f"""WITH {_UPLOAD} SELECT count(*) AS rows, count(CASE WHEN k IN (0, 9, 10) THEN 1 END) AS valid, count(CASE WHEN k BETWEEN 1 AND 8 THEN 1 END) AS rejected,
  count(CASE WHEN k = 10 THEN 1 END) AS labelled FROM up""")
def upload_counts(spark, d):
    from frisk.sources.upload import delivery_counts
    return delivery_counts(_upload(spark, d))


@query("blend_sources", f"""{Q.with_(Q.BASE)}, a AS (SELECT t, row_number() OVER (ORDER BY t, seq) AS r FROM txn), b AS (SELECT t, row_number() OVER (ORDER BY t, seq) AS r FROM ev WHERE type = 'login')
 SELECT 'real' AS source, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM a WHERE r > 100 AND r <= 400 UNION ALL SELECT 'other', count(*), min(t), max(t) FROM b WHERE r <= 200""")
def blend_sources(spark, d):
    from frisk.sources.replay import blend, source_counts
    e = _events(spark, d)
    b = blend(e.filter("type = 'txn'"), e.filter("type = 'login'"), 500, 0.6, cursor=100)
    return source_counts(b).select("source", "n", F.unix_micros("first_ts").alias("first_t"), F.unix_micros("last_ts").alias("last_t"))


@query("replay_page", f"""{Q.with_(Q.BASE)}, a AS (SELECT seq, row_number() OVER (ORDER BY t, seq) AS r, count(*) OVER () AS n FROM txn)
 SELECT seq, r AS rank, n <= 750 AS exhausted FROM a WHERE r > 500 AND r <= 750""")
def replay_page(spark, d):
    from frisk.sources.replay import page
    return page(_txns(spark, d), 500, 250).select("seq", "rank", "exhausted")


@query("replay_seek", f"""{Q.with_(Q.BASE)}, a AS (SELECT seq, amount, row_number() OVER (ORDER BY t, seq) AS r, count(*) OVER () AS n FROM txn)
 SELECT seq, amount, r AS rank, n <= r0 + 250 AS exhausted FROM a, (SELECT unnest([0, 500, 5000000]) AS r0) WHERE r > r0 AND r <= r0 + 250""")
def replay_seek(spark, d):
    """Three pages of one stored table, each from its own time buckets: the first, a middle one, one past the end."""
    from frisk.functions.keep import folder
    from frisk.sources.replay import read_page, write_replay
    path = folder(spark)
    write_replay(_txns(spark, d), path)
    first, second, last = (read_page(spark, path, cursor, 250) for cursor in (0, 500, 5_000_000))
    return first.unionByName(second).unionByName(last).select("seq", "amount", "rank", "exhausted")


@query("queue_view", f"""{_QUEUE.rstrip()}, shown AS (SELECT DISTINCT case_id FROM lg WHERE case_id % 2 = 0)
 SELECT s.case_id, coalesce(f.status, 'open') AS status, f.holder AS claimed_by, f.solver AS resolved_by, CAST(s.case_id % 7 AS VARCHAR) AS merchant_id FROM shown s LEFT JOIN fin f ON f.case_id = s.case_id
 WHERE coalesce(f.status, 'open') <> 'resolved'""")
def queue_view(spark, d):
    """Waiting and claimed entries with their case's fields."""
    log = kept(action_log(spark, d))
    entries = log.filter("case_id % 2 = 0").groupBy("case_id").agg(F.min("at").alias("queued_at"))
    shown = entries.select(F.col("case_id").alias("seq"), (F.col("case_id") % 7).cast("string").alias("merchant_id"), F.lit("").alias("city"), F.lit("IN").alias("country"),
                           F.col("queued_at").alias("ts"))
    state = kept(review_queue.queue_state(log))
    views = [review_queue.queue_view(entries, state, shown, status) for status in ("open", "claimed")]
    return views[0].unionByName(views[1]).select("case_id", "status", "claimed_by", "resolved_by", "merchant_id")


@query("profile_snapshot", f"""{Q.with_(Q.BASE)} SELECT cust_id, count(*) AS n, round(avg(amount), 6) AS mean_amount, max(amount) AS max_amount, arg_max(country, t) AS last_country, max(t) AS last_t
 FROM txn WHERE label = 0 GROUP BY cust_id""")
def profile_snapshot(spark, d):
    from frisk.sources.sinks import profile_snapshot as snap
    s = snap(_txns(spark, d))
    return s.select("cust_id", "n", F.round("mean_amount", 6).alias("mean_amount"), "max_amount", "last_country", F.unix_micros("last_ts").alias("last_t"))


# --- gate, training, streaming -------------------------------------------------------------------------------

@query("gate_mix")
def gate_mix(spark, d):
    from frisk.plans.gate import run_gate
    return metrics.decision_mix(run_gate(_events(spark, d), fixed_scorer, THRESHOLD, event_customers(spark, d)), ["channel"])


@query("train_model")
def train_model(spark, d):
    """Point-in-time training set, both heads, calibration, cut-off and out-of-time metrics."""
    from frisk.ml.model import train
    rows = kept(labels.with_training_weights(_features(spark, d)))
    m = train(rows)
    picked = {k: m.meta[k] for k in ("n_samples", "n_fraud", "calibration_method", "roc_auc", "pr_auc", "brier_raw", "brier_calibrated", "cost_threshold")}
    return spark.createDataFrame([tuple(picked.values())], "n_samples long, n_fraud long, calibration_method string, roc_auc double, pr_auc double, "
                                 "brier_raw double, brier_calibrated double, cost_threshold double")


_PAGE_ROWS = 2_000_000  # events that one micro-batch takes, about: its operators hold a batch's rows, so a larger table is streamed in pages
_STATE = {"providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
          "rocksdb.boundedMemoryUsage": "true", "rocksdb.maxMemoryUsageMB": "300"}  # for all state stores of an executor together


def _paged(spark, events: DataFrame, path: str) -> DataFrame:
    """``events`` as a stream that takes a page a batch, in time order."""
    from frisk.sources.replay import write_pages
    write_pages(events, path, _PAGE_ROWS)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def _drained(spark, make, path: str) -> DataFrame:
    """Drain the stream of ``make`` into a table and read it back.

    Every partition of every operator keeps a store of its own and commits it each batch, so their number follows the cores, not the input.
    """
    shuffle = "spark.sql.shuffle.partitions"
    held = spark.conf.get(shuffle)
    for name, value in _STATE.items():
        spark.conf.set(f"spark.sql.streaming.stateStore.{name}", value)
    spark.conf.set("spark.sql.streaming.minBatchesToRetain", "2")
    spark.conf.set(shuffle, str(min(int(held), max(12, 2 * spark.sparkContext.defaultParallelism))))
    try:
        q = make().writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(shuffle, held)
    return spark.read.parquet(f"{path}/out")


def _run_stream(spark, d, make, *names: str, shape=lambda e: e) -> DataFrame:
    """Drain a stream over the events file, ``shape``d before it is mapped, into a table and read it back."""
    from frisk.functions.keep import folder
    from frisk.sources.tables import map_events
    path, events = folder(spark), read(spark, d, "events")
    if events.count() > _PAGE_ROWS:
        raw = _paged(spark, shape(events), f"{path}/in")
    else:
        raw = shape(spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(d))
    return _drained(spark, lambda: make(map_events(raw)), path).select(*names)


@query("stream_entity_stats", f"""{Q.E} SELECT seq, kind, round(n, 6) AS n, round(f, 6) AS f, round(coalesce(touched, 0e0), 6) AS touched_n, CAST(fanout AS BIGINT) AS fanout FROM ek""")
def stream_entity_stats(spark, d):
    from frisk.streaming.stateful import entity_stream
    s = _run_stream(spark, d, lambda e: entity_stream(e.filter("type = 'txn'")), "seq", "kind", "n", "f", "touched_n", "fanout")
    return s.select("seq", "kind", *[rounded(F.col(c), 6).alias(c) for c in ("n", "f", "touched_n")], "fanout")


_STREAM_PROFILE = ("history_n", "secs_since_last", "new_merchant", "new_device", "new_beneficiary", "txn_count_5m", "txn_count_1h", "txn_count_24h", "amt_sum_24h",
                   "distinct_merchants_24h", "failed_logins_1h", "logins_1h", "peak_5m", "peak_1h")


@query("stream_profile", f"{Q.P} SELECT seq, {_r(*_STREAM_PROFILE, places=6)} FROM prof")
def stream_profile(spark, d):
    from frisk.streaming.stateful import profile_stream
    return _cols(_run_stream(spark, d, profile_stream, "seq", *_STREAM_PROFILE), *_STREAM_PROFILE, places=6)


def _stream_cases(spark, d, scorer, *names: str) -> DataFrame:
    """Cases of the event-at-a-time scorer, drained over the events file."""
    from frisk.streaming.event_scoring import case_stream, feature_stream
    return _run_stream(spark, d, lambda e: case_stream(feature_stream(e, scorer, THRESHOLD, event_customers(spark, d)), fixed_scorer, THRESHOLD), *names)


@query("stream_scores_and_actions", f"{Q.C} SELECT seq, {_r('fraud_proba', 'anomaly', 'risk', places=8)}, action FROM cases")
def stream_scores_and_actions(spark, d):
    """Every payment scored from keyed state; profiles learn from label 0."""
    names = ("fraud_proba", "anomaly", "risk")
    return _stream_cases(spark, d, None, "seq", *names, "action").select("seq", *[rounded(F.col(c), 8).alias(c) for c in names], "action")


@query("stream_restored_scores", f"{Q.C} SELECT seq, {_r('fraud_proba', 'anomaly', 'risk', places=8)}, action FROM cases")
def stream_restored_scores(spark, d):
    """As stream_scores_and_actions, by two streams: the first takes the earlier half and stops, the second starts from the saved state."""
    from frisk.functions.keep import folder
    from frisk.streaming.event_scoring import case_stream, feature_stream, save_state
    path, names, events = folder(spark), ("fraud_proba", "anomaly", "risk"), _events(spark, d)
    middle = events.agg(F.timestamp_micros(F.percentile_approx(F.unix_micros("ts"), 0.5)).alias("m")).first()["m"]
    for part, which in enumerate((F.col("ts") <= middle, F.col("ts") > middle)):
        half = _paged(spark, events.filter(which), f"{path}/{part}/in")
        rows = lambda: feature_stream(half, None, THRESHOLD, event_customers(spark, d), start=f"{path}/state" if part else None)
        _drained(spark, lambda: case_stream(rows(), fixed_scorer, THRESHOLD).select("seq", *names, "action"), f"{path}/{part}")
        if part == 0:
            save_state(spark, f"{path}/0/state", f"{path}/state")
    both = spark.read.parquet(f"{path}/0/out").unionByName(spark.read.parquet(f"{path}/1/out"))
    return both.select("seq", *[rounded(F.col(c), 8).alias(c) for c in names], "action")


@query("busy_stream_scores", Q.on_busy(f"{Q.C} SELECT seq, {_r('fraud_proba', 'anomaly', 'risk', places=8)}, action FROM cases"))
def busy_stream_scores(spark, d):
    """As stream_scores_and_actions over bursts and large amounts: every rule fires on rows scored from keyed state."""
    from frisk.sources.tables import busy
    from frisk.streaming.event_scoring import case_stream, feature_stream
    names = ("fraud_proba", "anomaly", "risk")
    rows = _run_stream(spark, d, lambda e: case_stream(feature_stream(e, None, THRESHOLD, event_customers(spark, d)), fixed_scorer, THRESHOLD), "seq", *names, "action", shape=busy)
    return rows.select("seq", *[rounded(F.col(c), 8).alias(c) for c in names], "action")


_STREAM_FEATURES = ("amount_z", "amount_to_max", "new_merchant", "new_country", "new_device", "new_beneficiary", "is_foreign", "dist_from_last_km", "speed_kmh",
                    "impossible_travel", "secs_since_last", "txn_count_24h", "amt_sum_24h", "distinct_merchants_24h", "failed_logins_1h", "account_age_days",
                    "seq_surprise", "seq_new_token", "seq_repeat_5", "seq_regime_kl", "peak_1h", "history_n")


@query("stream_features", f"{Q.P} SELECT seq, {_r(*_STREAM_FEATURES, places=6)} FROM prof")
def stream_features(spark, d):
    return _cols(_stream_cases(spark, d, None, "seq", *_STREAM_FEATURES), *_STREAM_FEATURES, places=6)


@query("stream_gate_mix")
def stream_gate_mix(spark, d):
    """As gate_mix, from keyed state: each decision says whether the profile learns from its row."""
    from frisk.streaming.row_policy import fixed_row_scorer
    return metrics.decision_mix(_stream_cases(spark, d, fixed_row_scorer, "seq", "channel", "action"), ["channel"])


@query("stream_rolling_psi", f'{_ROLL} SELECT seq, k, "window", state, segment, {_r("psi_raw", "psi", places=6)} FROM roll')
def stream_rolling_psi(spark, d):
    """As rolling_psi_rows, from events to index on keyed state: features, decisions and the monitor's window in one stream."""
    from frisk.streaming.drift_monitor import drift_stream
    from frisk.streaming.event_scoring import case_stream, feature_stream
    shares = [r["share"] for r in drift.score_histogram(cases(spark, d), "risk").orderBy("bin").collect()]  # ten rows
    rows = _run_stream(spark, d, lambda e: drift_stream(case_stream(feature_stream(e, None, THRESHOLD, event_customers(spark, d)), fixed_scorer, THRESHOLD), shares),
                       *_ROLL_COLS, "psi_raw", "psi")
    return rows.select(*_ROLL_COLS, *[rounded(F.col(c), 6).alias(c) for c in ("psi_raw", "psi")])


# --- splits, references and smaller operators ------------------------------------------------------------------

@query("time_split", f"""{Q.with_(Q.BASE)}, r AS (SELECT seq, row_number() OVER (ORDER BY t, seq) AS r, count(*) OVER () AS n FROM txn)
 SELECT seq, CASE WHEN r <= CAST(floor(n * 7e-1) AS BIGINT) THEN 'train' WHEN r <= CAST(floor(n * 85e-2) AS BIGINT) THEN 'valid' ELSE 'test' END AS split FROM r""")
def time_split(spark, d):
    from frisk.ml.model import time_split as by_time
    return by_time(_txns(spark, d)).select("seq", "split")


_MEDIAN_OF = ("amount", "amount_z", "secs_since_last", "txn_count_24h", "account_age_days")


@query("reference_medians", f"{Q.P} SELECT " + ", ".join(f"round(median({c}), 6) AS {c}" for c in _MEDIAN_OF) + " FROM prof")
def reference_medians(spark, d):
    from frisk.ml.model import medians
    rows = kept(_profile(spark, d).select(*_MEDIAN_OF))
    m = medians(rows, list(_MEDIAN_OF), rows.count())
    return spark.range(1).select(*[F.round(F.lit(m[c]), 6).alias(c) for c in _MEDIAN_OF])


@query("score_histogram", f"""{Q.C}, bins AS (SELECT CAST(range AS INT) AS bin FROM range(10)),
 h AS (SELECT b.bin, count(k.seq) + 1e-6 AS h FROM bins b LEFT JOIN (SELECT {_PBIN} AS bin, seq FROM cases) k ON k.bin = b.bin GROUP BY b.bin)
 SELECT bin, round(h / sum(h) OVER (), 8) AS share FROM h""")
def score_histogram(spark, d):
    return drift.score_histogram(cases(spark, d), "risk").select("bin", F.round("share", 8).alias("share"))


@query("evidence_gate", f"{Q.C} SELECT seq FROM cases WHERE n_hits > 0 OR risk >= 28e-2 OR fraud_proba >= {Q.THRESHOLD}")
def evidence_gate(spark, d):
    from frisk.operators.decision import needs_evidence
    return cases(spark, d).filter(needs_evidence(THRESHOLD)).select("seq")


@query("case_headlines", f"""{Q.C}, dec AS (SELECT DISTINCT seq FROM hits WHERE code IN ('impossible_travel', 'known_bad_entity', 'card_testing', 'ato_login_then_spend'))
 SELECT c.seq, CASE WHEN action = 'BLOCK' AND (risk >= 9e-1 OR dec.seq IS NOT NULL) THEN 'High-confidence block' WHEN action = 'ALLOW' AND risk < 15e-2 THEN 'Cleared — looks normal'
   WHEN action = 'BLOCK' THEN 'Blocked' WHEN action = 'CHALLENGE' THEN 'Step-up verification required' WHEN action = 'REVIEW' THEN 'Flagged for analyst review' ELSE 'Cleared' END AS headline,
   concat('Ground truth: ', CASE WHEN label = 1 THEN 'fraud (fraud)' ELSE 'legitimate' END, ' — the model was ', CASE WHEN ({_STOP}) = (label = 1) THEN 'correct' ELSE 'wrong' END, '.') AS ground_truth
 FROM cases c LEFT JOIN dec ON dec.seq = c.seq""")
def case_headlines(spark, d):
    from frisk.operators.narrative import with_narrative
    return with_narrative(case_table(cases(spark, d))).select("seq", "headline", "ground_truth")


@query("case_summaries", f"""{Q.C}, h1 AS (SELECT seq, arg_min(message, pos) AS message FROM hits GROUP BY seq)
 SELECT c.seq, concat('This ₹', format('{{:,.2f}}', amount), ' ', CASE WHEN channel = 'transfer' THEN 'transfer' ELSE concat(replace(mcc, '_', ' '), ' ', channel) END,
   CASE WHEN beneficiary <> '' AND new_beneficiary = 1 THEN concat(' to new payee ', beneficiary) WHEN beneficiary <> '' THEN concat(' to ', beneficiary) ELSE concat(' at ', merchant_id) END,
   ' in ', country, ' by ', cust_id, ' ', CASE action WHEN 'BLOCK' THEN 'was blocked' WHEN 'CHALLENGE' THEN 'was paused for verification' WHEN 'REVIEW' THEN 'was allowed but flagged' ELSE 'was allowed' END, '.',
   CASE WHEN n_hits > 0 AND {_STOP} THEN concat(' ', h1.message) ELSE '' END,
   CASE WHEN action = 'ALLOW' THEN ' Amount, merchant, location, device and timing are all consistent with this customer''s history.' ELSE '' END) AS summary
 FROM cases c LEFT JOIN h1 ON h1.seq = c.seq""")
def case_summaries(spark, d):
    """The note without probe lines (no explanation computed): opening, rule, closing."""
    from frisk.operators.narrative import with_narrative
    return with_narrative(case_table(cases(spark, d))).select("seq", "summary")


@query("fairness_gap", f"""{Q.C}, {_BRACKETS}, g AS (SELECT b.age_bracket, count(CASE WHEN label = 0 AND {_STOP} THEN 1 END) / nullif(CAST(count(CASE WHEN label = 0 THEN 1 END) AS DOUBLE), 0) AS fpr
   FROM br b LEFT JOIN cases c ON c.age_bracket = b.age_bracket GROUP BY b.age_bracket)
 SELECT CASE WHEN count(fpr) >= 2 THEN round(max(fpr) - min(fpr), 4) END AS fpr_gap FROM g""")
def fairness_gap(spark, d):
    return metrics.gap(metrics.age_breakdown(cases(spark, d)), "false_positive_rate", 4, "fpr_gap")


@query("verification_results", f"""{Q.C}, lg AS (SELECT c.seq AS case_id, b.k, u.n FROM (SELECT seq FROM cases) c JOIN base b ON b.seq = c.seq, (SELECT unnest([1, 2]) AS n) u WHERE b.k % 2 = 0 OR u.n = 1)
 SELECT l.case_id, l.n, CASE WHEN c.action = 'CHALLENGE' AND l.n = 1 THEN CASE WHEN l.k % 3 = 0 THEN 'passed' ELSE 'failed' END ELSE 'refused' END AS outcome
 FROM lg l JOIN cases c ON c.seq = l.case_id""")
def verification_results(spark, d):
    from frisk.streaming.micro_batch import apply_verifications
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    e = read(spark, d, "events").filter("event_type IN ('view', 'click', 'purchase')").select(
        F.col("event_id").alias("case_id"), k.alias("k"), F.col("ts").cast("timestamp").alias("ts"))
    log = e.withColumn("n", F.explode(F.when(F.col("k") % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).select(
        "case_id", (F.col("k") % 3 == 0).alias("passed"), F.timestamp_micros(F.unix_micros("ts") + F.col("n")).alias("at"), "n")
    c = kept(cases(spark, d).select("seq", "action"))
    ok, bad = apply_verifications(log, c)
    key = log.select("case_id", "at", "n")
    return ok.select("case_id", "at", F.col("verification").alias("outcome")).unionByName(
        bad.select("case_id", "at", F.lit("refused").alias("outcome"))).join(key, ["case_id", "at"]).select("case_id", "n", "outcome")


@query("entity_rates_with_feedback")
def entity_rates_with_feedback(spark, d):
    """Fraud feedback matched to transactions enters the entity statistics when it arrives."""
    t = _txns(spark, d)
    confirms = labels.feedback_confirms(feedback_log(spark, d), t)
    return _cols(entity_features(t, DEFAULT, confirms), "merchant_fraud_rate", "beneficiary_fraud_rate", "prior", places=6)
