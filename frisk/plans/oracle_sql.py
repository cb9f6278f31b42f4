"""The registered queries again, as plain SQL over the same tables (an independent statement)."""

from __future__ import annotations

ANCHOR = "1577836800000000"
HALF_LIFE = "(86400e6 * 30)"

BASE = """
base AS (
  SELECT event_id AS seq, ts, epoch_us(ts) AS t, user_id, event_type, value,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events),
ev AS (
  SELECT seq, ts, t, user_id, concat('u', user_id) AS cust_id,
    CASE WHEN event_type IN ('view','click','purchase') THEN 'txn' ELSE 'login' END AS type,
    CASE WHEN event_type IN ('view','click','purchase') THEN value * 1e2 END AS amount,
    CASE WHEN event_type IN ('view','click','purchase') THEN
      CASE WHEN k % 11 = 0 THEN 'wire_transfer' WHEN k % 13 = 0 THEN 'crypto' WHEN k % 3 = 0 THEN 'grocery' ELSE 'retail' END END AS mcc,
    CASE event_type WHEN 'view' THEN 'pos' WHEN 'click' THEN 'online' WHEN 'purchase' THEN 'transfer' END AS channel,
    CASE WHEN event_type IN ('view','click','purchase') THEN concat('m', k % 40) END AS merchant_id,
    CASE WHEN event_type = 'purchase' THEN concat('b', user_id % 25, '_', k % 4) ELSE '' END AS beneficiary,
    CASE WHEN event_type IN ('view','click','purchase') THEN CASE WHEN k % 17 = 0 THEN 'XX' ELSE 'IN' END END AS country,
    CASE WHEN k % 17 = 0 THEN 50e0 ELSE 19e0 END + (k % 5) * 1e-1 AS lat,
    72e0 + (k % 7) * 1e-1 AS lon,
    concat('d', CASE WHEN k % 10 = 0 THEN user_id % 15 ELSE user_id + 1000 END) AS device_id,
    concat('c', user_id) AS card_bin,
    CASE WHEN event_type IN ('view','click','purchase') AND ((k % 10 = 0 AND user_id % 15 < 3) OR value > 25e1) THEN 1 ELSE 0 END AS label,
    CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN 0 END AS success,
    18 + user_id % 70 AS age
  FROM base),
txn AS (SELECT * FROM ev WHERE type = 'txn')"""

# the events with bursts and a wide range of values
_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"
_BUSY = f"""(SELECT event_id, user_id, event_type, props, make_timestamp(t - t % 864000000000 + t % 864000000000 // squeeze) AS ts, value * times AS value FROM
   (SELECT *, CASE WHEN user_id % 3 = 2 THEN 1 WHEN t // 864000000000 % 4 = 3 THEN 240 ELSE 2880 END AS squeeze,
      CASE WHEN {_K} % 23 = 0 THEN 2e2 WHEN {_K} % 20 = 0 THEN 1e2 WHEN {_K} % 20 = 10 THEN 15e0 WHEN {_K} % 5 = 1 THEN 2e-2 ELSE 1e0 END AS times FROM (SELECT *, epoch_us(ts) AS t FROM events)))"""


def on_busy(sql: str) -> str:
    """A statement over ``events``, asked of the busy ones."""
    return sql.replace(" AS k FROM events)", f" AS k FROM {_BUSY})")


_PREV = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def _span(us: str) -> str:
    return f"OVER (PARTITION BY cust_id ORDER BY t RANGE BETWEEN {us} PRECEDING AND 1 PRECEDING)"


PROFILE = f"""
e1 AS (
  SELECT *, CASE WHEN type = 'txn' AND label = 0 THEN 1 END AS acc,
    CASE WHEN type = 'txn' THEN concat(mcc, '|', channel, '|', CAST(least(6, floor(ln(1e0 + greatest(amount, 0e0)) / 1.43e0)) AS INT)) END AS tok
  FROM ev),
e2 AS (
  SELECT *,
    count(acc) OVER (PARTITION BY cust_id, merchant_id ORDER BY t, seq {_PREV}) AS k_merchant,
    count(acc) OVER (PARTITION BY cust_id, country ORDER BY t, seq {_PREV}) AS k_country,
    count(CASE WHEN acc = 1 OR success = 1 THEN 1 END) OVER (PARTITION BY cust_id, device_id ORDER BY t, seq {_PREV}) AS k_device,
    count(acc) OVER (PARTITION BY cust_id, beneficiary ORDER BY t, seq {_PREV}) AS k_payee,
    count(acc) OVER (PARTITION BY cust_id, tok ORDER BY t, seq {_PREV}) AS k_token
  FROM e1),
e3 AS (
  SELECT *,
    count(acc) OVER w AS n,
    avg(CASE WHEN acc = 1 THEN amount END) OVER w AS mean,
    stddev_samp(CASE WHEN acc = 1 THEN amount END) OVER w AS sd,
    max(CASE WHEN acc = 1 THEN amount END) OVER w AS mx,
    last_value(CASE WHEN acc = 1 THEN t END IGNORE NULLS) OVER w AS last_t,
    last_value(CASE WHEN acc = 1 THEN lat END IGNORE NULLS) OVER w AS last_lat,
    last_value(CASE WHEN acc = 1 THEN lon END IGNORE NULLS) OVER w AS last_lon,
    count(CASE WHEN acc = 1 AND k_token = 0 THEN 1 END) OVER w AS vocab,
    count(acc) {_span('300000000')} AS c5, count(acc) {_span('3600000000')} AS c1, count(acc) {_span('86400000000')} AS c24,
    coalesce(sum(CASE WHEN acc = 1 THEN amount END) {_span('3600000000')}, 0e0) AS s1,
    coalesce(sum(CASE WHEN acc = 1 THEN amount END) {_span('86400000000')}, 0e0) AS s24,
    count(DISTINCT CASE WHEN acc = 1 THEN merchant_id END) {_span('86400000000')} AS dm,
    count(DISTINCT CASE WHEN acc = 1 THEN country END) {_span('86400000000')} AS dc,
    count(CASE WHEN type = 'login' AND success = 0 THEN 1 END) {_span('3600000000')} AS fl,
    count(CASE WHEN type = 'login' THEN 1 END) {_span('3600000000')} AS lg
  FROM e2
  WINDOW w AS (PARTITION BY cust_id ORDER BY t, seq {_PREV})),
e4 AS (
  SELECT *,
    max(CASE WHEN acc = 1 THEN c5 + 1 END) OVER p AS p5, max(CASE WHEN acc = 1 THEN c1 + 1 END) OVER p AS p1
  FROM e3
  WINDOW p AS (PARTITION BY cust_id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 3600000000 PRECEDING)),
geo AS (
  SELECT seq,
    CASE WHEN last_t IS NULL THEN 2592000e0 ELSE least((t - last_t) / 1e6, 2592000e0) END AS secs,
    CASE WHEN last_t IS NULL THEN 0e0 ELSE 2 * 6371e0 * asin(sqrt(least(1e0,
      pow(sin(radians(lat - last_lat) / 2), 2) + cos(radians(last_lat)) * cos(radians(lat)) * pow(sin(radians(lon - last_lon) / 2), 2)))) END AS dist
  FROM e4 WHERE type = 'txn'),
recent AS (
  SELECT p.seq, r.tok, count(*) AS q, max(r.c) AS c, count(CASE WHEN r.k >= p.n - 5 THEN 1 END) AS q5
  FROM e4 p JOIN (SELECT cust_id, n AS k, tok, k_token + 1 AS c FROM e4 WHERE acc = 1) r
    ON r.cust_id = p.cust_id AND r.k BETWEEN p.n - 10 AND p.n - 1
  WHERE p.type = 'txn' GROUP BY p.seq, r.tok),
tail AS (
  SELECT r.seq, sum(r.q) AS rn, sum(r.q5) AS r5, coalesce(sum(CASE WHEN r.tok = p.tok THEN r.q5 END), 0) AS same5
  FROM recent r JOIN e4 p ON p.seq = r.seq GROUP BY r.seq),
kl AS (
  SELECT r.seq, sum((r.q * 1e0 / t.rn) * ln((r.q * 1e0 / t.rn) / ((r.c + 5e-1) / (p.n + 5e-1 * (p.vocab + 1))))) AS v
  FROM recent r JOIN tail t ON t.seq = r.seq JOIN e4 p ON p.seq = r.seq GROUP BY r.seq),
prof AS (
  SELECT p.seq, p.ts, p.t, p.cust_id, p.user_id, p.age, p.amount, p.mcc, p.channel, p.merchant_id, p.beneficiary, p.country, p.device_id, p.card_bin, p.label,
    ln(1e0 + p.amount) AS amount_log,
    (p.amount - coalesce(nullif(p.mean, 0e0), p.amount)) / coalesce(nullif(p.sd, 0e0), greatest(coalesce(p.mean, 0e0) * 35e-2, 1e0)) AS amount_z,
    p.amount / coalesce(nullif(p.mx, 0e0), p.amount) AS amount_to_max,
    CAST(hour(p.ts) AS DOUBLE) AS hour,
    CASE WHEN hour(p.ts) < 6 OR hour(p.ts) >= 23 THEN 1e0 ELSE 0e0 END AS is_night,
    CASE WHEN isodow(p.ts) >= 6 THEN 1e0 ELSE 0e0 END AS is_weekend,
    CASE WHEN p.k_merchant = 0 THEN 1e0 ELSE 0e0 END AS new_merchant,
    CASE WHEN p.k_country = 0 AND p.country <> 'IN' THEN 1e0 ELSE 0e0 END AS new_country,
    CASE WHEN p.k_device = 0 THEN 1e0 ELSE 0e0 END AS new_device,
    CASE WHEN p.beneficiary <> '' AND p.k_payee = 0 THEN 1e0 ELSE 0e0 END AS new_beneficiary,
    CASE WHEN p.country <> 'IN' THEN 1e0 ELSE 0e0 END AS is_foreign,
    g.dist AS dist_from_last_km, g.secs AS secs_since_last,
    CASE WHEN p.last_t IS NULL THEN 0e0 ELSE g.dist / greatest(g.secs / 3600e0, 1e0 / 60e0) END AS speed_kmh,
    CASE WHEN p.last_t IS NOT NULL AND g.dist / greatest(g.secs / 3600e0, 1e0 / 60e0) > 900 AND g.dist > 200 AND g.secs < 10800 THEN 1e0 ELSE 0e0 END AS impossible_travel,
    CAST(p.c5 AS DOUBLE) AS txn_count_5m, CAST(p.c1 AS DOUBLE) AS txn_count_1h, CAST(p.c24 AS DOUBLE) AS txn_count_24h,
    p.s1 AS amt_sum_1h, p.s24 AS amt_sum_24h,
    CAST(p.dm AS DOUBLE) AS distinct_merchants_24h, CAST(p.dc AS DOUBLE) AS distinct_countries_24h,
    CAST(p.fl AS DOUBLE) AS failed_logins_1h, CAST(p.lg AS DOUBLE) AS logins_1h,
    CAST(floor((p.t - epoch_us(TIMESTAMP '2023-01-01 00:00:00')) / 86400e6) AS DOUBLE) AS account_age_days,
    CASE WHEN p.mcc IN ('crypto','gift_card','wire_transfer') THEN 1e0 ELSE 0e0 END AS high_risk_mcc,
    CASE WHEN p.channel = 'pos' THEN 1e0 ELSE 0e0 END AS channel_pos, CASE WHEN p.channel = 'online' THEN 1e0 ELSE 0e0 END AS channel_online,
    CASE WHEN p.channel = 'atm' THEN 1e0 ELSE 0e0 END AS channel_atm, CASE WHEN p.channel = 'transfer' THEN 1e0 ELSE 0e0 END AS channel_transfer,
    CASE WHEN p.n = 0 THEN 0e0 ELSE least(-ln((p.k_token + 5e-1) / (p.n + 5e-1 * (p.vocab + 1))) / 8e0, 1e0) END AS seq_surprise,
    CASE WHEN p.n > 0 AND p.k_token = 0 THEN 1e0 ELSE 0e0 END AS seq_new_token,
    CASE WHEN p.n = 0 THEN 0e0 ELSE coalesce(tl.same5 * 1e0 / tl.r5, 0e0) END AS seq_repeat_5,
    CASE WHEN coalesce(tl.rn, 0) >= 4 THEN least(kl.v / 4e0, 1e0) ELSE 0e0 END AS seq_regime_kl,
    CAST(coalesce(p.p5, 0) AS DOUBLE) AS peak_5m, CAST(coalesce(p.p1, 0) AS DOUBLE) AS peak_1h, CAST(p.n AS DOUBLE) AS history_n
  FROM e4 p JOIN geo g ON g.seq = p.seq LEFT JOIN tail tl ON tl.seq = p.seq LEFT JOIN kl ON kl.seq = p.seq
  WHERE p.type = 'txn')"""


def entity_ctes(delay_us: str | None = "259200000000") -> str:
    """Entity statistics; ``delay_us`` None = outcomes never known, '0' = known at once."""
    instant = delay_us == "0"
    inst = "CAST(label AS DOUBLE)" if instant else "0e0"
    late = "" if delay_us in (None, "0") else f"""
  UNION ALL SELECT seq, cust_id, merchant_id, card_bin, device_id, beneficiary, t + {delay_us}, 0, 0e0, 1e0, 0e0 FROM txn WHERE label = 1"""
    return f"""
outcomes AS (
  SELECT seq, cust_id, merchant_id, card_bin, device_id, beneficiary, t, 1 AS ord, 1e0 AS obs, 0e0 AS con, {inst} AS inst FROM txn{late}),
pr AS (
  SELECT seq, (3e-3 + coalesce(f, 0)) / (1 + coalesce(n, 0)) AS prior FROM (
    SELECT seq, ord, sum(con + inst) OVER w AS f, sum(obs) OVER w AS n FROM outcomes
    WINDOW w AS (ORDER BY t, ord, seq {_PREV})) WHERE ord = 1),
er AS (
  SELECT seq, cust_id, 'merchant' AS kind, merchant_id AS key, t, ord, obs, con, inst FROM outcomes
  UNION ALL SELECT seq, cust_id, 'bin', card_bin, t, ord, obs, con, inst FROM outcomes
  UNION ALL SELECT seq, cust_id, 'device', device_id, t, ord, obs, con, inst FROM outcomes
  UNION ALL SELECT seq, cust_id, 'beneficiary', beneficiary, t, ord, obs, con, inst FROM outcomes WHERE beneficiary <> ''),
ew AS (SELECT *, pow(2e0, (t - {ANCHOR}) / {HALF_LIFE}) AS w FROM er),
eo AS (
  SELECT *, coalesce(sum(w * obs) OVER o, 0e0) AS own_a, coalesce(sum(w * (con + inst)) OVER o, 0e0) AS own_f,
    coalesce(sum(obs) OVER o, 0e0) AS own_c
  FROM ew WINDOW o AS (PARTITION BY kind, key, cust_id ORDER BY t, ord, seq {_PREV})),
el AS (
  SELECT *, max(CASE WHEN con = 1 THEN own_f + w * (con + inst) - own_a END) OVER o AS lift
  FROM eo WINDOW o AS (PARTITION BY kind, key, cust_id ORDER BY t, ord, seq {_PREV})),
es AS (
  SELECT *, sum(w * obs) OVER k AS w_n, sum(w * (con + inst)) OVER k AS w_f, min(CASE WHEN obs = 1 THEN t END) OVER k AS first_t,
    max(t) OVER k AS touch_t, coalesce(sum(CASE WHEN obs = 1 AND own_c = 0 THEN 1 END) OVER k, 0) AS fanout
  FROM el WINDOW k AS (PARTITION BY kind, key ORDER BY t, ord, seq {_PREV})),
ek AS (
  SELECT seq, kind, coalesce(w_n, 0e0) / w AS n, coalesce(w_f, 0e0) / w AS f,
    greatest(coalesce(w_n, 0e0) / w - (own_a + greatest(0e0, coalesce(lift, 0e0))) / w, 0e0) AS n_x,
    own_f / w AS own_f, coalesce(w_n, 0e0) / pow(2e0, (touch_t - {ANCHOR}) / {HALF_LIFE}) AS touched,
    (t - first_t) / 86400e6 AS age, CAST(fanout AS DOUBLE) AS fanout, touch_t IS NOT NULL AS known
  FROM es WHERE ord = 1),
ent0 AS (
  SELECT pr.seq, pr.prior,
    CASE WHEN m.known THEN (m.f + pr.prior * 20) / (m.n + 20) ELSE pr.prior END AS merchant_fraud_rate,
    coalesce(m.touched, 0e0) AS merchant_txn_count, coalesce(m.age, 0e0) AS merchant_age_days,
    CASE WHEN b.known THEN (least(greatest(b.f - b.own_f, 0e0), b.n_x) + pr.prior * 20) / (b.n_x + 20) ELSE pr.prior END AS bin_fraud_rate,
    CASE WHEN d.known THEN (least(greatest(d.f - d.own_f, 0e0), d.n_x) + pr.prior * 20) / (d.n_x + 20) ELSE pr.prior END AS device_fraud_rate,
    d.fanout AS device_customer_fanout, CASE WHEN d.known THEN 0e0 ELSE 1e0 END AS device_is_global_new,
    CASE WHEN y.known THEN (y.f + pr.prior * 20) / (y.n + 20) ELSE pr.prior END AS beneficiary_fraud_rate,
    coalesce(y.fanout, 0e0) AS beneficiary_customer_fanin,
    CASE WHEN y.seq IS NOT NULL AND NOT y.known THEN 1e0 ELSE 0e0 END AS beneficiary_is_global_new,
    coalesce(y.touched, 0e0) AS beneficiary_txn_count
  FROM pr JOIN ek m ON m.seq = pr.seq AND m.kind = 'merchant' JOIN ek b ON b.seq = pr.seq AND b.kind = 'bin'
    JOIN ek d ON d.seq = pr.seq AND d.kind = 'device' LEFT JOIN ek y ON y.seq = pr.seq AND y.kind = 'beneficiary'),
ent AS (
  SELECT *, greatest(merchant_fraud_rate, bin_fraud_rate, device_fraud_rate, beneficiary_fraud_rate) AS entity_max_fraud_rate,
    greatest(device_customer_fanout, beneficiary_customer_fanin) AS ring_size FROM ent0)"""


ENTITY = entity_ctes()

FEAT = """
feat AS (SELECT prof.*, ent.* EXCLUDE (seq) FROM prof JOIN ent ON ent.seq = prof.seq)"""

# rule order is policy order; the first five are one chain
_COLD = "history_n < 20"
_B5 = f"txn_count_5m >= 6 AND ({_COLD} OR txn_count_5m > 15e-1 * peak_5m)"
_B1 = f"txn_count_1h >= 12 AND ({_COLD} OR txn_count_1h > 15e-1 * peak_1h)"
_RUPEE = "concat('₹', format('{:,.0f}', amount))"
_SIGMA = "concat(format('{:.1f}', amount_z), 'σ')"
RULE_LIST = [
    (1, "amount_hard_limit", "block", "amount >= 1e6", f"concat('Amount ', {_RUPEE}, ' exceeds the ₹10,00,000 single-transaction hard limit')"),
    (1, "large_new_device_no_history", "block", f"amount < 1e6 AND amount >= 2e5 AND new_device = 1 AND {_COLD}",
     f"concat({_RUPEE}, ' from an unrecognised device on an account with no history')"),
    (1, "amount_high", "challenge", f"amount < 1e6 AND amount >= 2e5 AND NOT (new_device = 1 AND {_COLD})",
     f"concat('Amount ', {_RUPEE}, ' is above the ₹2,00,000 verification threshold')"),
    (1, "new_device_high_amount", "challenge", "amount < 2e5 AND new_device = 1 AND amount >= 5e4",
     f"concat({_RUPEE}, ' from a device this customer has never used')"),
    (1, "first_time_large", "flag", f"amount < 2e5 AND NOT (new_device = 1 AND amount >= 5e4) AND {_COLD} AND amount >= 25e3",
     f"concat('First-time customer with no history making a ', {_RUPEE}, ' payment')"),
    (2, "impossible_travel", "block", "impossible_travel = 1",
     "concat('Impossible travel: ', format('{:.0f}', dist_from_last_km), ' km in ', format('{:.1f}', secs_since_last / 3600), ' h (~', format('{:.0f}', speed_kmh), ' km/h) since the last transaction')"),
    (3, "card_testing", "block", f"{_B5} AND amount <= 200 AND new_merchant = 1",
     "concat('Card-testing pattern: ', CAST(txn_count_5m AS BIGINT), ' small payments to new merchants in 5 minutes')"),
    (3, "rapid_burst", "challenge", f"{_B5} AND NOT (amount <= 200 AND new_merchant = 1)",
     "concat('Rapid burst: ', CAST(txn_count_5m AS BIGINT), ' transactions in 5 minutes — faster than this customer''s usual pace')"),
    (4, "ato_login_then_spend", "block", "failed_logins_1h >= 5 AND amount_to_max > 1",
     "concat('High-value ', channel, ' transaction right after ', CAST(failed_logins_1h AS BIGINT), ' failed logins — possible account takeover')"),
    (5, "new_country_large_amount", "block", "new_country = 1 AND amount_z > 4",
     f"concat('First-ever transaction in ', country, ' at ', {_SIGMA}, ' above this customer''s normal spend')"),
    (6, "new_device_online_spend", "challenge", "new_device = 1 AND channel_online = 1 AND amount > 5000 AND failed_logins_1h >= 1",
     "'Large online purchase from an unrecognised device after a failed login'"),
    (7, "high_risk_new_merchant", "challenge", "high_risk_mcc = 1 AND new_merchant = 1 AND amount_z > 2",
     f"concat('Large payment to a new ', replace(mcc, '_', ' '), ' merchant (', {_SIGMA}, ' above normal)')"),
    (8, "velocity_1h", "challenge", _B1, "concat('Unusual velocity: ', CAST(txn_count_1h AS BIGINT), ' transactions in the past hour')"),
    (9, "known_bad_entity", "block", "entity_max_fraud_rate >= 22e-2",
     "concat('Merchant / device / payee on this transaction has a ', format('{:.0f}', entity_max_fraud_rate * 100), '% historical fraud rate')"),
    (10, "fraud_ring", "challenge", "ring_size >= 4",
     "concat('Device or beneficiary is shared across ', CAST(ring_size AS BIGINT), ' different customers — likely a fraud ring / mule account')"),
    (11, "new_payee_large_transfer", "flag", "new_beneficiary = 1 AND channel_transfer = 1 AND amount_z > 15e-1",
     "'Large transfer to a payee this customer has never sent to before'"),
    (12, "amount_spike", "flag", "amount_z > 4 AND amount > 1500 AND (new_merchant = 1 OR is_foreign = 1 OR high_risk_mcc = 1) AND NOT (new_country = 1 AND amount_z > 4)",
     f"concat('Amount is ', {_SIGMA}, ' above this customer''s usual spend, at a new/foreign/high-risk merchant')"),
    (13, "foreign_pos_first_visit", "flag", "is_foreign = 1 AND new_country = 1 AND channel_pos = 1",
     "concat('In-person spend in ', country, ' for the first time')"),
]


def rules_ctes(source: str = "feat", suffix: str = "", keys: str = "seq") -> str:
    parts = "\n  UNION ALL ".join(
        f"SELECT {keys}, {pos} AS pos, '{code}' AS code, '{sev}' AS severity, {msg} AS message FROM {source} WHERE {pred}"
        for pos, code, sev, pred, msg in RULE_LIST)
    return f"""
hits{suffix} AS ({parts}),
sev{suffix} AS (
  SELECT {keys}, max(CASE severity WHEN 'block' THEN 3 WHEN 'challenge' THEN 2 ELSE 1 END) AS rank, count(*) AS n_hits FROM hits{suffix} GROUP BY {keys})"""


RULES = rules_ctes()
PROBA = ("round(1e0 / (1e0 + exp(-(-5e0 + 15e-2 * amount_log + 1e0 * new_device + 5e-1 * new_merchant + 15e-1 * new_country + 75e-2 * new_beneficiary"
         " + 5e-1 * high_risk_mcc + 5e-1 * failed_logins_1h + 6e0 * entity_max_fraud_rate + 125e-3 * ring_size + 1e0 * seq_surprise))), 6)")
NOVELTY = "round(1e0 - exp(-(txn_count_24h + 4 * is_night) / 8e0), 6)"
THRESHOLD = "3e-1"


def action_sql(risk: str, rank: str, says: str) -> str:
    return (f"CASE WHEN {rank} = 3 OR {risk} >= 9e-1 THEN 'BLOCK' WHEN {rank} = 2 OR {risk} >= 55e-2 OR {says} THEN 'CHALLENGE' "
            f"WHEN {rank} = 1 OR {risk} >= 28e-2 THEN 'REVIEW' ELSE 'ALLOW' END")


def cases_ctes(threshold: str = THRESHOLD) -> str:
    return f"""
scored AS (
  SELECT f.*, coalesce(s.rank, 0) AS rank, coalesce(s.n_hits, 0) AS n_hits, {PROBA} AS fraud_proba, {NOVELTY} AS anomaly
  FROM feat f LEFT JOIN sev s ON s.seq = f.seq),
risked AS (SELECT *, greatest(0e0, least(1e0, 75e-2 * fraud_proba + 25e-2 * anomaly)) AS risk FROM scored),
cases AS (
  SELECT *, {action_sql('risk', 'rank', f'fraud_proba >= {threshold}')} AS action,
    {action_sql('0', 'rank', 'false')} AS rules_only, {action_sql('risk', '0', f'fraud_proba >= {threshold}')} AS model_only,
    {action_sql('risk', 'rank', f'fraud_proba >= {threshold}')} AS "full",
    CASE WHEN age BETWEEN 18 AND 25 THEN '18-25' WHEN age BETWEEN 26 AND 40 THEN '26-40' WHEN age BETWEEN 41 AND 60 THEN '41-60' WHEN age BETWEEN 61 AND 100 THEN '60+' ELSE 'unknown' END AS age_bracket
  FROM risked)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


P = with_(BASE, PROFILE)
E = with_(BASE, ENTITY)
X = with_(BASE, PROFILE, ENTITY, FEAT, RULES)
C = with_(BASE, PROFILE, ENTITY, FEAT, RULES, cases_ctes())
