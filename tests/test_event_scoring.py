import random

from pyspark.sql import functions as F

from frisk.config import BASELINE_COLUMNS, DEFAULT, FEATURE_COLUMNS
from frisk.ml.scorers import fixed_scorer
from frisk.operators.rules import with_rules
from frisk.plans.features import feature_rows, scored_cases
from frisk.plans.gate import let_through
from frisk.streaming import event_scoring, micro_batch, row_policy
from tests.rows import START, frame, login, random_rows, txn
from tests.test_streaming import deliver

NAMES = [*FEATURE_COLUMNS, *BASELINE_COLUMNS, "prior", "risk", "fraud_proba", "anomaly"]


def drain(spark, scratch, customers=None, lateness="10 days", threshold=0.3, start=None):
    st = micro_batch.event_stream(spark, f"{scratch}/in")
    rows = event_scoring.feature_stream(st, row_policy.fixed_row_scorer, threshold, customers, lateness=lateness, start=start)
    sink = event_scoring.CaseSink(f"{scratch}/out", fixed_scorer, threshold)
    q = rows.writeStream.foreachBatch(sink).option("checkpointLocation", f"{scratch}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def same(cases, events, customers=None):
    """Every feature, score, rule code and decision row by row against one batch pass whose profiles learn from the rows the stream let through.

    The gate's answer is the one set of decisions that reproduces itself, so this pass and ``let_through`` agreeing is equality with the gate.
    """
    events = events.join(cases.select("seq", "accepted"), "seq", "left")
    want = scored_cases(feature_rows(events, customers, F.col("accepted")), fixed_scorer, 0.3)
    codes = F.transform("hits", lambda h: h["code"])
    pick = lambda df, p, ok: df.select("seq", *[F.col(c).alias(p + c) for c in (*NAMES, "action", "severity")], ok.alias(p + "accepted"), codes.alias(p + "codes"))
    j = pick(cases, "g_", F.col("accepted")).join(pick(want, "w_", let_through()), "seq", "full")
    differ = F.lit(False)
    for c in NAMES:
        near = F.abs(F.col("g_" + c) - F.col("w_" + c)) <= 1e-8 * F.greatest(F.abs("w_" + c), F.lit(1.0))
        differ = differ | ~F.coalesce(near, F.col("g_" + c).isNull() & F.col("w_" + c).isNull())
    for c in ("action", "severity", "accepted", "codes"):
        differ = differ | ~F.col("g_" + c).eqNullSafe(F.col("w_" + c))
    bad = j.filter(differ).limit(3).collect()
    assert not bad, [{c: (r["g_" + c], r["w_" + c]) for c in (*NAMES, "action", "accepted") if r["g_" + c] != r["w_" + c]} for r in bad]


def test_stream_equals_the_gate_survives_a_restart_and_sets_late_rows_aside(spark, scratch):
    rng, rows = random.Random(4), random_rows(n=150, seed=31, span=9 * 86400)
    for r in rows:
        for col in ("merchant_id", "country", "device_id", "mcc", "channel", "lat", "city"):
            if r["type"] == "txn" and rng.random() < 0.08:
                r[col] = None
    late = [txn(150, 5.0, "c1", merchant_id="m9"), login(151, 6.0, "c2")]
    after = txn(152, rows[-1]["t"] - START + 60, "c1", merchant_id="m9", label=1)
    customers = spark.createDataFrame([("c1", "SG", "2024-12-01 00:00:00"), ("c2", None, None)], "cust_id string, home_country string, account_open string")
    customers = customers.withColumn("account_open", F.col("account_open").cast("timestamp"))
    deliver(spark, rows[:100], f"{scratch}/in", [0, 60, 100])
    drain(spark, scratch, customers, "1 hour")
    deliver(spark, [*rows[100:], *late, after], f"{scratch}/in", [100, 150, 152, 153])
    drain(spark, scratch, customers, "1 hour")
    cases = spark.read.parquet(f"{scratch}/out/cases")
    assert cases.select("action").distinct().count() >= 3 and cases.select("batch").distinct().count() >= 4
    assert sorted(r["seq"] for r in spark.read.parquet(f"{scratch}/out/late").collect()) == [150, 151]
    same(cases, frame(spark, [*rows, after]), customers)


def test_a_new_stream_continues_from_a_snapshot(spark, scratch):
    rows = random_rows(n=110, seed=12, span=9 * 86400, customers=4)
    deliver(spark, rows[:70], f"{scratch}/in", [0, 70])
    drain(spark, scratch)
    event_scoring.save_state(spark, f"{scratch}/cp", f"{scratch}/state")
    due = spark.read.parquet(f"{scratch}/state/entities").filter("variable = 'due'").count()
    assert due > 0  # outcomes still on their way are part of it
    deliver(spark, rows[70:], f"{scratch}/next/in", [70, 110])
    drain(spark, f"{scratch}/next", start=f"{scratch}/state")
    names = ["seq", *dict.fromkeys([*NAMES, "action", "severity", "accepted"]), "hits"]
    cases = spark.read.parquet(f"{scratch}/out/cases").select(names).unionByName(spark.read.parquet(f"{scratch}/next/out/cases").select(names))
    assert cases.count() == sum(r["type"] == "txn" for r in rows)
    same(cases, frame(spark, rows))


def test_zero_amounts_without_a_record_stream_as_in_batch(spark, scratch):
    rows = [*[login(i, 60.0 * i, success=0) for i in range(6)], txn(6, 400, amount=0), txn(7, 460, amount=0, device_id="d9"), txn(8, 520, amount=70), txn(9, 580, amount=0)]
    deliver(spark, rows, f"{scratch}/in", [0, 10])
    drain(spark, scratch)
    cases = spark.read.parquet(f"{scratch}/out/cases")
    assert sorted(r["seq"] for r in cases.filter(F.isnan("amount_to_max")).collect())[0] == 6
    same(cases, frame(spark, rows))


def test_row_policy_equals_the_column_rules(spark):
    rng, feats = random.Random(2), []
    values = {"amount": [50, 150, 900, 6000, 30000, 60000, 250000, 2e6], "amount_z": [0, 1.6, 2.5, 5], "amount_to_max": [0.5, 2], "history_n": [0, 19, 20, 50],
              "txn_count_5m": [0, 5, 6, 9], "txn_count_1h": [0, 11, 12, 30], "peak_5m": [0, 4, 6], "peak_1h": [0, 8, 20], "failed_logins_1h": [0, 1, 5],
              "entity_max_fraud_rate": [0.0, 0.2, 0.22, 0.5], "ring_size": [0, 3, 4]}
    flags = ["new_device", "new_merchant", "new_country", "new_beneficiary", "is_foreign", "high_risk_mcc", "impossible_travel", "channel_pos", "channel_online", "channel_transfer"]
    for _ in range(1500):
        f = {k: float(rng.choice(v)) for k, v in values.items()} | {k: float(rng.random() < 0.2) for k in flags}
        feats.append(f | {"dist_from_last_km": 1.0, "secs_since_last": 60.0, "speed_kmh": 5.0, "mcc": "wire_transfer", "channel": "pos", "country": "SG"})
    rows = with_rules(spark.createDataFrame(feats), DEFAULT).select("severity", F.size("hits").alias("n")).collect()
    names = [None, "flag", "challenge", "block"]
    got = [names[row_policy.severity(f)] for f in feats]
    assert got == [r["severity"] for r in rows] and {*got} == {*names}
