import os
import time

import pandas as pd
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from frisk.ml.scorers import fixed_scorer
from frisk.operators.entity import entity_features
from frisk.operators.profile import profile_features
from frisk.plans.gate import run_gate
from frisk.streaming import micro_batch, stateful
from tests.rows import frame, random_rows


def deliver(spark, rows, path, cuts):
    ev = frame(spark, rows)
    for lo, hi in zip(cuts, cuts[1:]):
        ev.filter((F.col("seq") >= lo) & (F.col("seq") < hi)).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are taken in order of their modification time
    return ev


def run(df, path, checkpoint):
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def test_keyed_entity_state_equals_batch(spark, scratch):
    rows = [r for r in random_rows(n=150, seed=21, span=9 * 86400) if r["type"] == "txn"]
    ev = deliver(spark, rows, f"{scratch}/in", [0, 60, 150])
    st = micro_batch.event_stream(spark, f"{scratch}/in")
    run(stateful.entity_stream(st), f"{scratch}/out", f"{scratch}/cp")
    got = spark.read.parquet(f"{scratch}/out")
    j = got.join(entity_features(ev), "seq")
    m, d = j.filter("kind = 'merchant'"), j.filter("kind = 'device'")
    assert m.count() == d.count() == len(rows)
    assert m.filter("abs(touched_n - merchant_txn_count) > 1e-8 OR abs((f + 20 * prior) / (n + 20) - merchant_fraud_rate) > 1e-9 AND known").count() == 0
    assert d.filter("abs(fanout - device_customer_fanout) > 1e-8 OR abs((f_others + 20 * prior) / (n_others + 20) - device_fraud_rate) > 1e-9 AND known").count() == 0


def test_keyed_profile_state_equals_batch(spark, scratch):
    ev = deliver(spark, random_rows(n=150, seed=22), f"{scratch}/in", [0, 70, 150])
    run(stateful.profile_stream(micro_batch.event_stream(spark, f"{scratch}/in")), f"{scratch}/out", f"{scratch}/cp")
    got, want = spark.read.parquet(f"{scratch}/out"), profile_features(ev)
    names = [c for c in got.columns if c in want.columns and c not in ("seq", "cust_id", "new_country")]
    j = got.select("seq", *[F.col(c).alias("s_" + c) for c in names]).join(want.select("seq", *names), "seq")
    assert j.count() == want.count() and len(names) > 12
    off = j.agg(*[F.max(F.abs(F.col(c) - F.col("s_" + c))).alias(c) for c in names]).first().asDict()
    assert max(off.values()) < 1e-6, off


def test_micro_batches_equal_one_batch_and_survive_a_restart(spark, scratch):
    rows = random_rows(n=90, seed=23)
    ev = deliver(spark, rows[:45], f"{scratch}/in", [0, 45])
    scorer = micro_batch.MicroBatchScorer(f"{scratch}/out", fixed_scorer, 0.3)
    st = micro_batch.event_stream(spark, f"{scratch}/in")
    micro_batch.score_stream(st, scorer, f"{scratch}/cp").awaitTermination()
    ev = ev.unionByName(deliver(spark, rows[45:], f"{scratch}/in", [45, 90]))
    micro_batch.score_stream(micro_batch.event_stream(spark, f"{scratch}/in"), scorer, f"{scratch}/cp").awaitTermination()
    got = spark.read.parquet(f"{scratch}/out/cases").select("seq", F.col("action").alias("a"), F.col("risk").alias("r"))
    want = run_gate(ev, fixed_scorer, 0.3)
    assert got.count() == want.count() == sum(r["type"] == "txn" for r in rows)
    assert got.join(want, "seq").filter("a <> action OR abs(r - risk) > 1e-9").count() == 0


def test_late_rows_go_to_the_side(spark, scratch):
    from tests.rows import txn
    scorer = micro_batch.MicroBatchScorer(f"{scratch}/out", fixed_scorer, 0.3, lateness="1 hour")
    scorer(frame(spark, [txn(1, 10 * 86400)]), 0)
    scorer(frame(spark, [txn(2, 10 * 86400 - 600), txn(3, 5)]), 1)
    assert [r["seq"] for r in spark.read.parquet(f"{scratch}/out/late").collect()] == [3]
    assert sorted(r["seq"] for r in spark.read.parquet(f"{scratch}/out/cases").collect()) == [1, 2]


def test_action_counts_stream(spark, scratch):
    ev = frame(spark, random_rows(n=60, seed=5)).filter("type = 'txn'").withColumn("action", F.lit("ALLOW"))
    ev.write.parquet(f"{scratch}/in")
    st = spark.readStream.schema(ev.schema).parquet(f"{scratch}/in")
    out = []
    q = (micro_batch.action_counts(st).writeStream.outputMode("update").option("checkpointLocation", f"{scratch}/cp")
         .foreachBatch(lambda df, _: out.append(df.agg(F.sum("n")).first()[0])).trigger(availableNow=True).start())
    q.awaitTermination()
    assert sum(x or 0 for x in out) == ev.count()


def test_verification_join(spark, scratch):
    import datetime as dt
    t = lambda h: dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(hours=h)
    c = spark.createDataFrame([(1, t(0)), (2, t(1)), (3, t(90))], "seq long, ts timestamp")
    v = spark.createDataFrame([(1, True, t(2)), (9, True, t(90))], "case_id long, passed boolean, verified_at timestamp")
    c.write.parquet(f"{scratch}/c")
    v.write.parquet(f"{scratch}/v")
    j = micro_batch.verification_outcomes(spark.readStream.schema(c.schema).parquet(f"{scratch}/c"), spark.readStream.schema(v.schema).parquet(f"{scratch}/v"))
    run(j, f"{scratch}/out", f"{scratch}/cp")
    got = {r["case_id"]: r["verification"] for r in spark.read.parquet(f"{scratch}/out").collect()}
    assert got == {1: "passed", 2: "expired"}


def test_only_a_missing_history_is_none(spark, scratch):
    scorer = micro_batch.MicroBatchScorer(f"{scratch}/s", lambda df: df, 0.3)
    assert scorer._history(spark, 1) is None
    os.makedirs(f"{scratch}/s/history/batch=0/_temporary")
    assert scorer._history(spark, 1) is None
    spark.range(3).write.mode("overwrite").parquet(f"{scratch}/s/history")  # without batches: another table
    with pytest.raises(AnalysisException):
        scorer._history(spark, 1)


class States:
    """A handle whose state variables are held in memory and whose calls are counted; serves one group."""

    class Var:
        def __init__(self, count):
            self.count, self.rows, self.one = count, {}, None

        def __getattr__(self, name):
            self.count()
            return {"getValue": self.rows.get, "updateValue": self.rows.__setitem__, "containsKey": self.rows.__contains__, "removeKey": self.rows.pop,
                    "exists": lambda: self.one is not None, "get": lambda: self.one, "update": lambda v: setattr(self, "one", v)}[name]

    class Rows(Var):
        def __getattr__(self, name):
            self.count()
            return {"exists": lambda: bool(self.one), "get": lambda: iter(self.one or []), "put": lambda v: setattr(self, "one", v), "clear": lambda: setattr(self, "one", None)}[name]

    def __init__(self):
        self.calls = 0

    def call(self, *_):
        self.calls += 1

    def getMapState(self, *_):
        return self.Var(self.call)

    getValueState, registerTimer = getMapState, call

    def getListState(self, *_):
        return self.Rows(self.call)


def fed(processor, key, *batches):
    """Rows a processor gives for the batches, and the state calls it made."""
    states, out = States(), []
    processor.init(states)
    for b in batches:
        out += [p for p in processor.handleInputRows(key, iter([b]), None)]
    return pd.concat(out).reset_index(drop=True), states.calls


def test_entity_state_takes_few_calls_for_many_customers():
    """A merchant of many customers asked its state three times for each of them."""
    day, n = 86400 * 10**6, 2000
    at = 1_700_000_000 * 10**6
    rows = pd.DataFrame({"kind": "merchant", "key": "m1", "seq": range(2 * n), "cust_id": [f"u{i * 7 % 1500}" for i in range(2 * n)], "ts": pd.Timestamp("2024-01-01"),
                         "t": [at + i * day // 500 for i in range(2 * n)], "label": [int(i % 97 == 0) for i in range(2 * n)]})
    make = lambda: stateful.EntityProcessor(day, 30, 90)
    whole, calls = fed(make(), ("merchant", 0), rows)
    assert calls < 60
    parts, calls = fed(make(), ("merchant", 0), rows[:300], rows[300:n], rows[n:])
    assert calls < 160
    pd.testing.assert_frame_equal(parts, whole)
    assert whole["fanout"].iloc[-1] == 1500 and (whole["f_others"] > 0).any()


def test_profiles_of_a_group_take_few_calls():
    """A profile asked its state twice for every merchant it learned, and a call served one customer alone."""
    n, at = 3000, 1_700_000_000 * 10**6
    rows = pd.DataFrame({"type": "txn", "seq": range(n), "cust_id": [f"u{i % 2 * (i % 11)}" for i in range(n)], "t": [at + i * 60 * 10**6 for i in range(n)], "acc": 1.0,
                         "amount": [float(i % 50) for i in range(n)], "merchant_id": [f"m{i * 13 % 1400}" for i in range(n)], "country": "IN", "device_id": "d", "beneficiary": "", "success": 0})
    make = lambda: stateful.ProfileProcessor(30 * 86400)
    whole, calls = fed(make(), (0,), rows)
    assert calls < 100
    parts, _ = fed(make(), (0,), rows[:100], rows[100:1700], rows[1700:])
    order = lambda df: df.sort_values("seq").reset_index(drop=True)
    pd.testing.assert_frame_equal(order(parts), order(whole))
    first = ~rows.duplicated(["cust_id", "merchant_id"])
    assert list(order(whole)["new_merchant"] == 1.0) == list(first)


def test_an_idle_entity_is_pruned_and_an_outcome_that_falls_due_is_kept():
    from types import SimpleNamespace
    day = 86400 * 10**6
    row = lambda key, label: {"kind": "device", "key": key, "seq": label, "cust_id": "u", "ts": None, "t": stateful.ANCHOR_US, "label": label}
    states, p = States(), stateful.EntityProcessor(3 * day, 30, 90)
    p.init(states)
    list(p.handleInputRows(("device", 0), iter([pd.DataFrame([row("good", 0), row("bad", 1)])]), None))
    assert set(p.total.rows) == {("good",), ("bad",)} and len(p.alarms.rows) == 2  # the outcome's, and the idle time of both
    p.total.rows[("good",)] = (0.5, *p.total.rows[("good",)][1:])  # less than one observation left
    for (at,) in sorted(p.alarms.rows):
        list(p.handleExpiredTimer(("device", 0), SimpleNamespace(getCurrentWatermarkInMs=lambda at=at: at), SimpleNamespace(getExpiryTimeInMs=lambda at=at: at)))
    assert set(p.total.rows) == {("bad",)} == {k[:1] for k in p.own.rows} and not p.alarms.rows
    assert p.total.rows[("bad",)][1] > 0 and p.total.rows[("bad",)][5] == 0 and not p.due.rows
