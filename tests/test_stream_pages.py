import random

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from frisk.config import DEFAULT
from frisk.plans import registry
from frisk.sources.replay import write_pages
from frisk.streaming import drift_monitor, event_scoring
from tests.rows import START, frame, random_rows
from tests.test_event_scoring import drain
from tests.test_streaming import deliver


class Held:
    """A value or list state outside Spark."""

    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def put(self, rows):
        self.value = rows

    def clear(self):
        self.value = None


def raw_events(spark, n=240, seed=3):
    rng = random.Random(seed)
    rows, t = [], START
    for i in range(n):
        t += rng.choice([0.0, 40.0, 900.0, 20000.0])
        rows.append((i, t, rng.randrange(5), rng.choice(["view", "click", "purchase", "signup", "error"]), round(rng.random() * 300, 2), f'{{"k": {rng.randrange(100)}}}'))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "event_id long, t double, user_id long, event_type string, value double, props string")
    return df.withColumn("ts", F.timestamp_micros(F.round(F.col("t") * 1000000).cast("long"))).drop("t").coalesce(1)


def test_pages_hold_every_row_once_in_order_of_time(spark, scratch):
    events = raw_events(spark)
    events = events.unionByName(events.limit(3).withColumns({"ts": F.lit(None).cast("timestamp"), "event_id": F.col("event_id") + 1000}))
    pages = write_pages(events, f"{scratch}/pages", 50)
    assert pages == 5
    got = spark.read.parquet(f"{scratch}/pages/*").withColumn("file", F.input_file_name()).withColumn("page", F.regexp_extract("file", "pages/([0-9]+)/", 1).cast("int"))
    assert got.drop("page", "file").exceptAll(events).isEmpty() and events.exceptAll(got.drop("page", "file")).isEmpty()
    spans = got.groupBy("page").agg(F.min("ts"), F.max("ts"), F.count("*"), F.count_distinct("file"), F.count_if(F.col("ts").isNull())).orderBy("page").collect()
    assert len(spans) == 5 and all(a[2] < b[1] for a, b in zip(spans, spans[1:]))
    assert all(20 < r[3] < 90 and r[4] == 1 for r in spans) and [r[5] for r in spans] == [3, 0, 0, 0, 0]


@pytest.mark.parametrize("name", ["stream_features", "busy_stream_scores", "stream_gate_mix"])
def test_a_stream_in_pages_has_the_rows_of_one_batch(spark, scratch, monkeypatch, name):
    pq.write_table(raw_events(spark).toArrow(), f"{scratch}/events.parquet")
    rows = []
    for page_rows in (registry._PAGE_ROWS, 70):
        monkeypatch.setattr(registry, "_PAGE_ROWS", page_rows)
        monkeypatch.setattr("frisk.functions.keep.folder", lambda spark, p=page_rows: f"{scratch}/{p}")
        out = registry.QUERIES[name](spark, scratch)
        rows.append(sorted(map(str, out.collect())))
    batches = spark.read.parquet(f"{scratch}/70/in/*").count() // 70 + 1
    assert batches >= 4 and rows[0] == rows[1] and rows[0]


def test_a_customer_is_kept_in_an_entry_and_pages_not_in_a_row_per_thing_seen(spark, scratch):
    rows = random_rows(n=120, seed=5, span=9 * 86400, customers=4)
    rows[7]["cust_id"] = rows[19]["cust_id"] = None
    deliver(spark, rows, f"{scratch}/in", [0, 60, 120])
    drain(spark, scratch)
    event_scoring.save_state(spark, f"{scratch}/cp", f"{scratch}/state")
    kept = spark.read.parquet(f"{scratch}/state/customers").groupBy("variable").count().collect()
    assert {r["variable"]: r["count"] for r in kept} == {"summary": 5, "seen": 5}
    assert spark.read.parquet(f"{scratch}/out/cases").count() == sum(r["type"] == "txn" for r in rows) == frame(spark, rows).filter("type = 'txn'").count()


def test_tickets_leave_in_frames_of_bounded_size():
    n, rng = 250_000, np.random.default_rng(1)
    t = rng.integers(0, 10**12, n)
    pdf = pd.DataFrame({"t": t, "seq": np.arange(n), "who": np.arange(n) % 99, "ts": pd.to_datetime(t, unit="us"), "txn": rng.random(n) < 0.7, "fraud": False})
    pdf["fraud"] = pdf["txn"] & (rng.random(n) < 0.1)
    op = event_scoring.Tickets(10**9, 0.003, 1.0)
    op.totals, op.due = Held(), Held()
    out = list(op.handleInputRows(("all",), iter([pdf[:100], pdf[100:]]), None))
    assert max(map(len, out)) <= event_scoring._SLICE
    got = pd.concat(out).set_index("seq")["n"]
    ordered, known = pdf.sort_values(["t", "seq"]), np.sort(t[pdf["fraud"]] + 10**9)
    want = (0.003 + np.searchsorted(known, ordered["t"], "right")) / (1.0 + np.cumsum(ordered["txn"]) - ordered["txn"])
    assert np.array_equal(got.loc[ordered["seq"]].to_numpy(), want.to_numpy())


def test_the_drift_monitor_holds_histograms_of_a_slice(monkeypatch):
    s = DEFAULT.with_(psi_window=60, psi_min_samples=25, psi_rebaseline_after=120, psi_rebaseline_window=40)
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"t": rng.integers(0, 300, 500), "seq": np.arange(500), "risk": rng.beta(2, 8, 500), "allowed": rng.random(500) < 0.8})
    out = []
    for size in (10**6, 33):
        monkeypatch.setattr(drift_monitor, "_SLICE", size)
        op = drift_monitor.DriftMonitor([0.1] * 10, s)
        op.monitor = Held()
        frames = list(op.handleInputRows(("all",), iter([pdf[:100], pdf[100:]]), None))
        assert max(map(len, frames)) <= size
        out.append((pd.concat(frames, ignore_index=True), op.monitor.value))
    pd.testing.assert_frame_equal(out[0][0], out[1][0])
    assert out[0][1] == out[1][1] and out[0][0]["segment"].max() == 1
