import math
import random

import pytest
from pyspark.sql import functions as F

from frisk.config import DEFAULT
from frisk.ml.threshold import bootstrap_cost_threshold, exact_cost_threshold
from frisk.operators import drift, metrics


def labelled(spark, pairs, **kw):
    return spark.createDataFrame([(int(y), float(p), i) for i, (y, p) in enumerate(pairs)], "label int, fraud_proba double, seq long")


def test_confusion_by_hand_and_null_rates(spark):
    y, p = "11100000", "11010000"
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(y, p)], "label int, hit int")
    r = metrics.with_rates(metrics.confusion(df, F.col("hit") == 1)).first()
    assert (r["tp"], r["fn"], r["fp"], r["tn"]) == (2, 1, 1, 4)
    assert r["precision"] == pytest.approx(2 / 3) and r["recall"] == pytest.approx(2 / 3) and r["specificity"] == pytest.approx(0.8)
    assert r["mcc"] == pytest.approx((2 * 4 - 1) / math.sqrt(3 * 3 * 5 * 5))
    none = metrics.with_rates(metrics.confusion(df.filter("label = 0"), F.lit(False))).first()
    assert none["precision"] is None and none["recall"] is None and none["f1"] is None and none["specificity"] == 1.0


def brute_auc(pairs):
    pos, neg = [p for y, p in pairs if y], [p for y, p in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def brute_ap(pairs):
    total, out, last = sum(y for y, _ in pairs), 0.0, 0.0
    for s in sorted({p for _, p in pairs}, reverse=True):
        tp = sum(y for y, p in pairs if p >= s)
        recall = tp / total
        out += (recall - last) * tp / sum(1 for _, p in pairs if p >= s)
        last = recall
    return out


@pytest.mark.parametrize("buckets", [4, 256])
def test_ranking_quality_is_exact_with_ties(spark, buckets):
    rng = random.Random(4)
    pairs = [(int(rng.random() < 0.2), round(rng.random(), 2)) for _ in range(400)]
    r = metrics.ranking_quality(labelled(spark, pairs), "fraud_proba", DEFAULT.with_(score_buckets=buckets)).first()
    assert r["roc_auc"] == pytest.approx(brute_auc(pairs)) and r["pr_auc"] == pytest.approx(brute_ap(pairs))


def brute_threshold(pairs, c_fn=1.0, c_fp=0.04):
    best = (c_fn * sum(y for y, _ in pairs), -1.0, 1.0)
    for s in sorted({p for _, p in pairs}, reverse=True):
        cost = c_fp * sum(1 for y, p in pairs if p >= s and not y) + c_fn * sum(1 for y, p in pairs if p < s and y)
        if cost < best[0] - 1e-12:
            best = (cost, 0.0, s)
    return best[2], best[0]


def test_cost_threshold_equals_brute_force(spark):
    rng = random.Random(8)
    for case in range(12):
        rate = rng.choice([0.02, 0.1, 0.4])
        pairs = [(int(rng.random() < rate), round(rng.random() ** 2, 2)) for _ in range(rng.randrange(20, 120))]
        r = exact_cost_threshold(labelled(spark, pairs), "fraud_proba").first()
        thr, cost = brute_threshold(pairs)
        assert r["cost"] == pytest.approx(cost) and r["threshold"] == pytest.approx(thr), case


def test_bootstrap_threshold_is_stable_on_separated_scores(spark):
    pairs = [(1, 0.9)] * 40 + [(0, 0.1)] * 400
    assert bootstrap_cost_threshold(labelled(spark, pairs), "fraud_proba", 30) == pytest.approx(0.9)


def test_bootstrap_interval_brackets_the_rate(spark):
    df = spark.createDataFrame([(int(i < 100), "BLOCK" if i < 90 or i > 950 else "ALLOW") for i in range(1000)], "label int, action string")
    ci = {r["metric"]: r for r in metrics.bootstrap_ci(df, metrics.stopped(), 200).collect()}
    assert ci["recall"]["lo"] < 0.9 < ci["recall"]["hi"] and ci["recall"]["hi"] - ci["recall"]["lo"] < 0.2
    nothing = df.filter("label = 0").withColumn("action", F.lit("ALLOW"))
    assert {r["metric"]: r["lo"] for r in metrics.bootstrap_ci(nothing, metrics.stopped(), 50).collect()}["precision"] is None


def test_calibration_border_belongs_to_the_float_grid(spark):
    df = labelled(spark, [(0, 0.3), (1, 0.1 * 3), (1, 1.0), (0, 0.05)])
    t = {r["bin"]: r["n"] for r in metrics.calibration_table(df).collect()}
    assert t == {1: 1, 3: 1, 4: 1, 10: 1}  # 0.3 lies below 0.30000000000000004
    assert metrics.calibration_error(df).first()["brier"] == pytest.approx((0.09 + 0.49 + 0 + 0.0025) / 4, abs=1e-9)


def test_age_breakdown_has_every_bracket(spark):
    df = spark.createDataFrame([("18-25", 0, "BLOCK", 10.0), ("18-25", 1, "ALLOW", 20.0), ("60+", 0, "ALLOW", 5.0)],
                               "age_bracket string, label int, action string, amount double")
    r = {x["age_bracket"]: x for x in metrics.age_breakdown(df).collect()}
    assert set(r) == {"18-25", "26-40", "41-60", "60+"}
    assert r["26-40"]["fraud_rate"] is None and r["60+"]["detection_rate"] is None and r["18-25"]["false_positive_rate"] == 1.0
    assert metrics.gap(metrics.age_breakdown(df), "false_positive_rate", 4, "g").first()["g"] == 1.0
    assert metrics.gap(metrics.age_breakdown(df.filter("age_bracket = '60+'")), "false_positive_rate", 4, "g").first()["g"] is None


def test_psi_of_same_and_shifted_scores(spark):
    rng = random.Random(2)
    mk = lambda a, b: spark.createDataFrame([(rng.betavariate(a, b),) for _ in range(3000)], "risk double")
    ref = drift.score_histogram(mk(2, 20), "risk")
    assert drift.psi(ref, mk(2, 20), "risk").first()["psi"] < 0.1
    assert drift.psi(ref, mk(8, 3), "risk").first()["psi"] > DEFAULT.psi_alert
    assert drift.psi(ref, mk(2, 20).limit(0), "risk").first()["psi"] == 0.0


def sequential_psi(rows, ref, s):
    """The monitor stated one row at a time."""
    step = s.psi_range_hi / s.psi_bins
    binned = lambda x: min(sum(1 for i in range(1, s.psi_bins) if x >= step * i), s.psi_bins - 1)

    def index(r, window):
        o = [max(sum(1 for x in window if binned(x) == i) / len(window), s.psi_floor) for i in range(s.psi_bins)]
        q = [max(x / sum(r), s.psi_floor) for x in r]
        o, q = [x / sum(o) for x in o], [x / sum(q) for x in q]
        return sum((a - b) * math.log(a / b) for a, b in zip(o, q))

    out, allowed, level, moved = {}, [], None, False
    for i, (seq, risk, action) in enumerate(rows, start=1):
        if action != "ALLOW":
            continue
        allowed.append(risk)
        window = allowed[-s.psi_window:]
        if not moved and i >= s.psi_rebaseline_after and len(window) >= s.psi_rebaseline_window:
            counts = [sum(1 for x in window if binned(x) == b) + 1e-6 for b in range(s.psi_bins)]
            ref, level, moved = [c / sum(counts) for c in counts], None, True
        if len(window) >= s.psi_min_samples:
            raw = index(ref, window)
            level = raw if level is None else 0.9 * level + 0.1 * raw
            state = "alert" if level > s.psi_alert else "watch" if level > s.psi_watch else "stable"
            out[seq] = (raw, level, state)
        else:
            out[seq] = (0.0, 0.0, "warming")
    return out


@pytest.mark.parametrize("rebaseline", [120, 10**6])
def test_rolling_psi_equals_row_by_row(spark, rebaseline):
    s = DEFAULT.with_(psi_window=60, psi_min_samples=25, psi_rebaseline_after=rebaseline, psi_rebaseline_window=40, prior_bucket_s=50)
    rng = random.Random(6)
    data = [(i, rng.betavariate(2, 8 - 5 * (i > 200)), rng.choice(["ALLOW", "ALLOW", "ALLOW", "BLOCK"])) for i in range(700)]
    df = spark.createDataFrame(data, "seq long, risk double, action string").withColumn("ts", F.timestamp_seconds(F.floor(F.col("seq") / 3)))
    ref = [0.1] * 10
    hist = spark.createDataFrame(list(enumerate(ref)), "bin int, share double")
    got = {r["seq"]: r for r in drift.rolling_psi(df, hist, s, chunk_rows=90).collect()}
    want = sequential_psi(data, ref, s)
    assert set(got) == set(want)
    for k, (raw, level, state) in want.items():
        assert got[k]["psi_raw"] == pytest.approx(raw, abs=1e-9) and got[k]["psi"] == pytest.approx(level, abs=1e-9) and got[k]["state"] == state


def test_rank_and_second_half(spark):
    df = spark.createDataFrame([(i, i // 4) for i in range(101)], "seq long, s long").withColumn("ts", F.timestamp_seconds("s"))
    s = DEFAULT.with_(prior_bucket_s=3)
    assert all(r["rank"] == r["seq"] + 1 for r in drift.with_rank(df, s).collect())
    assert sorted(r["seq"] for r in drift.second_half(df, s).collect()) == list(range(50, 101))
