import random

import pytest
from pyspark.sql import functions as F

from frisk.config import DEFAULT
from frisk.ml import calibrate, feedback_adjust, iforest, model
from frisk.plans.features import kept

COLS = ["x1", "x2", "x3"]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(0)
    rows = []
    for i in range(3000):
        y = int(rng.random() < 0.06)
        rows.append((i, y, rng.gauss(2.5 * y, 1), rng.gauss(1.5 * y, 1), rng.random()))
    df = spark.createDataFrame(rows, "seq long, label int, x1 double, x2 double, x3 double")
    return kept(df.withColumn("ts", F.timestamp_seconds(F.col("seq") * 60)))


def test_time_split_is_ordered_and_exact(table):
    r = {x["split"]: x for x in model.time_split(table).groupBy("split").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b")).collect()}
    assert (r["train"]["n"], r["valid"]["n"], r["test"]["n"]) == (2100, 450, 450)
    assert r["train"]["b"] < r["valid"]["a"] and r["valid"]["b"] < r["test"]["a"]


def test_isolation_forest_ranks_outliers(spark, table):
    f = iforest.fit(table.filter("label = 0"), COLS)
    odd = spark.createDataFrame([(0.0, 0.0, 0.5), (9.0, 9.0, 5.0)], "x1 double, x2 double, x3 double")
    s = [r["s"] for r in odd.select(f.novelty(F.array(*COLS)).alias("s")).collect()]
    assert s[1] > 0.5 > s[0]
    share = table.filter("label = 0").select((f.novelty(F.array(*COLS)) > 0.5).cast("int").alias("o")).agg(F.avg("o")).first()[0]
    assert 0.005 < share < 0.04


def test_calibration_choice(spark, table):
    raw = table.select("seq", "label", (1 / (1 + F.exp(-(F.col("x1") * 2 - 3)))).alias("raw_proba"))
    iso, n = calibrate.choose(raw)
    assert iso.method == "isotonic" and n >= 50
    c = raw.withColumn("p", iso.apply(F.col("raw_proba"))).agg(
        F.avg(F.pow(F.col("p") - F.col("label"), 2)).alias("c"), F.avg(F.pow(F.col("raw_proba") - F.col("label"), 2)).alias("r")).first()
    assert c["c"] < c["r"]
    few = raw.filter("label = 0").limit(400).unionByName(raw.filter("label = 1").limit(20))
    assert calibrate.choose(few)[0].method in ("sigmoid", "none") and calibrate.choose(few)[1] == 20
    assert calibrate.choose(raw.filter("label = 0"))[0].method == "none"
    sig = calibrate.fit_sigmoid(raw)
    assert sig.a > 0


def test_train_score_save_load(spark, table, scratch):
    m = model.train(table.withColumn("weight", F.lit(1.0)), COLS, max_iter=10, n_boot=20)
    assert m.meta["roc_auc"] > 0.9 and 0 < m.meta["cost_threshold"] <= 1 and abs(sum(m.meta["ref_scores"]) - 1) < 1e-9
    mid = sorted(r["x3"] for r in model.time_split(table).filter("split = 'train'").collect())
    assert m.meta["median"]["x3"] == pytest.approx((mid[1049] + mid[1050]) / 2)
    m.save(spark, f"{scratch}/m")
    again = model.FraudModel.load(spark, f"{scratch}/m")
    a, b = (x(table).select("seq", "fraud_proba", "anomaly").orderBy("seq").limit(50).collect() for x in (m, again))
    assert a == b and m.threshold(DEFAULT.with_(model_threshold=0.2)) == 0.2 and m.threshold() == m.meta["cost_threshold"]


def test_raw_feature_columns(spark, table):
    wide = table.withColumn("raw_features", F.create_map(*[x for c in COLS for x in (F.lit(c), F.col(c))]))
    flat = wide.select("seq", "ts", "label", *[F.col("raw_features")[c].alias(c) for c in COLS])
    assert model.fit_classifier(flat, COLS, max_iter=2).getNumTrees >= 1


def test_feedback_adjustment_is_capped_and_silent_at_first(spark, table):
    cols = feedback_adjust.ADJUST_COLUMNS
    cases = table.limit(40).select("seq", "ts", F.lit("c").alias("cust_id"), F.lit(5.0).alias("amount"), *[(F.col("x1") * float(i == 0)).alias(c) for i, c in enumerate(cols)])
    log = cases.select(F.col("seq").alias("log_id"), "cust_id", "ts", "amount", (F.col("amount_z") > 0).cast("int").alias("label"), F.col("ts").alias("recorded_at"))
    fit = feedback_adjust.fit_adjustment(log, cases)
    adj = feedback_adjust.with_adjustment(cases, fit).select("amount_z", "online_adjustment").collect()
    assert all(abs(r["online_adjustment"]) <= 0.15 for r in adj)
    assert all((r["online_adjustment"] > 0) == (r["amount_z"] > 0) for r in adj if abs(r["amount_z"]) > 0.5)
    few = log.orderBy("log_id").limit(3)
    assert feedback_adjust.fit_adjustment(few, cases) is None
    assert feedback_adjust.with_adjustment(cases, None).filter("online_adjustment <> 0").count() == 0


def test_medians_are_exact_at_every_size(spark):
    from statistics import median

    from frisk.ml.model import medians
    rng = random.Random(3)
    rows = [(rng.gauss(0, 1), float(rng.randrange(3)), None if k % 2 else float(k), float(k == 7)) for k in range(5001)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(3)
    want = {c: median(r[i] for r in rows if r[i] is not None) for i, c in enumerate("abcd")}
    for most in (10**9, 2000):
        assert medians(df, list("abcd"), 5001, most) == want
    assert medians(df.filter("a > 1e9"), ["a"], 0) == {"a": 0.0}


def test_forest_draws_from_the_whole_table(spark):
    df = spark.range(20_000).selectExpr("id AS seq", "cast(id AS double) AS x")
    cuts = [n[3] for n in iforest.fit(df, ["x"], trees=16, sample=64).nodes if n[2] >= 0]
    assert min(cuts) < 1500 and max(cuts) > 18_500


def replayed(steps, alpha=1e-4):
    """Weights after each verdict, stated one at a time."""
    import math
    out, first, w, b = [], steps[0][0], [0.0] * len(steps[0][0]), 0.0
    for k, (x, y) in enumerate(steps):
        z = [u - v for u, v in zip(x, first)]
        p = max(-700.0, min(700.0, b + sum(u * v for u, v in zip(w, z))))
        eta = 1 / (alpha * (1000 + k))
        g = y - 1 / (1 + math.exp(-p))
        w, b = [u * (1 - eta * alpha) + eta * g * v for u, v in zip(w, z)], b + eta * g
        out.append((w, b))
    return first, out


def test_each_case_is_read_under_the_verdicts_that_had_come(spark):
    import math
    import random
    rng, cols = random.Random(3), feedback_adjust.ADJUST_COLUMNS
    data = [(i, f"c{i % 4}", 1000 + 60 * (i - i % 2), float(10 + i), *[None if rng.random() < 0.05 else round(rng.random(), 3) for _ in cols]) for i in range(60)]
    cases = spark.createDataFrame(data, "seq long, cust_id string, t long, amount double, " + ", ".join(f"{c} double" for c in cols))
    cases = cases.withColumn("ts", F.timestamp_seconds("t")).drop("t")
    at = {r[0]: r[2] for r in data}
    # every third case gets a verdict 5 minutes later, some a second one; one comes before its case, one matches nothing, one has no label
    log = [(10 * i, f"c{i % 4}", at[i], 10.0 + i, i % 2, at[i] + 300) for i in range(0, 60, 3)] + [(10 * i + 1, f"c{i % 4}", at[i], 10.0 + i, 1, at[i] + 600) for i in range(0, 60, 9)]
    lost = [(900, "c1", at[1], 11.0, 1, at[1] - 500), (901, "nobody", at[2], 1.0, 1, at[2]), (902, "c1", at[5], 15.0, None, at[5])]
    df = spark.createDataFrame(log + lost, "log_id long, cust_id string, t long, amount double, label int, r long")
    df = df.select("log_id", "cust_id", F.timestamp_seconds("t").alias("ts"), "amount", "label", F.timestamp_seconds("r").alias("recorded_at"))
    got = {r["seq"]: r for r in feedback_adjust.with_online_adjustment(cases, df, DEFAULT.with_(prior_bucket_s=500)).collect()}
    x = {r[0]: [v or 0.0 for v in r[4:]] for r in data}
    order = sorted(log, key=lambda r: (r[5], r[0]))
    first, versions = replayed([(x[r[0] // 10], r[4]) for r in order])
    assert set(got) == set(x)
    for i in x:
        k = sum(r[5] <= at[i] for r in order)
        want = 0.0
        if k >= 5:
            w, b = versions[k - 1]
            p = b + sum(u * (v - c) for u, v, c in zip(w, x[i], first))
            want = max(-0.15, min(0.15, (1 / (1 + math.exp(-p)) - 0.5) * 0.3))
        assert got[i]["updates"] == k and abs(got[i]["online_adjustment"] - want) < 1e-9
    assert {got[i]["online_adjustment"] for i in (0, 1)} == {0.0} and len({r["online_adjustment"] for r in got.values()}) > 10
    none = feedback_adjust.with_online_adjustment(cases, df.limit(0))
    assert none.filter("online_adjustment <> 0 OR updates <> 0").count() == 0 and none.count() == 60
