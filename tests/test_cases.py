import datetime as dt
import itertools

from pyspark.sql import functions as F

from frisk.config import DEFAULT, FEATURE_COLUMNS
from frisk.ml.scorers import COEFFICIENTS, INTERCEPT, fixed_scorer
from frisk.operators import evidence, graph, labels, review_queue
from frisk.operators.decision import action_for, customer_alert, reasons, result_reason
from frisk.operators.narrative import with_narrative
from frisk.plans.features import case_table, feature_rows, scored_cases, with_age
from frisk.plans.gate import run_gate
from frisk.streaming.micro_batch import apply_verifications
from tests import sequential
from tests.rows import START, by_seq, close, frame, random_rows, txn


def some_cases(spark, n=120, seed=2):
    return scored_cases(feature_rows(frame(spark, random_rows(n=n, seed=seed))), fixed_scorer, 0.3)


def test_action_map(spark):
    grid = [("block", 0.0, False, "BLOCK"), (None, 0.9, False, "BLOCK"), ("challenge", 0.0, False, "CHALLENGE"), (None, 0.55, False, "CHALLENGE"),
            (None, 0.1, True, "CHALLENGE"), ("flag", 0.0, False, "REVIEW"), (None, 0.28, False, "REVIEW"), (None, 0.27, False, "ALLOW")]
    df = spark.createDataFrame([(a, b, c, d) for a, b, c, d in grid], "s string, r double, m boolean, want string")
    assert df.filter(action_for(F.col("r"), F.col("s"), F.col("m")) != F.col("want")).count() == 0


def test_age_is_stable_and_bracketed(spark):
    rows = frame(spark, [txn(i, i, cust=f"k{i}") for i in range(3000)])
    a = with_age(rows, None)
    assert a.filter("cust_age < 18 OR cust_age > 90 OR age_bracket = 'unknown'").count() == 0
    share = {r["age_bracket"]: r["count"] / 3000 for r in a.groupBy("age_bracket").count().collect()}
    assert abs(share["26-40"] - 0.40) < 0.05 and abs(share["60+"] - 0.14) < 0.04
    assert a.select("seq", "cust_age").exceptAll(with_age(rows, None).select("seq", "cust_age")).count() == 0


def test_gate_equals_one_row_at_a_time(spark):
    """The fixpoint's profiles are those of a customer replayed in order with its decisions."""
    rows = random_rows(n=160, seed=12)
    got = run_gate(frame(spark, rows), fixed_scorer, 0.3)
    acc = {r["seq"]: r["accepted"] for r in got.select("seq", "accepted").collect()}
    names = ["amount_z", "txn_count_1h", "new_device", "seq_surprise", "history_n"]
    close(by_seq(got, names), sequential.all_profiles(rows, lambda r: acc[r["seq"]]), names)
    rule = F.col("action").isin("ALLOW", "REVIEW") | ((F.col("action") == "CHALLENGE") & (F.col("label") == 0))
    assert got.filter(F.col("accepted") != rule).count() == 0


def test_gate_refuses_a_half_settled_answer(spark):
    import pytest
    with pytest.raises(RuntimeError):
        run_gate(frame(spark, random_rows(n=80, seed=12)), fixed_scorer, 0.3, max_passes=1)


def test_probes_rank_by_effect(spark):
    c = some_cases(spark)
    ref = {k: 0.0 for k in FEATURE_COLUMNS}
    e = evidence.feature_probes(c, fixed_scorer, ref).collect()
    assert len(e) == c.count()
    for r in e:
        size = [abs(x["contribution"]) for x in r["explanation"]]
        assert len(size) == 5 and size == sorted(size, reverse=True)


def brute_counterfactual(own, ref, thr):
    import math

    def p(groups):
        f = dict(own)
        for g in groups:
            for name in evidence.GROUPS[g][1]:
                f[name] = ref[name]
        z = INTERCEPT + sum(c * f[k] for k, c in COEFFICIENTS.items())
        return round(1 / (1 + math.exp(-z)), 6)

    chosen, now = [], p([])
    if now < thr:
        return False, None
    while now >= thr and len(chosen) < len(evidence.GROUPS):
        best = min((p(chosen + [g]), g) for g in range(len(evidence.GROUPS)) if g not in chosen)
        if best[0] >= now:
            break
        now, chosen = best[0], chosen + [best[1]]
    if now >= thr:
        return False, now
    for g in list(reversed(chosen)):
        less = [x for x in chosen if x != g]
        if p(less) < thr:
            chosen, now = less, p(less)
    return True, now


def test_counterfactual_equals_brute_force(spark):
    c = some_cases(spark)
    ref = {k: 0.0 for k in FEATURE_COLUMNS}
    for thr in (0.02, 0.004):
        got = {r["seq"]: r for r in evidence.counterfactual(c, fixed_scorer, ref, thr).collect()}
        found = 0
        for r in c.select("seq", *FEATURE_COLUMNS).collect():
            ok, p = brute_counterfactual(r.asDict(), ref, thr)
            assert got[r["seq"]]["found"] == ok, (thr, r["seq"])
            if p is not None:
                assert abs(got[r["seq"]]["counterfactual_probability"] - p) < 1e-4
            found += ok
        assert found > 0 or thr < 0.01


def test_sweep_counts_decision_flips(spark):
    import pytest
    c = some_cases(spark)
    points = evidence.sweep_points(c, ["new_device", "ring_size", "account_age_days"], fixed_scorer, 0.3, steps=7)
    curves = {}
    for r in points.orderBy("i").collect():
        curves.setdefault((r["seq"], r["feature"]), []).append(r)
    assert len(curves) == 3 * c.count() and all(len(v) == 7 for v in curves.values())
    for r in evidence.sweep_summary(points).collect():
        acts = [x["action"] for x in curves[(r["seq"], r["feature"])]]
        flips = sum(a != b for a, b in zip(acts, acts[1:]))
        assert r["n_decision_flips"] == flips and r["monotonic"] == (flips <= 1)
    for (_, feature), v in curves.items():
        risks = [x["risk"] for x in v]
        assert feature == "account_age_days" or risks == sorted(risks)
    assert {x["value"] for x in curves[(min(k[0] for k in curves), "ring_size")]} == {round(8 * i / 6, 4) for i in range(7)}
    with pytest.raises(ValueError):
        evidence.sweep_points(c, ["nope"], fixed_scorer, 0.3)


def test_what_if_direction(spark):
    c = some_cases(spark)
    low = c.select("seq", F.lit(0.5).alias("amount_mult"), F.create_map(F.lit("new_device"), F.lit(0.0)).alias("changes"))
    w = evidence.what_if(c, low, fixed_scorer, 0.3)
    assert w.count() == c.count() and w.filter("risk > base_risk + 1e-3").count() == 0


def test_narrative_of_a_block_and_an_allow(spark):
    rows = [txn(i, i * 86400, amount=50) for i in range(30)] + [
        txn(100, 30 * 86400, amount=90000, mcc="wire_transfer", channel="transfer", beneficiary="mule", device_id="dx", country="SG", label=1)]
    c = scored_cases(feature_rows(frame(spark, rows)), fixed_scorer, 0.3)
    e = evidence.feature_probes(c, fixed_scorer, {k: 0.0 for k in FEATURE_COLUMNS})
    n = {r["seq"]: r for r in with_narrative(case_table(c, e)).collect()}
    bad, good = n[100], n[29]
    assert bad["action"] == "BLOCK" and "was blocked" in bad["summary"] and "to new payee mule" in bad["summary"]
    assert bad["drivers"] and bad["ground_truth"].startswith("Ground truth: fraud")
    assert bad["customer_alert"].startswith("We blocked a suspicious ₹90,000.00 transfer")
    assert good["headline"] == "Cleared — looks normal" and good["customer_alert"] is None


def test_reasons_headline_first(spark):
    c = some_cases(spark).withColumn("reasons", reasons())
    r = c.select("reasons", "hits", result_reason(F.col("reasons")).alias("x"), customer_alert().alias("a"), "action").collect()
    assert all(x["reasons"][0].startswith("Risk ") and len(x["reasons"]) == 1 + len(x["hits"]) for x in r)
    assert all((x["x"] == x["reasons"][1]) if x["hits"] else (x["x"] == x["reasons"][0]) for x in r)
    assert all((x["a"] is not None) == (x["action"] in ("BLOCK", "CHALLENGE")) for x in r)


def at(s):
    return dt.datetime.fromtimestamp(START + s, dt.timezone.utc)


def test_queue_claim_release_resolve(spark):
    log = [(1, 1, at(1), "claim", "ann", None), (1, 2, at(2), "claim", "bob", None), (1, 3, at(3), "release", "bob", None),
           (1, 4, at(4), "release", "ann", None), (1, 5, at(5), "claim", "bob", None), (1, 6, at(6), "resolve", "ann", "fraud"),
           (1, 7, at(7), "claim", "ann", None), (2, 8, at(8), "resolve", "bob", "legitimate"), (2, 9, at(9), "release", "cy", None)]
    df = spark.createDataFrame(log, "case_id long, n long, at timestamp, action string, analyst string, resolution string")
    err = {r["n"]: r["error"] for r in review_queue.apply_actions(df).collect() if r["error"]}
    assert err == {2: "already claimed by ann", 3: "claimed by ann, not bob", 7: "already resolved"}
    st = {r["case_id"]: r for r in review_queue.queue_state(df).collect()}
    assert st[1]["status"] == "resolved" and st[1]["resolved_by"] == "ann" and st[1]["resolution"] == "fraud" and st[1]["refused"] == 3
    assert st[2]["status"] == "open"
    cases = spark.createDataFrame([(i, "REVIEW", 0.3, "c", 1.0, at(0), "m", "", "IN") for i in (1, 2, 3)],
                                  "seq long, action string, risk double, cust_id string, amount double, ts timestamp, merchant_id string, city string, country string")
    q = review_queue.enqueue(cases)
    assert review_queue.queue_counts(q, review_queue.queue_state(df)).first().asDict() == {"open": 2, "claimed": 0, "resolved": 1}
    assert review_queue.enqueue(cases, q.filter("case_id = 1")).count() == 2
    assert [r["case_id"] for r in review_queue.queue_view(q, review_queue.queue_state(df), cases, "resolved").collect()] == [1]


def test_queue_of_a_long_case_in_runs_equals_the_row_fold(spark):
    import random
    from frisk.config import DEFAULT
    rng = random.Random(12)
    people = ["ann", "bob", "open", "resolved", "other", "null", "same", None]
    log = []
    for case in range(1, 8):
        busy = rng.choice([["claim"], ["claim", "release"], ["claim", "release", "resolve", "burn"]])
        for i in range(40 if case > 2 else 400):
            log.append((case, len(log), at(i // 3), rng.choice(busy), rng.choice(people[:2] if rng.random() < 0.5 else people), "fraud"))
    df = spark.createDataFrame(log, "case_id long, n long, at timestamp, action string, analyst string, resolution string")
    want, entry = {}, {}
    for case, n, _, action, who, _ in sorted(log, key=lambda r: (r[0], r[2], r[1])):
        *state, error = review_queue._step(*entry.get(case, ("open", None, None)), action, who)
        entry[case], want[n] = tuple(state), (*state, error)
    pick = lambda d: {r["n"]: (r["status"], r["claimed_by"], r["resolved_by"], r["error"]) for r in d.collect()}
    for hot in (10**6, 150, 7):
        assert pick(review_queue.apply_actions(df, DEFAULT.with_(hot_rows=hot))) == want
    assert review_queue.apply_actions(df.limit(0), DEFAULT.with_(hot_rows=7)).count() == 0
    state = lambda hot: sorted(review_queue.queue_state(df, DEFAULT.with_(hot_rows=hot)).collect(), key=lambda r: r["case_id"])
    assert state(7) == state(10**6)


def feedback(spark, rows):
    return spark.createDataFrame(rows, "log_id long, cust_id string, ts timestamp, amount double, label int, recorded_at timestamp")


def test_feedback_upsert_merge_and_match(spark):
    ev = frame(spark, [txn(1, 0, amount=10.0), txn(2, 100, amount=20.0), txn(3, 101, amount=20.0)])
    log = feedback(spark, [(1, "c1", at(0), 10.001, 1, at(500)), (2, "c1", at(0), 10.0, 0, at(400)), (3, "c1", at(100), 20.0, 0, at(600))])
    m = {r["seq"]: r for r in labels.merge_labels(ev, log).collect()}
    assert (m[1]["label"], m[1]["label_changed"], m[2]["label_changed"]) == (1, True, False)
    near = feedback(spark, [(9, "c1", at(101.5), 20.004, 1, at(700)), (10, "c1", at(104), 20.0, 1, at(700))])
    assert [tuple(r) for r in labels.match_feedback(near, ev).collect()] == [(9, 3)]
    assert labels.feedback_confirms(near, ev).first()["merchant_id"] == "m1"


def test_training_weights(spark):
    ev = frame(spark, [txn(1, 0, label=1), txn(2, 60 * 86400 - 10 * 86400), txn(3, 60 * 86400)])
    w = {r["seq"]: r["weight"] for r in labels.with_training_weights(ev).collect()}
    assert w[1] == 3.0 and abs(w[2] - (0.3 + 0.7 * 10 / 45)) < 1e-9 and abs(w[3] - 0.3) < 1e-9


def test_connections_and_graph(spark):
    rows = [txn(i, i, cust=f"c{i:02d}", device_id="shared", merchant_id=f"m{i}", card_bin="?") for i in range(12)]
    links = graph.connections(frame(spark, rows), frame(spark, rows[:1])).collect()
    assert len(links) == 1 and links[0]["kind"] == "device" and links[0]["total_customers"] == 12
    assert links[0]["shared_with"] == [f"c{i:02d}" for i in range(1, 9)]
    nodes, edges = graph.case_graph(graph.connections(frame(spark, rows), frame(spark, rows[:1])))
    assert (nodes.count(), edges.count()) == (10, 9)


def test_verification_counts_once(spark):
    cases = spark.createDataFrame([(1, "CHALLENGE"), (2, "ALLOW")], "seq long, action string")
    log = spark.createDataFrame([(1, True, at(1), 1), (1, False, at(2), 2), (2, True, at(3), 3), (7, True, at(4), 4)],
                                "case_id long, passed boolean, at timestamp, n long")
    ok, bad = apply_verifications(log, cases)
    assert [(r["case_id"], r["verification"]) for r in ok.collect()] == [(1, "passed")]
    assert {(r["case_id"], r["error"].split(" ")[0]) for r in bad.collect()} == {(1, "this"), (2, "this"), (7, "no")}


def test_combinations_of_groups_cover_every_feature():
    used = list(itertools.chain.from_iterable(names for _, names in evidence.GROUPS))
    assert len(used) == len(set(used)) and set(used) <= set(FEATURE_COLUMNS)
    assert DEFAULT.label_delay_hours == 72
