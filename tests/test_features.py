import random
from collections import Counter

import pytest

from frisk.config import DEFAULT, FEATURE_COLUMNS, PROFILE_COLUMNS
from frisk.operators.entity import entity_features
from frisk.operators.profile import profile_features
from frisk.operators.rules import with_rules
from frisk.plans.features import feature_rows
from tests import sequential
from tests.rows import by_seq, close, frame, login, random_rows, txn

CHECKED = ["amount_z", "amount_to_max", "new_merchant", "new_device", "new_beneficiary", "dist_from_last_km", "secs_since_last", "speed_kmh",
           "txn_count_5m", "txn_count_1h", "txn_count_24h", "amt_sum_1h", "amt_sum_24h", "distinct_merchants_24h", "distinct_countries_24h",
           "failed_logins_1h", "logins_1h", "history_n", "peak_5m", "peak_1h", "seq_surprise", "seq_new_token", "seq_repeat_5", "seq_regime_kl"]
ENTITY_CHECKED = ["merchant_fraud_rate", "bin_fraud_rate", "device_fraud_rate", "beneficiary_fraud_rate", "merchant_txn_count",
                  "device_customer_fanout", "beneficiary_customer_fanin", "ring_size", "prior"]


@pytest.mark.parametrize("hot_rows", [10**9, 20])
def test_windows_equal_row_by_row(spark, hot_rows):
    rows = random_rows(seed=3)
    got = profile_features(frame(spark, rows), settings=DEFAULT.with_(hot_rows=hot_rows))
    close(by_seq(got, CHECKED), sequential.all_profiles(rows), CHECKED)


@pytest.mark.parametrize("hot_rows", [10**9, 15])
def test_entity_statistics_equal_row_by_row(spark, hot_rows):
    rows = [r for r in random_rows(seed=5, n=220) if r["type"] == "txn"]
    got = entity_features(frame(spark, rows), DEFAULT.with_(hot_rows=hot_rows, label_delay_hours=12, prior_bucket_s=3600))
    close(by_seq(got, ENTITY_CHECKED), sequential.all_entities(rows, delay_s=12 * 3600), ENTITY_CHECKED)


def test_one_customer_holds_most_rows(spark):
    rows = random_rows(seed=9, n=200, customers=1)
    some = random_rows(seed=10, n=60, customers=3)
    for i, r in enumerate(some):
        r["seq"], r["cust_id"] = 1000 + i, "x" + r["cust_id"]
    got = profile_features(frame(spark, rows + some), settings=DEFAULT.with_(hot_rows=50))
    close(by_seq(got, CHECKED), sequential.all_profiles(rows + some), CHECKED)


def test_all_48_columns_in_order(spark):
    df = feature_rows(frame(spark, random_rows(n=30)))
    assert len(FEATURE_COLUMNS) == 48 and set(FEATURE_COLUMNS) <= set(df.columns)
    assert len(PROFILE_COLUMNS) == 35


def warmed(n=40):
    return [txn(i, i * 86400, amount=40 + i % 17) for i in range(n)]


def rules_of(spark, rows, seq):
    hit = with_rules(feature_rows(frame(spark, rows))).filter(f"seq = {seq}").select("hits.code", "severity", "impossible_travel").first()
    return hit["code"], hit["severity"], hit["impossible_travel"]


def test_impossible_travel(spark):
    t = 40 * 86400
    rows = warmed() + [txn(100, t, lat=40.7, lon=-74.0, country="US"), txn(101, t + 1800, lat=1.35, lon=103.8, country="SG")]
    codes, severity, flag = rules_of(spark, rows, 101)
    assert "impossible_travel" in codes and severity == "block" and flag == 1.0


def test_card_testing_and_ordinary_burst(spark):
    t = 41 * 86400
    tiny = warmed() + [txn(100 + i, t + 20 * i, amount=1.5, merchant_id=f"new{i}") for i in range(7)]
    assert "card_testing" in rules_of(spark, tiny, 106)[0]
    usual = warmed() + [txn(100 + i, t + 30 * i, amount=450) for i in range(7)]
    codes, severity, _ = rules_of(spark, usual, 106)
    assert "rapid_burst" in codes and "card_testing" not in codes and severity == "challenge"


def test_busy_customer_is_judged_by_own_pace(spark):
    rows = [txn(d * 100 + i, d * 86400 + i * 250, amount=100) for d in range(3) for i in range(14)]
    same = rows + [txn(1000 + i, 4 * 86400 + i * 250, amount=100) for i in range(14)]
    assert "velocity_1h" not in rules_of(spark, same, 1013)[0]
    fast = rows + [txn(1000 + i, 4 * 86400 + i * 115, amount=100) for i in range(30)]
    assert "velocity_1h" in rules_of(spark, fast, 1029)[0]


def test_regime_shift_raises_sequence_signals(spark):
    rows = [txn(i, i * 3600 * 12) for i in range(30)] + [
        txn(100 + i, 16 * 86400 + i * 600, amount=20000, mcc="wire_transfer", channel="transfer") for i in range(5)]
    f = by_seq(profile_features(frame(spark, rows)), ["seq_regime_kl", "seq_surprise", "seq_repeat_5"])
    assert f[104]["seq_regime_kl"] > f[29]["seq_regime_kl"] and f[100]["seq_surprise"] > f[29]["seq_surprise"]


def test_device_known_through_successful_login(spark):
    rows = [txn(1, 0), login(2, 10, device_id="dx"), login(3, 11, success=0, device_id="dy"), txn(4, 20, device_id="dx"), txn(5, 30, device_id="dy")]
    f = by_seq(profile_features(frame(spark, rows)), ["new_device", "logins_1h", "failed_logins_1h"])
    assert (f[4]["new_device"], f[5]["new_device"]) == (0.0, 1.0)
    assert (f[4]["logins_1h"], f[4]["failed_logins_1h"]) == (2.0, 1.0)


def test_early_logins_can_be_forgotten(spark):
    rows = [login(1, 0, device_id="dx"), txn(2, 10, device_id="dx"), login(3, 20, device_id="dz"), txn(4, 30, device_id="dz")]
    keep = by_seq(profile_features(frame(spark, rows)), ["new_device", "logins_1h"])
    drop = by_seq(profile_features(frame(spark, rows), early_logins=False), ["new_device", "logins_1h"])
    hot = by_seq(profile_features(frame(spark, rows), early_logins=False, settings=DEFAULT.with_(hot_rows=1)), ["new_device", "logins_1h"])
    assert keep[2]["new_device"] == 0.0 and drop[2]["new_device"] == 1.0
    assert drop[4] == hot[4] and drop[4]["logins_1h"] == 1.0 and keep[4]["logins_1h"] == 2.0


def test_mule_fan_in_and_ring(spark):
    rows = [txn(i, i * 60, cust=f"v{i}", channel="transfer", beneficiary="mule", device_id=f"d{i}", card_bin=f"b{i}") for i in range(7)]
    f = by_seq(entity_features(frame(spark, rows)), ["beneficiary_customer_fanin", "ring_size"])
    assert f[6]["beneficiary_customer_fanin"] == 6.0 and f[6]["ring_size"] == 6.0
    assert "fraud_ring" in rules_of(spark, rows, 6)[0]


def test_label_delay(spark):
    rows = [txn(i, i, cust=f"x{i}", merchant_id=f"mm{i}", device_id=f"d{i}", card_bin=f"b{i}") for i in range(300)]
    rows += [txn(900, 1000, merchant_id="bad", label=1), txn(901, 1000 + 3600, cust="q", merchant_id="bad"),
             txn(902, 1000 + 73 * 3600, cust="q", merchant_id="bad")]
    f = by_seq(entity_features(frame(spark, rows)), ["merchant_fraud_rate", "prior"])
    assert f[901]["merchant_fraud_rate"] < 0.01 and f[902]["merchant_fraud_rate"] > 3 * f[901]["merchant_fraud_rate"]


def test_own_fraud_is_excluded_from_device_and_card(spark):
    rows = [txn(i, i, cust=f"x{i % 200}", device_id=f"d{i % 200}", card_bin=f"b{i % 200}") for i in range(1500)]
    rows += [txn(5000 + i, 2000 + i, cust="victim", device_id="dv", card_bin="bv", label=1) for i in range(5)]
    rows += [txn(6000, 2000 + 5 * 86400, cust="victim", device_id="dv", card_bin="bv")]
    f = by_seq(entity_features(frame(spark, rows)), ["device_fraud_rate", "bin_fraud_rate", "prior"])[6000]
    assert abs(f["device_fraud_rate"] - f["prior"]) < 0.3 * f["prior"] and abs(f["bin_fraud_rate"] - f["prior"]) < 0.3 * f["prior"]


def test_ring_device_is_seen_by_the_next_customer(spark):
    rows = [txn(i, i, cust=f"x{i % 200}", device_id=f"d{i % 200}", card_bin=f"b{i % 200}") for i in range(1500)]
    rows += [txn(5000 + 10 * c + i, 2000 + i, cust=f"v{c}", device_id="ring", card_bin=f"bv{c}", label=1) for c in range(3) for i in range(3)]
    rows += [txn(6000, 2000 + 5 * 86400, cust="next", device_id="ring", card_bin="bn")]
    f = by_seq(entity_features(frame(spark, rows)), ["device_fraud_rate", "device_customer_fanout", "prior"])[6000]
    assert f["device_fraud_rate"] > 10 * f["prior"] and f["device_customer_fanout"] == 3.0


def test_both_routes_agree_on_missing_keys_ties_and_extreme_amounts(spark):
    rows = random_rows(seed=21, n=160, customers=3)
    for k, r in enumerate(rows):
        if r["type"] == "txn":
            r["merchant_id"], r["country"], r["device_id"] = (None if k % 3 == j else r[c] for j, c in enumerate(("merchant_id", "country", "device_id")))
            r["amount"] = {0: 1e-7, 1: 2e14, 2: 3.3e-3}.get(k % 7, r["amount"])
            r["t"] = float(int(r["t"] / 900) * 900)
    names = [c for c in PROFILE_COLUMNS if c != "amount_z"] + ["peak_5m", "peak_1h"]
    cold, hot = (by_seq(profile_features(frame(spark, rows), settings=DEFAULT.with_(hot_rows=n)), names) for n in (10**9, 10))
    close(hot, {s: r.asDict() for s, r in cold.items()}, names)
    assert any(r["distinct_merchants_24h"] > 0 for r in cold.values())


def test_cold_profile_windows_share_one_exchange(spark):
    plan = profile_features(frame(spark, random_rows(n=30)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_chunks_stay_bounded_however_large_the_key(spark):
    from frisk.operators.running import CHUNK, hot_keys, with_chunks
    rows = spark.range(6000).selectExpr("'k' AS key", "id AS t")
    chunked = with_chunks(rows, ["key"], "t", hot_keys(rows, ["key"], "t", 10))
    assert max(r["count"] for r in chunked.groupBy(CHUNK).count().collect()) <= 20


def test_window_counts_of_a_busy_customer_use_growing_frames_only(spark):
    """20,000 rows inside one day: counts against a plain sweep, and no frame that is summed again for every row except the two sums."""
    rng = random.Random(9)
    rows = [txn(k, 40 * k // 10 + (k % 7 == 0), "busy", 5.0 + k % 9, merchant_id=f"m{rng.randrange(300)}" if k % 11 else None, country=rng.choice(["IN", "SG", None]), label=int(k % 13 == 0))
            for k in range(20_000)]
    rows += [txn(20_000 + k, 86400 * 2 + 3600 * 20 * k, "busy", merchant_id=f"m{k % 3}") for k in range(6)]
    out = profile_features(frame(spark, rows)).select("seq", "txn_count_5m", "txn_count_1h", "txn_count_24h", "distinct_merchants_24h", "distinct_countries_24h")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan
    got = {r["seq"]: tuple(r)[1:] for r in out.collect()}
    rows.sort(key=lambda r: (r["t"], r["seq"]))
    past, lo = [], {300: 0, 3600: 0, 86400: 0}
    seen = {"merchant_id": Counter(), "country": Counter()}
    for r in rows:
        for s in lo:
            while lo[s] < len(past) and r["t"] - past[lo[s]]["t"] > s:
                if s == 86400:
                    for col, c in seen.items():
                        c[past[lo[s]][col]] -= 1
                lo[s] += 1
        distinct = [float(sum(n > 0 for v, n in c.items() if v is not None)) for c in seen.values()]
        assert got[r["seq"]] == (*[float(len(past) - lo[s]) for s in (300, 3600, 86400)], *distinct), r
        if r["label"] == 0:
            past.append(r)
            for col, c in seen.items():
                c[r[col]] += 1


def test_missing_coordinates_are_no_travel(spark):
    rows = [txn(0, 0), txn(1, 600, lat=None, lon=None), txn(2, 1200)]
    got = by_seq(profile_features(frame(spark, rows)), ["dist_from_last_km", "speed_kmh", "impossible_travel"])
    assert all(tuple(r)[1:] == (0.0, 0.0, 0.0) for r in got.values())


def test_spread_of_near_amounts_survives_large_ones_of_the_same_customer(spark):
    """Early amounts a cent apart, later ones in the millions: the sum of squares must not cancel on the hot route."""
    amounts = [54.11, 54.12, 54.13, 54.11, 54.14, 60.0, *[1e6 + 1e5 * i for i in range(30)], 54.0]
    ev = frame(spark, [txn(i, 60.0 * i, amount=a) for i, a in enumerate(amounts)])
    cold, hot = (by_seq(profile_features(ev, None, None, DEFAULT.with_(hot_rows=n)), ["amount_z", "amount_to_max", "history_n"]) for n in (10**6, 4))
    for seq in cold:
        for name in ("amount_z", "amount_to_max", "history_n"):
            assert abs(cold[seq][name] - hot[seq][name]) <= 1e-9 * max(1.0, abs(cold[seq][name])), (seq, name, cold[seq][name], hot[seq][name])


def test_a_zero_amount_without_a_record_has_no_ratio(spark):
    """0 / 0 stopped the whole job; a zero amount after a record is 0 of it."""
    ev = frame(spark, [txn(0, 0, amount=0), txn(1, 60, amount=0), txn(2, 120, amount=50), txn(3, 180, amount=0), txn(4, 240, amount=25)])
    for hot_rows in (10**6, 2):
        got = by_seq(profile_features(ev, None, None, DEFAULT.with_(hot_rows=hot_rows)), ["amount_to_max"])
        assert [str(got[i]["amount_to_max"]) for i in range(5)] == ["nan", "nan", "1.0", "0.0", "0.5"]


def test_only_hot_entities_take_the_hot_route(spark, monkeypatch):
    """Rows of cold entities were joined to carries as soon as one entity was hot, and a task's rows followed the input."""
    from frisk.operators import entity
    rows = [r for r in random_rows(seed=21, n=240) if r["type"] == "txn"]
    seen = []
    folds = entity._entity_folds
    monkeypatch.setattr(entity, "_TASK_ROWS", 40)
    monkeypatch.setattr(entity, "_entity_folds", lambda r, s, chunked: seen.append((chunked, r)) or folds(r, s, chunked))
    got = entity_features(frame(spark, rows), DEFAULT.with_(label_delay_hours=12, prior_bucket_s=3600))
    close(by_seq(got, ENTITY_CHECKED), sequential.all_entities(rows, delay_s=12 * 3600), ENTITY_CHECKED)
    (cold, a), (cut, b) = seen
    assert (cold, cut) == (False, True) and a.count() > 0 and b.count() > 0
    assert max(r["count"] for r in b.groupBy("kind", "key", "_chunk").count().collect()) < 120  # observations and outcomes of 40 observations or so
    assert a.rdd.getNumPartitions() >= len(rows) * 3 // 40
