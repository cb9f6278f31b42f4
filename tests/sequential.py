"""The features stated row by row, straight from their definitions (slow, for comparison only).

Nothing is kept incrementally: every value is recomputed from the plain list of earlier rows.
"""

from __future__ import annotations

import math
import statistics
from collections import Counter

DAY = 86400.0


def token(r):
    return f"{r['mcc']}|{r['channel']}|{min(6, int(math.log(1 + max(r['amount'], 0)) / 1.43))}"


def km(a, b):
    la, lb = math.radians(a["lat"]), math.radians(b["lat"])
    dlon = math.radians(b["lon"] - a["lon"])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(dlon / 2) ** 2
    return 12742.0 * math.asin(math.sqrt(min(h, 1.0)))


def profile(r, past, logins):
    """Features of ``r`` given its customer's accepted rows and logins before it (t in seconds)."""
    amounts = [p["amount"] for p in past]
    n = len(past)
    mean = statistics.fmean(amounts) if n else 0.0
    sd = statistics.stdev(amounts) if n > 1 else 0.0
    within = lambda s: [p for p in past if r["t"] - p["t"] <= s]
    last = past[-1] if n else None
    secs = min(r["t"] - last["t"], 30 * DAY) if last else 30 * DAY
    dist = km(last, r) if last else 0.0
    tokens = [token(p) for p in past]
    out = {
        "amount_z": (r["amount"] - (mean or r["amount"])) / (sd or max(0.35 * mean, 1.0)),
        "amount_to_max": r["amount"] / (max(amounts, default=0.0) or r["amount"]),
        "new_merchant": float(r["merchant_id"] not in {p["merchant_id"] for p in past}),
        "new_device": float(r["device_id"] not in {p["device_id"] for p in past} | {x["device_id"] for x in logins if x["success"] and x["device_id"]}),
        "new_beneficiary": float(bool(r["beneficiary"]) and r["beneficiary"] not in {p["beneficiary"] for p in past}),
        "dist_from_last_km": dist, "secs_since_last": secs,
        "speed_kmh": dist / max(secs / 3600, 1 / 60) if last else 0.0,
        "txn_count_5m": float(len(within(300))), "txn_count_1h": float(len(within(3600))), "txn_count_24h": float(len(within(DAY))),
        "amt_sum_1h": float(sum(p["amount"] for p in within(3600))), "amt_sum_24h": float(sum(p["amount"] for p in within(DAY))),
        "distinct_merchants_24h": float(len({p["merchant_id"] for p in within(DAY)})),
        "distinct_countries_24h": float(len({p["country"] for p in within(DAY)})),
        "failed_logins_1h": float(sum(1 for x in logins if not x["success"] and r["t"] - x["t"] <= 3600)),
        "logins_1h": float(sum(1 for x in logins if r["t"] - x["t"] <= 3600)),
        "history_n": float(n),
    }
    burst = lambda i, s: sum(1 for p in past[: i + 1] if past[i]["t"] - p["t"] <= s)
    aged = [i for i, p in enumerate(past) if r["t"] - p["t"] >= 3600]
    out["peak_5m"] = float(max((burst(i, 300) for i in aged), default=0))
    out["peak_1h"] = float(max((burst(i, 3600) for i in aged), default=0))
    counts, mine = Counter(tokens), token(r)
    smooth = n + 0.5 * (len(counts) + 1)
    p = lambda t: (counts[t] + 0.5) / smooth
    ten, five = tokens[-10:], tokens[-5:]
    kl = sum(c / len(ten) * math.log(c / len(ten) / p(t)) for t, c in Counter(ten).items())
    out["seq_surprise"] = min(-math.log(p(mine)) / 8, 1.0) if n else 0.0
    out["seq_new_token"] = float(bool(n) and mine not in counts)
    out["seq_repeat_5"] = five.count(mine) / len(five) if five else 0.0
    out["seq_regime_kl"] = min(kl / 4, 1.0) if len(ten) >= 4 else 0.0
    return out


def all_profiles(rows, accepted=lambda r: r["label"] == 0):
    past, logins, out = {}, {}, {}
    for r in sorted(rows, key=lambda x: (x["t"], x["seq"])):
        mine, seen = past.setdefault(r["cust_id"], []), logins.setdefault(r["cust_id"], [])
        if r["type"] == "login":
            seen.append(r)
            continue
        out[r["seq"]] = profile(r, mine, seen)
        if accepted(r):
            mine.append(r)
    return out


def all_entities(rows, delay_s=3 * DAY, half=30 * DAY):
    """Entity rates per transaction from explicit lists of observations and delivered outcomes."""
    rows = sorted(rows, key=lambda x: (x["t"], x["seq"]))
    kinds = {"merchant": "merchant_id", "bin": "card_bin", "device": "device_id", "beneficiary": "beneficiary"}
    obs, con, own_n, touched = {}, {}, {}, {}
    seen = bad = 0
    due, out = [], {}
    decay = lambda t0, t1: 0.5 ** ((t1 - t0) / half)
    own_f = {}

    def touch(store, key, t, value):
        n, at = store.get(key, (0.0, t))
        store[key] = (value(n * decay(at, t)), t)

    for r in rows:
        for d in sorted([d for d in due if d[0] <= r["t"]], key=lambda d: d[:2]):
            due.remove(d)
            t, _, x = d
            bad += 1
            for kind, col in kinds.items():
                if x[col] == "" and kind == "beneficiary":
                    continue
                k = (kind, x[col])
                touch(con, k, t, lambda v: v + 1)
                touched[k] = t
                touch(own_f, (k, x["cust_id"]), t, lambda v: v + 1)
                f = own_f[(k, x["cust_id"])][0]
                touch(own_n, (k, x["cust_id"]), t, lambda v, f=f: max(v, f))
        prior = (0.003 + bad) / (1 + seen)
        vals, fan = {}, {}
        for kind, col in kinds.items():
            k = (kind, r[col])
            hist = obs.get(k, [])
            n = sum(decay(o["t"], r["t"]) for o in hist)
            f = con[k][0] * decay(con[k][1], r["t"]) if k in con else 0.0
            if kind in ("bin", "device"):
                on = own_n.get((k, r["cust_id"]))
                of = own_f.get((k, r["cust_id"]))
                n = max(n - (on[0] * decay(on[1], r["t"]) if on else 0.0), 0.0)
                f = min(max(f - (of[0] * decay(of[1], r["t"]) if of else 0.0), 0.0), n)
            vals[kind] = (f + 20 * prior) / (n + 20) if k in touched else prior
            fan[kind] = len({o["cust_id"] for o in hist})
        if not r["beneficiary"]:
            vals["beneficiary"], fan["beneficiary"] = prior, 0
        m = ("merchant", r["merchant_id"])
        out[r["seq"]] = {
            **{f"{k}_fraud_rate": v for k, v in vals.items()},
            "merchant_txn_count": sum(decay(o["t"], touched[m]) for o in obs.get(m, [])) if m in touched else 0.0,
            "device_customer_fanout": float(fan["device"]), "beneficiary_customer_fanin": float(fan["beneficiary"]),
            "ring_size": float(max(fan["device"], fan["beneficiary"])), "prior": prior,
        }
        seen += 1
        for kind, col in kinds.items():
            if r[col] == "" and kind == "beneficiary":
                continue
            k = (kind, r[col])
            obs.setdefault(k, []).append(r)
            touched[k] = r["t"]
            touch(own_n, (k, r["cust_id"]), r["t"], lambda v: v + 1)
        if r["label"] == 1:
            due.append((r["t"] + delay_s, r["seq"], r))
    return out
