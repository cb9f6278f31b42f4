"""Hand-made and random event rows for tests."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from frisk.schema import EVENT, canonical

START = 1_735_689_600.0  # 2025-01-01


def txn(seq, t, cust="c1", amount=50.0, **kw):
    base = dict(type="txn", seq=seq, t=START + t, cust_id=cust, amount=float(amount), mcc="grocery", channel="pos", merchant_id="m1",
                beneficiary="", country="IN", city="", lat=19.0, lon=72.0, device_id="d1", card_bin="b1", label=0, success=None)
    return {**base, **kw}


def login(seq, t, cust="c1", success=1, device_id="d1"):
    return {**txn(seq, t, cust), "type": "login", "amount": None, "merchant_id": None, "country": None, "mcc": None, "channel": None,
            "beneficiary": "", "success": success, "device_id": device_id}


def frame(spark, rows):
    names = [f.name for f in EVENT.fields]
    data = []
    for r in rows:
        ts = dt.datetime.fromtimestamp(r["t"], dt.timezone.utc)
        data.append(tuple(ts if n == "ts" else r.get(n) for n in names))
    return canonical(spark.createDataFrame(data, EVENT))


def random_rows(n=250, customers=6, seed=1, tie_share=0.3, span=6 * 86400):
    rng, out, t = random.Random(seed), [], 0.0
    for seq in range(n):
        if rng.random() > tie_share:
            t += rng.choice([10, 60, 400, 3600, 9000, 40000]) * rng.random()
            if rng.random() < 0.1:
                t = float(int(t / 300) * 300 + 300)  # whole window steps, to meet the borders
        cust = f"c{rng.randrange(customers)}"
        if rng.random() < 0.2:
            out.append(login(seq, t, cust, int(rng.random() < 0.5), rng.choice(["d1", "d2", "", f"d{cust}"])))
            continue
        out.append(txn(
            seq, t, cust, round(rng.choice([5, 80, 900, 30000]) * (0.5 + rng.random()), 2), mcc=rng.choice(["grocery", "retail", "crypto"]),
            channel=rng.choice(["pos", "online", "transfer"]), merchant_id=f"m{rng.randrange(5)}", country=rng.choice(["IN", "IN", "IN", "SG"]),
            beneficiary=rng.choice(["", "", "p1", "p2"]), device_id=rng.choice(["d1", "d2", f"d{cust}"]), card_bin=rng.choice(["b1", f"b{cust}"]),
            lat=19 + rng.random() * 5, lon=72 + rng.random() * 5, label=int(rng.random() < 0.15)))
    return out


def by_seq(df, names):
    return {r["seq"]: r for r in df.select("seq", *names).collect()}


def close(got, want, names, tol=1e-6):
    bad = [(s, n, got[s][n], want[s][n]) for s in want for n in names
           if not abs((got[s][n] or 0.0) - want[s][n]) <= tol * max(1.0, abs(want[s][n]))]
    assert set(got) == set(want)
    assert not bad, bad[:5]


__all__ = ["F", "txn", "login", "frame", "random_rows", "by_seq", "close", "START"]
