"""Per-customer features, strictly before each transaction, from accepted rows only.

Customers of ordinary size run through plain windows: one shuffle by customer, then sorts.
Counts and distinct counts of a time window are differences of running counts, linear in the rows; the two sliding sums
keep range frames, which cost (rows x frame size), so customers above ``hot_rows`` take a second route
with the same results: every accepted row enters a running sum at its time and leaves it
when the sliding window has passed, which is linear, and the sums are cut into time chunks
(see ``running``), so one customer may hold any share of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frisk.config import BASELINE_COLUMNS, DEFAULT, PROFILE_COLUMNS, US, Settings
from frisk.functions.expr import behaviour_token, flag, haversine_km
from frisk.operators.running import CHUNK, Fold, chunk_of, hot_keys, running

_KEYS = {"merchant": "merchant_id", "country": "country", "device": "device_id",
         "payee": "beneficiary", "token": "tok"}
_DISTINCT = ("merchant", "country")  # keys counted distinctly over the last day
# sliding sums on the hot route add and subtract, so they are kept exact: a whole part and a fraction in steps of 2^-60
_EXACT, _STEPS = "decimal(38,0)", float(1 << 60)

# what each route has to deliver; ``_finish`` turns these into the published features
_RAW = ("n", "mean", "sd", "mx", "last", "home", "opened",
        "k_merchant", "k_country", "k_device", "k_payee", "k_token", "vocab", "recent",
        "c5", "c1", "c24", "s1", "s24", "dm", "dc", "fl", "lg", "peak_5m", "peak_1h")


def prepare(events: DataFrame, accepted: Column) -> DataFrame:
    """Add event time in micros, the accepted gate and the behaviour token."""
    txn = F.col("type") == "txn"
    return events.withColumns({
        "t": F.unix_micros("ts"),
        "acc": F.when(txn & accepted, F.lit(1)),
        "tok": F.when(txn, behaviour_token(F.col("mcc"), F.col("channel"), F.col("amount"))),
    })


def _login_rows(early_logins: bool) -> Column:
    is_login = F.col("type") == "login"
    return is_login if early_logins else is_login & (F.col("txns_before") > 0)


def _known_device(login: Column) -> Column:
    ok = login & (F.col("success") == 1) & (F.coalesce(F.col("device_id"), F.lit("")) != "")
    return F.when(F.col("acc").isNotNull() | ok, 1)


def _cold(e: DataFrame, early_logins: bool) -> DataFrame:
    acc = lambda c: F.when(F.col("acc").isNotNull(), c)
    first, now = Window.unboundedPreceding, -1
    by_cust = Window.partitionBy("cust_id").orderBy("t", "seq")
    if not early_logins:
        e = e.withColumn("txns_before", F.count(F.when(F.col("type") == "txn", 1)).over(by_cust.rowsBetween(first, now)))
    login = _login_rows(early_logins)

    for name, col in _KEYS.items():
        w = Window.partitionBy("cust_id", col).orderBy("t", "seq").rowsBetween(first, now)
        hit = _known_device(login) if name == "device" else F.col("acc")
        e = e.withColumn("k_" + name, F.count(hit).over(w))
        if name in _DISTINCT:
            # a key enters the last day with a row that finds none of its kind there, and leaves a day after a row that no other follows in time
            taken = F.col("acc").isNotNull() & F.col(col).isNotNull()
            e = e.withColumns({"_acc_t": F.when(taken, F.col("t")), "_before": F.max(F.when(taken, F.col("t"))).over(w)})
            after = F.expr(f"lead(_acc_t) IGNORE NULLS OVER (PARTITION BY cust_id, {col} ORDER BY t, seq)")
            day = 86400 * US
            e = e.withColumn("_after", after).withColumns({
                "_enter_" + name: F.when(taken & F.coalesce(F.col("t") - F.col("_before") > day, F.lit(True)), 1),
                "_leave_" + name: F.when(taken & F.coalesce(F.col("_after") - F.col("t") > day, F.lit(True)), 1)}).drop("_acc_t", "_before", "_after")

    prev = by_cust.rowsBetween(first, now)
    at_start = by_cust.rowsBetween(first, 0)
    txn_only = lambda c: F.when(F.col("type") == "txn", c)
    e = e.withColumns({
        "n": F.count("acc").over(prev),
        "mean": F.avg(acc(F.col("amount"))).over(prev),
        "sd": F.stddev_samp(acc(F.col("amount"))).over(prev),
        "mx": F.max(acc(F.col("amount"))).over(prev),
        "last": F.last(acc(F.struct("t", "lat", "lon")), ignorenulls=True).over(prev),
        "vocab": F.count(acc(F.when(F.col("k_token") == 0, 1))).over(prev),
        "home": F.first(txn_only(F.col("country")), ignorenulls=True).over(at_start),
        "opened": F.first(txn_only(F.col("t")), ignorenulls=True).over(at_start),
    })

    # rows that share this timestamp but come earlier in seq are outside a range frame
    tie = Window.partitionBy("cust_id", "t").orderBy("seq").rowsBetween(first, now)
    span = lambda s: Window.partitionBy("cust_id").orderBy("t").rangeBetween(-s * US, -1)
    amount, failed = acc(F.col("amount")), F.when(login & (F.col("success") == 0), 1)
    zero = F.lit(0.0)

    def long_past(s: int):
        """Rows over ``s`` seconds older than this one: a frame that only grows."""
        return Window.partitionBy("cust_id").orderBy("t").rangeBetween(first, -s * US - 1)

    def count_in(c: Column, s: int) -> Column:
        # two running counts: a frame with two moving ends is summed again for every row
        return F.count(c).over(prev) - F.count(c).over(long_past(s))

    def sum_in(c: Column, s: int) -> Column:
        return F.coalesce(F.sum(c).over(span(s)), zero) + F.coalesce(F.sum(c).over(tie), zero)

    def distinct_in(name: str) -> Column:
        return F.count("_enter_" + name).over(prev) - F.count("_leave_" + name).over(long_past(86400))

    e = e.withColumns({
        "c5": count_in(F.col("acc"), 300),
        "c1": count_in(F.col("acc"), 3600),
        "c24": count_in(F.col("acc"), 86400),
        "s1": sum_in(amount, 3600),
        "s24": sum_in(amount, 86400),
        "dm": distinct_in("merchant"),
        "dc": distinct_in("country"),
        "fl": count_in(failed, 3600),
        "lg": count_in(F.when(login, 1), 3600),
    })
    e = e.drop(*[x + name for name in _DISTINCT for x in ("_enter_", "_leave_")])
    aged = Window.partitionBy("cust_id").orderBy("t").rangeBetween(first, -3600 * US)
    e = e.withColumns({
        "peak_5m": F.max(acc(F.col("c5") + 1)).over(aged),
        "peak_1h": F.max(acc(F.col("c1") + 1)).over(aged),
    })
    # the ten accepted rows before this one: a range frame over the accepted ordinal
    last_ten = Window.partitionBy("cust_id").orderBy("n").rangeBetween(-10, -1)
    entry = F.struct(F.col("n").alias("k"), F.col("tok").alias("tok"), (F.col("k_token") + 1).alias("c"))
    e = e.withColumn("recent", F.collect_list(acc(entry)).over(last_ten))
    return e.filter(F.col("type") == "txn")


def _hot(e: DataFrame, grid: DataFrame, early_logins: bool) -> DataFrame:
    acc = lambda c: F.when(F.col("acc").isNotNull(), c)
    e = e.join(grid, "cust_id").withColumn(CHUNK, chunk_of(F.col("t")))
    first_txn = (
        e.filter(F.col("type") == "txn")
        .groupBy("cust_id")
        .agg(F.min(F.struct("t", "seq")).alias("first_txn"),
             F.min(F.when(F.col("country").isNotNull(), F.struct("t", "seq", "country"))).alias("first_home"))
    )  # one row per hot customer
    e = e.join(first_txn, "cust_id", "left")
    e = e.withColumn("txns_before", F.when(F.struct("t", "seq") > F.struct("first_txn.t", "first_txn.seq"), 1).otherwise(0))
    login = _login_rows(early_logins)

    # seen-before counts of all five keys in one pass over narrow (kind, key) rows
    def key_row(name: str, col: str) -> Column:
        hit = _known_device(login) if name == "device" else F.col("acc")
        return F.struct(F.lit(name).alias("kind"), F.col(col).alias("key"), hit.alias("hit"))

    pairs = F.array(*[key_row(name, col) for name, col in _KEYS.items()])
    narrow = e.select("cust_id", "t", "seq", CHUNK, "acc", F.explode(pairs).alias("p")).select(
        "cust_id", "t", "seq", CHUNK, "acc", "p.*")
    narrow = running(narrow, ["cust_id", "kind", "key"], ["t", "seq"],
                     [Fold("hits", "sum", F.col("hit")), Fold("hit_t", "max", acc(F.col("t")))], chunked=True)
    of = lambda name, c: F.max(F.when(F.col("kind") == name, F.col(c)))
    wide = narrow.groupBy("cust_id", "seq").agg(
        *[F.coalesce(of(name, "hits"), F.lit(0)).alias("k_" + name) for name in _KEYS],
        *[of(name, "hit_t").alias("t_" + name) for name in ("merchant", "country")])
    e = e.join(wide, ["cust_id", "seq"])

    day = 86400 * US
    has = {name: F.col(_KEYS[name]).isNotNull() for name in ("merchant", "country")}  # a missing key is no distinct value
    fresh = lambda name: F.when(has[name], F.when(F.col("t") - F.col("t_" + name) <= day, 0).otherwise(1))
    leave = lambda name: F.when(has[name], -1)
    whole = F.col("amount").cast(_EXACT)
    part = ((F.col("amount") - whole.cast("double")) * _STEPS).cast(_EXACT)
    failed = F.when(login & (F.col("success") == 0), 1)
    money = ("s1", "s24", "s1_part", "s24_part")
    moves = ("c5", "c1", "c24", *money, "dm", "dc", "fl", "lg")
    enter = {"c5": F.lit(1), "c1": F.lit(1), "c24": F.lit(1), "s1": whole, "s24": whole, "s1_part": part, "s24_part": part,
             "dm": fresh("merchant"), "dc": fresh("country")}

    def at(shift: Column, ord_: int, **delta: Column) -> Column:
        """One row of the running sums: when it applies and what it changes."""
        kind = lambda k: _EXACT if k in money else "long"
        return F.struct(
            shift.alias("t"), F.lit(ord_).alias("ord"),
            *[delta.get(k, F.lit(None)).cast(kind(k)).alias("d_" + k) for k in moves],
        )

    none = F.lit(None)
    now = at(F.col("t"), 2, **{k: acc(v) for k, v in enter.items()},
             fl=failed, lg=F.when(login, 1))
    is_acc = F.col("acc").isNotNull()
    steps = F.array(
        now,
        F.when(is_acc, at(F.col("t") + 300 * US, 3, c5=F.lit(-1))),
        F.when(is_acc, at(F.col("t") + 3600 * US, 3, c1=F.lit(-1), s1=-whole, s1_part=-part)),
        F.when(is_acc, at(F.col("t") + day, 3, c24=F.lit(-1), s24=-whole, s24_part=-part, dm=leave("merchant"), dc=leave("country"))),
        # a key seen again within the day was not counted twice, so its earlier exit is undone
        F.when(is_acc & (fresh("merchant") == 0), at(F.col("t_merchant") + day, 3, dm=F.lit(1))),
        F.when(is_acc & (fresh("country") == 0), at(F.col("t_country") + day, 3, dc=F.lit(1))),
        F.when(login, at(F.col("t") + 3600 * US, 3, lg=F.lit(-1), fl=F.when(failed == 1, -1))),
    )
    keep = [c for c in e.columns if c not in ("t", CHUNK, "t_merchant", "t_country")]
    moved = (
        e.withColumn("step", F.explode(F.filter(steps, lambda x: x.isNotNull())))
        .select(*keep, "step.*")
        .withColumn(CHUNK, chunk_of(F.col("t")))
    )
    here = lambda c: F.when((F.col("ord") == 2) & F.col("acc").isNotNull(), c)
    moved = running(moved, ["cust_id"], ["t", "ord", "seq"], [
        *[Fold(k, "sum", F.col("d_" + k)) for k in moves],
        Fold("n", "sum", here(F.lit(1))),
        Fold("spread", "moments", here(F.col("amount"))),
        Fold("mx", "max", here(F.col("amount"))),
        Fold("last", "last", here(F.struct("t", "lat", "lon"))),
        Fold("vocab", "sum", here(F.when(F.col("k_token") == 0, 1))),
    ], chunked=True)
    n = F.coalesce(F.col("n"), F.lit(0))
    rows = moved.filter(F.col("ord") == 2).withColumns({
        **{k: F.coalesce(F.col(k), F.lit(0)) for k in (*moves, "vocab")},
        "n": n,
        "mean": F.when(n > 0, F.col("spread.mean")),
        "sd": F.when(n > 1, F.sqrt(F.col("spread.m2") / (n - 1))),
        **{k: F.coalesce(F.col(k), F.lit(0)).cast("double") + F.coalesce(F.col(k + "_part"), F.lit(0)).cast("double") / _STEPS for k in ("s1", "s24")},
        "home": F.when(F.struct("t", "seq") >= F.struct("first_home.t", "first_home.seq"), F.col("first_home.country")),
        "opened": F.col("first_txn.t"),
    }).drop(*["d_" + k for k in moves], "s1_part", "s24_part", "spread", "ord")

    # personal peaks: a row's own counts become readable one hour later
    done = F.array(
        F.struct(F.col("t").alias("t"), F.lit(2).alias("ord"), none.cast("long").alias("p5"), none.cast("long").alias("p1")),
        F.when(is_acc, F.struct((F.col("t") + 3600 * US).alias("t"), F.lit(1).alias("ord"),
                                (F.col("c5") + 1).alias("p5"), (F.col("c1") + 1).alias("p1"))),
    )
    keep = [c for c in rows.columns if c not in ("t", CHUNK)]
    rows = (
        rows.withColumn("step", F.explode(F.filter(done, lambda x: x.isNotNull())))
        .select(*keep, "step.*")
        .withColumn(CHUNK, chunk_of(F.col("t")))
    )
    rows = running(rows, ["cust_id"], ["t", "ord", "seq"],
                   [Fold("peak_5m", "max", F.col("p5")), Fold("peak_1h", "max", F.col("p1"))], chunked=True)
    rows = rows.filter((F.col("ord") == 2) & (F.col("type") == "txn"))

    # each accepted row is one of the last ten of the next ten ordinals: at most ten per group
    entry = F.struct(F.col("n").alias("k"), F.col("tok").alias("tok"), (F.col("k_token") + 1).alias("c"))
    tails = (
        rows.filter(is_acc)
        .select("cust_id", entry.alias("entry"), F.explode(F.sequence(F.col("n") + 1, F.col("n") + 10)).alias("n"))
        .groupBy("cust_id", "n")
        .agg(F.collect_list("entry").alias("recent"))
    )
    rows = rows.join(tails, ["cust_id", "n"], "left")
    empty = F.array().cast("array<struct<k:bigint,tok:string,c:bigint>>")
    return rows.withColumn("recent", F.coalesce(F.col("recent"), empty))


def _sequence(n: Column, vocab: Column, c: Column, tok: Column, recent: Column) -> dict[str, Column]:
    """Surprise, novelty, repetition and shift of the customer's behaviour-token stream.

    ``recent`` carries each token's running count; its largest value per token is that
    token's all-time count, since the last occurrence is among the recent rows.
    """
    smooth = n + 0.5 * (vocab + 1)
    share = lambda count: (count + 0.5) / smooth
    none_yet = n == 0
    five = F.filter(recent, lambda x: x["k"] >= n - 5)
    ten = F.size(recent)
    tokens = F.array_distinct(F.transform(recent, lambda x: x["tok"]))

    def term(total, name):
        mine = F.filter(recent, lambda x: x["tok"] == name)
        q = F.size(mine) / ten
        return total + q * F.log(q / share(F.array_max(F.transform(mine, lambda x: x["c"]))))

    kl = F.when(ten >= 4, F.least(F.aggregate(tokens, F.lit(0.0), term) / 4.0, F.lit(1.0))).otherwise(0.0)
    same = F.size(F.filter(five, lambda x: x["tok"] == tok))
    return {
        "seq_surprise": F.when(none_yet, 0.0).otherwise(F.least(-F.log(share(c)) / 8.0, F.lit(1.0))),
        "seq_new_token": flag(~none_yet & (c == 0)),
        "seq_repeat_5": F.when(none_yet, 0.0).otherwise(F.coalesce(F.try_divide(same.cast("double"), F.size(five).cast("double")), F.lit(0.0))),
        "seq_regime_kl": F.when(none_yet, 0.0).otherwise(kl),
    }


def _finish(raw: DataFrame, s: Settings) -> DataFrame:
    amt, t = F.col("amount"), F.col("t")
    mean = F.coalesce(F.nullif(F.col("mean"), F.lit(0.0)), amt)
    floor = F.greatest(F.coalesce(F.col("mean"), F.lit(0.0)) * 0.35, F.lit(1.0))
    sd = F.coalesce(F.nullif(F.col("sd"), F.lit(0.0)), floor)
    # nothing against nothing: a zero amount with no record has no ratio, and NaN says so as the statement's division does
    record = F.coalesce(F.nullif(F.col("mx"), F.lit(0.0)), amt)
    seen, gap = F.col("last").isNotNull(), (t - F.col("last.t")) / float(US)
    secs = F.when(seen, F.least(gap, F.lit(float(s.max_gap_s)))).otherwise(float(s.max_gap_s))
    # a row without coordinates is no evidence of travel
    dist = F.when(seen, F.coalesce(haversine_km(F.col("last.lat"), F.col("last.lon"), F.col("lat"), F.col("lon")), F.lit(0.0))).otherwise(0.0)
    speed = F.when(seen, dist / F.greatest(secs / 3600.0, F.lit(1 / 60.0))).otherwise(0.0)
    home = F.coalesce(F.col("home_country"), F.col("home"))
    opened = F.coalesce(F.unix_micros("account_open"), F.col("opened"))
    payee = F.coalesce(F.col("beneficiary"), F.lit(""))
    unseen = lambda name: F.col("k_" + name) == 0
    dbl = lambda name: F.col(name).cast("double")
    hour = F.hour("ts")
    feats = {
        "amount": amt,
        "amount_log": F.log1p(amt),
        "amount_z": (amt - mean) / sd,
        "amount_to_max": F.when(record == 0, F.lit(float("nan"))).otherwise(F.try_divide(amt, record)),
        "hour": hour.cast("double"),
        "is_night": flag((hour < 6) | (hour >= 23)),
        "is_weekend": flag(F.weekday("ts") >= 5),
        "new_merchant": flag(unseen("merchant")),
        "new_country": flag(unseen("country") & ~F.col("country").eqNullSafe(home)),
        "new_device": flag(unseen("device")),
        "new_beneficiary": flag((payee != "") & unseen("payee")),
        "is_foreign": flag(~F.col("country").eqNullSafe(home)),
        "dist_from_last_km": dist,
        "speed_kmh": speed,
        "impossible_travel": flag(
            (speed > s.travel_kmh) & (dist > s.travel_min_km) & (secs < s.travel_max_gap_s)),
        "secs_since_last": secs,
        "txn_count_5m": dbl("c5"), "txn_count_1h": dbl("c1"), "txn_count_24h": dbl("c24"),
        "amt_sum_1h": dbl("s1"), "amt_sum_24h": dbl("s24"),
        "distinct_merchants_24h": dbl("dm"), "distinct_countries_24h": dbl("dc"),
        "failed_logins_1h": dbl("fl"), "logins_1h": dbl("lg"),
        "account_age_days": F.greatest(F.floor((t - opened) / (86400.0 * US)), F.lit(0)).cast("double"),
        "high_risk_mcc": flag(F.col("mcc").isin(*s.high_risk_mcc)),
        **{"channel_" + c: flag(F.col("channel") == c) for c in ("pos", "online", "atm", "transfer")},
        **_sequence(F.col("n"), F.col("vocab"), F.col("k_token"), F.col("tok"), F.col("recent")),
        "peak_5m": F.coalesce(dbl("peak_5m"), F.lit(0.0)),
        "peak_1h": F.coalesce(dbl("peak_1h"), F.lit(0.0)),
        "history_n": dbl("n"),
    }
    drop = [c for c in (*_RAW, "t", "acc", "tok", "txns_before", CHUNK, "first_txn", "first_home",
                        "_cuts", "ord", "p5", "p1", "home_country", "account_open")
            if c in raw.columns and c not in feats]
    return raw.withColumns(feats).drop(*drop)


def _with_home(e: DataFrame, customers: DataFrame | None) -> DataFrame:
    if customers is None:
        return e.withColumns({"home_country": F.lit(None).cast("string"), "account_open": F.lit(None).cast("timestamp")})
    return e.join(customers.select("cust_id", "home_country", "account_open"), "cust_id", "left")


def profile_features(
    events: DataFrame,
    customers: DataFrame | None = None,
    accepted: Column | None = None,
    settings: Settings = DEFAULT,
    early_logins: bool = True,
) -> DataFrame:
    """The transactions of ``events`` with PROFILE_COLUMNS and the velocity baseline added.

    ``accepted`` says which transactions a profile learns from (default: label 0).
    ``customers`` gives home_country and account_open; a customer without them starts at the
    first transaction.  ``early_logins=False`` forgets logins before a first transaction.
    """
    gate = (F.col("label") == 0) if accepted is None else accepted
    e = prepare(events, gate)
    grid = hot_keys(e.select("cust_id", "t"), ["cust_id"], "t", settings.hot_rows)
    # one exchange by customer: windows by (customer, merchant) and the like need only sorts behind it
    if grid is None:
        raw = _cold(_with_home(e.repartition("cust_id"), customers), early_logins)
    else:
        names = grid.select("cust_id")
        cold = _cold(_with_home(e.join(names, "cust_id", "left_anti").repartition("cust_id"), customers), early_logins)
        few = None if customers is None else customers.join(names, "cust_id", "left_semi")
        hot = _hot(_with_home(e.join(names, "cust_id", "left_semi"), few), grid, early_logins)
        shared = [c for c in cold.columns if c in hot.columns]
        raw = cold.select(shared).unionByName(hot.select(shared))
    return _finish(raw, settings)


__all__ = ["profile_features", "prepare", "PROFILE_COLUMNS", "BASELINE_COLUMNS"]
