"""Shared-entity statistics: what is known about a merchant, card BIN, device or payee.

Each transaction observes up to four (kind, key) entities; a fraud outcome is a second row,
``label_delay_hours`` later.  Weights 2^((t - anchor) / half-life) turn exponential decay into
plain running sums, so every statistic is a fold over rows before this one.  The global prior
is one key over the whole table; it is always cut into time buckets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frisk.config import DEFAULT, ENTITY_COLUMNS, US, Settings
from frisk.functions.expr import flag
from frisk.operators.running import BROADCAST_KEYS, CHUNK, Fold, global_running, hot_keys_and_rows, running, with_chunks

# fixed values: entity kind -> transaction column
KINDS = {"merchant": "merchant_id", "bin": "card_bin", "device": "device_id", "beneficiary": "beneficiary"}
_TASK_ROWS = 200_000  # rows of entities one task sorts, about; an entity with more is cut, or a few merchants would be sorted whole in a few tasks
ANCHOR_US = 1_577_836_800 * US  # 2020-01-01; doubles hold the weight for 80 years either side


def weight(t: Column, s: Settings) -> Column:
    return F.pow(F.lit(2.0), (t - ANCHOR_US) / (86400.0 * US * s.half_life_days))


def entity_keys() -> Column:
    """(kind, key) pairs of a transaction; an absent payee gives none."""
    pairs = [
        F.struct(F.lit(kind).alias("kind"), F.coalesce(F.col(col), F.lit("" if kind == "beneficiary" else "?")).alias("key"))
        for kind, col in KINDS.items()
    ]
    return F.filter(F.array(*pairs), lambda p: ~((p["kind"] == "beneficiary") & (p["key"] == "")))


def outcome_rows(txns: DataFrame, s: Settings = DEFAULT, confirms: DataFrame | None = None) -> DataFrame:
    """One row per observation and per delivered fraud outcome, with the entity columns.

    ord 0 = outcome, 1 = observation: an outcome due exactly now is known to the row.
    ``confirms`` are extra outcomes (analyst feedback, failed step-up) with the columns of a
    transaction and the time they arrived in ``ts``.  A delay of 0 puts the outcome on the
    observation itself; a negative delay never delivers it.
    """
    t = F.unix_micros("ts")
    fraud = F.coalesce(F.col("label"), F.lit(0)) == 1
    instant = s.label_delay_hours == 0
    cols = ["seq", "cust_id", *KINDS.values()]

    def step(at: Column, ord_: int, obs: int, con: int, inst: Column) -> Column:
        return F.struct(at.alias("t"), F.lit(ord_).alias("ord"), F.lit(obs).alias("obs"),
                        F.lit(con).alias("con"), inst.cast("int").alias("inst"))

    steps = [step(t, 1, 1, 0, F.when(fraud, 1).otherwise(0) if instant else F.lit(0))]
    if s.label_delay_hours > 0:
        late = int(s.label_delay_hours * 3600) * US
        steps.append(F.when(fraud, step(t + late, 0, 0, 1, F.lit(0))))
    out = txns.select(*cols, F.explode(F.filter(F.array(*steps), lambda x: x.isNotNull())).alias("e")).select(*cols, "e.*")
    if confirms is not None:
        out = out.unionByName(confirms.select(*cols, step(t, 0, 0, 1, F.lit(0)).alias("e")).select(*cols, "e.*"))
    return out


def entity_rows(outcomes: DataFrame) -> DataFrame:
    """``outcome_rows`` spread over the entities each one touches."""
    return outcomes.select("seq", "cust_id", F.explode(entity_keys()).alias("p"), "t", "ord", "obs", "con", "inst").select(
        "seq", "cust_id", "p.*", "t", "ord", "obs", "con", "inst")


def entity_state(rows: DataFrame, s: Settings = DEFAULT, hot: DataFrame | None = None, total: int = 0, light: bool = False) -> DataFrame:
    """Running statistics of each (kind, key) strictly before each row of ``entity_rows``.

    Only rows of the entities in ``hot`` pay for chunks and carries, and where no customer has too many rows for a task (``light``) only for the
    statistics of the whole entity: a customer's own share of a cut entity is folded uncut, instead of with a carry for every chunk of every
    (entity, customer).  ``total`` (the transactions' rows) above ``_TASK_ROWS`` sets the number of
    tasks: left to the sizes of the shuffle, a task's rows would follow the input.
    """
    keys = ["kind", "key"]
    dealt = [max(math.ceil(total / _TASK_ROWS), rows.sparkSession.sparkContext.defaultParallelism)] if total > _TASK_ROWS else []
    if hot is None:
        return _entity_folds(rows.repartition(*dealt, *keys), s, False)
    cold = rows.join(hot.select(*keys), keys, "left_anti").repartition(*dealt, *keys)
    cut = with_chunks(rows, keys, "t", hot).filter(F.col(CHUNK).isNotNull())
    # chunks are cut at as many rows as make an entity hot, and a hot entity has more of them: that bounds their number
    if light and 2 * total / min(s.hot_rows, _TASK_ROWS) <= BROADCAST_KEYS:
        cut = _own_folds(cut.repartition(*dealt, *keys, "cust_id"), s, False)
    return _entity_folds(cold, s, False).unionByName(_entity_folds(cut.repartition(*dealt, *keys, CHUNK), s, True).drop(CHUNK))


def _entity_folds(r: DataFrame, s: Settings, chunked: bool) -> DataFrame:
    """Both levels of folds; rows that bring their customers' own folds along are those of few chunks."""
    if "own_lift" in r.columns:
        return _all_folds(r, chunked, few=True)
    # one shuffle serves both window levels: (kind, key, customer) and (kind, key)
    return _all_folds(_own_folds(r, s, chunked), chunked)


_ORDER = ["t", "ord", "seq"]


def _own_folds(r: DataFrame, s: Settings, chunked: bool) -> DataFrame:
    """What a customer alone did with an entity before each row."""
    order = _ORDER
    w = weight(F.col("t"), s)
    r = r.withColumns({"w_obs": w * F.col("obs"), "w_bad": w * (F.col("con") + F.col("inst"))})
    mine = ["kind", "key", "cust_id"]
    r = running(r, mine, order, [
        Fold("own_obs", "sum", F.col("w_obs")),
        Fold("own_bad", "sum", F.col("w_bad")),
        Fold("own_cnt", "sum", F.col("obs")),
    ], chunked)
    zero = F.lit(0.0)
    r = r.withColumns({"own_obs": F.coalesce("own_obs", zero), "own_bad": F.coalesce("own_bad", zero),
                       "own_cnt": F.coalesce("own_cnt", F.lit(0))})
    # an outcome lifts a customer's own count to at least their own fraud count; in weighted
    # units the lift is the largest excess of fraud over observations seen at an outcome
    excess = F.when(F.col("con") == 1, F.col("own_bad") + F.col("w_bad") - F.col("own_obs"))
    r = running(r, mine, order, [Fold("own_lift", "max", excess)], chunked)
    return r.withColumn("is_new_cust", F.when((F.col("obs") == 1) & (F.col("own_cnt") == 0), 1))


def _all_folds(r: DataFrame, chunked: bool, few: bool = False) -> DataFrame:
    """What all customers did with an entity before each row."""
    return running(r, ["kind", "key"], _ORDER, [
        Fold("w_n", "sum", F.col("w_obs")),
        Fold("w_f", "sum", F.col("w_bad")),
        Fold("first_t", "min", F.when(F.col("obs") == 1, F.col("t"))),
        Fold("touch_t", "max", F.col("t")),
        Fold("fanout", "sum", F.col("is_new_cust")),
    ], chunked, few)


def running_prior(outcomes: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(seq, prior): the global fraud share as known before each transaction."""
    s = settings
    rows = outcomes.select("seq", "t", "ord", "obs", (F.col("con") + F.col("inst")).alias("bad"))
    sums = global_running(rows, F.floor(F.col("t") / (s.prior_bucket_s * US)), [F.col("t"), F.col("ord"), F.col("seq")],
                          {"obs_n": F.col("obs"), "bad_n": F.col("bad")})
    before = lambda total, own: F.col(total) - F.col(own)
    return sums.filter(F.col("ord") == 1).select("seq", (
        (F.lit(s.prior_fraud) + before("bad_n", "bad")) / (F.lit(s.prior_count) + before("obs_n", "obs"))).alias("prior"))


def hot_entities(txns: DataFrame, s: Settings = DEFAULT) -> tuple[DataFrame | None, int]:
    pairs = txns.select(F.unix_micros("ts").alias("t"), F.explode(entity_keys()).alias("p")).select("t", "p.*")
    return hot_keys_and_rows(pairs, ["kind", "key"], "t", min(s.hot_rows, _TASK_ROWS))


def _light(txns: DataFrame, hot: DataFrame | None, s: Settings) -> bool:
    """Whether no customer has more transactions than a task's rows."""
    if hot is None:
        return False
    most = txns.groupBy("cust_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return most is not None and most <= min(s.hot_rows, _TASK_ROWS)


def smoothed(f: Column, n: Column, prior: Column, s: Settings) -> Column:
    return (f + prior * s.prior_strength) / (n + s.prior_strength)


def entity_features(txns: DataFrame, settings: Settings = DEFAULT, confirms: DataFrame | None = None,
                    only: DataFrame | None = None) -> DataFrame:
    """(seq, running prior, ENTITY_COLUMNS) of every transaction, one row per seq.

    ``only`` (a frame of transactions) limits the result to those and the work to their entities.
    """
    s = settings
    hot, total = hot_entities(txns, s)
    outcomes = outcome_rows(txns, s, confirms)
    rows = entity_rows(outcomes)
    if only is not None:
        touched = only.select(F.explode(entity_keys()).alias("p")).select("p.*").distinct()
        rows = rows.join(touched, ["kind", "key"], "left_semi")
    # confirms are outcomes of their own, so a customer's rows are not counted by transactions then
    st = entity_state(rows, s, hot, total, confirms is None and _light(txns, hot, s)).filter(F.col("ord") == 1)
    w = weight(F.col("t"), s)
    zero = F.lit(0.0)
    n, f = F.coalesce(F.col("w_n"), zero) / w, F.coalesce(F.col("w_f"), zero) / w
    own_n = (F.col("own_obs") + F.greatest(zero, F.coalesce(F.col("own_lift"), zero))) / w
    own_f = F.col("own_bad") / w
    n_others = F.greatest(n - own_n, zero)
    others_only = F.col("kind").isin("bin", "device")  # a customer's own fraud does not count against them here
    parts = st.select(
        "seq", "kind",
        F.when(others_only, n_others).otherwise(n).alias("n"),
        F.when(others_only, F.least(F.greatest(f - own_f, zero), n_others)).otherwise(f).alias("f"),
        (F.coalesce(F.col("w_n"), zero) / weight(F.col("touch_t"), s)).alias("touched"),
        ((F.col("t") - F.col("first_t")) / (86400.0 * US)).alias("age"),
        F.coalesce(F.col("fanout"), F.lit(0)).cast("double").alias("fanout"),
        flag(F.col("touch_t").isNotNull()).alias("known"),
    )
    # the prior rides along in the same regrouping instead of a join of its own
    prior = running_prior(outcomes, s)
    parts = parts.select("*", F.lit(None).cast("double").alias("prior")).unionByName(prior, allowMissingColumns=True)
    if only is not None:
        parts = parts.join(only.select("seq"), "seq", "left_semi")
    # plain double columns, so the regrouping is a hash aggregation without a sort
    fields = {"merchant": ("n", "f", "known", "touched", "age"), "bin": ("n", "f", "known"),
              "device": ("n", "f", "known", "fanout"), "beneficiary": ("n", "f", "known", "fanout", "touched")}
    wide = parts.groupBy("seq").agg(F.max("prior").alias("prior"), *[
        F.max(F.when(F.col("kind") == k, F.col(c))).alias(f"{k}_{c}") for k, names in fields.items() for c in names])
    p = F.col("prior")

    def rate(kind: str) -> Column:
        known = F.col(kind + "_known") == 1.0
        return F.when(known, smoothed(F.col(kind + "_f"), F.col(kind + "_n"), p, s)).otherwise(p)

    get = lambda name: F.coalesce(F.col(name), zero)
    wide = wide.select(
        "seq", "prior",
        rate("merchant").alias("merchant_fraud_rate"),
        get("merchant_touched").alias("merchant_txn_count"),
        get("merchant_age").alias("merchant_age_days"),
        rate("bin").alias("bin_fraud_rate"),
        rate("device").alias("device_fraud_rate"),
        get("device_fanout").alias("device_customer_fanout"),
        (1.0 - F.col("device_known")).alias("device_is_global_new"),
        rate("beneficiary").alias("beneficiary_fraud_rate"),
        get("beneficiary_fanout").alias("beneficiary_customer_fanin"),
        F.coalesce(1.0 - F.col("beneficiary_known"), zero).alias("beneficiary_is_global_new"),
        get("beneficiary_touched").alias("beneficiary_txn_count"),
    )
    return wide.select(
        "*",
        F.greatest("merchant_fraud_rate", "bin_fraud_rate", "device_fraud_rate", "beneficiary_fraud_rate").alias("entity_max_fraud_rate"),
        F.greatest("device_customer_fanout", "beneficiary_customer_fanin").alias("ring_size"),
    ).select("seq", "prior", *ENTITY_COLUMNS)


def entity_snapshot(txns: DataFrame, settings: Settings = DEFAULT, confirms: DataFrame | None = None,
                    prune: bool = True) -> DataFrame:
    """Statistics of every entity after the last row, decayed to its last touch.

    With ``prune``, entities idle for over ``prune_idle_days`` that carry under one decayed
    observation and no fraud are left out.  Pure aggregation: partial sums before the shuffle.
    """
    s = settings
    asof = txns.agg(F.max(F.unix_micros("ts")).alias("asof"))
    rows = entity_rows(outcome_rows(txns, s, confirms)).crossJoin(F.broadcast(asof))  # one row
    rows = rows.filter(F.col("t") <= F.col("asof"))
    w = weight(F.col("t"), s)
    per_cust = rows.groupBy("kind", "key", "cust_id").agg(
        F.sum(w * F.col("obs")).alias("w_n"), F.sum(w * (F.col("con") + F.col("inst"))).alias("w_f"),
        F.sum("obs").alias("obs_n"), F.min(F.when(F.col("obs") == 1, F.col("t"))).alias("first_t"),
        F.max("t").alias("touch_t"), F.max("asof").alias("asof"))
    snap = per_cust.groupBy("kind", "key").agg(
        F.sum("w_n").alias("w_n"), F.sum("w_f").alias("w_f"), F.sum("obs_n").alias("obs_n"),
        F.min("first_t").alias("first_t"), F.max("touch_t").alias("touch_t"),
        F.count(F.when(F.col("obs_n") > 0, 1)).alias("customers"), F.max("asof").alias("asof"))
    at = weight(F.col("touch_t"), s)
    snap = snap.select(
        "kind", "key", (F.col("w_n") / at).alias("n"), (F.col("w_f") / at).alias("f"), "obs_n", "customers",
        F.timestamp_micros("first_t").alias("first_ts"), F.timestamp_micros("touch_t").alias("last_ts"),
        ((F.col("asof") - F.col("touch_t")) / (86400.0 * US)).alias("idle_days"))
    if not prune:
        return snap
    stale = (F.col("idle_days") > s.prune_idle_days) & (F.col("n") < 1.0) & ~(F.col("f") > 0)
    return snap.filter(~stale)


