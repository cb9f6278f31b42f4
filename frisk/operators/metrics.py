"""Evaluation reports as aggregations.  Rates with no denominator are NULL, never 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frisk.config import ACTIONS, ADVERSARIAL, AGE_BRACKETS, DEFAULT, POLICIES, STOPPED, Settings
from frisk.functions.expr import ratio
from frisk.functions.keep import kept
from frisk.operators.running import bucket_by_cuts, global_running, score_cuts

CELLS = ("tp", "fp", "tn", "fn")


def stopped() -> Column:
    return F.col("action").isin(*STOPPED)


def blocked() -> Column:
    return F.col("action") == "BLOCK"


def confusion_aggs(label: Column, predicted: Column) -> list[Column]:
    pos = label == 1
    return [F.count_if(pos & predicted).alias("tp"), F.count_if(~pos & predicted).alias("fp"),
            F.count_if(~pos & ~predicted).alias("tn"), F.count_if(pos & ~predicted).alias("fn")]


def confusion(df: DataFrame, predicted: Column, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(*confusion_aggs(F.col("label"), predicted))


def rate_columns() -> dict[str, Column]:
    """Every classification rate as an expression over tp, fp, tn, fn."""
    tp, fp, tn, fn = (F.col(x).cast("double") for x in CELLS)
    precision, recall, spec = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tn, tn + fp)
    denom = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return {
        "precision": precision,
        "recall": recall,
        "specificity": spec,
        "false_positive_rate": ratio(fp, fp + tn),
        "false_negative_rate": ratio(fn, fn + tp),
        "f1": ratio(2 * precision * recall, precision + recall),
        "mcc": ratio(tp * tn - fp * fn, denom),
        "balanced_accuracy": (recall + spec) / 2,
        "accuracy": ratio(tp + tn, tp + fp + tn + fn),
    }


def with_rates(cm: DataFrame) -> DataFrame:
    return cm.withColumns(rate_columns())


def both_views(df: DataFrame) -> DataFrame:
    """Confusion and rates under both definitions of positive, in one pass over the cases."""
    views = F.array(F.struct(F.lit("stopped").alias("view"), stopped().alias("hit")),
                    F.struct(F.lit("block_only").alias("view"), blocked().alias("hit")))
    long = df.select("label", F.explode(views).alias("v")).select("label", "v.*")
    return with_rates(confusion(long, F.col("hit"), ["view"]))


def expected_cost(df: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Adds false alarms per caught fraud and the expected cost to a confusion table."""
    return df.withColumns({
        "false_alarms_per_fraud": ratio(F.col("fp"), F.col("tp")),
        "expected_cost": s.cost_fn * F.col("fn") + s.cost_fp * F.col("fp"),
    })


def live_counters(cases: DataFrame) -> DataFrame:
    """One row: volumes per action, fraud stopped and missed, false blocks, amount saved."""
    fraud = F.col("label") == 1
    agg = cases.agg(
        F.count(F.lit(1)).alias("processed"),
        *[F.count_if(F.col("action") == a).alias("n_" + a.lower()) for a in ACTIONS],
        F.count_if(fraud).alias("fraud_total"),
        F.count_if(fraud & stopped()).alias("fraud_stopped"),
        F.count_if(fraud & ~stopped()).alias("fraud_missed"),
        F.count_if(~fraud & blocked()).alias("false_positives"),
        F.round(F.coalesce(F.sum(F.when(fraud & stopped(), F.col("amount"))), F.lit(0.0)), 2).alias("amount_saved"),
    )
    return agg.withColumns({
        "detection_rate": F.coalesce(F.round(ratio(F.col("fraud_stopped"), F.col("fraud_total")), 4), F.lit(0.0)),
        "false_positive_rate": F.coalesce(
            F.round(ratio(F.col("false_positives"), F.col("processed") - F.col("fraud_total")), 5), F.lit(0.0)),
    })


def decision_mix(cases: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows per action; every action is present."""
    keys = by or []
    return cases.groupBy(*keys).agg(*[F.count_if(F.col("action") == a).alias("n_" + a.lower()) for a in ACTIONS])


def by_scenario(cases: DataFrame) -> DataFrame:
    """Per attack type: frauds, stopped, recall."""
    g = cases.filter(F.col("label") == 1).groupBy("scenario").agg(
        F.count(F.lit(1)).alias("fraud"), F.count_if(stopped()).alias("caught"))
    return g.withColumns({"recall": F.round(ratio(F.col("caught"), F.col("fraud")), 4),
                          "adversarial": F.col("scenario").isin(*ADVERSARIAL)})


def policy_comparison(cases: DataFrame) -> DataFrame:
    """What each shadow policy would have caught, and blocked wrongly."""
    long = cases.select("label", F.explode(F.array(*[
        F.struct(F.lit(p).alias("policy"), F.col(p).alias("act")) for p in POLICIES])).alias("x")).select("label", "x.*")
    fraud = F.col("label") == 1
    g = long.groupBy("policy").agg(
        F.count_if(fraud & F.col("act").isin(*STOPPED)).alias("caught"),
        F.count_if((F.col("label") == 0) & (F.col("act") == "BLOCK")).alias("fp"),
        F.count_if(fraud).alias("fraud_total"), F.count(F.lit(1)).alias("processed"))
    return g.select(
        "policy", "caught", "fp",
        F.coalesce(F.round(ratio(F.col("caught"), F.col("fraud_total")), 4), F.lit(0.0)).alias("detection_rate"),
        F.coalesce(F.round(ratio(F.col("fp"), F.col("processed") - F.col("fraud_total")), 5), F.lit(0.0)).alias("false_positive_rate"))


def _all_brackets(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    return spark.createDataFrame([(b,) for b, _, _ in AGE_BRACKETS], "age_bracket string")


def age_breakdown(cases: DataFrame) -> DataFrame:
    """Per age bracket: volumes, stops, amounts, rates; every bracket has a row."""
    fraud, stop = F.col("label") == 1, stopped()
    g = cases.groupBy("age_bracket").agg(
        F.count(F.lit(1)).alias("transactions"), F.count_if(fraud).alias("fraud"), F.count_if(~fraud).alias("legit"),
        F.count_if(stop).alias("stopped"), F.count_if(fraud & stop).alias("fraud_caught"),
        F.count_if(~fraud & stop).alias("legit_stopped"),
        F.round(F.sum("amount"), 2).alias("amount"),
        F.round(F.sum(F.when(stop, F.col("amount"))), 2).alias("amount_stopped"))
    full = F.broadcast(_all_brackets(cases)).join(g, "age_bracket", "left")  # four rows
    counts = ("transactions", "fraud", "legit", "stopped", "fraud_caught", "legit_stopped")
    full = full.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts}
                            | {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("amount", "amount_stopped")})
    return full.withColumns({
        "detection_rate": ratio(F.col("fraud_caught"), F.col("fraud")),
        "false_positive_rate": ratio(F.col("legit_stopped"), F.col("legit")),
        "fraud_rate": ratio(F.col("fraud"), F.col("transactions")),
        "avg_amount": F.round(ratio(F.col("amount"), F.col("transactions")), 2),
    })


def gap(df: DataFrame, rate: str, places: int, name: str) -> DataFrame:
    """Largest minus smallest defined rate; NULL with fewer than two."""
    enough = F.count(rate) >= 2
    return df.agg(F.when(enough, F.round(F.max(rate) - F.min(rate), places)).alias(name))


def fairness_by_age(cases: DataFrame) -> DataFrame:
    """Confusion and rates per age bracket, with the gaps over all brackets on each row."""
    cm = with_rates(confusion(cases, stopped(), ["age_bracket"]))
    w = Window.partitionBy(F.lit(1))  # at most five rows
    fpr = F.round(F.col("false_positive_rate"), 5)
    rec = F.round(F.col("recall"), 4)
    two = lambda c: F.count(c).over(w) >= 2
    return cm.select(
        "age_bracket", *CELLS, rec.alias("recall"), fpr.alias("false_positive_rate"),
        F.round("precision", 4).alias("precision"),
        F.when(two(fpr), F.round(F.max(fpr).over(w) - F.min(fpr).over(w), 5)).alias("fpr_gap"),
        F.when(two(rec), F.round(F.max(rec).over(w) - F.min(rec).over(w), 4)).alias("recall_gap"))


def money(cases: DataFrame) -> DataFrame:
    fraud = F.col("label") == 1
    g = cases.agg(F.coalesce(F.sum(F.when(fraud, F.col("amount"))), F.lit(0.0)).alias("f"),
                  F.coalesce(F.sum(F.when(fraud & stopped(), F.col("amount"))), F.lit(0.0)).alias("p"))
    return g.select(F.round("f", 2).alias("fraud_amount"), F.round("p", 2).alias("prevented"),
                    F.round(ratio(F.col("p"), F.col("f")), 4).alias("prevented_share"))


# --- ranking quality: ties are grouped, so the heavy work is one partial aggregation -------

def by_score(df: DataFrame, score: str, label: str = "label") -> DataFrame:
    return df.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))


def cumulative_by_score(df: DataFrame, score: str, s: Settings = DEFAULT) -> DataFrame:
    """Per distinct score, positives and negatives at or above it (``tp``, ``fp``).

    The grouped scores are read three times (cut points, bucket totals, sums), so they are kept.
    """
    g = kept(by_score(df, score))
    return cumulative(g, s)


def cumulative(g: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """``cumulative_by_score`` of an already grouped (score, pos, neg) table."""
    cuts = score_cuts(g, "score", s.score_buckets)
    down = -bucket_by_cuts(F.col("score"), cuts)
    return global_running(g, down, [F.col("score").desc()], {"tp": F.col("pos"), "fp": F.col("neg")})


def ranking_quality(df: DataFrame, score: str, s: Settings = DEFAULT) -> DataFrame:
    """Exact ROC-AUC (Mann-Whitney, ties half) and average precision (step form)."""
    c = cumulative_by_score(df, score, s)
    tp, fp, pos, neg = (F.col(x).cast("double") for x in ("tp", "fp", "pos", "neg"))
    # every negative at this score is beaten by the positives above it, and half of the ties
    wins = neg * (tp - pos + pos / 2)
    agg = c.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.sum(wins).alias("wins"),
                F.sum(pos * tp / (tp + fp)).alias("steps"))
    return agg.select(F.try_divide(F.col("wins"), F.col("p").cast("double") * F.col("n")).alias("roc_auc"),
                      F.when(F.col("n") > 0, F.try_divide(F.col("steps"), F.col("p").cast("double"))).alias("pr_auc"))


def calibration_table(df: DataFrame, proba: str = "fraud_proba", bins: int = 10) -> DataFrame:
    """Reliability table: bins with rows only; the last bin is closed."""
    edges = [i * (1 / bins) for i in range(bins)] + [1.0]  # as a float grid: 3 * 0.1, not 0.3
    p = F.col(proba)
    which = F.when((p >= edges[-2]) & (p <= 1.0), bins - 1)
    for i in range(bins - 2, -1, -1):
        which = which.when((p >= edges[i]) & (p < edges[i + 1]), i)
    g = df.select(which.alias("bin"), p.alias("p"), F.col("label").cast("double").alias("y")).filter("bin IS NOT NULL")
    g = g.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("conf"), F.avg("y").alias("acc"))
    edge = lambda k: F.element_at(F.array(*[F.lit(round(e, 2)) for e in edges]), k)
    return g.select((F.col("bin") + 1).alias("bin"), edge(F.col("bin") + 1).alias("lo"), edge(F.col("bin") + 2).alias("hi"),
                    "n", F.round("conf", 4).alias("predicted"), F.round("acc", 4).alias("observed"), "conf", "acc")


def calibration_error(df: DataFrame, proba: str = "fraud_proba", bins: int = 10) -> DataFrame:
    """Expected calibration error over the same bins, and the Brier score."""
    t = calibration_table(df, proba, bins).agg(
        F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))).alias("weighted"))
    b = df.agg(F.count(F.lit(1)).alias("rows"),
               F.avg(F.pow(F.col(proba) - F.col("label"), 2)).alias("brier"))
    return t.crossJoin(b).select(F.try_divide(F.col("weighted"), F.col("rows").cast("double")).alias("ece"), "brier")


def bootstrap_ci(df: DataFrame, predicted: Column, n_boot: int = 500, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """Percentile bootstrap intervals of five rates.

    Resampling the rows behind a confusion matrix only redraws its four cells, so a replicate
    is one multinomial draw: the cases are read once and never multiplied.
    """
    cm = confusion(df, predicted)  # one row
    reps = df.sparkSession.range(n_boot).withColumnRenamed("id", "rep").crossJoin(F.broadcast(cm))

    def redraw(batches):
        import numpy as np
        for pdf in batches:
            rows = []
            for rep, *cells in pdf[["rep", *CELLS]].itertuples(index=False):
                total = sum(cells)
                share = [c / total for c in cells] if total else [0.25] * 4
                rows.append(np.random.default_rng((seed, rep)).multinomial(total, share))
            pdf[list(CELLS)] = np.array(rows, dtype="int64").reshape(-1, len(CELLS))
            yield pdf

    drawn = reps.mapInPandas(redraw, "rep long, tp long, fp long, tn long, fn long")
    names = ("precision", "recall", "specificity", "f1", "false_positive_rate")
    long = with_rates(drawn).select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])).alias("x")).select("x.*")
    g = long.groupBy("metric").agg(
        F.count("value").alias("defined"), F.percentile("value", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("q"))
    ok = F.col("defined") >= n_boot * 0.5
    return g.select("metric", F.when(ok, F.col("q")[0]).alias("lo"), F.when(ok, F.col("q")[1]).alias("hi"))


# --- cohort audit -----------------------------------------------------------------------

def spend_tier(mean: Column) -> Column:
    return F.when(mean < 280, "low").when(mean < 530, "mid").otherwise("high")


def cohort_audit(cases: DataFrame, keys: tuple[str, ...] = ("country", "tier", "age_bracket", "channel")) -> DataFrame:
    """Detection and wrongful-block rate per slice of each key, flagged against the fairest slice."""
    fraud = F.col("label") == 1
    g = cases.select(*keys, "label", "action").groupingSets([[F.col(k)] for k in keys], *[F.col(k) for k in keys]).agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"), F.count_if(fraud).alias("fraud"),
        F.count_if(fraud & stopped()).alias("caught"), F.count_if(~fraud & blocked()).alias("wrong"))
    full = (1 << len(keys)) - 1
    dim, val = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, k in enumerate(keys):
        own = F.col("gid") == (full ^ (1 << (len(keys) - 1 - i)))
        dim = F.when(own, F.lit(k)).otherwise(dim)
        val = F.when(own, F.col(k)).otherwise(val)
    g = g.select(dim.alias("dimension"), val.alias("slice"), "n", "fraud",
                 ratio(F.col("caught"), F.col("fraud")).alias("detection"),
                 F.coalesce(ratio(F.col("wrong"), F.col("n") - F.col("fraud")), F.lit(0.0)).alias("fp_rate"))
    w = Window.partitionBy("dimension")
    best = F.coalesce(F.min(F.when(F.col("n") > 50, F.col("fp_rate"))).over(w), F.lit(0.0))
    times = F.when(best > 1e-9, F.col("fp_rate") / best).otherwise(1.0)
    return g.withColumn("disparate", (F.col("n") > 50) & (times > 1.25) & (F.col("fp_rate") > 0.002))
