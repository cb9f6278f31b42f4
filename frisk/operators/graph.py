"""Which other customers share a transaction's device, payee, card BIN or merchant."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frisk.config import DEFAULT, US, Settings
from frisk.operators.entity import KINDS, entity_rows, entity_snapshot, outcome_rows, smoothed, weight

_SALTS = 512  # parts a widely shared key is ranked in


def entity_edges(txns: DataFrame) -> DataFrame:
    """Distinct (cust_id, kind, key) links; unknown keys are no link."""
    rows = entity_rows(outcome_rows(txns, DEFAULT.with_(label_delay_hours=-1)))
    return rows.filter(~F.col("key").isin("?", "")).select("cust_id", "kind", "key").distinct()


def _first_customers(edges: DataFrame, keep: int) -> DataFrame:
    """Per (kind, key): customer count and the ``keep`` smallest customer ids.

    Ranked in two steps (within a salt, then overall) so a key shared by a third of all
    customers is neither sorted nor collected in one task.
    """
    keys = ["kind", "key"]
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("cust_id"), F.lit(_SALTS)))
    local = Window.partitionBy(*keys, "salt").orderBy("cust_id")
    part = salted.withColumn("r", F.row_number().over(local)).groupBy(*keys, "salt").agg(
        F.count(F.lit(1)).alias("n"), F.collect_list(F.when(F.col("r") <= keep, F.col("cust_id"))).alias("few"))
    return part.groupBy(*keys).agg(
        F.sum("n").alias("total_customers"),
        F.slice(F.array_sort(F.flatten(F.collect_list("few"))), 1, keep).alias("few"))


def connections(txns: DataFrame, focus: DataFrame, settings: Settings = DEFAULT, keep: int = 8) -> DataFrame:
    """Per focus transaction and shared key: up to ``keep`` other customers, total and fraud rate.

    One customer more than ``keep`` is held per key, so leaving the focus customer out still
    leaves the first ``keep`` others.
    """
    s = settings
    few = _first_customers(entity_edges(txns), keep + 1)
    snap = entity_snapshot(txns, s, prune=False)
    prior = txns.agg(F.count(F.lit(1)).alias("_n"), F.max(F.unix_micros("ts")).alias("_now"))
    late = int(max(s.label_delay_hours, 0) * 3600) * US
    known = txns.crossJoin(F.broadcast(prior)).agg(
        F.count_if((F.col("label") == 1) & (F.unix_micros("ts") + late <= F.col("_now"))).alias("_bad"),
        F.max("_n").alias("_n"), F.max("_now").alias("_now"))
    p = (s.prior_fraud + F.col("_bad")) / (s.prior_count + F.col("_n"))
    at = F.unix_micros("last_ts")
    k = weight(at, s) / weight(F.greatest(F.col("_now"), at), s)
    rate = snap.crossJoin(F.broadcast(known)).select(
        "kind", "key", F.round(smoothed(F.col("f") * k, F.col("n") * k, p, s), 4).alias("fraud_rate"))
    pairs = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(col).alias("key")) for kind, col in KINDS.items()])
    f = focus.select("seq", "cust_id", F.explode(pairs).alias("p")).select("seq", "cust_id", "p.*")
    f = f.filter(F.col("key").isNotNull() & ~F.col("key").isin("?", ""))
    out = f.join(few, ["kind", "key"]).join(rate, ["kind", "key"], "left")
    others = F.slice(F.filter(F.col("few"), lambda x: x != F.col("cust_id")), 1, keep)
    return out.withColumn("shared_with", others).filter(F.size("shared_with") > 0).select(
        "seq", "cust_id", "kind", "key", "fraud_rate", "shared_with", "total_customers")


def case_graph(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of each focus case, nodes de-duplicated."""
    entity = F.concat_ws(":", "kind", "key")
    none = F.lit(None)
    focus = links.select("seq", F.col("cust_id").alias("id"), F.lit("focus_customer").alias("kind"),
                         none.cast("double").alias("fraud_rate"), none.cast("long").alias("total_customers"))
    ents = links.select("seq", entity.alias("id"), F.concat(F.lit("entity_"), "kind").alias("kind"), "fraud_rate", "total_customers")
    other = links.select("seq", F.explode("shared_with").alias("id"), F.lit("linked_customer").alias("kind"),
                         none.cast("double").alias("fraud_rate"), none.cast("long").alias("total_customers"))
    nodes = focus.unionByName(ents).unionByName(other).dropDuplicates(["seq", "id"])
    edges = links.select("seq", F.col("cust_id").alias("source"), entity.alias("target"), "kind").unionByName(
        links.select("seq", F.explode("shared_with").alias("source"), entity.alias("target"), "kind"))
    return nodes, edges.dropDuplicates(["seq", "source", "target"])
