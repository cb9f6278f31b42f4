import random
import re

import pytest
from pyspark.sql import functions as F

from frisk.config import DEFAULT, ENTITY_COLUMNS
from frisk.operators.entity import entity_features, entity_rows, entity_state, hot_entities, outcome_rows
from tests.rows import by_seq, close, frame, random_rows

CUT = DEFAULT.with_(hot_rows=25)


def rows_of(spark, customers):
    rng, rows = random.Random(6), [r for r in random_rows(n=260, customers=customers, seed=9, span=9 * 86400) if r["type"] == "txn"]
    for r in rows:
        if rng.random() < 0.1:
            r["cust_id" if rng.random() < 0.3 else "merchant_id"] = None
    return frame(spark, rows)


@pytest.mark.parametrize("customers", [60, 3])  # no customer has 25 rows; each of them has more
def test_cut_entities_have_the_statistics_of_whole_ones(spark, customers):
    txns = rows_of(spark, customers)
    most = txns.groupBy("cust_id").count().agg(F.max("count")).first()[0]
    assert (most <= 25) == (customers == 60)
    names = ["prior", *ENTITY_COLUMNS]
    close(by_seq(entity_features(txns, CUT), names), by_seq(entity_features(txns), names), names, 1e-9)


def test_a_customers_share_of_a_cut_entity_is_folded_without_carries(spark):
    txns = rows_of(spark, 60)
    hot, total = hot_entities(txns, CUT)
    st = entity_state(entity_rows(outcome_rows(txns, CUT)), CUT, hot, total, True)
    plan = st._jdf.queryExecution().executedPlan().toString()
    by = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    assert any("_chunk" in x for x in by) and not any("_chunk" in x and "cust_id" in x for x in by)
