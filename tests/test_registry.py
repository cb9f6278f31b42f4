import importlib

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import TABLES, rows_of

from tests.conftest import SF

SAMPLE = ["rules_only_mix", "entity_connections", "policy_comparison", "cost_threshold", "calibration_table", "psi_second_half", "feedback_merge",
          "feedback_near_join", "queue_state", "sweep_flips", "feature_probes", "source_paysim", "upload_errors", "operating_points", "replay_page"]


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    cur = db.execute(entry.oracle_sql()[name])
    cols = [x[0] for x in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, cur.fetchall())


def test_every_statement_has_a_query(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 80
    assert entry.entry(spark).count() == 3


@pytest.mark.parametrize("name,module,operator", [("train_model", "frisk.ml.model", "train"), ("evaluation_report", "frisk.plans.evaluate", "report_tables")])
def test_query_runs_its_operator_with_all_rounds_and_resamples(spark, monkeypatch, name, module, operator):
    class Called(Exception):
        pass

    def called(*_, **given):
        raise Called(given)
    monkeypatch.setattr(importlib.import_module(module), operator, called)
    with pytest.raises(Called) as e:
        entry.queries()[name](spark, SF)
    assert not {"max_iter", "n_boot"} & set(e.value.args[0])


def test_hot_route_plan_has_no_single_task_over_the_rows(spark):
    """Only bucket totals may be gathered in one partition, never the transactions."""
    from frisk.operators.entity import outcome_rows, running_prior
    from frisk.plans.registry import _txns
    plan = running_prior(outcome_rows(_txns(spark, SF)))._jdf.queryExecution().executedPlan().toString()
    for i, line in enumerate(plan.splitlines()):
        if "SinglePartition" in line:
            assert "HashAggregate" in plan.splitlines()[i + 1]


def test_scan_reads_only_needed_columns(spark):
    df = entry.queries()["maturity_weights"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "PushedFilters: [In(event_type" in plan
