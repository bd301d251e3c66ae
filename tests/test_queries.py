"""Every registered query against its SQL twin, and properties of the plans."""

import pytest

import __spark_entry__ as entry
from tests.harness import compare

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()

#: On the smallest tables these may be empty.
MAY_BE_EMPTY = {"duplicate_lines", "dirty_values", "precision_recall_at_k", "metrics_by_rfm_segment", "top_k_filtered"}
#: Trained models differ by engine; they are run, not compared.
TRAINED = sorted(n for n in set(QUERIES) - set(ORACLES) if n != "pipeline" and not n.startswith("op"))


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if not n.startswith("op")))
def test_matches_sql(spark, folder, name):
    difference = compare(spark, folder, name, QUERIES[name], ORACLES[name])
    assert difference is None or (difference == "empty result" and name in MAY_BE_EMPTY), difference


@pytest.mark.parametrize("name", TRAINED)
def test_runs(spark, folder, name):
    rows = QUERIES[name](spark, folder).collect()  # a count would let the optimizer drop the predictions
    assert rows and all(v is not None for r in rows for c, v in r.asDict().items() if c.startswith(("predicted", "p_order")))


def test_entry(spark):
    df = entry.entry(spark)
    assert "rfm_segment" in df.columns and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize(
    "name",
    ["bcg_matrix", "volume_segment", "join_contains_unique", "join_address_to_province", "group_share_forecast",
     "snapshot_features", "zero_sales_sku_share", "decile_calibration", "ntile_reference", "monthly_panel"],
)
def test_plan_has_no_cross_product_or_python(spark, folder, name):
    plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas"):
        assert node not in plan
