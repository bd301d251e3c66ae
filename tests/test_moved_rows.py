"""What shuffles, windows and filters carry: values are worked out once, and after the joins."""

import json
from decimal import Decimal

from pyspark.sql import functions as F

from tradeloom.operators import documents
from tradeloom.sources import splits
from tradeloom.sources.star import FACT_COLUMNS, StarTables


def nodes(df):
    """Nodes of the optimized plan."""

    def walk(node):
        yield node
        children = node.children()
        for i in range(children.size()):
            yield from walk(children.apply(i))

    return list(walk(df._jdf.queryExecution().optimizedPlan()))


def test_invoice_lines_are_cleaned_once(spark):
    rows = [(1, " TP0099.0000012 ", "3 cái", "12.000 đ", "36000"), (2, "short", "1", "1", "1"), (3, "AB00012", "2,5", "7", "0"), (4, None, "1", "1", "1"), (5, "AB00012", "2,5", "7", "17")]
    df = spark.createDataFrame(rows, "doc_id long, product_code string, quantity string, unit_price string, line_total string").repartition(2)
    found = documents.invoice_lines(df)
    assert found.columns == df.columns
    assert sorted(tuple(r) for r in found.collect()) == [
        (1, "TP0099.0000012", Decimal(3), Decimal(12000), Decimal(36000)), (5, "AB00012", Decimal("2.5"), Decimal(7), Decimal(17)),
    ]
    assert not [n for n in nodes(found) if n.nodeName() == "Filter" and "regexp_replace" in n.condition().toString()]


def test_joins_of_the_fact_move_raw_columns(spark, folder):
    fact = StarTables(spark, folder).fact()
    assert fact.columns == FACT_COLUMNS
    joins = [n for n in nodes(fact) if n.nodeName() == "Join"]
    assert len(joins) >= 4
    moved = {part.split("#")[0] for n in joins for side in (n.left(), n.right()) for part in side.output().mkString(",").split(",")}
    assert "l_extendedprice" in moved
    assert not moved & (set(FACT_COLUMNS) - {"province_name", "region"})


def test_windows_over_json_pieces_carry_no_copies_of_the_text(spark, tmp_path):
    orders = [{"so": f'a"}}{{{i}\\', "lines": [{"n": str(i)}, {"n": "}"}]} for i in range(50)]
    for at in range(2):
        (tmp_path / f"{at}.json").write_text(json.dumps({"note": '{"', "ready_orders": orders[at::2], "other": [{"x": "1"}]}))
    found = splits.json_elements(spark, str(tmp_path))
    texts = [r["text"] for r in found.where(F.col("field") == "ready_orders").collect()]
    assert sorted(texts) == sorted(json.dumps(o) for o in orders)
    carried = [n.output().mkString(",") for n in nodes(found) if n.nodeName() == "Window"]
    assert carried and not [c for c in carried if "full#" in c or "header#" in c]
