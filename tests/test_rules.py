"""Ordered rules and their borders on hand-made rows."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tradeloom import params
from tradeloom.functions import dates, text
from tradeloom.operators import (
    cleaning, dealers, documents, features, forecast, kpis, models, panels, views,
)
from tradeloom.params import RfmThresholds, SalesCalendar

CAL = SalesCalendar()


def one(spark, values, expr):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


@pytest.mark.parametrize(
    "r, f, m, scores",
    [
        (30, 10, 1e9, (5, 5, 5)), (31, 9, 1e9 - 1, (4, 4, 4)), (60, 6, 3e8, (4, 4, 4)), (61, 5, 3e8 - 1, (3, 3, 3)),
        (90, 3, 1e8, (3, 3, 3)), (91, 2, 1e8 - 1, (2, 2, 2)), (180, 2, 3e7, (2, 2, 2)), (181, 1, 3e7 - 1, (1, 1, 1)),
        # published spot checks
        (0, 55, 9587.0e6, (5, 5, 5)), (5, 70, 4483.1e6, (5, 5, 5)), (371, 21, 1582.0e6, (1, 5, 5)),
        (61, 2, 1366.3e6, (3, 2, 5)), (22, 1, 60.8e6, (5, 1, 2)), (404, 1, 60.3e6, (1, 1, 2)), (389, 1, 1.5e6, (1, 1, 1)),
    ],
)
def test_rfm_scores(spark, r, f, m, scores):
    base = spark.createDataFrame([(r, f, float(m))], "recency_days int, frequency long, monetary double")
    row = dealers.rfm_scores(base, RfmThresholds()).first()
    assert (row["r_score"], row["f_score"], row["m_score"]) == scores


@pytest.mark.parametrize(
    "r, f, m, label",
    [
        (4, 4, 4, "Champions"), (5, 3, 3, "Loyal"), (3, 2, 4, "Big Spender"), (3, 2, 2, "Potential"), (4, 1, 3, "New"),
        (2, 3, 3, "At Risk"), (1, 2, 1, "Hibernating"), (1, 1, 2, "Hibernating"), (1, 1, 1, "Lost"), (3, 1, 3, "Lost"),
    ],
)
def test_segments(spark, r, f, m, label):
    df = spark.createDataFrame([(r, f, m)], "r int, f int, m int")
    assert df.select(dealers.segment_label(F.col("r"), F.col("f"), F.col("m"))).first()[0] == label


def test_bcg_borders(spark):
    rows = [
        ("new", 2026, 1, 100.0), ("flat", 2025, 1, 10000.0), ("flat", 2026, 1, 10004.0), ("small", 2025, 1, 10.0), ("small", 2026, 1, 20.0),
        ("big", 2025, 1, 20000.0), ("big", 2026, 2, 30000.0), ("none", 2025, 7, 5.0),
    ]
    fact = spark.createDataFrame(rows, "line_name string, fiscal_year int, fiscal_month int, line_total double").withColumns(
        {"group_code": F.lit("g"), "group_name": F.lit("g"), "quantity": F.lit(1), "line_total": F.col("line_total").cast("decimal(15,2)")}
    )
    got = {r["line_name"]: (r["growth_pct_yoy"], r["bcg_category"]) for r in views.bcg_matrix(fact, CAL).collect()}
    # growth of 0.04 % rounds to 0.0, so the line is no star
    assert got["flat"] == (0.0, "Cash Cows")
    assert got["new"] == (None, "New Launch")
    assert got["big"] == (50.0, "Stars")
    assert got["small"] == (100.0, "Question Marks")
    assert got["none"] == (None, "Dogs")


SERIES = [("s", p, float(q)) for p, q in [(1, 10), (2, 20), (3, 30), (13, 40), (15, 60)]] + [("t", 15, 5.0)]


def test_lags_never_cross_a_gap(spark):
    df = spark.createDataFrame(SERIES, "product_code string, p int, q double")
    got = {
        (r["product_code"], r["p"]): (r["l1"], r["l2"])
        for r in df.select("product_code", "p", features.safe_lag("q", 1, "p").alias("l1"), features.safe_lag("q", 2, "p").alias("l2")).collect()
    }
    assert got[("s", 13)] == (None, None)
    assert got[("s", 3)] == (20.0, 10.0)
    assert got[("s", 15)] == (None, 40.0)
    assert got[("t", 15)] == (None, None)


def test_lag_and_rolling_mean_average_split_periods(spark):
    df = spark.createDataFrame([("s", 1, 10.0), ("s", 2, 10.0), ("s", 2, 50.0), ("s", 3, 0.0)], "product_code string, p int, q double")
    row = df.select("p", features.safe_lag("q", 1, "p").alias("l"), features.safe_rolling_mean("q", 2, "p").alias("m")).where("p = 3").first()
    assert (row["l"], row["m"]) == (30.0, 20.0)


def test_week_numbers_of_a_long_year(spark):
    df = spark.createDataFrame([(date(2026, 12, 28),), (date(2027, 1, 4),)], "d date")
    d = F.col("d")
    weeks = [r[0] for r in df.select(dates.year_week(d)).collect()]
    plain = [r[0] for r in df.select(dates.period_week(dates.iso_year(d), F.weekofyear(d), CAL)).collect()]
    running = [r[0] for r in df.select(dates.running_week(d, CAL)).collect()]
    assert weeks == ["2026-W53", "2027-W01"]
    assert plain[0] == plain[1]
    assert running[1] == running[0] + 1


def test_future_segments_cover_the_quarter():
    segments = features.future_segments(CAL)
    assert sum(s["days_in_segment"] for s in segments) == 91
    assert segments[0]["segment_start_date"] == date(2026, 4, 1) and segments[-1]["segment_end_date"] == date(2026, 6, 30)
    assert {s["fiscal_month"] for s in segments} == {4, 5, 6}
    assert sum(s["is_partial_week"] for s in segments) == 4  # Apr 1-5, Apr 27-30, May 1-3, Jun 29-30


def panel_rows(spark, rows):
    return spark.createDataFrame(
        rows, "product_code string, group_code_clean string, period_month int, total_quantity double, total_revenue double"
    ).withColumn("implied_price", F.col("total_revenue") / F.col("total_quantity"))


def test_price_cascade_has_one_level_each(spark):
    meta = spark.createDataFrame([("a", "g"), ("b", "x"), ("c", "g"), ("d", "x"), ("e", "z"), ("late", "y")], "product_code string, group_code_clean string")
    prices = spark.createDataFrame(
        [("a", 7.0, date(2026, 3, 31), 1, 1), ("a", 6.0, date(2026, 3, 1), 2, 1), ("late", 9.0, date(2026, 4, 1), 3, 1)],
        "product_code string, unit_price double, effective_from date, order_id long, line_id int",
    ).withColumn("unit_price", F.col("unit_price").cast("decimal(15,2)"))
    panel = panel_rows(spark, [("b", "x", 15, 2.0, 10.0), ("x1", "x", 15, 1.0, 2.0)])
    got = {r["product_code"]: (r["asp_used"], r["asp_source"][0]) for r in forecast.asp_cascade(meta, prices, panel, date(2026, 3, 31), 15).collect()}
    assert got == {"a": (7.0, "a"), "b": (5.0, "b"), "c": (7.0, "c"), "d": (4.0, "d"), "e": (4.0, "e"), "late": (4.0, "e")}


def test_slow_movers(spark):
    meta = spark.createDataFrame(
        [(c, "g", "x", "x") for c in ("never", "red", "amber", "decl", "ok", "march")],
        "product_code string, group_code_clean string, base_color string, color string",
    )
    rows = [("red", "g", 1, 5.0, 1.0), ("amber", "g", 13, 10.0, 1.0), ("decl", "g", 1, 100.0, 1.0), ("decl", "g", 13, 50.0, 1.0),
            ("ok", "g", 1, 100.0, 1.0), ("ok", "g", 13, 51.0, 1.0), ("march", "g", 15, 3.0, 1.0)]
    got = {r["product_code"]: r["slow_moving_flag"] for r in forecast.slow_moving_flags(panel_rows(spark, rows), meta, CAL).collect()}
    assert got == {"never": "new_or_uncertain", "march": "new_or_uncertain", "red": "red_no_demand", "amber": "amber_slow_moving",
                   "decl": "declining_activity", "ok": "healthy"}


def test_forecast_adds_up_to_the_scenario(spark):
    meta = spark.createDataFrame([("a", "g", "A", 1, "x"), ("b", "g", "B", 1, "x"), ("c", "h", "C", 2, "y"), ("n", "h", "N", 2, "y")],
                                 "product_code string, group_code_clean string, product_name string, line_id_clean int, base_color string")
    panel = panel_rows(spark, [("a", "g", 13, 6.0, 60.0), ("b", "g", 14, 2.0, 10.0), ("c", "h", 15, 2.0, 8.0)])
    asp = spark.createDataFrame([(c, 2.0, "a", date(2026, 3, 31)) for c in "abcn"], "product_code string, asp_used double, asp_source string, asp_cutoff_date date")
    out = forecast.group_share_forecast(panel, meta, asp, params.Scenarios().totals, CAL)
    summary = {r["scenario"]: (r["total_quantity"], r["total_revenue"]) for r in forecast.scenario_summary(out).collect()}
    assert summary["Base"] == (pytest.approx(37596.0), pytest.approx(75192.0))
    assert out.where("product_code = 'n'").agg(F.sum("predicted_quantity")).first()[0] == 0.0
    delta = {r["scenario"]: r["delta_quantity"] for r in forecast.scenario_delta(forecast.scenario_summary(out)).collect()}
    assert delta["Aggressive"] == pytest.approx(42953 - 37596)
    checks = forecast.reconcile_totals(
        out.withColumn("model_scenario", F.col("scenario")), spark.createDataFrame([("Base", 37596.0), ("Aggressive", 1.0)], "model_scenario string, expected double")
    )
    assert {r["model_scenario"]: r["status"] for r in checks.collect()} == {"Base": "PASS", "Aggressive": "FAIL"}
    with pytest.raises(ValueError):
        forecast.require_pass(checks)


def test_money_and_quantity_text(spark):
    values = ["1.234.567", "1,234", "12,5", "1,234.5", "", None, "abc", "1.2.3"]
    assert one(spark, values, text.clean_money) == [Decimal(x) for x in (1234567, 1234, 125, 12345, 0, 0, 0, 123)]
    got = [float(x) for x in one(spark, values, text.clean_quantity)]
    assert got == [0.0, 1.234, 12.5, 1234.5, 0.0, 0.0, 0.0, 0.0]


def test_mail_fields(spark):
    body = "MÃ SỐ THUẾ： 0123456789\nđại lý: Cửa hàng A \nNGÀY 05/03/2026\nSĐT: 09 12-34\nTổng tiền 1.000 đồng, trị giá 2.500.000 VND"
    df = spark.createDataFrame([(1, body), (2, "không có gì")], "id int, body string")
    a, b = documents.extract_fields(df).orderBy("id").collect()
    assert (a["tax_code"], a["customer_name"], a["order_date_text"], a["phone"], a["address"]) == ("0123456789", "Cửa hàng A", "05/03/2026", "09 12-34", None)
    assert a["email_total"] == 2500000 and b["email_total"] == 0 and b["tax_code"] is None


def test_invoice_lines_need_positive_numbers(spark):
    rows = [("TP0099.0000570", "2", "10", "20"), ("short", "2", "10", "20"), ("TP0099.0000571", "0", "10", "20"), ("TP0099.0000572", "1", "x", "20")]
    df = spark.createDataFrame(rows, "product_code string, quantity string, unit_price string, line_total string")
    assert [r["product_code"] for r in documents.invoice_lines(df).collect()] == ["TP0099.0000570"]


def test_colors(spark):
    assert one(spark, ["café/nâu", "ĐEN", "đen/hồng", None], text.title_case) == ["Café/Nâu", "Đen", "Đen/Hồng", None]
    named = one(spark, ["Coban", "Café/Nâu", "lạ", None, ""], lambda c: text.base_color(c, unknown=params.UNKNOWN_LABEL))
    assert named == ["Xanh Dương", "Nâu", "lạ", params.UNKNOWN_LABEL, params.UNKNOWN_LABEL]
    from_name = one(spark, ["Xe xanh đen", "Xe do", "Xe màu tím", "Xe", None], lambda c: text.color_from_name(c, F.lit(None)))
    assert from_name == ["Xanh", "Đỏ", "Tím", params.UNKNOWN_LABEL, params.UNKNOWN_LABEL]


def test_line_rules(spark):
    rows = [("Xe Super 26 đen", None), ("Xe Super 26 S đen", None), ("Xe grx at 27.5 - 2.0", None), ("Xe Nam 2", None), ("Superman nam", None), ("Xe New 26", 9)]
    products = spark.createDataFrame(rows, "product_name string, line_id int")
    lines = spark.createDataFrame([(1, "Xe Super 26"), (2, "Xe GRX AT 27,5_2.0"), (3, "Xe Nam"), (4, "Xe New 26")], "line_id int, line_name string")
    got = {r["product_name"]: r["line_id"] for r in cleaning.rule_assign_line(products, lines).collect()}
    assert got == {"Xe Super 26 đen": 1, "Xe Super 26 S đen": None, "Xe grx at 27.5 - 2.0": 2, "Xe Nam 2": 3, "Superman nam": None, "Xe New 26": 9}


def test_unique_containment(spark):
    lines = spark.createDataFrame([(1, "new26"), (2, "new24"), (3, "neo"), (4, "neo")], "line_id int, line_key string")
    names = spark.createDataFrame([("new26den",), ("new",), ("neo2003",), ("",), ("xyz",), ("new26new24",)], "product_key string")
    got = {r["product_key"]: r["line_id"] for r in cleaning.join_contains_unique(names, lines).collect()}
    assert got == {"new26den": 1, "new": None, "neo2003": 4, "": None, "xyz": None, "new26new24": None}


def test_address_match_takes_the_last_name(spark):
    provinces = spark.createDataFrame([(1, "Hà Nam"), (2, "Hải Phòng"), (3, "Hà Nội"), (4, "Hà Nội"), (5, "Nam")], "province_id int, province_name_clean string")
    people = spark.createDataFrame(
        [("a", None, "Xã Hà Nam, TP HẢI PHÒNG"), ("b", None, "Hà Nội"), ("c", None, "nowhere"), ("d", 9, "Hà Nội"), ("e", None, None), ("f", None, "ở Hà Nam")],
        "customer_code string, province_id int, address string",
    )
    got = {r["customer_code"]: r["province_id"] for r in cleaning.join_address_to_province(people, provinces).collect()}
    assert got == {"a": 2, "b": 3, "f": 5}


def test_new_customers_are_numbered_after_the_last(spark):
    known = spark.createDataFrame([("KH-00007", " 111 "), ("X", None)], "customer_code string, tax_code string")
    buyers = spark.createDataFrame([("111", "a", "p"), ("222", "b", "q"), ("222", "c", "r"), ("  ", "d", "s"), (None, "e", "t"), ("333", None, None)],
                                   "tax_code string, customer_name string, address string")
    got = cleaning.upsert_customers(known, buyers).collect()
    assert sorted(r["customer_code"] for r in got) == ["KH-00008", "KH-00009"]
    assert {r["tax_code"]: r["customer_name"] for r in got} == {"222": "b", "333": "Khách hàng 333"}


def test_sync_takes_nulls_of_matched_rows(spark):
    fact = spark.createDataFrame([("a", "old"), ("b", "old")], "k string, v string")
    dim = spark.createDataFrame([("a", None)], "k string, v string")
    assert {r["k"]: r["v"] for r in cleaning.sync_from_dimension(fact, dim, "k", ["v"]).collect()} == {"a": None, "b": "old"}


def test_routes(spark):
    asked = ["Dự báo tháng sau", "thống kê và dự báo", "doanh thu", "sẽ bán bao nhiêu"]
    assert one(spark, asked, text.question_route) == ["forecast", "history", "history", "forecast"]


def test_date_cascade(spark):
    rows = [("05/03/2026", None, "x", None), ("31/02/2026", "06/03/2026", "x", None), (None, None, "đơn 07/03/2026", None), (None, "", "x", date(2026, 3, 8))]
    df = spark.createDataFrame(rows, "a string, b string, c string, d date")
    got = [r[0] for r in df.select(text.order_date_cascade(*[F.col(c) for c in "abcd"])).collect()]
    assert got == [date(2026, 3, d) for d in (5, 6, 7, 8)]


def test_metadata_names_the_mapping_source(spark):
    products = spark.createDataFrame([("a", 1), ("b", None), ("c", 9)], "product_code string, line_id_fk int").withColumns(
        {c: F.lit("x") for c in ("product_name", "color", "base_color")}
    )
    lines = spark.createDataFrame([(1, "L", "G")], "line_id int, line_name string, group_code string")
    groups = spark.createDataFrame([("G", "Group")], "group_code string, group_name string")
    fact = spark.createDataFrame([("a", date(2026, 3, 2)), ("c", date(2026, 2, 1)), ("c", date(2026, 3, 1))], "product_code string, order_date date")
    got = {r["product_code"]: (r["mapping_source"], r["group_name_clean"], r["is_cold_start_march_sku"])
           for r in panels.product_metadata(products, lines, groups, fact, date(2026, 3, 1)).collect()}
    assert got == {"a": ("dimension_join", "Group", True), "b": ("original_null", "UNKNOWN", False), "c": ("join_failed", "UNKNOWN", False)}


@pytest.mark.parametrize("part_size", [30, 10_000])
def test_nested_orders_are_one_row_each(spark, part_size):
    rows = [("big", i, f"p{i}", 1) for i in range(100)] + [("small", 1, "p", 1), ("small", 1, "p", 1), (None, 1, "p", 1)]
    df = spark.createDataFrame(rows, "so_number string, line_id int, product_code string, quantity int").withColumn("customer", F.lit("c"))
    out = documents.nest_orders(df.repartition(5), ["customer"], ["product_code", "quantity"], ["line_id"], part_size=part_size).collect()
    got = {r["so_number"]: [(x["line_id"], x["product_code"]) for x in r["lines"]] for r in out}
    assert len(out) == 2 and got == {"big": [(i, f"p{i}") for i in range(100)], "small": [(1, "p"), (1, "p")]}


def test_price_changes_match_a_plain_scan(spark):
    import random

    rng = random.Random(1)
    rows = [("s" if i % 3 else "hot", date(2026, 1, rng.randint(1, 9)), i, 1, Decimal(rng.choice([1, 2]))) for i in range(200)]
    df = spark.createDataFrame(rows, "product_code string, effective_from date, order_id long, line_id int, unit_price decimal(15,2)")
    want = set()
    for sku in ("s", "hot"):
        last = None
        for r in sorted((r for r in rows if r[0] == sku), key=lambda r: r[1:]):
            if last is None or last != r[4]:
                want.add(r[2])
            last = r[4]
    assert {r["order_id"] for r in kpis.price_change_log(df).collect()} == want


def test_snapshot_ignores_later_rows(spark):
    schema = "customer_code string, order_date date, order_id long, product_code string, group_code string, quantity int, line_total int"
    early = [("a", date(2025, 1, 10), 1, "p", "g", 2, 20), ("a", date(2025, 1, 31), 2, "q", None, 1, 5), ("b", date(2025, 2, 20), 3, "p", "g", 1, 9)]
    late = [("a", date(2026, 5, 20), 9, "z", "h", 7, 70)]

    def rows(data):
        df = spark.createDataFrame(data, schema).withColumns({c: F.col(c).cast("decimal(15,2)") for c in ("quantity", "line_total")})
        return {(r["customer_code"], r["snapshot_date"]): r.asDict() for r in dealers.snapshot_features(df, CAL, RfmThresholds()).collect()}

    assert rows(early) == rows(early + late)
    first = rows(early)[("a", date(2025, 1, 31))]
    assert (first["recency_days"], first["frequency"], first["n_groups_bought"], first["monetary"], first["is_new_dealer"]) == (0, 2, 1, 25.0, 1)
    assert ("b", date(2025, 1, 31)) not in rows(early) and rows(early)[("a", date(2025, 1, 31))]["target_active_next_30d"] == 0


def test_actions_and_risk(spark):
    columns = "rfm_segment string, churn_risk_score double, value_score double, purchase_trend_score double, p_order_next_30d double, marketing_priority_score double"
    rows = [("Loyal", 0.39, 0.1, 90.0, 0.61, 10.0), ("Lost", 0.7, 0.7, 90.0, 0.3, 10.0), ("Lost", 0.5, 0.5, 39.9, 0.5, 80.0), ("New", 0.3, 0.5, 60.0, 0.65, 10.0), ("Other", 0.5, 0.2, 50.0, 0.5, 10.0)]
    df = spark.createDataFrame(rows, columns).select(dealers.recommended_action().alias("a"), dealers.risk_segment().alias("r"))
    got = [(r["a"].split(":")[0], r["r"]) for r in df.collect()]
    assert got == [("Protect & upsell", "Monitor"), ("Urgent win-back", "Win-back priority"), ("Decline intervention", "High priority"),
                   ("Restock reminder", "Growth opportunity"), ("Monitor", "Monitor")]


def test_feature_lists(spark):
    assert [len(params.FEATURE_SETS[n]) for n in ("monthly_minimal_features", "monthly_extended_features", "weekly_minimal_features", "weekly_extended_features")] == [9, 21, 11, 15]
    assert features.feature_registry(spark).count() == 16


def test_alignment(spark):
    future = spark.createDataFrame([(1, 2)], "last_known_qty_1 int, last_known_qty_2 int").withColumn("qty_lag_2", F.lit(5))
    aligned = features.align_columns(future)
    assert "qty_lag_1" in aligned.columns and "last_known_qty_2" in aligned.columns
    train = spark.createDataFrame([(1, 2, 3)], "qty_lag_1 int, qty_lag_2 int, total_quantity int")
    assert features.usable_features(train, aligned, ["qty_lag_1", "total_quantity"]) == ["qty_lag_1"]
    with pytest.raises(ValueError):
        features.usable_features(train, aligned, ["absent"])


def test_schema_checks(spark):
    from tradeloom.operators import audit

    df = spark.createDataFrame([(1, 2)], "a int, total_quantity int")
    got = {r["check"]: r["status"] for r in audit.column_presence(df, ["a", "b"], spark).collect()}
    assert got == {"a": "PASS", "b": "FAIL"}
    sets = audit.feature_set_check(spark, df, df.drop("a"), {"s": ["a", "total_quantity"]}).first()
    assert (sets["status"], sets["missing_in_future"], sets["leakage"]) == ("FAIL", "a", "total_quantity")
    snap = documents.schema_snapshot(spark, {"t": df})
    assert [(r["table_name"], r["column_name"], r["data_type"]) for r in snap.collect()] == [("t", "a", "int"), ("t", "total_quantity", "int")]


def test_metrics(spark):
    rows = spark.createDataFrame([("m", 10.0, 8.0), ("m", 0.0, 0.0), ("z", 0.0, 1.0)], "model string, total_quantity double, predicted double")
    got = {r["model"]: r for r in forecast.forecast_metrics(rows).collect()}
    assert got["m"]["wmape"] == pytest.approx(0.2) and got["m"]["smape"] == pytest.approx((2 / 9) / 2) and got["m"]["mae"] == 1.0
    assert got["z"]["wmape"] is None and got["z"]["bias_ratio"] is None


def test_models_learn_and_stay_positive(spark):
    rows = [("c%d" % (i % 3), 2025 if i < 60 else 2026, 1 + i % 3, float(i % 7) if i % 5 else None, float((i % 7) * 10)) for i in range(90)]
    df = spark.createDataFrame(rows, "base_color string, fiscal_year int, fiscal_month int, qty_lag_1 double, total_quantity double")
    names = ["base_color", "fiscal_month", "qty_lag_1"]
    train, validation = models.temporal_split(df, CAL)
    assert train.count() + validation.count() == 90
    fitted = models.train_regressors(train, {"tiny": names}, {"GBT": models.regressors(3, 3)["GBT"]})
    scored = models.predict_all(fitted, validation.withColumn("base_color", F.lit("unseen")))
    assert scored.where("predicted < 0 or predicted is null").count() == 0
    importance = {r["feature"]: r["importance"] for r in models.feature_importance(fitted, df).collect()}
    assert set(importance) == set(names) and sum(importance.values()) == pytest.approx(1.0)
    assert max(importance, key=importance.get) == "qty_lag_1"


def test_csv_with_byte_order_mark_and_line_breaks(spark, tmp_path):
    from tradeloom.sources import readers

    (tmp_path / "province.csv").write_text('﻿province_id,province_name,region\n007,"Hưng\nYên",Bắc\n', encoding="utf-8")
    row = readers.scan_table_csv(spark, str(tmp_path), "province").first()
    assert tuple(row) == ("007", "Hưng\nYên", "Bắc")


def test_substring_joins_with_short_names_and_long_addresses(spark):
    from tradeloom.operators import cleaning

    names = spark.createDataFrame([("a",), ("abc",), ("zz",), ("q",), ("",), ("lamp x",), (None,)], "product_key string")
    lines = spark.createDataFrame([(1, "abc"), (2, "lamp"), (3, "table"), (4, "q")], "line_id int, line_key string")
    got = {r["product_key"]: r["line_id"] for r in cleaning.join_contains_unique(names, lines).collect()}
    assert got == {"a": None, "abc": 1, "zz": None, "q": 4, "": None, "lamp x": 2}

    long_address = "x" * 10_000 + " Hue " + "y" * 20
    customers = [("c1", None, long_address), ("c2", None, "Hanoi, then Hue"), ("c3", 7, "Hue"), ("c4", None, None), ("c5", None, "zz"), ("c6", None, "q")]
    provinces = [(1, "Hue"), (2, "Hanoi"), (3, "q")]
    found = cleaning.join_address_to_province(
        spark.createDataFrame(customers, "customer_code string, province_id int, address string"),
        spark.createDataFrame(provinces, "province_id int, province_name_clean string"),
    )
    assert {r["customer_code"]: r["province_id"] for r in found.collect()} == {"c1": 1, "c2": 1, "c6": 3}


def test_lines_keep_their_population(spark, tmp_path):
    """Lines of unknown orders, customers or products stay, whatever columns are asked for; quantity 0 has no price."""
    from tradeloom.sources.star import StarTables

    source = "/root/testdata/sf0.001"
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        df = spark.read.parquet(f"{source}/{name}.parquet")
        if name == "lineitem":
            odd = df.limit(3).selectExpr(*[
                f"cast({dict(l_orderkey=-5, l_partkey=-6, l_quantity=0).get(c, c)} as {k}) as {c}" for c, k in df.dtypes
            ])
            df = df.unionByName(odd)
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    t = StarTables(spark, str(tmp_path))
    n = spark.read.parquet(f"{tmp_path}/lineitem.parquet").count()
    for columns in (("quantity",), ("order_date", "quantity"), ("customer_name",), ("region", "product_name", "unit_price")):
        assert t.fact(*columns).count() == n
    assert t.lines().where("quantity = 0 and unit_price is null").count() == 3


def test_slow_moving_texts_follow_the_calendar():
    from tradeloom import params

    cal = params.SalesCalendar()
    assert (cal.quarter, cal.year_a, cal.year_b, cal.as_of.strftime("%b%y")) == (1, 2025, 2026, "Mar26")


def test_top_bins_are_open_and_shares_count_every_row(spark):
    from tradeloom.operators import stats

    df = spark.createDataFrame([(1,), (3,), (20_000,), (None,)], "v int")
    got = {r["bin"]: r for r in stats.closed_bins(df, "v", [(1, 2), (3, None)]).collect()}
    assert (got[0]["n"], got[1]["n"]) == (1, 2) and (got[0]["share_pct"], got[1]["cumulative_pct"]) == (25.0, 75.0)


def test_substring_joins_match_brute_force(spark):
    """Keys of every length, letters of two and four bytes, names of 10 000 characters, a gram that all texts hold."""
    import random

    from tradeloom.operators import cleaning

    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abé😀") for _ in range(n))
    texts = [word(rng.randint(0, 12)) for _ in range(150)] + [word(10_000), "abab" + word(10_000), "", "ab"]
    keys = [word(rng.randint(0, 7)) for _ in range(120)] + ["", "zz", "aa" * 4000, texts[150][2000:9000]]
    left = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    right = spark.createDataFrame([(k,) for k in keys] + [(None,)], "k string")
    want = {(t, k) for t in texts for k in keys if k and k in t}
    got = [tuple(r) for r in cleaning.contained_keys(left, right, "t", "k").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300
    assert cleaning.contained_keys(left, right.limit(0), "t", "k").collect() == []

    lines = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "line_id int, line_key string")
    found = {r["t"]: r["line_id"] for r in cleaning.join_contains_unique(left, lines, "t").collect()}
    last = {k: i for i, k in enumerate(keys)}
    for t in set(texts):
        hits = [i for k, i in last.items() if k in t or t in k]
        assert found[t] == (hits[0] if len(hits) == 1 else None)


def test_substring_join_plan_cuts_texts_once(spark):
    """A gram row has a hash of its text; the texts themselves are exchanged for the candidates only."""
    from tradeloom.operators import cleaning

    texts = spark.createDataFrame([("some long text",)], "t string")
    plan = cleaning.contained_keys(texts, spark.createDataFrame([("long",)], "k string"), "t", "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "__gram" in plan
