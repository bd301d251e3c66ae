"""Tree models: training, future scoring, comparison, importance, dealer classifier.

The registered runs take the operators' default rounds and trees, and every learner on every feature set.
A model is fitted once in an application for the files as they are; all queries share it.
"""

from threading import Lock

from pyspark.sql import functions as F

from tradeloom import params
from tradeloom.operators import dealers, features, forecast, models, stats
from tradeloom.plans.dealer_plans import snapshots
from tradeloom.plans.forecast_plans import (
    asp, build_weekly, future_monthly, metadata, monthly, monthly_features, monthly_sums, share_forecast,
)
from tradeloom.plans.registry import query
from tradeloom.sources.star import CALENDAR, StarTables

MONTHLY = {n: f for n, f in params.FEATURE_SETS.items() if n.startswith("monthly")}
KINDS = ("GBT", "OrderedGBT", "RandomForest", "DecisionTree")
WEEKLY = {n: f for n, f in params.FEATURE_SETS.items() if n.startswith("weekly")}


def feature_table(t: StarTables):
    return t.table("features", lambda: monthly_features(t))


def weekly_table(t: StarTables):
    return t.table("weekly_features", lambda: features.weekly_features(build_weekly(t, metadata(t)), metadata(t)))


#: Fitted models by application, files of the folder and name.
_FITTED: dict[tuple, dict] = {}
_LOCK = Lock()


def files_of(t: StarTables) -> tuple:
    """Path, length and time of every file in the folder, so that changed data is fitted anew."""
    folder = t.spark._jvm.org.apache.hadoop.fs.Path(t.folder)
    listed = folder.getFileSystem(t.spark._jsc.hadoopConfiguration()).listFiles(folder, True)
    found = []
    while listed.hasNext():
        status = listed.next()
        found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return tuple(sorted(found))


def shared(t: StarTables, names: list[str], fit) -> dict:
    """The models of these names; ``fit`` makes those that are missing."""
    key = (t.spark.sparkContext.applicationId, t.folder, t.once("files", lambda: files_of(t)))
    with _LOCK:
        known = _FITTED.setdefault(key, {})
        missing = [n for n in names if n not in known]
        if missing:
            known |= fit(missing)
        return {n: known[n] for n in names}


def trained(t: StarTables, *grains, kinds=KINDS):
    """Per (rows, sets) the fitted models and the validation rows; the models that are missing are fitted side by side."""
    splits = [models.temporal_split(rows, CALENDAR) for rows, _ in grains]
    learners = {k: v for k, v in models.regressors().items() if k in kinds}
    names = [[f"{kind}_{name}" for name in sets for kind in learners] for _, sets in grains]

    def fit(missing):
        groups = []
        for (train, _), (_, sets) in zip(splits, grains):
            # sets that lack the same learners are trained on one table
            lacking = {name: tuple(k for k in learners if f"{k}_{name}" in missing) for name in sets}
            for wanted in dict.fromkeys(k for k in lacking.values() if k):
                groups.append((train, {n: sets[n] for n, k in lacking.items() if k == wanted}, {k: learners[k] for k in wanted}))
        return models.train_groups(groups)

    fitted = shared(t, [n for of_grain in names for n in of_grain], fit)
    return [({n: fitted[n] for n in of_grain}, validation) for of_grain, (_, validation) in zip(names, splits)]


def with_volume(t: StarTables, rows):
    segments = forecast.volume_segments(monthly(t), CALENDAR).select("product_code", "volume_segment")
    return rows.join(segments, "product_code", "left").withColumn(
        "volume_segment", F.coalesce("volume_segment", F.lit("Low Volume"))
    )


@query(
    "temporal_split",
    """SELECT product_code, period_month, total_quantity, CASE WHEN period_month = 15 THEN 'validation' ELSE 'train' END AS side FROM monthly""",
)
def _(t):
    train, validation = models.temporal_split(monthly_sums(t), CALENDAR)
    columns = ["product_code", "period_month", "total_quantity"]
    return train.select(*columns, F.lit("train").alias("side")).unionByName(
        validation.select(*columns, F.lit("validation").alias("side"))
    )


EXTENDED = params.FEATURE_SETS["monthly_extended_features"]
SLOTS = " + ".join(
    f"(SELECT count(DISTINCT coalesce(CAST({c} AS VARCHAR), 'UNKNOWN')) + 1 FROM monthly_feat)" if c in models.CATEGORIES else "2" for c in EXTENDED
)


@query("encode_features", f"SELECT product_code, period_month, CAST({SLOTS} AS INTEGER) AS n_slots FROM monthly_feat")
def _(t):
    encoded = models.encode_features(feature_table(t), EXTENDED)
    return encoded.select("product_code", "period_month", F.size(models.vector_to_array("features")).alias("n_slots"))


@query("train_tree_regressors")
def _(t):
    [(fitted, validation)] = trained(t, (feature_table(t), MONTHLY))
    return models.predict_all(fitted, validation).select("product_code", "model", "total_quantity", "predicted")


@query("train_weekly_regressors")
def _(t):
    [(fitted, validation)] = trained(t, (weekly_table(t), WEEKLY))
    return models.predict_all(fitted, validation).select("product_code", "period_week", "model", "total_quantity", "predicted")


@query("model_comparison")
def _(t):
    parts = []
    grains = trained(t, (feature_table(t), MONTHLY), (weekly_table(t), WEEKLY))
    for grain, (fitted, validation) in zip(("monthly", "weekly"), grains):
        scored = models.predict_all(fitted, with_volume(t, validation))
        parts.append(forecast.metrics_by_segment(scored).withColumn("grain", F.lit(grain)))
    return parts[0].unionByName(parts[1])


def future_forecast(t: StarTables):
    """The monthly models; weekly ones serve the comparison only, as in the original."""
    [(fitted, _)] = trained(t, (feature_table(t), MONTHLY))
    return models.forecast_future(fitted, t.table("future", lambda: future_monthly(t)), asp(t))


@query("forecast_future")
def _(t):
    return future_forecast(t)


@query(
    "forecast_future_contract",
    f"""SELECT product_code, CAST(m AS INTEGER) AS fiscal_month, model, asp_used, asp_source, 0 AS n_below_zero, TRUE AS is_priced
    FROM asp, (VALUES (4), (5), (6)) v(m), (VALUES {", ".join(f"('{kind}_{name}')" for name in MONTHLY for kind in KINDS)}) x(model)""",
    rounded="asp_used:4",
)
def _(t):
    """Every SKU, future month and model once, priced by the cascade; the revenue is the quantity at that price."""
    price = F.abs(F.col("estimated_revenue") - F.col("predicted_quantity") * F.col("asp_used")) <= 1e-6 * (1 + F.abs(F.col("estimated_revenue")))
    below = F.when(F.col("predicted_quantity") >= 0, 0).otherwise(1)
    return future_forecast(t).select(
        "product_code", "fiscal_month", "model", "asp_used", "asp_source", below.alias("n_below_zero"), F.coalesce(price, F.lit(False)).alias("is_priced")
    )


@query("ml_vs_baseline")
def _(t):
    return models.method_totals(future_forecast(t), share_forecast(t))


@query("feature_importance")
def _(t):
    (monthly_ones, _), (weekly_ones, _) = trained(t, (feature_table(t), MONTHLY), (weekly_table(t), WEEKLY))
    importance = models.feature_importance(monthly_ones, feature_table(t))
    return models.top_importance(importance.unionByName(models.feature_importance(weekly_ones, weekly_table(t))))


@query(
    "importance_contract",
    " UNION ALL ".join(
        f"SELECT '{kind}_{name}' AS model, CAST({len(names)} AS BIGINT) AS n_features, CAST(1 AS DOUBLE) AS total, CAST(0 AS BIGINT) AS n_negative"
        for name, names in MONTHLY.items()
        for kind in KINDS
    ),
    rounded="total",
)
def _(t):
    """The importance of every model's features is not negative and adds up to 1."""
    [(fitted, _)] = trained(t, (feature_table(t), MONTHLY))
    importance = models.feature_importance(fitted, feature_table(t))
    return importance.groupBy("model").agg(
        F.count("*").alias("n_features"), F.sum("importance").alias("total"), F.count_if(F.col("importance") < 0).alias("n_negative")
    )


def classified(t: StarTables, n: int):
    """The dealers of the cutoff after the first ``n``, scored by a model of those."""
    rows = t.table("snapshots", lambda: snapshots(t))
    name = f"dealers_{n}"
    fitted = shared(t, [name], lambda _: {name: models.fit_before(rows, CALENDAR, n, models.dealer_classifier())})
    return models.score_at(fitted[name], rows, CALENDAR, n)


@query("train_classifier")
def _(t):
    ranked = dealers.priority_ranking(classified(t, 4))
    return ranked.select(
        "customer_code", "rfm_segment", "p_order_next_30d", "marketing_priority_score", "recommended_action", "risk_segment"
    )


@query("classifier_metrics")
def _(t):
    validation = classified(t, 3)
    scored = t.table("validation_scores", lambda: validation.select("customer_code", "target_active_next_30d", "p_order_next_30d"))
    auc = stats.roc_auc(scored, "target_active_next_30d", "p_order_next_30d")
    ap = stats.average_precision(scored, "target_active_next_30d", "p_order_next_30d").scalar()
    return auc.withColumn("average_precision", ap)
