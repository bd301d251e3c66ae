"""Corrections, rule mappings, substring joins, upserts and reloads of master data."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeloom import params
from tradeloom.functions import text
from tradeloom.functions.rules import first_match, ilike_rule
from tradeloom.operators.common import join_null_safe
from tradeloom.operators.ranking import row_numbers


def override_by_code(products: DataFrame, corrections: DataFrame, columns: list[str], key: str = "product_code") -> DataFrame:
    """Corrected values where the correction table has one, else the old ones."""
    fixes = corrections.select(key, *[F.col(c).alias(f"__fix_{c}") for c in columns])
    joined = products.join(fixes, key, "left")
    return joined.withColumns({c: F.coalesce(f"__fix_{c}", c) for c in columns}).select(*products.columns)


def rule_assign(df: DataFrame, name: str, target: str, rules=None) -> DataFrame:
    """Target of the first rule that matches the name, only where ``target`` is NULL."""
    ladder = first_match(
        [(ilike_rule(F.col(name), include, exclude), F.lit(value)) for include, exclude, value in rules or params.LINE_RULES]
    )
    return df.withColumn(target, F.when(F.col(target).isNull(), ladder).otherwise(F.col(target)))


def rule_assign_line(products: DataFrame, lines: DataFrame, rules=None) -> DataFrame:
    """Line id by ordered name rules for products without one; unknown line names stay NULL."""
    named = rule_assign(products.withColumn("__line", F.lit(None).cast("string")), "product_name", "__line", rules)
    ids = lines.groupBy(F.col("line_name").alias("__line")).agg(F.min("line_id").alias("__id"))
    joined = named.join(ids, "__line", "left")
    return joined.withColumn("line_id", F.coalesce("line_id", "__id")).select(*products.columns)


def apply_correction_map(provinces: DataFrame, rules: DataFrame) -> DataFrame:
    """Clean names from the rules, raw ones where there is no rule."""
    joined = provinces.join(rules, provinces.province_id == rules.raw_province_id, "left")
    return joined.select(
        provinces.province_id,
        provinces.province_name.alias("province_name_raw"),
        provinces.region.alias("region_raw"),
        F.coalesce(rules.province_name_clean, provinces.province_name).alias("province_name_clean"),
        F.coalesce(rules.region_clean, provinces.region).alias("region_clean"),
        F.coalesce(rules.mapping_type, F.lit("keep")).alias("mapping_type"),
        rules.note,
    )


def changed_rows(clean: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Rows in which a raw value differs from the clean one, NULLs included."""
    cond = None
    for raw, new in pairs:
        differs = ~F.col(raw).eqNullSafe(F.col(new))
        cond = differs if cond is None else cond | differs
    return clean.where(cond)


def sync_from_dimension(fact: DataFrame, dimension: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Refresh denormalised columns; a matched row takes the new value even when it is NULL."""
    new = dimension.select(key, F.lit(True).alias("__hit"), *[F.col(c).alias(f"__new_{c}") for c in columns])
    joined = fact.join(new, key, "left")
    changes = {c: F.when(F.col("__hit"), F.col(f"__new_{c}")).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(changes).select(*fact.columns)


# substring joins -------------------------------------------------------------------


#: Length of the grams of the index; shorter keys are grams themselves.
GRAM = 3


def _grams(value: Column, size: int) -> Column:
    """All stretches of ``size`` characters; the characters are cut once, so the work grows with the length."""
    letters = F.split(value, "")
    shifted = [F.slice(letters, i + 1, F.greatest(F.length(value), F.lit(1))) for i in range(size)]
    joined = F.transform(F.arrays_zip(*[s.alias(f"c{i}") for i, s in enumerate(shifted)]), lambda z: F.concat(*[z.getField(f"c{i}") for i in range(size)]))
    return F.filter(joined, lambda g: g.isNotNull())


def contained_keys(texts: DataFrame, keys: DataFrame, text: str, key: str, gram: int = GRAM) -> DataFrame:
    """(text, key): each distinct pair in which the text contains the key; both are not empty.

    An index holds each key under the rarest of its grams, counted over all texts, so a text meets only keys of
    which it holds the rarest part, and ``contains`` decides. A gram row carries a hash of its text; texts
    join again once, for the candidates. Keys that no text holds a gram of never leave the index.
    """
    told = texts.select(text).where(F.length(text) > 0).distinct().withColumn("__id", F.xxhash64(text))
    asked = keys.select(key).where(F.length(key) > 0).distinct().withColumn("__size", F.least(F.length(key), F.lit(gram)))
    sizes = asked.agg(F.collect_set("__size")).scalar()  # at most ``gram`` numbers
    none = F.array().cast("array<string>")
    every = [F.when(F.array_contains(sizes, n) & (F.length(text) >= n), _grams(F.col(text), n)).otherwise(none) for n in range(1, gram + 1)]
    of_texts = told.select("__id", F.explode(F.array_distinct(F.concat(*every))).alias("__gram"))
    own = F.when(F.col("__size") < gram, F.array(key)).otherwise(F.array_distinct(_grams(F.col(key), gram)))
    of_keys = asked.select(key, F.explode(own).alias("__gram"))
    counts = of_texts.join(of_keys.select("__gram").distinct(), "__gram", "left_semi").groupBy("__gram").agg(F.count(F.lit(1)).alias("__n"))
    rarest = of_keys.join(counts, "__gram", "left").groupBy(key).agg(
        F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), F.col("__gram").alias("gram"))).alias("__least")
    )
    index = rarest.where("__least.n > 0").select(key, F.col("__least.gram").alias("__gram"))
    near = of_texts.join(index, "__gram").select("__id", key)
    return near.join(told, "__id").where(F.contains(text, key)).select(text, key)


def join_contains_unique(names: DataFrame, lines: DataFrame, key: str = "product_key") -> DataFrame:
    """Line of each key when exactly one line key contains it or is contained in it, else NULL.

    An empty key is contained in every line key. Of lines with the same key the one with the largest id counts.
    """
    line_keys = lines.groupBy("line_key").agg(F.max("line_id").alias("line_id"))
    keys = names.select(key).where(F.col(key).isNotNull()).distinct()
    inside = contained_keys(keys, line_keys, key, "line_key")
    around = contained_keys(line_keys, keys, "line_key", key).where(F.col(key) != F.col("line_key"))  # an equal key counts once
    hits = inside.unionByName(around).join(line_keys, "line_key")
    empty_line = line_keys.where("line_key = ''").select("line_id")  # is contained in every key
    found = hits.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("line_id").alias("line_id"))
    every_line = line_keys.agg(F.struct(F.count(F.lit(1)).alias("n"), F.min("line_id").alias("line_id"))).scalar()
    empty = empty_line.agg(F.struct(F.count(F.lit(1)).alias("n"), F.min("line_id").alias("line_id"))).scalar()
    n = F.coalesce("n", F.lit(0)) + empty.getField("n")
    only_one = F.when(n == 1, F.coalesce("line_id", empty.getField("line_id")))
    of_empty = F.when(every_line.getField("n") == 1, every_line.getField("line_id"))
    return keys.join(found, key, "left").select(key, F.when(F.col(key) == "", of_empty).otherwise(only_one).alias("line_id"))


def join_address_to_province(customers: DataFrame, provinces: DataFrame) -> DataFrame:
    """Province for customers without one from the name found last in the address.

    Of several names the one that starts latest (at its first place) wins, then the longer name, then the smaller id.
    """
    names = provinces.select("province_id", F.lower("province_name_clean").alias("name"), F.length("province_name_clean").alias("size"))
    open_rows = customers.where(F.col("province_id").isNull() & F.col("address").isNotNull()).select("customer_code", F.lower("address").alias("address"))
    hits = contained_keys(open_rows, names, "address", "name").join(names, "name")
    best = F.max_by("province_id", F.struct(F.instr("address", F.col("name")).alias("at"), "size", -F.col("province_id")))
    return open_rows.join(hits.groupBy("address").agg(best.alias("province_id")), "address").select("customer_code", "province_id")


# upserts and reloads ----------------------------------------------------------------


def upsert_customers(customers: DataFrame, buyers: DataFrame) -> DataFrame:
    """Customers to add for tax codes that are not known yet, numbered after the largest code.

    Buyers without a tax code stay apart and are not created. The running number comes from
    counts per hash range of the tax code, so no task sorts all new customers.
    """
    known = customers.select(F.trim("tax_code").alias("tax_code")).where(F.col("tax_code").isNotNull()).distinct()
    wanted = (
        buyers.withColumn("tax_code", F.trim("tax_code"))
        .where(F.coalesce("tax_code", F.lit("")) != "")
        .groupBy("tax_code")
        .agg(F.min("customer_name").alias("customer_name"), F.min("address").alias("address"))
    )
    new = wanted.join(known, "tax_code", "left_anti").withColumn("__same", F.lit(0))
    used = F.when(F.col("customer_code").startswith("KH-"), F.substring("customer_code", 4, 10).try_cast("bigint"))
    top = customers.agg(F.coalesce(F.max(used), F.lit(0))).scalar()
    placed = row_numbers(new, "__same", "tax_code", "position")
    number = (F.col("position") + 1 + top).cast("bigint")
    return placed.select(
        F.format_string("KH-%05d", number).alias("customer_code"),
        F.coalesce("customer_name", F.concat(F.lit("Khách hàng "), F.col("tax_code"))).alias("customer_name"),
        "tax_code",
        "address",
    )


def insert_missing_products(products: DataFrame, lines: DataFrame) -> DataFrame:
    """Known products plus one row per unknown code; defaults fill what the document lacks."""
    new = (
        lines.groupBy("product_code")
        .agg(F.min("product_name").alias("product_name"), F.min("color").alias("color"))
        .join(products.select("product_code"), "product_code", "left_anti")
    )
    return products.unionByName(
        new.select(
            "product_code",
            F.coalesce("product_name", "product_code").alias("product_name"),
            "color",
            text.base_color(F.col("color"), unknown=params.UNKNOWN_LABEL).alias("base_color"),
        ),
        allowMissingColumns=True,
    )


def replace_period(current: DataFrame, new: DataFrame, first: date, last: date, day: str = "order_date") -> DataFrame:
    """Rows outside the period plus the new rows inside it."""
    inside = F.col(day).between(F.lit(first), F.lit(last))
    return current.where(~inside).unionByName(new.where(inside))


def semi_join_membership(fact: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    return join_null_safe(fact, members.select(*keys).distinct(), keys, "left_semi")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose key is set but has no parent."""
    return child.where(F.col(key).isNotNull()).join(parent.select(key).distinct(), key, "left_anti")
