"""Star schema on top of the bundled order tables.

``StarTables`` gives every table of the sales star schema as a typed DataFrame. The fact
is a left-deep join that only touches the dimensions whose columns are asked for: the
foreign keys are declared (and audited by ``fk_check``), so an unused dimension neither
adds nor removes rows. No join carries a broadcast hint; Spark decides from file sizes and
from the sizes it measures at run time.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.functions import dates
from tradeloom.params import RfmThresholds, SalesCalendar
from tradeloom.storage import materialize

#: Declared, so that planning reads no file footers.
RAW_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
MONEY = "decimal(15,2)"
QUANTITY = "decimal(10,2)"

#: Parameters that fit the bundled tables (orders run from 1995 to August 2001).
CALENDAR = SalesCalendar(
    year_a=2000,
    as_of=date(2001, 3, 31),
    snapshot_dates=(
        date(2000, 1, 31),
        date(2000, 2, 29),
        date(2001, 1, 31),
        date(2001, 2, 28),
        date(2001, 3, 31),
    ),
)
THRESHOLDS = RfmThresholds(frequency=(15, 12, 10, 6), monetary=(3_000_000, 1_900_000, 1_500_000, 1_000_000))
SCENARIO_FACTORS = {"Conservative": 0.85, "Base": 1.0, "Aggressive": 1.1425}
BASE_COLORS = {"red": "warm", "hot": "warm", "blue": "cool", "cold": "cool"}

_DAY = "cast(o_orderdate as date)"
_RECODE = " ".join(f"when '{old}' then '{new}'" for old, new in BASE_COLORS.items())
#: Columns of the star as expressions over the bundled tables.
LINE_SQL = {
    "so_number": "cast(l_orderkey as string)",
    "order_id": "l_orderkey",
    "line_id": "l_linenumber",
    "product_code": "cast(l_partkey as string)",
    "quantity": f"cast(l_quantity as {QUANTITY})",
    "unit_price": f"cast(round(try_divide(cast(l_extendedprice as decimal(15,2)), cast(l_quantity as {QUANTITY})), 2) as {MONEY})",
    "line_total": f"cast(l_extendedprice as {MONEY})",
}
ORDER_SQL = {
    "order_date": _DAY,
    "customer_code": "cast(o_custkey as string)",
    "total_amount": f"cast(o_totalprice as {MONEY})",
    "fiscal_year": f"year({_DAY})",
    "fiscal_quarter": f"quarter({_DAY})",
    "fiscal_month": f"month({_DAY})",
    "week_of_year": f"weekofyear({_DAY})",
}
CUSTOMER_SQL = {
    "customer_name": "c_name",
    "customer_tier": "c_mktsegment",
    "province_id": "if(c_custkey % 20 <> 0, c_nationkey, null)",
}
PRODUCT_SQL = {
    "product_name": "p_name",
    "color": "split(p_name, ' ')[0]",
    "base_color": f"case split(p_name, ' ')[0] {_RECODE} else split(p_name, ' ')[0] end",
    "line_id_fk": "if(p_partkey % 5 <> 0, ascii(p_type) * 10000 + ascii(substring(p_type, 2, 1)) * 100"
    " + cast(regexp_extract(p_brand, '([0-9]+)', 1) as int), null)",
    "line_name": "if(p_partkey % 5 <> 0, concat_ws(' ', p_type, p_brand), null)",
    "group_code": "if(p_partkey % 5 <> 0, p_type, null)",
    "group_name": "if(p_partkey % 5 <> 0, p_type, null)",
}


def _named(expressions: dict[str, str]) -> list[str]:
    return [f"{sql} as {name}" for name, sql in expressions.items()]


ORDER_COLUMNS = {"order_date", "fiscal_year", "fiscal_quarter", "fiscal_month", "week_of_year", "customer_code"}
CUSTOMER_COLUMNS = {"customer_name", "customer_tier", "province_id"}
PROVINCE_COLUMNS = {"province_name", "region"}
PRODUCT_COLUMNS = {
    "product_name", "color", "base_color", "line_id_fk", "line_name", "group_code", "group_name",
}
LINE_COLUMNS = ["so_number", "order_id", "line_id", "product_code", "quantity", "unit_price", "line_total"]
FACT_COLUMNS = [
    "order_date", "fiscal_year", "fiscal_quarter", "fiscal_month", "week_of_year", "so_number", "order_id",
    "line_id", "customer_code", "customer_name", "province_id", "province_name", "region", "product_code",
    "product_name", "color", "base_color", "line_id_fk", "line_name", "group_code", "group_name", "quantity",
    "unit_price", "line_total",
]


def day_range(column: str, first: date | None, last: date | None) -> Column:
    """Range on the raw timestamp, so that it reaches the Parquet scan."""
    parts = ["true"]
    if first is not None:
        parts.append(f"{column} >= timestamp_ntz'{first} 00:00:00'")
    if last is not None:
        parts.append(f"{column} < timestamp_ntz'{last + timedelta(days=1)} 00:00:00'")
    return F.expr(" and ".join(parts))


class StarTables:
    """Tables of one folder. Frames asked for twice are built once per instance."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._built: dict[str, DataFrame] = {}

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._built:
            self._built[name] = build()
        return self._built[name]

    def table(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """Like ``once``, written out because several steps read it."""
        return self.once(f"table:{name}", lambda: materialize(build(), name))

    def raw(self, table: str) -> DataFrame:
        path = f"{self.folder}/{table}.parquet"
        return self.once(f"raw:{table}", lambda: self.spark.read.schema(RAW_SCHEMAS[table]).parquet(path))

    # dimensions ---------------------------------------------------------------

    def product(self, *extra: str) -> DataFrame:
        """A line and its group are missing for every fifth product, as unmapped SKUs."""
        return self.raw("part").selectExpr("cast(p_partkey as string) as product_code", *_named(PRODUCT_SQL), *extra)

    def product_line(self) -> DataFrame:
        """One row per line of the catalogue."""
        return (
            self.product()
            .where(F.col("line_id_fk").isNotNull())
            .select(F.col("line_id_fk").alias("line_id"), "line_name", "group_code")
            .distinct()
        )

    def product_group(self) -> DataFrame:
        return self.raw("part").select(F.col("p_type").alias("group_code"), F.col("p_type").alias("group_name")).distinct()

    def province(self) -> DataFrame:
        nation, region = self.raw("nation"), self.raw("region")
        return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
            F.col("n_nationkey").alias("province_id"),
            F.col("n_name").alias("province_name"),
            F.col("r_name").alias("region"),
        )

    def province_corrections(self) -> DataFrame:
        """Every fifth province gets a corrected name and region."""
        key = F.col("n_nationkey")
        return (
            self.raw("nation")
            .where(key % 5 == 0)
            .select(
                key.alias("raw_province_id"),
                F.concat(F.lit("NATION_"), ((key + 1) % 25).cast("string")).alias("province_name_clean"),
                F.when(key % 10 == 0, F.lit("NORTH")).alias("region_clean"),
                F.when(key % 10 == 0, "fix_typo").otherwise("normalize_text").alias("mapping_type"),
                F.concat(F.lit("was "), F.col("n_name")).alias("note"),
            )
        )

    def customer(self, *extra: str) -> DataFrame:
        """Some customers lack a province, some a tax code or have a blank one."""
        return self.raw("customer").selectExpr(
            "cast(c_custkey as string) as customer_code",
            *_named(CUSTOMER_SQL),
            "case when c_custkey % 10 = 3 then null when c_custkey % 10 = 7 then '  '"
            " else lpad(cast(c_custkey as string), 10, '0') end as tax_code",
            "concat('No. ', c_custkey, ', Nation_', c_nationkey, ' street, NATION_', (c_nationkey + 7) % 25) as address",
            *extra,
        )

    # orders -------------------------------------------------------------------

    def orders(self, first: date | None = None, last: date | None = None, *extra: str) -> DataFrame:
        return (
            self.raw("orders")
            .where(day_range("o_orderdate", first, last))
            .selectExpr("o_orderkey as order_id", "cast(o_orderkey as string) as so_number", *_named(ORDER_SQL), *extra)
        )

    def email_log(self) -> DataFrame:
        status = (
            F.when(F.col("o_orderstatus") == "F", "READY_TO_INSERT")
            .when(F.col("o_orderstatus") == "O", "PARSE_FAILED")
            .otherwise("FAILED_NO_ATTACHMENT")
        )
        return self.raw("orders").select(
            F.col("o_orderkey").cast("string").alias("message_id"),
            F.col("o_orderdate").alias("received_at"),
            status.alias("processing_status"),
        )

    def lines(self, *extra: str) -> DataFrame:
        """The unit price is the line amount over the quantity, rounded half up in cents; NULL for the quantity 0."""
        return self.raw("lineitem").selectExpr(*_named(LINE_SQL), *extra)

    def product_price(self, last: date | None = None) -> DataFrame:
        """Invoice prices per SKU and date."""
        fact = self.fact("product_code", "unit_price", "order_date", "order_id", "line_id", last=last)
        return fact.withColumnRenamed("order_date", "effective_from")

    def fact(self, *columns: str, first: date | None = None, last: date | None = None) -> DataFrame:
        """Order lines with the requested dimension columns; joins run on the integer keys.

        The population is every order line, whatever columns are asked for: a line whose order, customer or
        product is unknown stays, with NULLs. Only a date range leaves lines out.

        The joins move the numbers and names of the tables as they are; texts and amounts are made from them in the last
        step, so no shuffle carries them. Customers meet the orders, which are fewer than the lines.
        """
        wanted = list(columns) or FACT_COLUMNS
        need = set(wanted)
        need_province = bool(need & PROVINCE_COLUMNS)
        need_customer = need_province or bool(need & CUSTOMER_COLUMNS)
        df = self.raw("lineitem")
        if need_customer or need & ORDER_COLUMNS or first or last:
            orders = self.raw("orders").where(day_range("o_orderdate", first, last))
            if need_customer:
                customers = self.raw("customer")
                orders = orders.join(customers, orders.o_custkey == customers.c_custkey, "left")
            df = df.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "inner" if first or last else "left")
        if need & PRODUCT_COLUMNS:
            df = df.join(self.raw("part"), F.col("l_partkey") == F.col("p_partkey"), "left")
        if need_province:
            province = self.province().withColumnRenamed("province_id", "n_nationkey")
            df = df.join(province, F.expr(CUSTOMER_SQL["province_id"]) == F.col("n_nationkey"), "left")
        known = PRODUCT_SQL | CUSTOMER_SQL | ORDER_SQL | LINE_SQL
        return df.select(*[F.expr(known.get(c, c)).alias(c) for c in wanted])

    def block_fact(self, *columns: str, cal: SalesCalendar = CALENDAR) -> DataFrame:
        """Fact rows of the two observed quarters; the months between them are left out."""
        need = list(dict.fromkeys([*columns, "fiscal_year", "fiscal_month"]))
        first = date(cal.year_a, cal.block_months[0], 1)
        df = self.fact(*need, first=first, last=cal.as_of)
        return df.where(dates.in_block(F.col("fiscal_year"), F.col("fiscal_month"), cal))
