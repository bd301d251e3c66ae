"""Document extraction, text cleaning, master-data joins, sources and sinks.

The order tables hold no invoices, so documents, mails and names are put together from
their columns; both sides build the same text.
"""

import uuid

from pyspark.sql import functions as F

from tradeloom import params
from tradeloom.functions import text
from tradeloom.operators import audit, cleaning, documents
from tradeloom.plans.registry import cte, query
from tradeloom.sources import manifest, readers, versions
from tradeloom.sources.star import CALENDAR, FACT_COLUMNS, StarTables
from tradeloom.storage import work_folder

VN_COLORS = list(params.BASE_COLORS)
TARGETS = [target for _, _, target in params.LINE_RULES]


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def pick_sql(values, index: str) -> str:
    """Element of a literal list by a 0-based number."""
    return f"([{quoted(values)}])[({index}) + 1]"


def pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


# extraction --------------------------------------------------------------------------


def mails(t: StarTables):
    key = F.col("doc_id")
    colon = F.when(key % 2 == 0, F.lit(": ")).otherwise(F.lit("："))
    date = F.format_string("%02d/%02d/2001", key % 28 + 1, key % 12 + 1)
    return t.raw("documents").select(
        "doc_id",
        F.concat(
            F.col("text"),
            F.when(key % 5 != 0, F.concat(F.lit("\nmst"), colon, F.lpad(key.cast("string"), 9, "0"))).otherwise(F.lit("")),
            F.lit("\nĐẠI  LÝ"), colon, F.col("source"), F.lit(" - "), F.col("lang"), F.lit("  "),
            F.lit("\nNgày "), date,
            F.lit("\nđịa chỉ"), colon, F.lit("No. "), key.cast("string"),
            F.lit("\nSĐT: 09 "), F.lpad((key % 1000).cast("string"), 3, "0"), F.lit("-55"),
            F.lit("\ntổng tiền 1.000 đồng\nTrị giá "), F.col("n_chars").cast("string"), F.lit(".500,00 VND"),
        ).alias("body"),
    )


cte(
    "mail",
    """
SELECT doc_id, text || CASE WHEN doc_id % 5 <> 0 THEN chr(10) || 'mst' || colon || lpad(CAST(doc_id AS VARCHAR), 9, '0') ELSE '' END
  || chr(10) || 'ĐẠI  LÝ' || colon || source || ' - ' || lang || '  '
  || chr(10) || 'Ngày ' || printf('%02d/%02d/2001', doc_id % 28 + 1, doc_id % 12 + 1)
  || chr(10) || 'địa chỉ' || colon || 'No. ' || CAST(doc_id AS VARCHAR)
  || chr(10) || 'SĐT: 09 ' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') || '-55'
  || chr(10) || 'tổng tiền 1.000 đồng' || chr(10) || 'Trị giá ' || CAST(n_chars AS VARCHAR) || '.500,00 VND' AS body
FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN ': ' ELSE '：' END AS colon FROM documents)""",
)


def field_sql(labels: str, value: str) -> str:
    found = f"regexp_extract(body, '(?i)(?:{labels})\\s*[:：]\\s*({value})', 1)"
    return f"nullif(regexp_replace({found}, '^\\s+|\\s+$', '', 'g'), '')"


TOTALS = "regexp_extract_all(body, '(?i)(?:Tổng\\s*tiền|trị\\s*giá)\\s*([0-9.,]+)\\s*(?:đồng|VND)?', 1)"
LAST_TOTAL = f"CAST(coalesce(try_cast(regexp_replace({TOTALS}[-1], '[^0-9]', '', 'g') AS BIGINT), 0) AS DOUBLE)"


@query(
    "extract_fields",
    f"""SELECT doc_id, {field_sql('MST|Mã\\s*số\\s*thuế', '\\d{8,13}')} AS tax_code, {field_sql('Đại\\s*lý|Khách\\s*hàng|Đơn\\s*vị', '.+')} AS customer_name,
    nullif(regexp_extract(body, '(?i)ngày\\s*(\\d{{2}}/\\d{{2}}/\\d{{4}})', 1), '') AS order_date_text, {field_sql('Địa\\s*chỉ', '.+')} AS address,
    {field_sql('Liên\\s*hệ|SĐT|Điện\\s*thoại', '[\\d\\s\\.\\-]+')} AS phone FROM mail""",
)
def _(t):
    return documents.extract_fields(mails(t)).drop("body", "email_total")


@query("extract_last_total", f"SELECT doc_id, {LAST_TOTAL} AS email_total FROM mail")
def _(t):
    return mails(t).select("doc_id", text.last_total(F.col("body")).cast("double").alias("email_total"))


def invoice_rows(t: StarTables):
    key, part = F.col("l_orderkey"), F.col("l_partkey")
    no = F.col("l_linenumber")
    row = (
        F.when(no % 5 == 1, F.format_string("Số đơn hàng BH%02d.%04d", key % 100, part % 10000))
        .when(no % 5 == 2, F.format_string("Ngày %02d/%02d/2001", part % 28 + 1, part % 12 + 1))
        .when(no % 5 == 3, F.format_string("MST %010d", part))
        .when(no % 5 == 4, F.format_string("Tổng cộng 1 trang %d.%03d,00", part, key % 1000))
        .otherwise(F.lit("Ghi chú"))
    )
    return t.raw("lineitem").select(
        key.alias("doc_id"),
        (no.cast("bigint") * 1_000_000_000 + part * 1000 + F.col("l_suppkey") % 1000).alias("row_no"),
        row.alias("row_text"),
    )


cte(
    "invoice_row",
    """
SELECT l_orderkey AS doc_id, l_linenumber::BIGINT * 1000000000 + l_partkey * 1000 + l_suppkey % 1000 AS row_no,
  CASE l_linenumber % 5 WHEN 1 THEN printf('Số đơn hàng BH%02d.%04d', l_orderkey % 100, l_partkey % 10000)
    WHEN 2 THEN printf('Ngày %02d/%02d/2001', l_partkey % 28 + 1, l_partkey % 12 + 1) WHEN 3 THEN printf('MST %010d', l_partkey)
    WHEN 4 THEN printf('Tổng cộng 1 trang %d.%03d,00', l_partkey, l_orderkey % 1000) ELSE 'Ghi chú' END AS row_text
FROM lineitem""",
)


@query(
    "extract_invoice_header",
    """SELECT doc_id, arg_max(regexp_extract(row_text, 'BH\\d{2}\\.\\d{4}'), row_no) FILTER (WHERE row_text LIKE '%Số%' AND row_text LIKE '%hàng%') AS so_number,
    arg_max(regexp_extract(row_text, '\\d{2}/\\d{2}/\\d{4}'), row_no) FILTER (WHERE row_text LIKE '%Ngày%') AS order_date_text,
    arg_max(regexp_extract(row_text, '\\d{8,13}'), row_no) FILTER (WHERE row_text LIKE '%MST%') AS tax_code,
    coalesce(arg_max(CAST(regexp_replace(regexp_extract_all(row_text, '[0-9.,]+')[-1], '[^0-9]', '', 'g') AS DOUBLE), row_no)
      FILTER (WHERE row_text LIKE '%Tổng cộng%'), 0) AS pdf_total FROM invoice_row GROUP BY 1""",
)
def _(t):
    return documents.invoice_header(invoice_rows(t)).withColumn("pdf_total", F.col("pdf_total").cast("double"))


def raw_lines(t: StarTables):
    part, cents = F.col("l_partkey"), F.round(F.col("l_extendedprice") * 100).cast("bigint")
    units = F.col("l_quantity").cast("bigint").cast("string")
    return t.raw("lineitem").select(
        F.col("l_orderkey").alias("doc_id"),
        F.when(part % 3 == 0, part.cast("string")).otherwise(F.format_string(" TP0099.%07d ", part)).alias("product_code"),
        F.when(part % 4 == 0, F.concat(units, F.lit(",5"))).when(part % 4 == 1, F.concat(units, F.lit(" cái")))
        .when(part % 4 == 2, F.concat(F.lit("1,"), units, F.lit(".25"))).otherwise(F.concat(units, F.lit(".1.2"))).alias("quantity"),
        F.concat((cents / 100).cast("bigint").cast("string"), F.lit(".000 đ")).alias("unit_price"),
        F.when(part % 11 == 0, F.lit("0")).when(part % 11 == 1, F.lit("")).otherwise(cents.cast("string")).alias("line_total"),
    )


QTY = """CAST(coalesce(try_cast(CASE WHEN contains(k, ',') AND NOT contains(k, '.') THEN replace(k, ',', '.')
  ELSE replace(k, ',', '') END AS DECIMAL(20,6)), 0) AS DOUBLE)"""
cte(
    "raw_line",
    """
SELECT *, regexp_replace(quantity_text, '[^0-9,.]', '', 'g') AS k FROM (
SELECT l_orderkey AS doc_id, CASE WHEN l_partkey % 3 = 0 THEN CAST(l_partkey AS VARCHAR) ELSE printf(' TP0099.%07d ', l_partkey) END AS code,
  CASE l_partkey % 4 WHEN 0 THEN CAST(l_quantity::BIGINT AS VARCHAR) || ',5' WHEN 1 THEN CAST(l_quantity::BIGINT AS VARCHAR) || ' cái'
    WHEN 2 THEN '1,' || CAST(l_quantity::BIGINT AS VARCHAR) || '.25' ELSE CAST(l_quantity::BIGINT AS VARCHAR) || '.1.2' END AS quantity_text,
  CAST(CAST(floor(round(l_extendedprice * 100) / 100) AS BIGINT) AS VARCHAR) || '.000 đ' AS price_text,
  CASE l_partkey % 11 WHEN 0 THEN '0' WHEN 1 THEN '' ELSE CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR) END AS total_text
FROM lineitem)""",
)


def money_sql(column: str) -> str:
    return f"CAST(coalesce(try_cast(regexp_replace({column}, '[^0-9]', '', 'g') AS BIGINT), 0) AS DOUBLE)"


@query(
    "filter_invoice_lines",
    f"""SELECT doc_id, trim(code) AS product_code, {QTY} AS quantity, {money_sql('price_text')} AS unit_price, {money_sql('total_text')} AS line_total
    FROM raw_line WHERE regexp_full_match(trim(code), '[A-Za-z0-9][A-Za-z0-9.]{{5,25}}') AND {QTY} > 0 AND {money_sql('price_text')} > 0
    AND {money_sql('total_text')} > 0""",
)
def _(t):
    numbers = {c: F.col(c).cast("double") for c in ("quantity", "unit_price", "line_total")}
    return documents.invoice_lines(raw_lines(t)).withColumns(numbers)


@query("is_product_code", "SELECT DISTINCT code, regexp_full_match(trim(code), '[A-Za-z0-9][A-Za-z0-9.]{5,25}') AS valid FROM raw_line")
def _(t):
    code = F.col("product_code")
    return raw_lines(t).select(code.alias("code"), text.is_product_code(code).alias("valid")).distinct()


@query("clean_money", f"SELECT doc_id, price_text, {money_sql('price_text')} AS amount FROM raw_line")
def _(t):
    return raw_lines(t).select(
        "doc_id", F.col("unit_price").alias("price_text"), text.clean_money(F.col("unit_price")).cast("double").alias("amount")
    )


@query("clean_quantity", f"SELECT doc_id, quantity_text, {QTY} AS quantity FROM raw_line")
def _(t):
    return raw_lines(t).select(
        "doc_id", F.col("quantity").alias("quantity_text"), text.clean_quantity(F.col("quantity")).cast("double").alias("quantity")
    )


def order_documents(t: StarTables):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    status = F.col("o_orderstatus")
    day = F.date_format("o_orderdate", "dd/MM/yyyy")
    return t.raw("orders").select(
        key.alias("doc_id"),
        F.when(cust % 10 != 3, F.lpad(cust.cast("string"), 10, "0")).alias("tax_code_mail"),
        F.when(cust % 2 == 0, F.format_string("T%09d", cust)).otherwise(F.lit("")).alias("tax_code_pdf"),
        F.when(status == "F", day).when(status == "O", F.lit("31/02/2000")).otherwise(F.lit("")).alias("order_date_pdf"),
        F.when(key % 2 == 0, day).alias("order_date_mail"),
        F.when(key % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("Customer "), cust.cast("string"))).alias("customer_pdf"),
        F.concat(F.lit("Mail "), cust.cast("string")).alias("customer_mail"),
        F.when(key % 4 == 0, F.col("o_orderpriority")).alias("address_pdf"),
        F.col("o_orderstatus").alias("address_mail"),
        F.when(key % 5 == 0, F.lit(None)).otherwise(F.format_string("BH01.%04d", key % 10000)).alias("so_number_pdf"),
        key.cast("string").alias("file_name"),
        F.when(key % 7 == 0, F.concat(F.lit("Đơn hàng ngày "), day)).otherwise(F.lit("Đơn hàng")).alias("subject"),
        F.when(key % 11 != 0, F.col("o_orderdate")).alias("received_at"),
        F.floor("o_totalprice").cast("bigint").alias("total"),
        status.alias("order_status"),
        cust.alias("custkey"),
    )


cte(
    "order_doc",
    """
SELECT o_orderkey AS doc_id, CASE WHEN o_custkey % 10 <> 3 THEN lpad(CAST(o_custkey AS VARCHAR), 10, '0') END AS tax_code_mail,
  CASE WHEN o_custkey % 2 = 0 THEN printf('T%09d', o_custkey) ELSE '' END AS tax_code_pdf,
  CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 'O' THEN '31/02/2000' ELSE '' END AS order_date_pdf,
  CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%d/%m/%Y') END AS order_date_mail,
  CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Customer ' || CAST(o_custkey AS VARCHAR) END AS customer_pdf,
  'Mail ' || CAST(o_custkey AS VARCHAR) AS customer_mail, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority END AS address_pdf,
  o_orderstatus AS address_mail, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE printf('BH01.%04d', o_orderkey % 10000) END AS so_number_pdf,
  CAST(o_orderkey AS VARCHAR) AS file_name,
  CASE WHEN o_orderkey % 7 = 0 THEN 'Đơn hàng ngày ' || strftime(o_orderdate, '%d/%m/%Y') ELSE 'Đơn hàng' END AS subject,
  CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS received_at, CAST(floor(o_totalprice) AS BIGINT) AS total, o_orderstatus, o_custkey
FROM orders""",
)


@query(
    "coalesce_sources",
    """SELECT doc_id, coalesce(nullif(tax_code_mail, ''), nullif(tax_code_pdf, '')) AS tax_code,
    coalesce(nullif(order_date_pdf, ''), nullif(order_date_mail, '')) AS order_date_text,
    coalesce(nullif(customer_pdf, ''), customer_mail) AS customer_name, coalesce(nullif(address_pdf, ''), address_mail) AS address,
    coalesce(nullif(so_number_pdf, ''), file_name) AS so_number FROM order_doc""",
)
def _(t):
    return documents.coalesce_sources(order_documents(t)).select(
        "doc_id", "tax_code", "order_date_text", "customer_name", "address", "so_number"
    )


@query(
    "order_date_cascade",
    """SELECT doc_id, coalesce(try_strptime(order_date_pdf, '%d/%m/%Y')::DATE, try_strptime(order_date_mail, '%d/%m/%Y')::DATE,
    try_strptime(regexp_extract(subject, '(\\d{2}/\\d{2}/\\d{4})', 1), '%d/%m/%Y')::DATE, received_at::DATE) AS order_date FROM order_doc""",
)
def _(t):
    cols = [F.col(c) for c in ("order_date_pdf", "order_date_mail", "subject", "received_at")]
    return order_documents(t).select("doc_id", text.order_date_cascade(*cols).alias("order_date"))


def checked_documents(t: StarTables):
    docs = documents.coalesce_sources(order_documents(t)).select(
        "doc_id",
        "tax_code",
        "order_date_text",
        F.when(F.col("order_status") == "O", 0).otherwise(F.col("total")).cast("decimal(20,2)").alias("pdf_total"),
        (F.col("total") + (F.col("custkey") % 3) * 10).cast("decimal(20,2)").alias("email_total"),
        (F.col("custkey") % 13 != 0).alias("has_pdf"),
    )
    lines = t.raw("lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_extendedprice").cast("decimal(15,2)").alias("line_total")
    )
    return documents.total_check(docs, lines)


cte(
    "doc_checked",
    """
SELECT *, array_to_string(list_filter([CASE WHEN coalesce(tax_code, '') = '' THEN 'missing tax code' END,
  CASE WHEN coalesce(order_date_text, '') = '' THEN 'missing order date' END, CASE WHEN pdf_total <= 0 THEN 'no invoice total' END,
  CASE WHEN pdf_total > 0 AND abs(calc_total - pdf_total) > 10 THEN 'line sum differs from invoice total' END,
  CASE WHEN email_total > 0 AND pdf_total > 0 AND abs(pdf_total - email_total) > 10 THEN 'invoice total differs from mail total' END],
  lambda x: x IS NOT NULL), ' | ') AS warning_message
FROM (SELECT d.doc_id, coalesce(nullif(tax_code_mail, ''), nullif(tax_code_pdf, '')) AS tax_code,
    coalesce(nullif(order_date_pdf, ''), nullif(order_date_mail, '')) AS order_date_text, CASE WHEN o_orderstatus = 'O' THEN 0 ELSE total END AS pdf_total,
    total + (o_custkey % 3) * 10 AS email_total, coalesce(l.s, 0) AS calc_total, coalesce(l.n, 0) AS line_count, o_custkey % 13 <> 0 AS has_pdf
  FROM order_doc d LEFT JOIN (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS s, count(*) AS n FROM lineitem GROUP BY 1) l
  ON l.l_orderkey = d.doc_id)""",
)


@query(
    "three_way_total_check",
    """SELECT doc_id, CAST(calc_total AS DOUBLE) AS calc_total, CAST(pdf_total AS DOUBLE) AS pdf_total, CAST(email_total AS DOUBLE) AS email_total,
    line_count, warning_message FROM doc_checked""",
)
def _(t):
    return checked_documents(t).select(
        "doc_id",
        *[F.col(c).cast("double").alias(c) for c in ("calc_total", "pdf_total", "email_total")],
        "line_count",
        F.concat_ws(" | ", "warnings").alias("warning_message"),
    )


@query(
    "route_status",
    """SELECT doc_id, CASE WHEN NOT has_pdf THEN 'FAILED_NO_ATTACHMENT' WHEN line_count = 0 THEN 'PARSE_FAILED' ELSE 'READY_TO_INSERT' END AS status,
    nullif(warning_message, '') AS warning_message FROM doc_checked""",
)
def _(t):
    return documents.route_status(checked_documents(t), F.col("has_pdf")).select("doc_id", "status", "warning_message")


@query(
    "noise_keyword_share",
    """SELECT count(*) FILTER (WHERE lower(n) LIKE '%nnp%') AS damaged_rows, count(*) AS all_rows,
    100.0 * count(*) FILTER (WHERE lower(n) LIKE '%nnp%') / count(*) AS damaged_pct
    FROM (SELECT CASE WHEN p_size % 4 = 0 THEN 'XeNNPThnngNhnt ' || p_name ELSE p_name END AS n FROM part)""",
    rounded="damaged_pct",
)
def _(t):
    name = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("XeNNPThnngNhnt "), "p_name")).otherwise(F.col("p_name"))
    return audit.damaged_share(t.raw("part").select(name.alias("n")), text.has_damaged_token(F.col("n")))


ASKED = ["", " Dự báo tháng sau?", " thống kê và dự báo", " xu hướng"]


def like_any(column: str, words) -> str:
    return " OR ".join(f"contains({column}, '{w}')" for w in words)


@query(
    "route_question",
    f"""SELECT CASE WHEN ({like_any('q', params.FORECAST_WORDS)}) AND NOT ({like_any('q', params.HISTORY_WORDS)}) THEN 'forecast' ELSE 'history' END AS route,
    count(*) AS n FROM (SELECT lower(text || {pick_sql(ASKED, '(conv_id + turn) % 4')}) AS q FROM conversations) GROUP BY 1""",
)
def _(t):
    asked = pick(ASKED, (F.col("conv_id") + F.col("turn")) % 4)
    return documents.route_counts(t.raw("conversations").select(F.concat("text", asked).alias("text")))


# scalar cleaning -----------------------------------------------------------------------


@query(
    "title_case",
    """SELECT doc_id, array_to_string(list_transform(regexp_extract_all(lower(source || '/' || lang || '-' || text), '([\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+)'),
    lambda w: CASE WHEN w[1] = 'ß' THEN w ELSE upper(w[1]) || w[2:] END), '') AS titled FROM documents""",
)
def _(t):
    value = F.concat("source", F.lit("/"), "lang", F.lit("-"), "text")
    return t.raw("documents").select("doc_id", text.title_case(value).alias("titled"))


COLOR_CASE = "CASE c " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in params.BASE_COLORS.items()) + " ELSE c END"


@query(
    "base_color",
    f"""SELECT p_partkey, c AS color, coalesce(nullif({COLOR_CASE}, ''), 'Chưa xác định') AS base_color FROM (
    SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN NULL WHEN p_size % 10 = 1 THEN split_part(p_name, ' ', 1) ELSE
    {pick_sql(VN_COLORS, f'p_partkey % {len(VN_COLORS)}')} END AS c FROM part)""",
)
def _(t):
    size = F.col("p_size") % 10
    color = F.when(size == 0, F.lit(None)).when(size == 1, F.split("p_name", " ")[0]).otherwise(
        pick(VN_COLORS, F.col("p_partkey") % len(VN_COLORS))
    )
    return t.raw("part").select("p_partkey", color.alias("color")).withColumn(
        "base_color", text.base_color(F.col("color"), unknown=params.UNKNOWN_LABEL)
    )


COLOR_RULES = "CASE " + " ".join(f"WHEN contains(n, '{w}') THEN '{c}'" for w, c in params.COLOR_WORDS)
NAME_COLORS = ["", " màu Đỏ", " XANH rêu", " Tím", " trắng", " coban", " ghi"]


@query(
    "color_from_name",
    f"""SELECT p_partkey, {COLOR_RULES} ELSE coalesce(nullif(raw, ''), 'Chưa xác định') END AS color FROM (SELECT p_partkey,
    lower(p_name || {pick_sql(NAME_COLORS, 'p_partkey % 7')}) AS n, CASE WHEN p_size % 3 = 0 THEN p_brand WHEN p_size % 3 = 1 THEN '' END AS raw FROM part)""",
)
def _(t):
    name = F.concat("p_name", pick(NAME_COLORS, F.col("p_partkey") % 7))
    raw = F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).when(F.col("p_size") % 3 == 1, "")
    return t.raw("part").select("p_partkey", text.color_from_name(name, raw).alias("color"))


def key_sql(column: str) -> str:
    out = f"regexp_replace(lower({column}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
    for word in params.KEY_NOISE:
        out = f"replace({out}, '{word}', '')"
    return out


@query("normalize_key", f"SELECT p_partkey, {key_sql(chr(39) + 'Xe ĐẠP. TE ' + chr(39) + ' || p_name || p_brand')} AS product_key FROM part")
def _(t):
    return t.raw("part").select(
        "p_partkey", text.normalize_key(F.concat(F.lit("Xe ĐẠP. TE "), "p_name", "p_brand")).alias("product_key")
    )


@query(
    "build_product_name",
    """SELECT product_code, CASE WHEN line_name IS NOT NULL THEN trim('Xe ' || trim(replace(line_name || ' (IP - Bản quyền)', '(IP - Bản quyền', ''))
    || ' ' || color) ELSE product_name END AS product_name_clean FROM dim_product""",
)
def _(t):
    line = F.when(F.col("line_name").isNotNull(), F.concat("line_name", F.lit(" (IP - Bản quyền)")))
    return t.product().select(
        "product_code", text.build_product_name(line, F.col("color"), F.col("product_name"), "Xe").alias("product_name_clean")
    )


def code_corrections(t: StarTables):
    return t.raw("part").where("p_size > 40").select(
        F.col("p_partkey").cast("string").alias("product_code"),
        F.upper("p_name").alias("product_name"),
        F.when(F.col("p_size") > 45, F.lit("Đen")).alias("color"),
    )


@query(
    "override_by_code",
    """SELECT p.product_code, CASE WHEN s.p_size > 40 THEN upper(p.product_name) ELSE p.product_name END AS product_name,
    CASE WHEN s.p_size > 45 THEN 'Đen' ELSE p.color END AS color FROM dim_product p JOIN part s ON CAST(s.p_partkey AS VARCHAR) = p.product_code""",
)
def _(t):
    return cleaning.override_by_code(
        t.product().select("product_code", "product_name", "color"), code_corrections(t), ["product_name", "color"]
    )


SAMPLE_NAMES = [
    "gn 06-27 2.0 pro shimano", "Super 26", "Super 26 S", "Super 24", "Super 20", "Super 20 Man", "Batman16", "BATMAN12",
    "Bubbles 20", "Road RPD 700C", "RPD 700C V5", "GRX AT 27,5 x 2.0", "GRX AT 27.5 2.0", "The flash 20", "New 26 DA", "New 24",
    "LD 24-02", "Neo 20-03", "LD 24-01", "MTB 26 02", "LD 26", "MTB SPD 27.5", "Nữ 0209", "Super Man 12", "Super Man 16",
    "Powerpuff Girls 12", "Wonder Woman 20", "GN 06 24 D", "GN 06-26 2.0", "GN 06-26", "nam 0209", "SuperMan nam",
]


def rule_sql(include, exclude) -> str:
    def hit(pattern):
        if isinstance(pattern, tuple):
            return "(" + " OR ".join(hit(p) for p in pattern) + ")"
        return f"n ILIKE '%{pattern}%'"

    return " AND ".join([hit(p) for p in include] + [f"NOT {hit(p)}" for p in exclude])


LADDER = "CASE " + " ".join(f"WHEN {rule_sql(i, e)} THEN '{x}'" for i, e, x in params.LINE_RULES) + " END"


@query(
    "rule_assign_line",
    f"""SELECT p_partkey, n AS product_name, coalesce(own, l.line_id) AS line_id FROM (SELECT p_partkey, n, own, {LADDER} AS line_name FROM (
    SELECT p_partkey, 'Xe ' || {pick_sql(SAMPLE_NAMES, f'p_partkey % {len(SAMPLE_NAMES)}')} || ' ' || p_name AS n,
    CASE WHEN p_size % 6 = 0 THEN 1000 + p_size END AS own FROM part))
    LEFT JOIN (SELECT {pick_sql(TARGETS, f'p_partkey % {len(TARGETS)}')} AS line_name, min(CAST(p_partkey % {len(TARGETS)} AS INTEGER)) AS line_id
      FROM part GROUP BY 1) l USING (line_name)""",
)
def _(t):
    part = t.raw("part")
    products = part.select(
        "p_partkey",
        F.concat(F.lit("Xe "), pick(SAMPLE_NAMES, F.col("p_partkey") % len(SAMPLE_NAMES)), F.lit(" "), "p_name").alias("product_name"),
        F.when(F.col("p_size") % 6 == 0, F.col("p_size") + 1000).alias("line_id"),
    )
    number = F.col("p_partkey") % len(TARGETS)
    lines = part.select(pick(TARGETS, number).alias("line_name"), number.cast("int").alias("line_id")).distinct()
    return cleaning.rule_assign_line(products, lines)


@query(
    "normalize_id",
    """SELECT p_partkey, x AS raw_id, coalesce(CAST(CAST(trunc(try_cast(x AS DOUBLE)) AS BIGINT) AS VARCHAR), x) AS clean_id FROM (
    SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN CAST(p_partkey AS VARCHAR) || '.0' WHEN 1 THEN p_brand WHEN 2 THEN CAST(p_partkey AS VARCHAR) END AS x
    FROM part)""",
)
def _(t):
    size, key = F.col("p_size") % 4, F.col("p_partkey").cast("string")
    raw = F.when(size == 0, F.concat(key, F.lit(".0"))).when(size == 1, F.col("p_brand")).when(size == 2, key)
    return t.raw("part").select("p_partkey", raw.alias("raw_id")).withColumn("clean_id", text.normalize_id(F.col("raw_id")))


@query("normalize_so_number", "SELECT o_orderkey, replace('BH25_' || CAST(o_orderkey AS VARCHAR) || '_1', '_', '.') AS so_number FROM orders")
def _(t):
    raw = F.concat(F.lit("BH25_"), F.col("o_orderkey").cast("string"), F.lit("_1"))
    return t.raw("orders").select("o_orderkey", text.normalize_so_number(raw).alias("so_number"))


# nested data ------------------------------------------------------------------------------

LINE_FIELDS = ["line_id", "product_code", "quantity", "unit_price", "line_total"]


def nested(t: StarTables):
    lines = t.fact("so_number", "order_date", "customer_code", *LINE_FIELDS)
    return documents.nest_orders(lines, ["order_date", "customer_code"], LINE_FIELDS, ["line_id", "product_code"])


@query(
    "nest_orders",
    """SELECT so_number, any_value(order_date) AS order_date, any_value(customer_code) AS customer_code, count(*) AS n_lines,
    CAST(sum(line_total) AS DOUBLE) AS total FROM fact GROUP BY 1""",
)
def _(t):
    total = F.aggregate("lines", F.lit(0).cast("decimal(38,2)"), lambda s, x: (s + x["line_total"]).cast("decimal(38,2)"))
    return nested(t).select(
        "so_number", "order_date", "customer_code", F.size("lines").cast("bigint").alias("n_lines"), total.cast("double").alias("total")
    )


@query(
    "flatten_orders",
    """SELECT so_number, order_date, customer_code, line_id, product_code, CAST(quantity AS DOUBLE) AS quantity,
    CAST(unit_price AS DOUBLE) AS unit_price, CAST(line_total AS DOUBLE) AS line_total FROM fact""",
)
def _(t):
    flat = documents.flatten_orders(nested(t))
    return flat.withColumns({c: F.col(c).cast("double") for c in ("quantity", "unit_price", "line_total")})


# joins on master data -----------------------------------------------------------------------


@query("join_inner_equi", "SELECT f.so_number, f.line_id, f.product_code, c.customer_name, c.customer_tier FROM fact f JOIN dim_customer c USING (customer_code)")
def _(t):
    return t.fact("so_number", "line_id", "product_code", "customer_name", "customer_tier")


@query(
    "join_left_dim",
    """SELECT c.customer_code, coalesce(v.province_name, 'Chưa xác định') AS province_name, coalesce(v.region, 'Chưa xác định') AS region
    FROM dim_customer c LEFT JOIN dim_province v USING (province_id)""",
)
def _(t):
    label = F.lit(params.UNKNOWN_LABEL)
    return t.customer().join(t.province(), "province_id", "left").select(
        "customer_code", F.coalesce("province_name", label).alias("province_name"), F.coalesce("region", label).alias("region")
    )


cte(
    "province_clean",
    """SELECT v.province_id, v.province_name AS province_name_raw, v.region AS region_raw, coalesce(m.province_name_clean, v.province_name) AS province_name_clean,
    coalesce(m.region_clean, v.region) AS region_clean, coalesce(m.mapping_type, 'keep') AS mapping_type, m.note
    FROM dim_province v LEFT JOIN dim_correction m ON m.raw_province_id = v.province_id""",
)


def clean_provinces(t: StarTables):
    return cleaning.apply_correction_map(t.province(), t.province_corrections())


@query("apply_correction_map", "SELECT * FROM province_clean")
def _(t):
    return clean_provinces(t)


@query(
    "changed_rows",
    """SELECT * FROM province_clean WHERE province_name_raw IS DISTINCT FROM province_name_clean OR region_raw IS DISTINCT FROM region_clean""",
)
def _(t):
    return cleaning.changed_rows(clean_provinces(t), [("province_name_raw", "province_name_clean"), ("region_raw", "region_clean")])


cte(
    "address_hit",
    """SELECT customer_code, province_id, pos, size FROM (SELECT *, row_number() OVER (PARTITION BY customer_code ORDER BY pos DESC, size DESC, province_id) AS rn
    FROM (SELECT c.customer_code, v.province_id, strpos(lower(c.address), lower(v.province_name_clean)) AS pos, length(v.province_name_clean) AS size
      FROM dim_customer c JOIN province_clean v ON contains(lower(c.address), lower(v.province_name_clean)) WHERE c.province_id IS NULL)) WHERE rn = 1""",
)


@query("join_address_to_province", "SELECT customer_code, province_id FROM address_hit")
def _(t):
    return cleaning.join_address_to_province(t.customer(), clean_provinces(t))


@query(
    "rank_best_match",
    """SELECT c.customer_code, coalesce(c.province_id, h.province_id) AS province_id FROM dim_customer c LEFT JOIN address_hit h USING (customer_code)""",
)
def _(t):
    found = cleaning.join_address_to_province(t.customer(), clean_provinces(t)).withColumnRenamed("province_id", "found")
    return t.customer().join(found, "customer_code", "left").select(
        "customer_code", F.coalesce("province_id", "found").alias("province_id")
    )


@query(
    "sync_from_dim",
    """SELECT f.so_number, f.line_id, f.product_code, CASE WHEN h.customer_code IS NOT NULL THEN h.province_id ELSE f.province_id END AS province_id
    FROM fact f LEFT JOIN address_hit h USING (customer_code)""",
)
def _(t):
    found = cleaning.join_address_to_province(t.customer(), clean_provinces(t))
    fact = t.fact("so_number", "line_id", "product_code", "customer_code", "province_id")
    return cleaning.sync_from_dimension(fact, found, "customer_code", ["province_id"]).drop("customer_code")


@query("anti_join_orphans", "SELECT order_id, customer_code FROM sales_order WHERE order_id NOT IN (SELECT order_id FROM order_line)")
def _(t):
    return cleaning.orphans(t.orders().select("order_id", "customer_code"), t.lines(), "order_id")


@query(
    "semi_join_membership",
    """SELECT so_number, line_id, product_code, CAST(line_total AS DOUBLE) AS line_total FROM order_line
    WHERE product_code IN (SELECT product_code FROM dim_product WHERE line_id_fk IS NULL)""",
)
def _(t):
    unmapped = t.product().where("line_id_fk is null")
    rows = t.lines().select("so_number", "line_id", "product_code", F.col("line_total").cast("double").alias("line_total"))
    return cleaning.semi_join_membership(rows, unmapped, ["product_code"])


@query(
    "join_contains_unique",
    """SELECT k.product_key, CASE WHEN count(l.line_key) = 1 THEN min(l.line_id) END AS line_id FROM (
      SELECT DISTINCT CASE WHEN p_size % 9 = 0 THEN '' WHEN p_size % 9 = 1 THEN lower(split_part(p_name, ' ', 2)) WHEN p_size % 9 = 2 THEN lower(substr(p_type, 1, 4))
        ELSE lower(regexp_replace(p_name || p_type || p_brand, '[^A-Za-z0-9]', '', 'g')) END AS product_key FROM part) k
    LEFT JOIN (SELECT lower(regexp_replace(line_name, '[^A-Za-z0-9]', '', 'g')) AS line_key, max(line_id) AS line_id FROM dim_line GROUP BY 1) l
    ON contains(k.product_key, l.line_key) OR contains(l.line_key, k.product_key) GROUP BY 1""",
)
def _(t):
    plain = r"[^A-Za-z0-9]"
    size = F.col("p_size") % 9
    key = (
        F.when(size == 0, F.lit(""))
        .when(size == 1, F.lower(F.split("p_name", " ")[1]))
        .when(size == 2, F.lower(F.substring("p_type", 1, 4)))
        .otherwise(F.lower(F.regexp_replace(F.concat("p_name", "p_type", "p_brand"), plain, "")))
    )
    names = t.raw("part").select(key.alias("product_key"))
    lines = t.product_line().select("line_id", F.lower(F.regexp_replace("line_name", plain, "")).alias("line_key"))
    return cleaning.join_contains_unique(names, lines)


def buyers(t: StarTables):
    """Buyers of the order documents; every third one is not a customer yet."""
    cust = F.col("o_custkey")
    tax = F.when(cust % 10 == 3, F.lit(None)).when(cust % 3 == 0, F.format_string("9%09d", cust)).otherwise(F.lpad(cust.cast("string"), 10, "0"))
    return t.raw("orders").select(
        tax.cast("string").alias("tax_code"), F.when(cust % 2 == 0, F.concat(F.lit("Buyer "), cust.cast("string"))).alias("customer_name"),
        F.col("o_orderpriority").alias("address"),
    )


@query(
    "upsert_customer",
    """SELECT printf('KH-%05d', row_number() OVER (ORDER BY md5(tax_code), tax_code)) AS customer_code,
    coalesce(customer_name, 'Khách hàng ' || tax_code) AS customer_name, tax_code, address FROM (
    SELECT tax_code, min(customer_name) AS customer_name, min(o_orderpriority) AS address FROM (SELECT *, CASE WHEN o_custkey % 10 = 3 THEN NULL
      WHEN o_custkey % 3 = 0 THEN printf('9%09d', o_custkey) ELSE lpad(CAST(o_custkey AS VARCHAR), 10, '0') END AS tax_code,
      CASE WHEN o_custkey % 2 = 0 THEN 'Buyer ' || CAST(o_custkey AS VARCHAR) END AS customer_name FROM orders)
    WHERE tax_code IS NOT NULL AND tax_code NOT IN (SELECT trim(tax_code) FROM dim_customer WHERE tax_code IS NOT NULL) GROUP BY 1)""",
)
def _(t):
    return cleaning.upsert_customers(t.customer(), buyers(t))


@query(
    "insert_missing_products",
    """SELECT product_code, product_name, color, base_color FROM dim_product UNION ALL
    SELECT code, min(coalesce(nm, code)), NULL, 'Chưa xác định' FROM (SELECT 'N' || CAST(l_partkey AS VARCHAR) AS code,
    CASE WHEN l_partkey % 2 = 0 THEN 'New ' || CAST(l_partkey AS VARCHAR) END AS nm FROM lineitem WHERE l_quantity > 49) GROUP BY 1""",
)
def _(t):
    part = F.col("l_partkey").cast("string")
    code = F.when(F.col("l_quantity") > 49, F.concat(F.lit("N"), part)).otherwise(part)
    lines = t.raw("lineitem").select(
        code.alias("product_code"),
        F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("New "), part)).alias("product_name"),
        F.lit(None).cast("string").alias("color"),
    )
    return cleaning.insert_missing_products(t.product().select("product_code", "product_name", "color", "base_color"), lines)


# sources and sinks ------------------------------------------------------------------------------


@query("scan_parquet", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem")
def _(t):
    return readers.scan_parquet(t.spark, f"{t.folder}/lineitem.parquet", "l_orderkey", "l_partkey", "l_quantity")


DOUBLES = ("quantity", "unit_price", "line_total")
FACT_SQL = "SELECT " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" if c in DOUBLES else c for c in FACT_COLUMNS) + " FROM {}"


@query("build_fact", FACT_SQL.format("fact"))
def _(t):
    return t.fact().withColumns({c: F.col(c).cast("double") for c in DOUBLES})


def folder(t: StarTables, name: str) -> str:
    return f"{work_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "scan_typed_csv",
    "SELECT customer_code, customer_name, tax_code, replace(address, ', ', ',' || chr(10)) AS address, CAST(province_id AS VARCHAR) AS province_id FROM dim_customer",
)
def _(t):
    columns = ["customer_code", "customer_name", "tax_code", "address", "province_id", "customer_tier"]
    rows = t.customer().withColumn("address", F.replace("address", F.lit(", "), F.lit(",\n"))).select(*columns)
    path = folder(t, "customer_csv")
    readers.write_csv(rows.withColumn("is_active", F.lit(True)), path)
    scanned = readers.scan_typed_csv(t.spark, path, readers.CSV_SCHEMAS["customer"])
    return scanned.select("customer_code", "customer_name", "tax_code", "address", "province_id")


@query(
    "scan_nested_json",
    "SELECT so_number, customer_name, product_code, CAST(quantity AS VARCHAR) AS quantity, CAST(line_total AS VARCHAR) AS line_total FROM fact",
)
def _(t):
    lines = t.fact("so_number", "customer_name", "line_id", "product_code", "quantity", "line_total")
    texts = lines.withColumns({c: F.col(c).cast("string") for c in ("quantity", "line_total")})
    orders = documents.nest_orders(
        texts, ["customer_name"], ["line_id", "product_code", "quantity", "line_total"], ["line_id", "product_code"]
    )
    # one document per order: the nested layout of the order files
    one = orders.select(F.array(F.struct("so_number", "customer_name", "lines")).alias("ready_orders"))
    path = folder(t, "orders_json")
    readers.write_json(one, path)
    read = readers.scan_orders_json(t.spark, path)
    return documents.flatten_orders(read.select("so_number", "customer_name", "lines")).select(
        "so_number", "customer_name", "product_code", "quantity", "line_total"
    )


@query(
    "write_parquet_csv_json",
    """SELECT f AS format, processing_status, count(*) AS n FROM mail_log, (VALUES ('csv'), ('json'), ('parquet')) v(f) GROUP BY 1, 2""",
)
def _(t):
    log = t.email_log().select("message_id", "processing_status")
    schema = "message_id string, processing_status string"
    parts = []
    for kind, write in (("parquet", readers.write_parquet), ("csv", readers.write_csv), ("json", readers.write_json)):
        path = folder(t, f"log_{kind}")
        write(log, path)
        reader = t.spark.read.schema(schema).option("header", True)
        parts.append(reader.format(kind).load(path).withColumn("format", F.lit(kind)))
    return audit.union_all(parts).groupBy("format", "processing_status").agg(F.count(F.lit(1)).alias("n"))


def in_month(month: tuple[int, int]):
    return (F.col("fiscal_year") == month[0]) & (F.col("fiscal_month") == month[1])


@query("append_log", "SELECT message_id, CAST(received_at AS DATE) AS received_on, processing_status FROM mail_log")
def _(t):
    path, keys = folder(t, "email_log"), ["received_year", "received_month"]
    log = t.email_log().withColumns({"received_year": F.year("received_at"), "received_month": F.month("received_at")})
    log = log.repartition(*keys)  # one file for each month
    ready = F.col("processing_status") == "READY_TO_INSERT"
    versions.commit(log.where(ready), path, keys, replaced=[])
    versions.commit(log.where(~F.coalesce(ready, F.lit(False))), path, keys, replaced=[])
    return versions.read(t.spark, path).select("message_id", F.col("received_at").cast("date").alias("received_on"), "processing_status")


@query(
    "replace_period",
    """SELECT order_id, order_date, CAST(CASE WHEN order_date BETWEEN DATE '2001-03-01' AND DATE '2001-03-31' THEN total_amount * 2 ELSE total_amount END AS DOUBLE)
    AS total_amount FROM sales_order""",
)
def _(t):
    path, keys = folder(t, "orders_by_day"), ["fiscal_year", "fiscal_month"]
    orders = t.orders().select("order_id", "order_date", F.col("total_amount").cast("double").alias("total_amount"), *keys)
    versions.commit(orders.repartition(*keys), path, keys)
    stored = versions.read(t.spark, path)
    reload = orders.withColumn("total_amount", F.col("total_amount") * 2)
    month = (CALENDAR.year_b, CALENDAR.block_months[-1])
    changed = cleaning.replace_period(stored.where(in_month(month)), reload, CALENDAR.last_month_start, CALENDAR.as_of)
    versions.commit(changed, path, keys, replaced=[month])
    return versions.read(t.spark, path).select("order_id", "order_date", "total_amount")


@query(
    "replace_period_partitions",
    """SELECT fiscal_year, fiscal_month, count(*) AS n, CAST(sum(CASE WHEN fiscal_year = 2001 AND fiscal_month = 3 THEN total_amount * 2 ELSE total_amount END) AS DOUBLE)
    AS total_amount FROM sales_order GROUP BY 1, 2""",
)
def _(t):
    path, keys = folder(t, "orders_by_month"), ["fiscal_year", "fiscal_month"]
    orders = t.orders().select("order_id", "total_amount", *keys)
    versions.commit(orders.repartition(*keys), path, keys)
    month = (CALENDAR.year_b, CALENDAR.block_months[-1])
    reload = orders.where(in_month(month)).withColumn("total_amount", (F.col("total_amount") * 2).cast("decimal(15,2)"))
    versions.commit(reload, path, keys, replaced=[month])
    stored = versions.read(t.spark, path)
    return stored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("total_amount").cast("double").alias("total_amount"))


@query("input_manifest")
def _(t):
    return manifest.input_manifest(t.spark, t.folder, "*.parquet")


@query(
    "input_manifest_by_nation",
    """SELECT CAST(sum(strlen(line) + 1) AS BIGINT) AS n_bytes, sha256(string_agg(line || chr(10), '' ORDER BY c_custkey)) AS sha256
    FROM (SELECT c_nationkey, c_custkey, c_custkey || ',' || c_name AS line FROM customer) GROUP BY c_nationkey""",
)
def _(t):
    """Customers written as one text file for each nation: their sizes and hashes follow from the rows."""
    path = folder(t, "customer_texts")
    rows = t.raw("customer").select("c_nationkey", "c_custkey", F.concat_ws(",", "c_custkey", "c_name").alias("line"))
    rows = rows.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey")
    rows.select("c_nationkey", "line").write.partitionBy("c_nationkey").text(path)
    return manifest.input_manifest(t.spark, path, "*/part-*").select("n_bytes", "sha256")
