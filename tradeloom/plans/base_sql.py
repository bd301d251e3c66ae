"""SQL twin of the star schema adapter."""

from tradeloom.plans.registry import cte

AS_OF = "DATE '2001-03-31'"

cte(
    "dim_product",
    """
SELECT CAST(p_partkey AS VARCHAR) AS product_code, p_name AS product_name, split_part(p_name, ' ', 1) AS color,
  CASE split_part(p_name, ' ', 1) WHEN 'red' THEN 'warm' WHEN 'hot' THEN 'warm' WHEN 'blue' THEN 'cool'
    WHEN 'cold' THEN 'cool' ELSE split_part(p_name, ' ', 1) END AS base_color,
  CASE WHEN p_partkey % 5 <> 0 THEN CAST(ascii(p_type) * 10000 + ascii(substr(p_type, 2, 1)) * 100
    + CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) AS INTEGER) END AS line_id_fk,
  CASE WHEN p_partkey % 5 <> 0 THEN p_type || ' ' || p_brand END AS line_name,
  CASE WHEN p_partkey % 5 <> 0 THEN p_type END AS group_code,
  CASE WHEN p_partkey % 5 <> 0 THEN p_type END AS group_name
FROM part""",
)
cte("dim_line", "SELECT DISTINCT line_id_fk AS line_id, line_name, group_code FROM dim_product WHERE line_id_fk IS NOT NULL")
cte("dim_group", "SELECT DISTINCT p_type AS group_code, p_type AS group_name FROM part")
cte(
    "dim_province",
    """
SELECT n_nationkey AS province_id, n_name AS province_name, r_name AS region
FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
cte(
    "dim_correction",
    """
SELECT n_nationkey AS raw_province_id, 'NATION_' || CAST((n_nationkey + 1) % 25 AS VARCHAR) AS province_name_clean,
  CASE WHEN n_nationkey % 10 = 0 THEN 'NORTH' END AS region_clean,
  CASE WHEN n_nationkey % 10 = 0 THEN 'fix_typo' ELSE 'normalize_text' END AS mapping_type,
  'was ' || n_name AS note
FROM nation WHERE n_nationkey % 5 = 0""",
)
cte(
    "dim_customer",
    """
SELECT CAST(c_custkey AS VARCHAR) AS customer_code, c_name AS customer_name, c_mktsegment AS customer_tier,
  CASE WHEN c_custkey % 20 <> 0 THEN c_nationkey END AS province_id,
  CASE WHEN c_custkey % 10 = 3 THEN NULL WHEN c_custkey % 10 = 7 THEN '  '
    ELSE lpad(CAST(c_custkey AS VARCHAR), 10, '0') END AS tax_code,
  'No. ' || CAST(c_custkey AS VARCHAR) || ', Nation_' || CAST(c_nationkey AS VARCHAR) || ' street, NATION_'
    || CAST((c_nationkey + 7) % 25 AS VARCHAR) AS address
FROM customer""",
)
cte(
    "sales_order",
    """
SELECT o_orderkey AS order_id, CAST(o_orderkey AS VARCHAR) AS so_number, CAST(o_orderdate AS DATE) AS order_date,
  CAST(o_custkey AS VARCHAR) AS customer_code, CAST(o_totalprice AS DECIMAL(15,2)) AS total_amount,
  CAST(year(o_orderdate) AS INTEGER) AS fiscal_year, CAST(quarter(o_orderdate) AS INTEGER) AS fiscal_quarter,
  CAST(month(o_orderdate) AS INTEGER) AS fiscal_month, CAST(week(o_orderdate) AS INTEGER) AS week_of_year
FROM orders""",
)
cte(
    "mail_log",
    """
SELECT CAST(o_orderkey AS VARCHAR) AS message_id, o_orderdate AS received_at,
  CASE o_orderstatus WHEN 'F' THEN 'READY_TO_INSERT' WHEN 'O' THEN 'PARSE_FAILED'
    ELSE 'FAILED_NO_ATTACHMENT' END AS processing_status
FROM orders""",
)
cte(
    "order_line",
    """
SELECT CAST(l_orderkey AS VARCHAR) AS so_number, l_orderkey AS order_id, l_linenumber AS line_id,
  CAST(l_partkey AS VARCHAR) AS product_code, CAST(l_quantity AS DECIMAL(10,2)) AS quantity,
  CAST(((2 * CAST(round(l_extendedprice * 100) AS BIGINT) + CAST(l_quantity AS BIGINT))
    // (2 * CAST(l_quantity AS BIGINT))) / 100.0 AS DECIMAL(15,2)) AS unit_price,
  CAST(l_extendedprice AS DECIMAL(15,2)) AS line_total
FROM lineitem""",
)
cte(
    "fact",
    """
SELECT o.order_date, o.fiscal_year, o.fiscal_quarter, o.fiscal_month, o.week_of_year, l.so_number, l.order_id,
  l.line_id, o.customer_code, c.customer_name, c.customer_tier, c.province_id, v.province_name, v.region,
  l.product_code, p.product_name, p.color, p.base_color, p.line_id_fk, p.line_name, p.group_code, p.group_name,
  l.quantity, l.unit_price, l.line_total
FROM order_line l JOIN sales_order o ON o.order_id = l.order_id
JOIN dim_customer c ON c.customer_code = o.customer_code
JOIN dim_product p ON p.product_code = l.product_code
LEFT JOIN dim_province v ON v.province_id = c.province_id""",
)
cte("past", f"SELECT * FROM fact WHERE order_date <= {AS_OF}")
cte(
    "blocks",
    "SELECT * FROM fact WHERE fiscal_year IN (2000, 2001) AND fiscal_month IN (1, 2, 3)",
)
