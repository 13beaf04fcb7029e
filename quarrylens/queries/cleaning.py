"""Cleaning and coercion over whole tables whose dirt is placed by key, alike on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.operators import cleaning
from quarrylens.operators.merging import smart_merge
from quarrylens.queries.registry import query

# The same text runs in both engines: missing values, blanks, money text, negatives.
DIRTY_CUSTOMER = """
SELECT CASE WHEN c_custkey % 11 = 4 THEN NULL ELSE c_custkey END AS custkey,
       CASE WHEN c_custkey % 11 = 4 OR c_custkey % 7 = 2 THEN NULL ELSE c_mktsegment END AS segment,
       CASE WHEN c_custkey % 11 = 4 OR c_custkey % 5 = 3 THEN NULL ELSE c_acctbal END AS balance,
       CASE WHEN c_custkey % 11 = 4 THEN NULL ELSE c_acctbal - 3000 END AS net,
       CASE WHEN c_custkey > 0 THEN NULL ELSE CAST(NULL AS VARCHAR(10)) END AS "unnamed: 3",
       CASE WHEN c_custkey % 11 = 4 THEN NULL
            WHEN c_custkey % 4 = 1 THEN 'unknown'
            ELSE concat('$', CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR(20)), ' ') END AS money,
       CASE WHEN c_custkey % 11 = 4 THEN NULL
            WHEN c_custkey % 2 = 1 THEN 'n/a'
            ELSE CAST(c_nationkey AS VARCHAR(20)) END AS half
FROM {customer}
"""


def dirty_customer(t):
    return t.sql(DIRTY_CUSTOMER.replace('"unnamed: 3"', "`unnamed: 3`"), "customer")


DIRTY_SQL = "WITH dirty AS (" + DIRTY_CUSTOMER.replace("{customer}", "customer") + ")\n"

# 80% ISO dates, the rest text; "late" holds only 50%.
DIRTY_ORDERS = """
SELECT o_orderkey,
       CASE WHEN o_orderkey % 5 = 0 THEN 'pending'
            ELSE concat(CAST(year(o_orderdate) AS VARCHAR(4)), '-',
                        lpad(CAST(month(o_orderdate) AS VARCHAR(2)), 2, '0'), '-',
                        lpad(CAST(day(o_orderdate) AS VARCHAR(2)), 2, '0')) END AS placed,
       CASE WHEN o_orderkey % 2 = 0 THEN 'pending'
            ELSE concat(CAST(year(o_orderdate) AS VARCHAR(4)), '-01-15') END AS late,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL
            ELSE concat(lpad(CAST(month(o_orderdate) AS VARCHAR(2)), 2, '0'), '/',
                        lpad(CAST(day(o_orderdate) AS VARCHAR(2)), 2, '0'), '/',
                        CAST(year(o_orderdate) AS VARCHAR(4))) END AS slashed
FROM {orders}
"""
ORDERS_SQL = "WITH dirty AS (" + DIRTY_ORDERS.replace("{orders}", "orders") + ")\n"


@query("b1_drop_empty_rows", DIRTY_SQL + """
SELECT custkey, segment, balance FROM dirty
WHERE NOT (custkey IS NULL AND segment IS NULL AND balance IS NULL)
""", approx="balance")
def drop_empty_rows(t):
    return cleaning.drop_empty_rows(dirty_customer(t).select("custkey", "segment", "balance"))


@query("b2_drop_empty_columns", DIRTY_SQL + "SELECT custkey, segment, balance FROM dirty", approx="balance")
def drop_empty_columns(t):
    df = dirty_customer(t).withColumn("void", F.lit(None).cast("double"))
    return cleaning.drop_empty_columns(df.select("custkey", "void", "segment", "balance"))


@query("b3_trim_names", "SELECT n_name AS name, n_regionkey AS region FROM nation")
def trim_names(t):
    df = t.nation.select(F.col("n_name").alias("  name "), F.col("n_regionkey").alias("region "))
    return cleaning.trim_names(df)


@query("b4_snake_case_columns", """
SELECT c_custkey AS "cust_key", c_name AS "full_name", c_nationkey AS "col_2", c_mktsegment AS "cust_key_2"
FROM customer
""")
def snake_case_columns(t):
    df = t.customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return cleaning.snake_case_columns(df.toDF(" Cust Key ", "Full-Name", "$$", "cust.key"))


@query("b5_drop_unnamed", DIRTY_SQL + "SELECT custkey, segment FROM dirty")
def drop_unnamed(t):
    return cleaning.drop_unnamed(dirty_customer(t).select("custkey", "segment", "unnamed: 3"))


@query("b6_coerce_dates_gated", ORDERS_SQL + """
SELECT o_orderkey, try_cast(placed AS TIMESTAMP) AS placed, late, slashed FROM dirty
""")
def coerce_dates_gated(t):
    return cleaning.coerce_dates(t.sql(DIRTY_ORDERS, "orders"), gate=True)


@query("b7_coerce_dates", ORDERS_SQL + """
SELECT o_orderkey, try_cast(placed AS TIMESTAMP) AS placed, late,
       CAST(try_strptime(slashed, '%m/%d/%Y') AS TIMESTAMP) AS slashed FROM dirty
""")
def coerce_dates(t):
    return cleaning.coerce_dates(t.sql(DIRTY_ORDERS, "orders"), gate=False)


@query("b8_coerce_numeric", DIRTY_SQL + """
SELECT custkey, try_cast(replace(replace(money, '$', ''), ' ', '') AS DOUBLE) AS money, half FROM dirty
""")
def coerce_numeric(t):
    return cleaning.coerce_numeric(dirty_customer(t).select("custkey", "money", "half"))


@query("b9_coerce_numeric_sheet", """
SELECT c_custkey, try_cast(code AS DOUBLE) AS code, dollars FROM (
  SELECT c_custkey,
         CASE WHEN c_custkey % 9 < 5 THEN CAST(c_nationkey AS VARCHAR) ELSE 'n/a' END AS code,
         concat('$', CAST(c_nationkey AS VARCHAR)) AS dollars FROM customer)
""")
def coerce_numeric_sheet(t):
    nation = F.col("c_nationkey").cast("string")
    df = t.customer.select(
        "c_custkey",
        F.when(F.col("c_custkey") % 9 < 5, nation).otherwise("n/a").alias("code"),
        F.concat(F.lit("$"), nation).alias("dollars"),
    )
    return cleaning.coerce_numeric(df, threshold=0.5, strip="")


@query("b10_impute_median", DIRTY_SQL + """
SELECT coalesce(CAST(custkey AS DOUBLE), (SELECT quantile_cont(CAST(custkey AS DOUBLE), 0.5) FROM dirty)) AS custkey,
       coalesce(balance, (SELECT quantile_cont(balance, 0.5) FROM dirty)) AS balance
FROM dirty
""", approx="custkey balance")
def impute_median(t):
    return cleaning.impute(dirty_customer(t).select("custkey", "balance"))


@query("b11_impute_text", DIRTY_SQL + "SELECT coalesce(segment, 'N/A') AS segment, coalesce(half, 'N/A') AS half FROM dirty")
def impute_text(t):
    return cleaning.impute(dirty_customer(t).select("segment", "half"))


@query("b12_drop_outliers", """
WITH med AS (SELECT quantile_cont(l_quantity, 0.5) AS q, quantile_cont(l_extendedprice, 0.5) AS p,
                    quantile_cont(l_tax, 0.5) AS x FROM lineitem),
mad AS (SELECT quantile_cont(abs(l_quantity - q), 0.5) AS q, quantile_cont(abs(l_extendedprice - p), 0.5) AS p,
               quantile_cont(abs(l_tax - x), 0.5) AS x FROM lineitem, med),
scored AS (
  SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_tax,
         pow((l_quantity - med.q) / (1.4826 * mad.q), 2) + pow((l_extendedprice - med.p) / (1.4826 * mad.p), 2)
         + pow((l_tax - med.x) / (1.4826 * mad.x), 2) AS score
  FROM lineitem, med, mad)
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_tax FROM scored
WHERE score <= (SELECT quantile_cont(score, 0.98) FROM scored)
""", approx="l_quantity l_extendedprice l_tax")
def drop_outliers(t):
    df = t.pick("lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax")
    return cleaning.drop_outliers(df, cols=["l_quantity", "l_extendedprice", "l_tax"])


@query("b12_drop_outliers_iforest")
def drop_outliers_iforest(t):
    df = t.pick("lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax")
    kept = cleaning.drop_outliers(df, method="iforest", cols=["l_quantity", "l_extendedprice", "l_tax"])
    return kept.select("l_orderkey", "l_linenumber")


@query("b13_validate_numeric", DIRTY_SQL + """
SELECT custkey, CASE WHEN net < 0 THEN 0 ELSE net END AS net,
       CASE WHEN balance < 0 THEN 0 ELSE balance END AS balance FROM dirty
""", approx="net balance")
def validate_numeric(t):
    return cleaning.validate_numeric(dirty_customer(t).select("custkey", "net", "balance"))[0]


@query("b13_negative_issues", DIRTY_SQL + """
SELECT 'net' AS "column", min(net) AS "min" FROM dirty HAVING min(net) < 0
UNION ALL SELECT 'balance', min(balance) FROM dirty HAVING min(balance) < 0
""", approx="min")
def negative_issues(t):
    return cleaning.validate_numeric(dirty_customer(t).select("custkey", "net", "balance"))[1].select("column", "min")


@query("b14_engineer_features", """
WITH s AS (SELECT event_id, value, exp(value / 40.0) - 20.0 AS burst FROM events),
k AS (SELECT skewness(value) AS kv, skewness(burst) AS kb, least(min(burst), 0) AS lb, least(min(value), 0) AS lv FROM s)
SELECT event_id, value, burst, ln(1 + burst - lb) AS burst_log FROM s, k WHERE abs(kb) > 2 AND abs(kv) <= 2
""", approx="value burst burst_log")
def engineer_features(t):
    df = t.events.select("event_id", "value", (F.exp(F.col("value") / 40.0) - 20.0).alias("burst"))
    return cleaning.engineer_features(df)


NAMED_NATIONS = """
SELECT c_custkey, c_acctbal,
       CASE c_nationkey % 8 WHEN 0 THEN 'Germany' WHEN 1 THEN 'FRANCE' WHEN 2 THEN 'usa' WHEN 3 THEN 'Japan'
            WHEN 4 THEN 'South Korea' WHEN 5 THEN 'Brazil' WHEN 6 THEN 'Atlantis' ELSE NULL END AS country
FROM {customer}
"""
NAMED_SQL = "WITH named AS (" + NAMED_NATIONS.replace("{customer}", "customer") + """),
iso(country, code) AS (VALUES ('germany', 'DEU'), ('france', 'FRA'), ('usa', 'USA'), ('japan', 'JPN'),
                              ('south korea', 'KOR'), ('brazil', 'BRA'))
"""


@query("b15_map_country", NAMED_SQL + """
SELECT c_custkey, named.country, code AS iso3 FROM named LEFT JOIN iso ON lower(named.country) = iso.country
""")
def map_country(t):
    return cleaning.map_country(t.sql(NAMED_NATIONS, "customer"), "country").drop("c_acctbal")


@query("b16_smart_merge", """
SELECT o.o_orderkey, o.o_custkey, o.o_totalprice, c.c_custkey, c.c_mktsegment, c.c_nationkey
FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey
""", approx="o_totalprice")
def merge_star(t):
    orders = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    return smart_merge([orders, t.customer.select("c_custkey", "c_mktsegment", "c_nationkey")])


@query("b16_smart_merge_nulls", """
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS custkey FROM orders),
c AS (SELECT CASE WHEN c_custkey % 5 > 0 THEN c_custkey END AS custkey, c_mktsegment FROM customer)
SELECT o_orderkey, o.custkey, c_mktsegment FROM o LEFT JOIN c ON o.custkey = c.custkey
""")
def merge_nulls(t):
    """Keys missing on both sides match nothing."""
    orders = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey")).alias("custkey"))
    customers = t.customer.select(F.when(F.col("c_custkey") % 5 > 0, F.col("c_custkey")).alias("custkey"), "c_mktsegment")
    return smart_merge([orders, customers])


DATE_FORMS = """
SELECT o_orderkey,
       CASE o_orderkey % 4 WHEN 0 THEN date_format(o_orderdate, 'd MMM yyyy') WHEN 1 THEN date_format(o_orderdate, 'yyyy/M/d')
            WHEN 2 THEN date_format(o_orderdate, 'MMMM d, yyyy') ELSE date_format(o_orderdate, 'yyyyMMdd') END AS mixed,
       date_format(o_orderdate, 'd/M/yyyy') AS days_first, date_format(o_orderdate, 'M-d-yyyy HH:mm') AS months_first,
       concat('   ', date_format(o_orderdate, 'yyyy-MM-dd'), repeat(' ', 50)) AS padded
FROM {orders}
"""


@query("b7_date_forms", """
SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS mixed, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS days_first,
       date_trunc('minute', o_orderdate) AS months_first, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS padded FROM orders
""")
def date_forms(t):
    """Month names, compact and slashed dates; the order of day and month from the column."""
    return cleaning.coerce_dates(t.sql(DATE_FORMS, "orders"), gate=False)


@query("b7_date_orders", """
WITH d AS (SELECT day(o_orderdate) AS d, month(o_orderdate) AS m FROM orders)
SELECT 'days_first' AS "column", count(*) FILTER (d > 12) AS day_first, CAST(0 AS BIGINT) AS month_first, 'day_first' AS "order" FROM d
UNION ALL SELECT 'months_first', 0, count(*) FILTER (d > 12), 'month_first' FROM d
""")
def date_orders(t):
    """How often each column shows its order of day and month."""
    return cleaning.date_orders(t.sql(DATE_FORMS, "orders").select("days_first", "months_first"))


@query("b16_smart_merge_stacked", """
SELECT r_name, NULL AS c_mktsegment, NULL AS c_acctbal FROM region
UNION ALL SELECT NULL, c_mktsegment, c_acctbal FROM customer
""", approx="c_acctbal")
def merge_stacked(t):
    return smart_merge([t.region.select("r_name"), t.customer.select("c_mktsegment", "c_acctbal")])


@query("b17_format_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders")
def format_dates(t):
    return cleaning.format_dates(t.orders.select("o_orderkey", "o_orderdate"))
