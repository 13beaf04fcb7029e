"""Query classes of the SQL surface. Most texts run unchanged in both engines."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from quarrylens.operators.frames import range_frames
from quarrylens.operators.ordering import asof_join, neighbours, rank_rows, with_index
from quarrylens.operators.relational import range_join, result_preview, run_sql
from quarrylens.queries.registry import query


def shared(name: str, tables: str, text: str, approx: str = "", digits: int = 9, spark: str | None = None):
    """A query whose text is the same on both sides (or differs only in dialect)."""

    def run(t):
        return run_sql({n: getattr(t, n) for n in tables.split()}, spark or text)

    query(name, text, approx, digits)(run)


@query("s0_run_sql", """
SELECT o_orderstatus, count(*) AS n, max(c_acctbal) AS best FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1
""", approx="best")
def registered(t):
    return run_sql({"my orders.csv": t.orders, "customer-list.v2.json": t.customer}, """
SELECT o_orderstatus, count(*) AS n, max(c_acctbal) AS best
FROM my_orders JOIN customer_list_v2 ON o_custkey = c_custkey GROUP BY 1
""")


@query("s0_name_clash", """
SELECT (SELECT count(*) FROM nation) AS nations, (SELECT count(*) FROM region) AS regions, TRUE AS refused
""")
def name_clash(t):
    """Names that are equal after the cut to 30 characters are refused; others are told apart."""
    long = "a_table_with_a_really_long_name"
    try:
        run_sql({f"{long}_nation.csv": t.nation, f"{long}_region.csv": t.region}, f"SELECT count(*) FROM {long[:30]}")
        refused = False
    except ValueError:
        refused = True
    return run_sql({"nations of the world.csv": t.nation, "regions of the world.csv": t.region}, f"""
SELECT (SELECT count(*) FROM nations_of_the_world) AS nations, (SELECT count(*) FROM regions_of_the_world) AS regions,
       {refused} AS refused
""")


shared("s1_projection", "lineitem", """
SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross,
       concat(l_returnflag, '/', l_linestatus) AS flags FROM lineitem
""")

shared("s2_filter", "lineitem part", """
SELECT l_orderkey, l_linenumber, l_quantity, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE l_quantity BETWEEN 10 AND 20 AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') AND p_name LIKE '%ring%'
  AND l_shipdate IS NOT NULL AND NOT l_returnflag = 'R'
""", "l_quantity")

shared("s3_group_by_having", "lineitem", """
SELECT l_suppkey, l_returnflag, count(*) AS n, sum(l_quantity) AS quantity, avg(l_extendedprice) AS price, max(l_tax) AS tax
FROM lineitem WHERE l_discount < 0.08 GROUP BY l_suppkey, l_returnflag HAVING sum(l_quantity) > 500
""", "quantity price tax")

shared("s3_pricing_summary", "lineitem", """
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice) AS sum_base,
       sum(l_extendedprice * (1 - l_discount)) AS sum_net, avg(l_discount) AS avg_discount, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus
""", "sum_qty sum_base sum_net avg_discount")

shared("s4_distinct", "lineitem", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")

shared("s4_count_distinct", "lineitem", """
SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag
""")

shared("s4_approx_distinct", "lineitem", """
SELECT l_returnflag, abs(approx_count_distinct(l_orderkey) - count(DISTINCT l_orderkey)) < 0.2 * count(DISTINCT l_orderkey) AS near
FROM lineitem GROUP BY l_returnflag
""")

for kind, clause in (
    ("rollup", "ROLLUP (o_orderstatus, o_orderpriority)"),
    ("cube", "CUBE (o_orderstatus, o_orderpriority)"),
    ("grouping_sets", "GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"),
):
    shared(f"s5_{kind}", "orders", f"""
SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) AS INTEGER) AS g, count(*) AS n, sum(o_totalprice) AS total
FROM orders GROUP BY {clause}
""", "total")

shared("s6_inner_join", "region nation customer orders lineitem supplier", """
SELECT n_name, sum(l_extendedprice * (1 - l_discount)) AS revenue, count(*) AS n FROM lineitem
JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' GROUP BY n_name
""", "revenue")

shared("s7_left_join", "customer orders", """
SELECT c_custkey, count(o_orderkey) AS orders, sum(o_totalprice) AS spent FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey
""", "spent")

shared("s7_full_join", "customer supplier", """
SELECT coalesce(c.nation, s.nation) AS nation, c.customers, s.suppliers
FROM (SELECT c_nationkey AS nation, count(*) AS customers FROM customer WHERE c_nationkey < 20 GROUP BY 1) c
FULL JOIN (SELECT s_nationkey AS nation, count(*) AS suppliers FROM supplier WHERE s_nationkey > 5 GROUP BY 1) s ON c.nation = s.nation
""")

shared("s7_right_join", "orders customer", """
SELECT c_custkey, c_mktsegment, o_orderkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_totalprice > 300000
""")

shared("s8_semi_join", "orders lineitem", """
SELECT o_orderkey, o_orderpriority FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)
""")

shared("s8_anti_join", "customer orders", """
SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')
""")


@query("s9_range_join", """
SELECT s_suppkey, count(*) AS customers, sum(c_acctbal) AS balance FROM customer JOIN supplier
ON c_acctbal >= s_acctbal AND c_acctbal < s_acctbal + 250 GROUP BY s_suppkey
""", approx="balance")
def ranges(t):
    bands = t.supplier.select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 250).alias("high"))
    wanted = {"customers": ("count", "c_acctbal"), "balance": ("sum", "c_acctbal")}
    joined = range_join(t.customer.select("c_custkey", "c_acctbal"), bands, "c_acctbal", "low", "high", 250.0, salt=4, totals=wanted)
    return joined.groupBy("s_suppkey").agg(F.sum("customers").alias("customers"), F.sum("balance").alias("balance"))


@query("s10_asof_join", """
SELECT p.event_id, p.user_id, p.value, v.event_id AS view_id, v.value AS view_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts
""", approx="value view_value")
def latest_view(t):
    buys = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts", "value")
    views = t.events.where("event_type = 'view'").select(
        "user_id", "ts", F.col("event_id").alias("view_id"), F.col("value").alias("view_value")
    )
    return asof_join(buys, views, "ts", ["user_id"], ["view_id", "view_value"], tie=["event_id"]).drop("ts")


@query("s11_scenario_grid", """
SELECT p_brand, rate, sum(p_retailprice * (1 - rate)) AS total FROM part CROSS JOIN (VALUES (0.0), (0.1), (0.25)) AS v(rate) GROUP BY 1, 2
""", approx="rate total")
def scenario_grid(t):
    """A product with a fixed list is an expansion of each summed row, not a join."""
    summed = t.part.groupBy("p_brand").agg(F.sum("p_retailprice").alias("total"))
    grid = summed.withColumn("rate", F.explode(F.array(F.lit(0.0), F.lit(0.1), F.lit(0.25))))
    return grid.select("p_brand", "rate", (F.col("total") * (1 - F.col("rate"))).alias("total"))


shared("s12_union", "customer supplier", """
SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier
""")

shared("s12_union_all", "customer supplier", """
SELECT kind, count(*) AS n, sum(balance) AS balance FROM (
  SELECT 'customer' AS kind, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_acctbal FROM supplier) u GROUP BY kind
""", "balance")

shared("s13_intersect", "customer orders", "SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders")
shared("s13_except", "customer orders", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 400000")
shared("s13_except_all", "orders", """
SELECT o_custkey, o_orderstatus FROM orders EXCEPT ALL SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderpriority = '1-URGENT'
""")

shared("s14_top_k", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", "o_totalprice")


@query("s14_result_preview", """
SELECT c_name, spent FROM (SELECT c_name, sum(o_totalprice) AS spent FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_name)
ORDER BY c_name LIMIT 25
""", approx="spent")
def preview(t):
    out = run_sql({"customer": t.customer, "orders": t.orders}, """
SELECT c_name, sum(o_totalprice) AS spent FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_name""")
    return result_preview(out, ["c_name"])


shared("s15_cte_subquery", "orders customer", """
WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey),
big AS (SELECT * FROM spend WHERE total > (SELECT avg(total) FROM spend))
SELECT c_mktsegment, count(*) AS customers, sum(total) AS total FROM big JOIN customer ON c_custkey = o_custkey
WHERE c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY c_nationkey HAVING count(*) > 3) GROUP BY c_mktsegment
""", "total")

shared("s15_correlated_subquery", "lineitem part", """
SELECT p_brand, sum(l_extendedprice) AS total FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE l_quantity < (SELECT 0.5 * avg(i.l_quantity) FROM lineitem i WHERE i.l_partkey = p_partkey) GROUP BY p_brand
""", "total")

shared("s16_top_per_group", "orders", """
SELECT o_custkey, o_orderkey, o_totalprice, place FROM (
  SELECT o_custkey, o_orderkey, o_totalprice, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS place
  FROM orders) r WHERE place <= 3
""", "o_totalprice")

shared("s16_ranking_windows", "orders customer", """
WITH spend AS (SELECT c_mktsegment AS segment, c_nationkey AS nation, CAST(count(*) AS BIGINT) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT segment, nation, n, CAST(row_number() OVER (PARTITION BY segment ORDER BY n DESC, nation) AS BIGINT) AS rn,
       CAST(rank() OVER (PARTITION BY segment ORDER BY n DESC) AS BIGINT) AS rk,
       CAST(dense_rank() OVER (PARTITION BY segment ORDER BY n DESC) AS BIGINT) AS dr,
       CAST(ntile(4) OVER (PARTITION BY segment ORDER BY n DESC, nation) AS BIGINT) AS quarter,
       percent_rank() OVER (PARTITION BY segment ORDER BY n DESC) AS pr FROM spend
""", "pr")


@query("s16_rank_large_groups", """
SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity,
       row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity, l_orderkey, l_linenumber) AS row_number,
       rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS rank,
       dense_rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS dense_rank,
       ntile(4) OVER (PARTITION BY l_returnflag ORDER BY l_quantity, l_orderkey, l_linenumber) AS ntile FROM lineitem
""")
def rank_large_groups(t):
    """Three keys hold all rows: no key may be ordered in one task."""
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return rank_rows(df, "l_quantity", ["l_returnflag"], ["l_orderkey", "l_linenumber"])


shared("s17_analytic_windows", "orders", """
WITH m AS (SELECT o_orderpriority AS priority, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS month, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2)
SELECT priority, month, total, lag(total) OVER w AS before, lead(total) OVER w AS after,
       first_value(total) OVER w AS first, last_value(total) OVER (PARTITION BY priority ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last,
       avg(total) OVER (PARTITION BY priority ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS moving,
       sum(total) OVER (PARTITION BY priority ORDER BY month RANGE BETWEEN 6 PRECEDING AND CURRENT ROW) AS half_year
FROM m WINDOW w AS (PARTITION BY priority ORDER BY month)
""", "total before after first last moving half_year")


@query("s17_frames_large_groups", """
SELECT l_orderkey, l_linenumber, lag(l_quantity, 2) OVER w AS before, lead(l_quantity) OVER w AS after,
       avg(l_quantity) OVER (PARTITION BY l_linestatus ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS around
FROM lineitem WINDOW w AS (PARTITION BY l_linestatus ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity)
""", approx="around")
def frames_large_groups(t):
    """Two keys hold all rows: frames are computed in blocks with their neighbouring rows."""
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]
    indexed = with_index(t.lineitem.select("l_linestatus", *order), order, ["l_linestatus"])
    frames = lambda w: {
        "before": F.lag("l_quantity", 2).over(w), "after": F.lead("l_quantity").over(w),
        "around": F.avg("l_quantity").over(w.rowsBetween(-3, 2)),
    }
    out = neighbours(indexed, frames, 3, 2, ["l_linestatus"])
    return out.select("l_orderkey", "l_linenumber", "before", "after", "around")


@query("s17_range_large_groups", """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_shipdate,
       count(*) OVER w AS n, sum(CAST(l_quantity AS BIGINT)) OVER w AS quantity, avg(l_extendedprice) OVER w AS mean_price,
       min(l_extendedprice) OVER w AS least, max(l_extendedprice) OVER w AS most
FROM lineitem WINDOW w AS (PARTITION BY l_linestatus ORDER BY l_shipdate RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND INTERVAL 7 DAYS FOLLOWING)
""", approx="mean_price least most")
def range_large_groups(t):
    """Two keys hold all rows, and a frame many blocks: no key and no frame may meet in one task."""
    df = t.pick("lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate", "l_linestatus", "l_extendedprice")
    df = df.withColumn("whole", F.col("l_quantity").cast("bigint"))
    outputs = {
        "n": ("count", "l_orderkey"), "quantity": ("sum", "whole"), "mean_price": ("avg", "l_extendedprice"),
        "least": ("min", "l_extendedprice"), "most": ("max", "l_extendedprice"),
    }
    framed = range_frames(df, "l_shipdate", outputs, timedelta(days=90), timedelta(days=7), ["l_linestatus"], block_points=64)
    return framed.drop("whole", "l_linestatus", "l_extendedprice")


shared("s18_text_functions", "part", """
SELECT p_partkey, upper(p_name) AS up, CAST(length(p_name) AS INTEGER) AS len, substring(p_name, 1, 3) AS head, replace(p_name, ' ', '-') AS dashed,
       concat_ws(':', p_brand, p_type) AS tag, trim(concat(' ', p_type, ' ')) AS trimmed, lpad(p_type, 12, '.') AS padded,
       reverse(p_type) AS flipped, split_part(p_brand, '#', 2) AS number FROM part
""")

shared("s18_math_functions", "part", """
SELECT p_partkey, round(sqrt(p_retailprice), 6) AS root, round(ln(p_retailprice), 6) AS logarithm, round(pow(p_size, 1.5), 6) AS power,
       abs(p_size - 25) AS gap, CAST(floor(p_retailprice / 7) AS BIGINT) AS low, CAST(ceil(p_retailprice / 7) AS BIGINT) AS high, p_size % 7 AS rest,
       greatest(p_size, 10) AS top, CAST(sign(p_size - 25.0) AS INTEGER) AS side, nullif(p_size, 1) AS other FROM part
""")

shared("s18_date_functions", "orders", """
SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, month(o_orderdate) AS m, day(o_orderdate) AS d,
       dayofyear(o_orderdate) AS doy, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, CAST(last_day(o_orderdate) AS DATE) AS month_end,
       CAST(o_orderdate + INTERVAL 30 DAY AS DATE) AS due FROM orders
""", spark="""
SELECT o_orderkey, bigint(year(o_orderdate)) AS y, bigint(quarter(o_orderdate)) AS q, bigint(month(o_orderdate)) AS m, bigint(day(o_orderdate)) AS d,
       bigint(dayofyear(o_orderdate)) AS doy, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, CAST(last_day(o_orderdate) AS DATE) AS month_end,
       CAST(o_orderdate + INTERVAL 30 DAY AS DATE) AS due FROM orders
""")

shared("s18_conditional_functions", "orders", """
SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'small' END AS size,
       coalesce(nullif(o_orderstatus, 'P'), 'pending') AS status, o_orderpriority IN ('1-URGENT', '2-HIGH') AS hurry FROM orders
""")

shared("s19_json", "events", """
SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY event_type
""", spark="""
SELECT event_type, count(*) AS n, sum(CAST(get_json_object(props, '$.k') AS BIGINT)) AS k FROM events GROUP BY event_type
""")

shared("s19_arrays", "embeddings", """
SELECT vec_id, CAST(len(embedding) AS INTEGER) AS size, CAST(embedding[1] AS DOUBLE) AS first, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) AS energy,
       CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS positive FROM embeddings
""", "first energy", 7, spark="""
SELECT vec_id, size(embedding) AS size, double(embedding[0]) AS first, aggregate(transform(embedding, x -> double(x) * x), 0D, (a, x) -> a + x) AS energy,
       size(filter(embedding, x -> x > 0)) AS positive FROM embeddings
""")

shared("s19_map_explode", "events", """
SELECT key, count(*) AS n, CAST(sum(value) AS BIGINT) AS total FROM (SELECT 'k' AS key, CAST(json_extract(props, '$.k') AS BIGINT) AS value FROM events) GROUP BY key
""", spark="""
SELECT key, count(*) AS n, sum(value) AS total FROM (SELECT explode(from_json(props, 'map<string,bigint>')) FROM events) GROUP BY key
""")

shared("s20_pivot", "orders", """
SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P"
FROM orders GROUP BY o_orderpriority
""", spark="""
SELECT o_orderpriority, coalesce(F, 0) AS F, coalesce(O, 0) AS O, coalesce(P, 0) AS P
FROM (SELECT o_orderpriority, o_orderstatus FROM orders) PIVOT (count(1) FOR o_orderstatus IN ('F', 'O', 'P'))
""")

shared("s20_unpivot", "lineitem", """
SELECT l_returnflag, measure, sum(value) AS total FROM (
  SELECT l_returnflag, 'l_quantity' AS measure, l_quantity AS value FROM lineitem UNION ALL SELECT l_returnflag, 'l_tax', l_tax FROM lineitem
  UNION ALL SELECT l_returnflag, 'l_discount', l_discount FROM lineitem) GROUP BY 1, 2
""", "total", spark="""
SELECT l_returnflag, measure, sum(value) AS total FROM (SELECT l_returnflag, l_quantity, l_tax, l_discount FROM lineitem)
UNPIVOT (value FOR measure IN (l_quantity, l_tax, l_discount)) GROUP BY 1, 2
""")
