"""Decision-support queries over the star schema, as one SQL text each.

The text holds ``{table}`` where a table goes. It is the same for Spark, which
plans it with Catalyst, and for any other engine that results are held against;
so amounts are summed as decimals, whose sum doesn't depend on the order of rows.
"""

from __future__ import annotations

_DISC = "CAST(CAST(l_extendedprice AS DECIMAL(18,4)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4))"
_REVENUE = f"CAST(sum({_DISC}) AS DOUBLE)"


def _sum(column: str) -> str:
    return f"CAST(sum(CAST({column} AS DECIMAL(18,4))) AS DOUBLE)"


BUSINESS: dict[str, str] = {
    "biz_pricing_summary": f"""
        SELECT l_returnflag, l_linestatus, {_sum("l_quantity")} AS sum_qty, {_sum("l_extendedprice")} AS sum_base, {_REVENUE} AS sum_disc,
               {_sum("l_quantity")} / count(*) AS avg_qty, {_sum("l_extendedprice")} / count(*) AS avg_price, count(*) AS n
        FROM {{lineitem}} WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus""",
    "biz_shipping_priority": f"""
        SELECT l_orderkey, {_REVENUE} AS revenue, o_orderdate, o_orderpriority
        FROM {{customer}}, {{orders}}, {{lineitem}}
        WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey
          AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15'
        GROUP BY l_orderkey, o_orderdate, o_orderpriority ORDER BY revenue DESC, l_orderkey LIMIT 10""",
    "biz_late_orders": """
        SELECT o_orderpriority, count(*) AS n FROM {orders}
        WHERE o_orderdate >= DATE '1997-07-01' AND o_orderdate < DATE '1998-07-01'
          AND EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL 60 DAY)
        GROUP BY o_orderpriority""",
    "biz_local_supplier": f"""
        SELECT n_name, {_REVENUE} AS revenue
        FROM {{customer}}, {{orders}}, {{lineitem}}, {{supplier}}, {{nation}}, {{region}}
        WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey
          AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA'
        GROUP BY n_name""",
    "biz_forecast_revenue": """
        SELECT CAST(sum(CAST(CAST(l_extendedprice AS DECIMAL(18,4)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,4))) AS DOUBLE) AS revenue
        FROM {lineitem} WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""",
    "biz_nation_volume": f"""
        SELECT s.n_name AS supp_nation, c.n_name AS cust_nation, CAST(year(l_shipdate) AS INT) AS l_year, {_REVENUE} AS revenue
        FROM {{supplier}}, {{lineitem}}, {{orders}}, {{customer}}, {{nation}} s, {{nation}} c
        WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = s.n_nationkey AND c_nationkey = c.n_nationkey
          AND ((s.n_name = 'NATION_1' AND c.n_name = 'NATION_2') OR (s.n_name = 'NATION_2' AND c.n_name = 'NATION_1'))
        GROUP BY s.n_name, c.n_name, year(l_shipdate)""",
    "biz_market_share": f"""
        SELECT o_year, CAST(sum(CASE WHEN nation = 'NATION_3' THEN volume ELSE 0 END) AS DOUBLE) / CAST(sum(volume) AS DOUBLE) AS share
        FROM (SELECT CAST(year(o_orderdate) AS INT) AS o_year, {_DISC} AS volume, n2.n_name AS nation
              FROM {{part}}, {{supplier}}, {{lineitem}}, {{orders}}, {{customer}}, {{nation}} n1, {{nation}} n2, {{region}}
              WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey
                AND n1.n_regionkey = r_regionkey AND r_name = 'AMERICA' AND s_nationkey = n2.n_nationkey AND p_type = 'ECONOMY') AS all_nations
        GROUP BY o_year""",
    "biz_returned_items": f"""
        SELECT c_custkey, c_name, {_REVENUE} AS revenue, c_acctbal, n_name
        FROM {{customer}}, {{orders}}, {{lineitem}}, {{nation}}
        WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= DATE '1996-10-01' AND o_orderdate < DATE '1997-01-01'
          AND l_returnflag = 'R' AND c_nationkey = n_nationkey
        GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
    "biz_order_sizes": """
        SELECT c_count, count(*) AS custdist
        FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_orderpriority <> '1-URGENT' GROUP BY c_custkey) AS c
        GROUP BY c_count""",
    "biz_promo_share": f"""
        SELECT 100.0 * CAST(sum(CASE WHEN p_type LIKE 'PROMO%' THEN {_DISC} ELSE 0 END) AS DOUBLE) / CAST(sum({_DISC}) AS DOUBLE) AS promo
        FROM {{lineitem}}, {{part}} WHERE l_partkey = p_partkey AND l_shipdate >= DATE '1997-09-01' AND l_shipdate < DATE '1997-12-01'""",
    "biz_top_supplier": f"""
        WITH revenue AS (SELECT l_suppkey, {_REVENUE} AS total FROM {{lineitem}} WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-04-01' GROUP BY l_suppkey)
        SELECT s_suppkey, s_name, total FROM {{supplier}} JOIN revenue ON s_suppkey = l_suppkey WHERE total = (SELECT max(total) FROM revenue)""",
    "biz_suppliers_by_part": """
        SELECT p_brand, p_type, count(DISTINCT l_suppkey) AS suppliers FROM {lineitem} JOIN {part} ON p_partkey = l_partkey
        WHERE p_brand <> 'Brand#4' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (3, 9, 14, 19, 23, 36, 45, 49)
          AND l_suppkey NOT IN (SELECT s_suppkey FROM {supplier} WHERE s_acctbal < 0)
        GROUP BY p_brand, p_type""",
    "biz_small_quantity": f"""
        SELECT {_sum("l_extendedprice")} / 7.0 AS avg_yearly FROM {{lineitem}} o JOIN {{part}} ON p_partkey = l_partkey
        WHERE p_brand = 'Brand#9' AND l_quantity < (SELECT 0.4 * {_sum("l_quantity")} / count(*) FROM {{lineitem}} i WHERE i.l_partkey = p_partkey)""",
    "biz_large_volume": f"""
        SELECT c_custkey, o_orderkey, o_totalprice, {_sum("l_quantity")} AS quantity FROM {{customer}}, {{orders}}, {{lineitem}}
        WHERE o_orderkey IN (SELECT l_orderkey FROM {{lineitem}} GROUP BY l_orderkey HAVING sum(l_quantity) > 200) AND c_custkey = o_custkey AND o_orderkey = l_orderkey
        GROUP BY c_custkey, o_orderkey, o_totalprice""",
    "biz_discounted": f"""
        SELECT {_REVENUE} AS revenue FROM {{lineitem}}, {{part}}
        WHERE p_partkey = l_partkey AND ((p_brand = 'Brand#2' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 15)
          OR (p_brand = 'Brand#9' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 25) OR (p_brand = 'Brand#16' AND l_quantity BETWEEN 20 AND 30))""",
    "biz_idle_customers": f"""
        SELECT c_nationkey, count(*) AS n, {_sum("c_acctbal")} AS total FROM {{customer}}
        WHERE c_acctbal > (SELECT {_sum("c_acctbal")} / count(*) FROM {{customer}} WHERE c_acctbal > 0)
          AND NOT EXISTS (SELECT 1 FROM {{orders}} WHERE o_custkey = c_custkey AND o_orderdate >= DATE '2000-01-01')
        GROUP BY c_nationkey""",
}


def tables_of(text: str) -> list[str]:
    """The tables that a query's text names."""
    return sorted({part.split("}")[0] for part in text.split("{")[1:]})
