"""The registered queries: each a DataFrame function and, where SQL can say it, its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.functions import parse, pretty
from heddle.operators.aggregates import money, top_per_group
from heddle.operators.joins import asof, broadcast_if_small, in_range, salted
from heddle.plans import business, placement
from heddle.plans.ledger import Ledger
from heddle.plans.placement import Node
from heddle.sources import scan as scans
from heddle.sources.registry import Registry
from heddle.sources.sinks import stored_copy
from heddle.streaming import health, windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


class Tables:
    """A data directory's tables as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._dir}/{name}.parquet")

    def path(self, name: str) -> str:
        return f"{self._dir}/{name}.parquet"

    def sql(self, text: str, *names: str) -> DataFrame:
        return self._spark.sql(text, **{n: getattr(self, n) for n in names})


def query(sql: str | None = None):
    """Registers a function of Tables under its name."""

    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# Scans and projections


@query("SELECT r_regionkey, r_name FROM region")
def scan_all(t):
    return scans.scan(t._spark, t.path("region"))


@query("SELECT l_orderkey, l_extendedprice FROM lineitem")
def scan_project(t):
    return scans.scan(t._spark, t.path("lineitem"), "l_orderkey, l_extendedprice")


@query("SELECT * FROM lineitem")
def scan_wide(t):
    return scans.scan(t._spark, t.path("lineitem"))


@query("SELECT o_totalprice, o_orderkey, o_totalprice AS o_totalprice_2 FROM orders")
def scan_reorder_duplicate(t):
    return scans.project(t.orders, " o_totalprice ,o_orderkey,o_totalprice", suffix_duplicates=True)


@query("SELECT c_custkey FROM customer")
def scan_single_column(t):
    return scans.project(t.customer, ["c_custkey"])


@query("SELECT r_name FROM region LIMIT 3")
def scan_first_values(t):
    # A table of one file: its first values are those that any reader meets first.
    return scans.first_values(t.region, "r_name", 3)


@query("SELECT count(*) AS n FROM lineitem")
def scan_count(t):
    return t.lineitem.agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_shipdate >= TIMESTAMP '1995-01-01' AND l_returnflag = 'R'")
def scan_pushdown(t):
    where = "l_quantity > 45 AND l_shipdate >= timestamp_ntz'1995-01-01 00:00:00' AND l_returnflag = 'R'"
    return scans.project(t.lineitem.where(where), "l_orderkey, l_linenumber, l_quantity")


@query("SELECT s_suppkey, s_name, CAST(NULL AS VARCHAR) AS s_comment, 'TEST' AS part FROM supplier")
def scan_null_fill_constant(t):
    schema = t.supplier.select("s_suppkey", "s_name").schema.add("s_comment", "string")
    return scans.scan(t._spark, t.path("supplier"), schema=schema, constants={"part": "TEST"})


@query("SELECT (row_number() OVER (ORDER BY ordinal_position) - 1)::INT AS pos, column_name AS name FROM information_schema.columns WHERE table_name = 'orders'")
def schema_columns(t):
    return scans.schema_rows(t.orders).select("pos", "name")


@query("SELECT count(*) AS n_rows, 2048::BIGINT AS most, true AS numbered, sum(l_orderkey)::BIGINT AS keys FROM lineitem")
def batch_sizes(t):
    """Delivered batches: all rows, at most 2,048 a batch, all full but each partition's last, numbered without gaps."""
    per = scans.batches(t.lineitem.select("l_orderkey")).groupBy("partition", "batch").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("k"))
    of = per.groupBy("partition").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max("batch").alias("last"), F.sum("k").alias("k"))
    numbered = F.bool_and(F.col("last") == F.floor((F.col("n") - 1) / 2048))
    return of.agg(F.sum("n").alias("n_rows"), F.max("most").alias("most"), numbered.alias("numbered"), F.sum("k").alias("keys"))


@query("SELECT count(*) AS n_rows, count(*) * 32 AS n_bytes FROM orders")
def stream_totals(t):
    return scans.stream_totals(t.orders, 32).agg(F.sum("n_rows").alias("n_rows"), F.sum("n_bytes").alias("n_bytes"))


@query("SELECT count(*) AS n_rows, (SELECT count(*) FROM information_schema.columns WHERE table_name = 'lineitem') AS n_columns FROM lineitem")
def footer_totals(t):
    from heddle.sources.footers import footers

    f = footers(t._spark, t.path("lineitem")).groupBy("path", "row_group").agg(F.max("n_rows").alias("n"), F.countDistinct("column").alias("c"))
    return f.agg(F.sum("n").alias("n_rows"), F.max("c").alias("n_columns"))


@query("SELECT n_nationkey, n_name FROM nation")
def row_group_scan(t):
    from heddle.sources.footers import row_groups

    return row_groups(t._spark, t.path("nation"), "n_nationkey, n_name")


# Filters


@query("SELECT p_partkey, p_size FROM part WHERE p_size > 10 AND (p_brand LIKE '%1' OR NOT p_type LIKE 'S%')")
def filter_boolean(t):
    return t.part.where((F.col("p_size") > 10) & (F.col("p_brand").like("%1") | ~F.col("p_type").like("S%"))).select("p_partkey", "p_size")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice BETWEEN 1000 AND 50000 AND o_orderpriority IS NOT NULL")
def filter_in_between_null(t):
    return t.orders.where(F.col("o_orderstatus").isin("F", "O") & F.col("o_totalprice").between(1000, 50000) & F.col("o_orderpriority").isNotNull()).select("o_orderkey")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'some' ELSE 'rich' END AS class, CAST(floor(c_acctbal) AS BIGINT) AS whole, c_custkey % 7 AS m FROM customer")
def expr_case_cast(t):
    band = F.when(F.col("c_acctbal") < 0, "debt").when(F.col("c_acctbal") < 5000, "some").otherwise("rich")
    return t.customer.select("c_custkey", band.alias("class"), F.floor("c_acctbal").alias("whole"), (F.col("c_custkey") % 7).alias("m"))


# Joins


@query("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def join_broadcast(t):
    return broadcast_if_small(t.customer, t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority")
def join_sort_merge(t):
    j = t.lineitem.join(t.orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("SELECT p_brand, sum(l_quantity) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")
def join_shuffle_hash(t):
    return t.lineitem.join(t.part.hint("shuffle_hash"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.sum("l_quantity").alias("quantity"))


@query("SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
def join_theta(t):
    a, b = t.nation.alias("a"), t.nation.alias("b")
    on = (F.col("a.n_nationkey") < F.col("b.n_nationkey")) & (F.col("a.n_regionkey") == F.col("b.n_regionkey"))
    return a.join(b, on).select(F.col("a.n_name").alias("a_name"), F.col("b.n_name").alias("b_name"))


@query("SELECT r_name, n_name FROM region, nation")
def join_cross(t):
    # 5 x 25 rows: both sides are fixed-size reference tables.
    return t.region.crossJoin(t.nation).select("r_name", "n_name")


@query("SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_partkey >= s_suppkey * 10 AND p_partkey < s_suppkey * 10 + 15")
def join_range(t):
    ranges = t.supplier.select("s_suppkey", (F.col("s_suppkey") * 10).alias("low"), (F.col("s_suppkey") * 10 + 15).alias("high"))
    return in_range(t.part.select("p_partkey"), ranges, at="p_partkey", low="low", high="high", width=16).select("p_partkey", "s_suppkey")


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def join_left(t):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("SELECT c_custkey, o_orderkey FROM (SELECT * FROM orders WHERE o_totalprice < 20000) RIGHT JOIN customer ON c_custkey = o_custkey")
def join_right(t):
    return t.orders.where("o_totalprice < 20000").join(t.customer, F.col("c_custkey") == F.col("o_custkey"), "right").select("c_custkey", "o_orderkey")


@query("SELECT s_suppkey, n_nationkey FROM (SELECT * FROM supplier WHERE s_acctbal > 0) FULL JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON s_nationkey = n_nationkey")
def join_full(t):
    return t.supplier.where("s_acctbal > 0").join(t.nation.where("n_regionkey < 3"), F.col("s_nationkey") == F.col("n_nationkey"), "full").select("s_suppkey", "n_nationkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def join_semi(t):
    return t.customer.join(t.orders.where("o_totalprice > 100000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def join_anti(t):
    return t.customer.join(t.orders.where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""
WITH c AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'),
     v AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY user_id, ts)
SELECT event_id, value AS last_view FROM c ASOF LEFT JOIN v ON c.user_id = v.user_id AND c.ts >= v.ts
""")
def join_asof(t):
    e = t.events
    views = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("v_ts"), F.col("value").alias("last_view"))
    clicks = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    return asof(clicks, views, by=["user_id"], left_at="ts", right_at="v_ts", values=["last_view"]).select("event_id", "last_view")


@query("""
WITH o AS (SELECT o_orderkey, o_orderstatus AS k, o_orderdate AS ts FROM orders),
     l AS (SELECT l_linestatus AS k, l_shipdate AS ts, max(l_quantity) AS q FROM lineitem GROUP BY ALL)
SELECT o_orderkey, q AS last_quantity FROM o ASOF LEFT JOIN l ON o.k = l.k AND o.ts >= l.ts
""")
def join_asof_hot(t):
    """Three keys for all rows, so each is cut into slots of time."""
    shipped = t.lineitem.select(F.col("l_linestatus").alias("k"), F.col("l_shipdate").alias("s_ts"), F.col("l_quantity").alias("last_quantity"))
    orders = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("k"), F.col("o_orderdate").alias("ts"))
    return asof(orders, shipped, by=["k"], left_at="ts", right_at="s_ts", values=["last_quantity"], hot_rows=1000).select("o_orderkey", "last_quantity")


@query("SELECT n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def join_salted(t):
    nation = t.nation.select(F.col("n_nationkey").alias("k"), "n_name")
    return salted(t.supplier.select(F.col("s_nationkey").alias("k"), "s_suppkey"), nation, "k").groupBy("n_name").agg(F.count("*").alias("n"))


# Aggregates


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice::DECIMAL(18,4))::DOUBLE AS sum_price,
  sum((l_extendedprice::DECIMAL(18,4) * (1 - l_discount::DECIMAL(4,2)))::DECIMAL(18,4))::DOUBLE AS sum_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def agg_group(t):
    price = F.col("l_extendedprice").cast("decimal(18,4)")
    disc = (price * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(18,4)")
    rows = t.lineitem.where("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), money("l_extendedprice").alias("sum_price"), F.sum(disc).cast("double").alias("sum_disc"), F.count("*").alias("n"))


@query("SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")
def agg_distinct(t):
    return t.lineitem.agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def agg_distinct_rows(t):
    return t.orders.select("o_orderstatus", "o_orderpriority").distinct()


@query()
def agg_approx_distinct(t):
    return t.lineitem.agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"))


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, true AS near FROM lineitem GROUP BY l_returnflag")
def agg_approx_error(t):
    """Estimates of distinct parts beside the exact counts: ``near`` is within three standard errors.

    Both are taken of distinct pairs, which leaves the estimate as it is: beside a ``count_distinct``, each pair would hold a sketch (3 KB) of its own.
    """
    told, exact = F.approx_count_distinct("l_partkey", 0.02), F.count("l_partkey")
    pairs = t.lineitem.select("l_returnflag", "l_partkey").distinct()
    return pairs.groupBy("l_returnflag").agg(exact.alias("parts"), (F.abs(told - exact) <= 3 * 0.02 * exact).alias("near"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def agg_cube(t):
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT n_regionkey, n_nationkey, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey)")
def agg_rollup(t):
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).rollup("n_regionkey", "n_nationkey").agg(F.count("*").alias("n"))


_SETS = "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS INT) AS g, count(*) AS n FROM {t} GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())"


@query(_SETS.format(t="lineitem"))
def agg_grouping_sets(t):
    return t.sql(_SETS.format(t="{lineitem}"), "lineitem")


_FILTER = "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 50000) AS big, max(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent FROM {t} GROUP BY o_orderstatus"


@query(_FILTER.format(t="orders"))
def agg_filter(t):
    return t.sql(_FILTER.format(t="{orders}"), "orders")


@query("SELECT c_mktsegment, round(stddev_samp(c_acctbal), 4) AS sd, round(corr(c_acctbal, c_custkey), 6) AS r, round(quantile_cont(c_acctbal, 0.5), 4) AS med, min(c_acctbal) AS low FROM customer GROUP BY c_mktsegment")
def agg_stats(t):
    return t.customer.groupBy("c_mktsegment").agg(
        F.round(F.stddev_samp("c_acctbal"), 4).alias("sd"), F.round(F.corr("c_acctbal", "c_custkey"), 6).alias("r"), F.round(F.percentile("c_acctbal", 0.5), 4).alias("med"), F.min("c_acctbal").alias("low"))


@query("SELECT n_regionkey, array_to_string(list(n_name ORDER BY n_name), ',') AS names FROM nation GROUP BY n_regionkey")
def agg_collect(t):
    return t.nation.groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("names"))


@query("SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS F, count(*) FILTER (WHERE l_linestatus = 'O') AS O FROM lineitem GROUP BY l_returnflag")
def pivot(t):
    return t.lineitem.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1))).na.fill(0)


@query("SELECT p_partkey, 'size' AS what, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part")
def unpivot(t):
    wide = t.part.select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return wide.unpivot("p_partkey", ["size", "price"], "what", "value")


# Windows


_RANK = """SELECT c_custkey, row_number() OVER w AS rn, rank() OVER w2 AS rk, dense_rank() OVER w2 AS dr, ntile(4) OVER w AS nt,
  round(percent_rank() OVER w2, 9) AS pr, round(cume_dist() OVER w2, 9) AS cd FROM {t}
WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey), w2 AS (PARTITION BY c_nationkey ORDER BY c_mktsegment)"""


@query(_RANK.format(t="customer"))
def win_rank(t):
    w = Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")
    v = Window.partitionBy("c_nationkey").orderBy("c_mktsegment")
    return t.customer.select(
        "c_custkey", *[f.over(o).cast("long").alias(n) for f, o, n in ((F.row_number(), w, "rn"), (F.rank(), v, "rk"), (F.dense_rank(), v, "dr"), (F.ntile(4), w, "nt"))],
        F.round(F.percent_rank().over(v), 9).alias("pr"), F.round(F.cume_dist().over(v), 9).alias("cd"))


@query("""SELECT o_orderkey, lag(o_totalprice) OVER w AS before, lead(o_totalprice, 2) OVER w AS after2, first_value(o_totalprice) OVER w AS first,
  last_value(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last,
  nth_value(o_totalprice, 2) OVER w AS second FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def win_analytic(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = "o_totalprice"
    return t.orders.select("o_orderkey", F.lag(p).over(w).alias("before"), F.lead(p, 2).over(w).alias("after2"), F.first(p).over(w).alias("first"), F.last(p).over(full).alias("last"), F.nth_value(p, 2).over(w).alias("second"))


@query("SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS q FROM lineitem")
def win_rows(t):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").rowsBetween(-2, 0)
    return t.lineitem.select("l_orderkey", "l_linenumber", F.sum("l_quantity").over(w).alias("q"))


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM part")
def win_range(t):
    w = Window.partitionBy("p_brand").orderBy("p_size").rangeBetween(-5, 5)
    return t.part.select("p_partkey", F.count("*").over(w).alias("near"))


# Sorting and limits


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority DESC NULLS LAST, o_totalprice NULLS FIRST, o_orderkey")
def sort_multi(t):
    return t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice").orderBy(F.col("o_orderpriority").desc_nulls_last(), F.col("o_totalprice").asc_nulls_first(), "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 25")
def limit_offset(t):
    return t.customer.select("c_custkey").orderBy("c_custkey").offset(25).limit(10)


@query("SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def topk_group(t):
    return top_per_group(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).drop("o_totalprice").withColumn("rn", F.col("rn").cast("long"))


# Sets


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def set_union_all(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).intersect(t.supplier.select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def set_intersect_all(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).intersectAll(t.supplier.select("s_nationkey"))


@query("SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def set_except(t):
    return t.orders.select(F.col("o_custkey").alias("k")).subtract(t.customer.where("c_acctbal > 0").select("c_custkey"))


@query("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def set_except_all(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).exceptAll(t.supplier.select("s_nationkey"))


# Subqueries


def _sub(name: str, text: str, *names: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: Tables(spark, sf_dir).sql(text.format(**{n: f"{{{n}}}" for n in names}), *names)
    SQL[name] = text.format(**{n: n for n in names})


_sub("sub_scalar", "SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT max(o_totalprice) * 0.9 FROM {orders})", "orders")
_sub("sub_in", "SELECT s_suppkey FROM {supplier} WHERE s_nationkey IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey = 1)", "supplier", "nation")
_sub("sub_exists", "SELECT p_partkey FROM {part} p WHERE EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > 49)", "part", "lineitem")
_sub("sub_correlated", "SELECT o_orderkey FROM {orders} o WHERE o_totalprice = (SELECT max(i.o_totalprice) FROM {orders} i WHERE i.o_custkey = o.o_custkey)", "orders")
_sub(
    "sub_cte",
    "WITH big AS (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 5) SELECT c_nationkey, count(*) AS n, max(n) AS most FROM {customer} JOIN big ON c_custkey = o_custkey GROUP BY c_nationkey",
    "orders", "customer",
)


# Placement, moves and node states


_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({v}) + 1), lambda i: ascii(substr({v}, i::INT, 1))::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [1,2,3,4,5,6,7,8]::BIGINT[]), lambda x, k: xor(x >> 1, (x & 1) * 3988292384::BIGINT))), 4294967295::BIGINT)"""
NODES = [(0, "grpc+tcp://127.0.0.1:10011", 1 << 30), (1, "grpc+tcp://127.0.0.2:10012", 2 << 30), (2, "grpc+tcp://127.0.0.3:10013", 2 << 30)]


def _nodes(t, n: int) -> DataFrame:
    return t._spark.createDataFrame(NODES[:n], "pos int, uri string, cache_bytes long")


def _ring_sql(name: str, n: int) -> str:
    rows = ", ".join(f"({p}, '{u}', {b})" for p, u, b in NODES[:n])
    return f"""{name}_v AS (SELECT pos, uri, i, uri || '_' || i AS v FROM (VALUES {rows}) AS n(pos, uri, b), LATERAL (SELECT unnest(range(0, greatest(1, least(400, (b // 1048576) // 100)))) AS i)),
{name} AS (SELECT point, arg_min(uri, pos * 1000 + i) AS uri FROM (SELECT *, {_CRC.format(v='v')} AS point FROM {name}_v) GROUP BY point),
{name}_a AS (SELECT k, coalesce((SELECT arg_min(uri, point) FROM {name} WHERE point >= h), (SELECT arg_min(uri, point) FROM {name})) AS uri FROM keys)"""


_KEYS = f"keys AS MATERIALIZED (SELECT k, {_CRC.format(v='k')} AS h FROM (SELECT o_orderkey::VARCHAR AS k FROM orders))"


def _assigned(t, n: int) -> DataFrame:
    return placement.assign(t.orders.select(F.col("o_orderkey").cast("string").alias("k")), "k", _nodes(t, n))


@query(f"WITH {_KEYS}, {_ring_sql('r', 3)} SELECT k, uri FROM r_a")
def placement_assign(t):
    return _assigned(t, 3).select("k", "uri")


@query(f"WITH {_KEYS}, {_ring_sql('r', 3)} SELECT uri, n, (100 * n // sum(n) OVER ())::INT AS percent FROM (SELECT uri, count(*) AS n FROM r_a GROUP BY uri)")
def placement_percent(t):
    return placement.distribution(_assigned(t, 3))


@query(f"WITH {_KEYS}, {_ring_sql('r', 2)}, {_ring_sql('s', 3)} SELECT r_a.uri, k FROM r_a JOIN s_a USING (k) WHERE r_a.uri <> s_a.uri")
def placement_moved(t):
    return placement.moved(_assigned(t, 2), _assigned(t, 3), "k")


@query("SELECT pos, uri, greatest(1, least(400, (b // 1048576) // 100))::INT AS n FROM (VALUES (0, 'a', 1048576), (1, 'b', 1073741824), (2, 'c', 2147483648), (3, 'd', 1099511627776)) AS n(pos, uri, b)")
def placement_vnodes(t):
    rows = [(0, "a", 1 << 20), (1, "b", 1 << 30), (2, "c", 2 << 30), (3, "d", 1 << 40)]
    return t._spark.createDataFrame([(p, u, placement.vnodes(b)) for p, u, b in rows], "pos int, uri string, n int")


@query("""WITH g AS (SELECT event_id, date_diff('millisecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) AS gap FROM events),
m AS (SELECT event_id, CASE WHEN gap IS NOT NULL THEN greatest(0, (gap - 1) // 3600000) END AS missed FROM g)
SELECT event_id, missed, CASE WHEN missed IS NULL THEN 'UNKNOWN' WHEN missed > 5 THEN 'FAILED' WHEN missed > 2 THEN 'SUSPECTED' ELSE 'OK' END AS state FROM m""")
def health_missed(t):
    return health.missed_beats(t.events.select("user_id", "ts", "event_id"), "user_id", "ts", beat_ms=3_600_000).select("event_id", F.col("missed").cast("long").alias("missed"), "state")


# Scalar functions


@query("SELECT c_custkey, upper(c_name) AS u, substr(c_name, 3, 5) AS s, length(c_name) AS n, replace(c_name, '#', '-') AS r, concat_ws('/', c_mktsegment, c_name) AS j FROM customer")
def fn_string(t):
    c = "c_name"
    return t.customer.select("c_custkey", F.upper(c).alias("u"), F.substring(c, 3, 5).alias("s"), F.length(c).cast("long").alias("n"), F.replace(F.col(c), F.lit("#"), F.lit("-")).alias("r"), F.concat_ws("/", "c_mktsegment", c).alias("j"))


@query("SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, date_trunc('month', o_orderdate)::TIMESTAMP AS t, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::INT AS d, o_orderdate + INTERVAL 3 DAY AS later FROM orders")
def fn_date(t):
    d = F.col("o_orderdate")
    month = F.make_timestamp_ntz(F.year(d), F.month(d), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return t.orders.select("o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), month.alias("t"), F.datediff(d.cast("date"), F.lit("1992-01-01").cast("date")).alias("d"), (d + F.expr("INTERVAL 3 DAYS")).alias("later"))


@query("SELECT p_partkey, round(sqrt(p_retailprice), 6) AS s, floor(p_retailprice)::BIGINT AS f, abs(p_size - 25) AS a, power(p_size, 2)::DOUBLE AS p FROM part")
def fn_math(t):
    return t.part.select("p_partkey", F.round(F.sqrt("p_retailprice"), 6).alias("s"), F.floor("p_retailprice").alias("f"), F.abs(F.col("p_size") - 25).alias("a"), F.pow("p_size", F.lit(2)).alias("p"))


@query("SELECT vec_id, len(embedding)::INT AS n, round(list_sum(list_transform(embedding, lambda x: (x * x)::DOUBLE)), 3) AS norm2, embedding[1]::DOUBLE AS first FROM embeddings")
def fn_array(t):
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + (x * x).cast("double"))
    return t.embeddings.select("vec_id", F.size("embedding").alias("n"), F.round(total, 3).alias("norm2"), F.col("embedding")[0].cast("double").alias("first"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_valid(props) AS ok FROM events")
def fn_json(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.expr("try_parse_json(props) is not null").alias("ok"))


@query(f"SELECT c_custkey, {_CRC.format(v='c_name')} AS h FROM customer")
def fn_crc32(t):
    return t.customer.select("c_custkey", F.crc32(F.col("c_name").cast("binary")).alias("h"))


_NUMBERS = [" 42 ", "-7", "+", "99999999999999999999", "-99999999999999999999", "12x", "", "\t0\n", "007"]


@query("SELECT * FROM (VALUES (0, 42::BIGINT), (1, -7), (2, 0), (3, 9223372036854775807), (4, -9223372036854775808), (5, NULL), (6, NULL), (7, 0), (8, 7)) AS v(i, value)")
def fn_parse_int(t):
    rows = t._spark.createDataFrame(list(enumerate(_NUMBERS)), "i int, text string")
    return rows.select("i", parse.to_int(F.col("text")).alias("value"))


@query("SELECT * FROM (VALUES (0, '1023.00 B'), (1, '1.00 KB'), (2, '1.50 MB'), (3, '0'), (4, '3.00 GB')) AS v(i, text)")
def fn_pretty_bytes(t):
    rows = t._spark.createDataFrame(list(enumerate([1023, 1024, 1572864, 0, 3 << 30])), "i int, v long")
    return rows.select("i", pretty.bytes_(F.col("v")).alias("text"))


@query("SELECT * FROM (VALUES (0, 1.5::DOUBLE), (1, -0.25), (2, 1200.0), (3, 'inf'::DOUBLE), (4, '-inf'::DOUBLE), (5, NULL), (6, 'inf'::DOUBLE)) AS v(i, value)")
def fn_parse_float(t):
    rows = t._spark.createDataFrame(list(enumerate([" 1.5", "-.25", "1.2e3", "INF", "-Infinity", "1.5x", "1e999"])), "i int, text string")
    return rows.select("i", parse.to_float(F.col("text")).alias("value"))


@query("SELECT * FROM (VALUES (0, 'true'), (1, 'false'), (2, NULL), (3, NULL), (4, NULL)) AS v(i, value)")
def fn_parse_bool(t):
    rows = t._spark.createDataFrame(list(enumerate([" TRUE\t", "False", "t", "1", ""])), "i int, text string")
    return rows.select("i", pretty.boolean(parse.to_bool(F.col("text"))).alias("value"))


@query("SELECT * FROM (VALUES (0, 255::BIGINT), (1, -18), (2, 0), (3, 18)) AS v(i, value)")
def fn_parse_base(t):
    rows = t._spark.createDataFrame(list(enumerate(["ff", " -12", "zz", "12g"])), "i int, text string")
    return rows.select("i", parse.to_int_base(F.col("text"), 16).alias("value"))


@query("SELECT * FROM (VALUES (0, '999', '999.000ns', '999ms'), (1, '1.50K', '1.500us', '1s500ms'), (2, '3.66M', '3.661ms', '1h1m')) AS v(i, amount, ns, ms)")
def fn_pretty_units(t):
    rows = t._spark.createDataFrame(list(enumerate([999, 1500, 3_661_000])), "i int, v long")
    v = F.col("v")
    return rows.select("i", pretty.unit(v).alias("amount"), pretty.nanoseconds(v).alias("ns"), pretty.milliseconds(v).alias("ms"))


@query("SELECT p_partkey, regexp_extract(p_brand, '([0-9]+)', 1) AS digits, regexp_replace(p_name, '[aeiou]', '_', 'g') AS masked, md5(p_name) AS m, sha256(p_brand) AS s FROM part")
def fn_regex_hash(t):
    return t.part.select("p_partkey", F.regexp_extract("p_brand", "([0-9]+)", 1).alias("digits"), F.regexp_replace("p_name", "[aeiou]", "_").alias("masked"), F.md5("p_name").alias("m"), F.sha2("p_brand", 256).alias("s"))


@query("SELECT n_regionkey, map_extract_value(map_from_entries(list((n_nationkey, n_name))), n_regionkey) AS own, count(*) AS n FROM nation GROUP BY n_regionkey")
def fn_map(t):
    pairs = F.map_from_entries(F.collect_list(F.struct("n_nationkey", "n_name")))
    return t.nation.groupBy("n_regionkey").agg(pairs.alias("m"), F.count("*").alias("n")).select("n_regionkey", F.try_element_at("m", F.col("n_regionkey")).alias("own"), "n")


# Event time, as batches


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS w_start, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 1 HOUR AS w_end, event_type, count(*) AS n, sum(value::DECIMAL(18,6))::DOUBLE AS total FROM events GROUP BY ALL")
def stream_tumbling(t):
    return windows.tumbling(t.events, "ts", "1 hour", "event_type")


@query("""SELECT b - INTERVAL 30 MINUTE * k AS w_start, b - INTERVAL 30 MINUTE * k + INTERVAL 1 HOUR AS w_end, count(*) AS n, sum(value::DECIMAL(18,6))::DOUBLE AS total
FROM (SELECT value, time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '1970-01-01') AS b FROM events), (VALUES (0), (1)) AS v(k) GROUP BY ALL""")
def stream_sliding(t):
    return windows.sliding(t.events, "ts", "1 hour", "30 minutes")


@query("""WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g)
SELECT min(ts) AS w_start, max(ts) + INTERVAL 2 HOUR AS w_end, user_id, count(*) AS n, sum(value::DECIMAL(18,6))::DOUBLE AS total FROM s GROUP BY user_id, sid""")
def stream_sessions(t):
    return windows.sessions(t.events, "ts", "2 hours", "user_id")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_deduplicated(t):
    return windows.deduplicated(t.events, "ts", "1 hour", "user_id", "event_type").select("user_id", "event_type")


# User-defined functions


@query("SELECT p_partkey, p_retailprice * 1.1 AS taxed FROM part")
def udf_pandas(t):
    @F.pandas_udf("double")
    def taxed(price: pd.Series) -> pd.Series:
        return price * 1.1

    return t.part.select("p_partkey", taxed("p_retailprice").alias("taxed"))


@query("SELECT n_nationkey, unnest(string_split(n_name, '_')) AS word FROM nation")
def udf_table(t):
    @F.udtf(returnType="word string")
    class Words:
        def eval(self, text: str):
            for w in text.split("_"):
                yield (w,)

    t._spark.udtf.register("heddle_words", Words)
    return t.sql("SELECT n_nationkey, word FROM {nation}, LATERAL heddle_words(n_name)", "nation")


@query("SELECT c_mktsegment, max(c_acctbal) - min(c_acctbal) AS spread FROM customer GROUP BY c_mktsegment")
def udaf_pandas(t):
    @F.pandas_udf("double")
    def spread(v: pd.Series) -> float:
        return v.max() - v.min()

    return t.customer.groupBy("c_mktsegment").agg(spread("c_acctbal").alias("spread"))


@query("SELECT r_regionkey, reverse(r_name) AS turned FROM region")
def udf_scalar(t):
    turned = F.udf(lambda s: s[::-1], "string", useArrow=True)
    return t.region.select("r_regionkey", turned("r_name").alias("turned"))


@query("SELECT user_id, count(*) AS n, sum(value::DECIMAL(18,6))::DOUBLE AS total FROM events GROUP BY user_id")
def stream_run_totals(t):
    """A real stream: the file is read as a source, its running totals are kept as state, and the last ones are returned."""
    source = t._spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t._dir)
    totals = source.groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,6)")).cast("double").alias("total"))
    return windows.finished(totals)


@query("SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS w_start, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') + INTERVAL 1 DAY AS w_end, count(*) AS n, sum(value::DECIMAL(18,6))::DOUBLE AS total FROM events GROUP BY ALL")
def stream_run_windows(t):
    source = t._spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t._dir)
    return windows.finished(windows.tumbling(source, "ts", "1 day"))


# Decision support


for _name, _text in business.BUSINESS.items():
    _sub(_name, _text, *business.tables_of(_text))


# Datasets: plans, listings, sinks, cache accounting


@query("SELECT 'lineitem.parquet' AS file, 'l_orderkey,l_tax' AS columns, 'struct<l_orderkey:bigint,l_tax:double>' AS projected_schema, true AS placed, count(*) AS n_rows FROM lineitem")
def plan_partitions(t):
    r = Registry(t._spark, [Node(u, b) for _, u, b in NODES])
    r.register("lineitem", t.path("lineitem"))
    p = r.plan("lineitem", "l_orderkey, l_tax")
    return p.select(F.element_at(F.split("partition_id", "/"), -1).alias("file"), F.array_join("columns", ",").alias("columns"), "projected_schema", F.col("location").isNotNull().alias("placed"), "n_rows")


@query("SELECT * FROM (VALUES ('nation', 'PARQUET', 1, true), ('region', 'PARQUET', 1, true)) AS v(name, format, n_files, sized)")
def dataset_listing(t):
    r = Registry(t._spark)
    for name in ("region", "nation", "part"):
        r.register(name, t.path(name))
    return r.listed().where("name like '%ion'").select("name", "format", "n_files", (F.col("n_bytes") > 0).alias("sized"))


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def sink_orc_round_trip(t):
    return stored_copy(t.supplier.select("s_suppkey", "s_name", "s_nationkey"), format="orc")


@query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderpriority = '2-HIGH'")
def sink_partitioned(t):
    rows = t.orders.select("o_orderkey", "o_totalprice", "o_orderpriority")
    return stored_copy(rows, partition_by=["o_orderpriority"]).where("o_orderpriority = '2-HIGH'")


@query("SELECT 2 * count(*) AS n FROM customer")
def sink_append(t):
    return stored_copy(t.customer, t.customer).agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES ('a,b', '', 'a,b', 0, 0, 0), ('a,b', 'a,b', '', 50, 50, 50), ('b,c', 'b', 'c', 66, 66, 33), ('a', '', 'a', 75, 75, 25), ('c', 'c', '', 80, 80, 40)) AS v(request, hits, misses, dataset, partition, col)")
def cache_ledger(t):
    # Room for two columns: reading c lets a go, so a is missed again and lets b go.
    ledger, rows = Ledger(capacity=1000), []
    for request in ("a,b", "a,b", "b,c", "a", "c"):
        hits, misses = ledger.scan("d", "p", request.split(","), lambda _: 400)
        rates = ledger.metrics.rates()
        rows.append((request, ",".join(hits), ",".join(misses), rates["dataset"], rates["partition"], rates["column"]))
    return t._spark.createDataFrame(rows, "request string, hits string, misses string, dataset int, partition int, col int")


@query("""WITH a AS (SELECT user_id, (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(max(ts))) // 1000 AS age FROM events GROUP BY user_id)
SELECT user_id, age AS age_ms, CASE WHEN age > 43200000 THEN 'FAILED' WHEN age > 7200000 THEN 'SUSPECTED' ELSE 'OK' END AS state FROM a""")
def health_timeouts(t):
    age = F.expr("timestampdiff(MILLISECOND, last, timestamp_ntz'2024-01-31 00:00:00')")
    last = t.events.groupBy("user_id").agg(F.max("ts").alias("last")).withColumn("age_ms", age)
    return last.select("user_id", "age_ms", health.timed_out(F.col("age_ms"), 7_200_000, 43_200_000).alias("state"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem projected by a column string, then aggregated."""
    t = Tables(spark, sf_dir)
    rows = scans.scan(spark, t.path("lineitem"), "l_orderkey, l_extendedprice")
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("n"), money("l_extendedprice").alias("total"))


QUERIES["flagship"] = flagship
SQL["flagship"] = "SELECT l_orderkey, count(*) AS n, sum(l_extendedprice::DECIMAL(18,4))::DOUBLE AS total FROM lineitem GROUP BY l_orderkey"


from heddle import service_queries  # noqa: E402, F401  (registers its queries)
