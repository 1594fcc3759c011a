"""Registered queries of datasets by name, nodes, tables by SQL, put streams, dictionaries and running streams."""

from __future__ import annotations

import time
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.catalog import _CRC, NODES, _assigned, _ring_sql, query
from heddle.operators import dictionary
from heddle.plans import placement
from heddle.plans.ledger import ColumnCache, Ledger
from heddle.plans.placement import Node
from heddle.plans.workers import Workers, let_go
from heddle.session import shared_dir
from heddle.sources import footers, puts, scan, tables
from heddle.sources.registry import Registry
from heddle.streaming import health, windows


def _folder(t, name: str) -> str:
    return f"{shared_dir(t._spark)}/{name}-{uuid.uuid4().hex}"


def _copy(df: DataFrame, t, name: str, files: int = 1) -> str:
    path = _folder(t, name)
    df.repartition(files).write.parquet(path)
    return path


# Tables by SQL


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def ddl_create_select(t):
    tables.create_table(t._spark, "heddle_nation", t.path("nation"), replace=True)
    return t._spark.sql("SELECT n_regionkey, count(*) AS n FROM heddle_nation GROUP BY n_regionkey")


@query("""SELECT (row_number() OVER (ORDER BY ordinal_position) - 1)::INT AS pos, column_name AS name,
CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double' ELSE data_type END AS type
FROM information_schema.columns WHERE table_name = 'supplier'""")
def ddl_describe(t):
    tables.create_table(t._spark, "heddle_supplier", t.path("supplier"), replace=True)
    return tables.described(t._spark, "heddle_supplier").select("pos", "name", "type")


@query("SELECT 'heddle_shown_' || table_name AS name, false AS temporary FROM information_schema.tables WHERE table_name IN ('region', 'part')")
def ddl_show(t):
    for name in ("region", "part"):
        tables.create_table(t._spark, f"heddle_shown_{name}", t.path(name), replace=True)
    return tables.shown(t._spark, "heddle_shown_*")


# Row groups, plans and statistics


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 400 OFFSET 400")
def row_group_chosen(t):
    """One row group of a file that has three, by its number, and two of its columns."""
    path, key = _folder(t, "groups"), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = t._spark.conf.get(key)
    t._spark.conf.set(key, "400")  # the batches of a put are the row groups of its file
    try:
        puts.put(t.orders.orderBy("o_orderkey").limit(1200), path)
    finally:
        t._spark.conf.set(key, before)
    return footers.row_groups(t._spark, path, "o_orderkey, o_totalprice", row_group=1)


@query("SELECT count(*) AS n_rows, 3::BIGINT AS n_partitions FROM customer")
def plan_counts(t):
    r = Registry(t._spark, [Node(u, b) for _, u, b in NODES])
    r.register("c", _copy(t.customer, t, "plan", 3))
    return r.plan("c", "c_custkey").agg(F.sum("n_rows").alias("n_rows"), F.count("*").alias("n_partitions"))


# Puts, dictionaries, batches by hand


@query("SELECT 'note' AS note, sum(n)::BIGINT AS n_rows, sum(n)::BIGINT AS acknowledged FROM (SELECT count(*) AS n FROM customer)")
def put_stream(t):
    path = _folder(t, "put")
    told = puts.put(t.customer, path, note="note").groupBy("note").agg(F.sum("n_rows").alias("acknowledged"))
    return told.crossJoin(t._spark.read.parquet(path).agg(F.count("*").alias("n_rows"))).select("note", "n_rows", "acknowledged")  # one row each


@query("SELECT p_partkey, p_brand, p_size FROM part")
def dictionary_round_trip(t):
    codes, words = dictionary.encoded(t.part.select("p_partkey", "p_brand", "p_size"), "p_brand")
    return dictionary.decoded(codes, words, "p_brand")


@query("SELECT count(DISTINCT p_brand) AS n, count(DISTINCT p_brand) AS n_codes FROM part")
def dictionary_size(t):
    codes, words = dictionary.encoded(t.part.select("p_brand"), "p_brand")
    return words.agg(F.count("*").alias("n")).crossJoin(codes.agg(F.countDistinct("p_brand").alias("n_codes")))  # one row each


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE sqrt(c_acctbal) END AS root FROM customer")
def transform_with_hook(t):
    """A function of batches that fails on debts; the hook gives what it can for those batches."""

    def root(b: pa.RecordBatch) -> pa.RecordBatch:
        if pc.any(pc.less(b.column(1), 0)).as_py():
            raise ValueError("a debt has no root")
        return pa.RecordBatch.from_arrays([b.column(0), pc.sqrt(b.column(1))], names=["c_custkey", "root"])

    def mended(b: pa.RecordBatch, error: Exception) -> pa.RecordBatch:
        known = pc.if_else(pc.less(b.column(1), 0), pa.scalar(None, pa.float64()), b.column(1))
        return pa.RecordBatch.from_arrays([b.column(0), pc.sqrt(known)], names=["c_custkey", "root"])

    rows = t.customer.select("c_custkey", "c_acctbal")
    return scan.transformed(rows, root, f"c_custkey {rows.schema['c_custkey'].dataType.simpleString()}, root double", mended)


@query("SELECT r_regionkey, r_name FROM region")
def collect_table(t):
    """Collected as one Arrow table, which then is a source again."""
    return t._spark.createDataFrame(scan.collected(t.region))


# Registry: appends, moves, failures


@query("SELECT count(*) AS before, 2 * count(*) AS after, 2 * count(*) AS planned FROM nation")
def registry_append(t):
    r = Registry(t._spark, [Node(u, b) for _, u, b in NODES])
    r.register("n", _copy(t.nation, t, "append"))
    before = r.frame("n").count()
    r.put("n", t.nation)
    planned = r.plan("n").agg(F.sum("n_rows")).first()[0]
    return t._spark.createDataFrame([(before, r.frame("n").count(), planned)], "before long, after long, planned long")


_KEYS = f"keys AS MATERIALIZED (SELECT k, {_CRC.format(v='k')} AS h FROM (SELECT o_orderkey::VARCHAR AS k FROM orders))"


@query(f"WITH {_KEYS}, {_ring_sql('r', 2)} SELECT k, uri FROM r_a")
def placement_removed(t):
    """A ring of three that lost its last node places as the ring of the first two does."""
    three = placement.ring_points(t._spark.createDataFrame(NODES, "pos int, uri string, cache_bytes long"))
    ring = placement.Ring([Node(u, b) for _, u, b in NODES])
    ring.remove(Node(*NODES[2][1:]))
    left = {r["point"] for r in three.where(F.col("uri") != NODES[2][1]).collect()}  # points of a ring: 400 a node at most
    if left != set(ring.points):
        raise AssertionError("the two forms of the ring differ")
    return _assigned(t, 2).select("k", "uri")


#: Two names whose first points are the same.
_ALIKE = ("n599430bd25", "nf7633dd321")


@query(f"SELECT {_CRC.format(v='v')} AS point, '{_ALIKE[1]}' AS uri FROM (SELECT '{_ALIKE[0]}_0' AS v)")
def placement_collision(t):
    """The node that comes first keeps a point that both claim."""
    return placement.ring_points(t._spark.createDataFrame([(1, _ALIKE[0], 1 << 20), (0, _ALIKE[1], 1 << 20)], "pos int, uri string, cache_bytes long"))


@query("SELECT 'FAILED' AS state, 2 AS n_nodes, true AS heard, true AS told_once, true AS placed_on_others, true AS let_go")
def node_failure(t):
    """A node falls silent: it is removed, its partitions go to others, and those that moved off living nodes are let go."""
    spark, path = t._spark, _copy(t.nation, t, "failure", 8)
    registry, heard = Registry(spark), []
    workers = Workers(registry, observers=[heard.append])
    nodes = [Node(u, b) for _, u, b in NODES]
    for n in nodes:
        workers.register(n, 0)
    held = registry.register("n", path).locations
    cache = ColumnCache(Ledger(1 << 20))
    for part in held:
        cache.ledger.insert(("n", part, "n_name"), 10)
    for n in nodes[:2]:
        workers.beat(n.uri, 30_000)
    state = workers.check(30_000)[nodes[2].uri]
    now = registry.get("n").locations
    moved = {p for p in held if held[p] != now[p]}
    drops = registry.take_drops(nodes[2].uri) + [d for n in nodes[:2] for d in workers.beat(n.uri, 31_000)]
    let_go(cache, drops)
    again = [d for n in nodes[:2] for d in workers.beat(n.uri, 32_000)]
    kept = {k[1] for k in cache.ledger.entries}
    row = (state, len(workers.nodes), heard == [nodes[2].uri], not again, set(now.values()) <= {n.uri for n in nodes[:2]}, kept == set(held) - moved)
    return spark.createDataFrame([row], "state string, n_nodes int, heard boolean, told_once boolean, placed_on_others boolean, let_go boolean")


# Streams that run: watermarks, late rows, sessions, states


def _source(t, path: str | None = None) -> DataFrame:
    """Events as a stream, with instants for times; a folder is read file by file, the oldest first."""
    reader = t._spark.readStream.schema(t.events.schema)
    if path:
        rows = reader.option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)
    else:
        rows = reader.option("pathGlobFilter", "events.parquet").parquet(t._dir)
    return rows.withColumn("ts", windows.instant("ts"))


def _sent(counted: DataFrame) -> DataFrame:
    return windows.drained(counted).withColumns({c: windows.wall(c) for c in ("w_start", "w_end")})


_DAYS = "time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01')"


@query(f"""SELECT w_start, w_end, n, total FROM (SELECT {_DAYS} AS w_start, {_DAYS} + INTERVAL 1 DAY AS w_end, count(*) AS n, sum(value::DECIMAL(18,6))::DOUBLE AS total FROM events GROUP BY ALL)
WHERE w_end <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 6 HOUR FROM events)""")
def stream_run_watermark(t):
    """Windows are sent when the watermark, six hours behind the latest event, has passed their end."""
    return _sent(windows.tumbling(_source(t).withWatermark("ts", "6 hours"), "ts", "1 day"))


@query(f"""WITH e AS (SELECT *, ts < TIMESTAMP '2024-01-20' AS late FROM events)
SELECT w_start, w_end, n, total FROM (SELECT {_DAYS} AS w_start, {_DAYS} + INTERVAL 1 DAY AS w_end, count(*) AS n, sum(value::DECIMAL(18,6))::DOUBLE AS total FROM e WHERE NOT late GROUP BY ALL)
WHERE w_end <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY FROM events)""")
def stream_run_late(t):
    """Three files in turn. The third's events are behind the watermark that the first has moved (it holds from the batch after next), and are dropped."""
    path = _folder(t, "late")
    recent = "ts >= timestamp_ntz'2024-01-20 00:00:00'"
    for name, rows in (("a", f"{recent} and event_id % 2 = 0"), ("b", f"{recent} and event_id % 2 <> 0"), ("c", f"not {recent}")):
        t.events.where(rows).coalesce(1).write.parquet(f"{path}/{name}")
        time.sleep(0.05)  # files are read by their modification times
    return _sent(windows.tumbling(_source(t, path).withWatermark("ts", "1 day"), "ts", "1 day"))


@query("""WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g),
f AS (SELECT min(ts) AS w_start, max(ts) + INTERVAL 2 HOUR AS w_end, user_id, count(*) AS n, sum(value::DECIMAL(18,6))::DOUBLE AS total FROM s GROUP BY user_id, sid)
SELECT * FROM f WHERE w_end <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)""")
def stream_run_sessions(t):
    return _sent(windows.sessions(_source(t).withWatermark("ts", "1 hour"), "ts", "2 hours", "user_id"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_run_deduplicated(t):
    """Each pair once within a watermark that spans the table."""
    return windows.drained(windows.deduplicated(_source(t), "ts", "400 days", "user_id", "event_type").select("user_id", "event_type"))


@query("""WITH p AS (SELECT user_id, count(*) AS beats, epoch_ms(max(ts)) AS last FROM events GROUP BY user_id)
SELECT user_id, beats, 'OK' AS state FROM p
UNION ALL SELECT user_id, beats, 'FAILED' FROM p WHERE last + 86400000 < (SELECT epoch_ms(max(ts)) FROM events)""")
def stream_run_states(t):
    """Heartbeats as a stateful stream: all peers are seen, and those silent for a day of event time have failed."""
    return windows.drained(health.stream_states(_source(t), "user_id", "ts", timeout_ms=86_400_000), "update")
