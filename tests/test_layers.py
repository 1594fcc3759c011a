"""Registry, placement, ledger, scans, scalars, health, streams."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.errors import DatasetError, NotSupported
from heddle.functions import parse, pretty
from heddle.operators import dictionary
from heddle.operators.joins import asof, in_range, salted
from heddle.plans import business
from heddle.plans.ledger import ColumnCache, Ledger
from heddle.plans.placement import Node, Ring, assign, crc32, vnodes
from heddle.plans.workers import Workers
from heddle.settings import settings as session_settings
from heddle.sources import footers, puts, scan
from heddle.sources.registry import Registry
from heddle.sources.sinks import stored_copy
from heddle.streaming import health, listeners, windows


def test_column_strings():
    assert scan.column_names("a, b, c") == ["a", "b", "c"]
    assert scan.column_names(None) is None and scan.column_names([]) is None
    assert scan.column_names("") == [""]


def test_projection_errors(spark):
    df = spark.range(3).select("id", F.lit(1).alias("A"))
    assert scan.project(df, "A, id, A", suffix_duplicates=True).columns == ["A", "id", "A_2"]
    for bad in ("a", "", "id,"):
        with pytest.raises(DatasetError):
            scan.project(df, bad)


def test_required_column_missing(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "d"))
    with pytest.raises(DatasetError):
        scan.scan(spark, str(tmp_path / "d"), schema=T.StructType([T.StructField("id", T.LongType()), T.StructField("x", T.LongType(), False)]))


def test_registry_life(spark, tmp_path):
    path = str(tmp_path / "d")
    spark.range(10).repartition(6).write.parquet(path)
    nodes = [Node(f"tcp://n{i}", 1 << 30) for i in range(3)]
    r = Registry(spark, nodes)
    assert len(r.register("d", path).files.files) == 6
    plan = r.plan("d", "id")
    assert plan.count() == 6 and {x.location for x in plan.collect()} <= {n.uri for n in nodes}
    assert r.listed().where("name = 'd' and n_files = 6").count() == 1
    before = r.datasets["d"].locations
    r.set_nodes(nodes[:2])
    after = r.get("d").locations
    assert {p for w, _, parts in r.drops for p in parts} == {p for p in before if before[p] != after[p]}
    r.put("d", spark.range(10, 20), path)
    assert r.frame("d").count() == 20 and r.plan("d").agg(F.sum("n_rows")).first()[0] == 20
    for bad in (lambda: r.put("d", spark.range(1), str(tmp_path / "other")), lambda: r.put("d", spark.range(1).toDF("x")), lambda: r.put("new", spark.range(1))):
        with pytest.raises(DatasetError):
            bad()
    assert r.frame("d").count() == 20
    spark.range(4).write.orc(str(tmp_path / "o"))
    r.register("o", str(tmp_path / "o"), format="ORC")
    r.put("o", spark.range(4, 6))
    assert sorted(x.id for x in r.frame("o").collect()) == list(range(6)) and {x.n_rows for x in r.plan("o").collect()} == {-1}
    with pytest.raises(DatasetError):
        r.register("z", "nosuch://host/path")
    for bad in (lambda: r.plan("d", "nope"), lambda: r.get("x"), lambda: r.register("y", path, catalog="odd"), lambda: r.register("y", path, format="CSV"), lambda: r.register("y", str(tmp_path / "none"))):
        with pytest.raises(DatasetError):
            bad()
    with pytest.raises(NotSupported):
        r.register("y", path, catalog="PRIVATE")
    r.drop("d")
    with pytest.raises(DatasetError):
        r.drop("d")


def test_ring_vectors():
    assert crc32("partitionfile1") == 921121902 and crc32("a") == 3904355907 and crc32("teststring") == 525924414
    assert [vnodes(b << 20) for b in (1, 1024, 2048, 1 << 20)] == [1, 10, 20, 400]
    with pytest.raises(DatasetError):
        Ring([]).locate("a")


@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=50), st.integers(1, 5))
@settings(max_examples=30, deadline=None)
def test_a_joining_node_only_takes(keys, n):
    nodes = [Node(f"n{i}", 1 << 30) for i in range(n + 1)]
    old, new = Ring(nodes[:n]), Ring(nodes)
    for k in map(str, keys):
        assert new.locate(k) in (old.locate(k), f"n{n}")


@given(st.lists(st.tuples(st.integers(0, 9), st.integers(1, 60), st.booleans()), max_size=60), st.sampled_from(["LRU", "FIFO"]))
@settings(max_examples=50, deadline=None)
def test_ledger_stays_within_ratio(steps, policy):
    led = Ledger(100, policy=policy)
    for c, size, touch in steps:
        led.touch(("d", "p", str(c))) if touch else led.insert(("d", "p", str(c)), size)
        assert led.used <= 80
    m = led.metrics
    assert m.column <= m.partition <= m.dataset <= m.total


def test_ledger_order_and_metrics():
    gone = []
    led = Ledger(100, on_evict=gone.append)
    assert led.scan("d", "p", ["a", "b"], lambda c: 30) == ([], ["a", "b"])
    assert led.scan("d", "p", ["a"], lambda c: 30) == (["a"], [])
    led.scan("d", "p", ["c"], lambda c: 30)
    assert gone == [("d", "p", "b")]
    assert not led.insert(("d", "p", "big"), 90)
    assert led.metrics.rates() == {"dataset": 66, "partition": 66, "column": 33}


def test_column_cache(spark):
    df = spark.range(5).select("id", (F.col("id") * 2).alias("x"))
    cache = ColumnCache(Ledger(1000))
    assert cache.read("d", df, ["x"], lambda c: 10).count() == 5
    assert cache.read("d", df, ["id", "x"], lambda c: 10).columns == ["id", "x"]
    cache.drop("d")
    assert not cache.held


def test_footers_and_row_groups(spark, tmp_path):
    path = str(tmp_path / "d")
    spark.range(100).select("id", F.col("id").cast("string").alias("s")).repartition(3).write.parquet(path)
    f = footers.footers(spark, path)
    assert f.groupBy("column").agg(F.sum("n_rows").alias("n")).where("n = 100").count() == 2
    got = footers.row_groups(spark, path, "s, id")
    assert got.columns == ["s", "id"] and got.count() == 100


def test_batches(spark):
    sent = scan.batches(spark.range(0, 6000, 1, 1))
    assert [r["count"] for r in sent.groupBy("batch").count().orderBy("batch").collect()] == [2048, 2048, 1904]
    assert [r.batch for r in sent.orderBy("id").collect()] == [i // 2048 for i in range(6000)]
    assert scan.batches(spark.range(10), rows=3).groupBy("partition", "batch").count().agg(F.max("count")).first()[0] <= 3
    assert scan.batches(spark.range(0)).count() == 0
    with pytest.raises(DatasetError):
        scan.batches(spark.range(1).toDF("batch"))
    assert [len(x) for x in scan.pulled(spark.range(0, 10, 1, 3), 4)] == [4, 4, 2]
    assert scan.collected(spark.range(5)).num_rows == 5
    with pytest.raises(DatasetError):
        scan.collected(spark.range(5), most_bytes=1)


def test_transform_without_hook_fails(spark):
    def bad(b):
        raise ValueError("no")

    with pytest.raises(Exception, match="no"):
        scan.transformed(spark.range(3), bad, "id long").collect()
    assert scan.transformed(spark.range(3), bad, "id long", lambda b, e: None).count() == 0


def test_cancel(spark):
    import threading
    import time

    got = []

    def run():
        with scan.cancellable(spark, "slow") as cancel:
            got.append(cancel)
            try:
                spark.range(0, 4, 1, 4).mapInPandas(lambda it: (time.sleep(60) or x for x in it), "id long").count()
            except Exception as e:
                got.append(str(e))

    t = threading.Thread(target=run)
    t.start()
    while not got:
        time.sleep(0.1)
    time.sleep(3)
    got[0]()
    t.join(40)
    assert not t.is_alive() and "cancel" in got[1].lower()


def test_constants_that_clash(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "d"))
    with pytest.raises(DatasetError):
        scan.scan(spark, str(tmp_path / "d"), constants={"id": 1})


def test_puts(spark, tmp_path):
    path = str(tmp_path / "p")
    told = puts.put(spark.range(0, 10, 1, 2), path, note="a")
    assert sorted((r.n_rows, r.note) for r in told.collect()) == [(5, "a"), (5, "a")] and spark.read.parquet(path).count() == 10
    assert puts.put(spark.range(3), path, note="b").agg(F.sum("n_rows")).first()[0] == 13
    told = puts.put(spark.range(1), path, mode="overwrite")
    assert [(r.n_rows, r.note) for r in told.collect()] == [(1, "")] and spark.read.parquet(path).count() == 1

    def bad(it):
        yield from it
        raise ValueError("half way")

    with pytest.raises(Exception, match="half way"):
        puts.put(spark.range(0, 10, 1, 2).mapInArrow(bad, "id long"), path)
    assert spark.read.parquet(path).count() == 1


def test_dictionary(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (4, "b")], "code int, `a b` string")
    codes, words = dictionary.encoded(df, "a b")
    assert codes.columns == ["code", "a b"] and words.count() == 2
    assert sorted(map(tuple, dictionary.decoded(codes, words, "a b").collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_settings(spark):
    assert session_settings(spark).batch_rows == 2048 and ColumnCache.of(spark).ledger.policy == "LRU"
    spark.conf.set("spark.heddle.batch.rows", "many")
    try:
        with pytest.raises(DatasetError):
            session_settings(spark)
    finally:
        spark.conf.unset("spark.heddle.batch.rows")


def test_listener(spark, tmp_path):
    import time

    spark.range(5).write.parquet(str(tmp_path / "in"))
    seen = []
    with listeners.listening(spark, lambda what, call: seen.append(what)) as calls:
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        assert windows.drained(stream).count() == 5
        for _ in range(50):
            if "ended" in seen:
                break
            time.sleep(0.1)
    (call,) = calls.calls.values()
    assert seen[0] == "started" and seen[-1] == "ended" and call.rows == 5 and call.ended and call.error is None


def test_workers(spark, tmp_path):
    spark.range(10).repartition(4).write.parquet(str(tmp_path / "d"))
    r = Registry(spark)
    w = Workers(r)
    w.register(Node("a", 1 << 30), 0)
    w.register(Node("b", 1 << 30), 0)
    r.register("d", str(tmp_path / "d"))
    assert [w.state("a", t) for t in (3000, 9000, 9001, 12001, 18000, 18001)] == ["OK", "OK", "SUSPECTED", "SUSPECTED", "SUSPECTED", "FAILED"]
    assert w.state("x", 0) == "UNKNOWN"
    w.beat("a", 20_000)
    assert w.check(21_000)["b"] == "FAILED" and list(w.nodes) == ["a"]
    assert set(r.get("d").locations.values()) == {"a"}
    with pytest.raises(DatasetError):
        w.beat("b", 22_000)


def test_empty_ring_places_nothing(spark):
    none = spark.createDataFrame([], "pos int, uri string, cache_bytes long")
    with pytest.raises(DatasetError):
        assign(spark.range(3), "id", none)


def test_salts_spread_equal_rows(spark):
    equal = spark.range(0, 1000, 1, 1).select(F.lit(1).alias("k"))
    joined = salted(equal, spark.createDataFrame([(1, "x")], "k int, n string"), "k", 16)
    assert joined.count() == 1000
    assert equal.select(F.pmod(F.monotonically_increasing_id(), F.lit(16)).alias("s")).distinct().count() == 16


def test_cells_of_large_numbers(spark):
    big = (1 << 60) + 1
    got = in_range(spark.createDataFrame([(big,), (-5,)], "x long"), spark.createDataFrame([(big, big + 1), (-6, -4)], "a long, b long"), at="x", low="a", high="b", width=10)
    assert got.count() == 2


def test_local_scan_pins_its_columns(spark):
    df = spark.range(5).select("id", (F.col("id") * 2).alias("x"))
    cache = ColumnCache(Ledger(20))
    with cache.local("d", df, ["x"], lambda c: 10) as frame:
        cache.read("d", df, ["id"], lambda c: 10)
        assert ("d", "*", "x") in cache.ledger.entries and frame.count() == 5
        cache.drop("d")
        assert ("d", "*", "x") in cache.ledger.entries
    cache.drop("d")
    assert not cache.ledger.entries and not cache.held


@pytest.mark.parametrize("hot_rows", [1_000_000, 100, 0])
@pytest.mark.parametrize("kind", ["int", "timestamp_ntz", "string"])
def test_asof_hot_keys_and_nulls(spark, hot_rows, kind):
    """A key with most of the rows, ties, null keys and null times, against a scan of all rows."""
    rng = random.Random(4)
    some = lambda n: rng.choice([None, *range(n)])
    left = [(i, "hot" if i % 3 else rng.choice([None, "a", "b"]), some(300)) for i in range(500)]
    right = [("hot" if i % 3 else rng.choice([None, "a", "b"]), some(300), rng.choice([None, i])) for i in range(300)]
    at = {"int": "{}", "timestamp_ntz": "timestamp_ntz'2020-01-01' + make_interval(0, 0, 0, 0, 0, {})", "string": "lpad(cast({} as string), 4, '0')"}[kind]
    l = spark.createDataFrame(left, "i int, k string, t int").select("i", "k", F.expr(at.format("t")).alias("t"))
    r = spark.createDataFrame(right, "k string, u int, v int").select("k", F.expr(at.format("u")).alias("u"), "v")
    got = asof(l, r, by=["k"], left_at="t", right_at="u", values=["v"], hot_rows=hot_rows).collect()
    assert len(got) == len(left)
    low = lambda v: -1 if v is None else v
    for x in got:
        _, k, t = left[x.i]
        near = [(u, low(v), v) for k2, u, v in right if None not in (k, t, u) and k2 == k and u <= t]
        assert x.v == (max(near)[2] if near else None)


@pytest.mark.parametrize("kind", ["long", "double"])
def test_in_range_of_any_length(spark, kind):
    """Ranges of less than a cell and of all numbers, empty, reversed and null ones, points at their ends, ends between whole numbers."""
    rng = random.Random(8)
    of = (lambda x: int(x)) if kind == "long" else float
    ends = [of(rng.choice([1, 30, 1000, 10**6]) * rng.uniform(-1, 1)) for _ in range(120)]
    ranges = [(i, a, b) for i, (a, b) in enumerate(zip(ends, ends[1:]))] + [(200, of(-(2**62)), of(2**62 - 1)), (201, None, of(5)), (202, of(5), None), (203, of(3), of(3))]
    if kind == "double":
        ranges += [(300, 0.5, 1.2), (301, float("-inf"), float("inf")), (302, -1.0, float("inf"))]
    else:
        ranges += [(300, -(2**63), 2**63 - 1), (301, -(2**63), -(2**63) + 1), (302, 2**63 - 2, 2**63 - 1)]
    points = list(enumerate([*ends, None, of(0), of(1), of(1.1), of(-(2**61)), of(-(2**63)), of(2**63 - 2) if kind == "long" else 1e300]))
    schema = f"i int, x {kind}", f"r int, a {kind}, b {kind}"
    joined = in_range(spark.createDataFrame(points, schema[0]), spark.createDataFrame(ranges, schema[1]), at="x", low="a", high="b", width=7)
    assert joined.columns == ["i", "x", "r", "a", "b"]
    want = sorted((i, r) for i, x in points for r, a, b in ranges if None not in (x, a, b) and a <= x < b)
    assert sorted((r.i, r.r) for r in joined.collect()) == want
    none = in_range(spark.createDataFrame(points, schema[0]), spark.createDataFrame([], schema[1]), at="x", low="a", high="b", width=7)
    assert none.columns == joined.columns and none.isEmpty()


def test_asof_in_range_salted(spark):
    rng = random.Random(1)
    left = [(i, rng.randrange(3), rng.randrange(50)) for i in range(60)]
    right = sorted({(rng.randrange(3), rng.randrange(50)): i for i in range(40)}.items())
    right = [(k, t, v) for (k, t), v in right]
    got = asof(spark.createDataFrame(left, "i int, k int, t int"), spark.createDataFrame(right, "k int, u int, v int"), by=["k"], left_at="t", right_at="u", values=["v"])
    want = {i: max(((u, v) for k2, u, v in right if k2 == k and u <= t), default=(0, None))[1] for i, k, t in left}
    assert {r.i: r.v for r in got.collect()} == want
    ranges = [(i, a, a + rng.randrange(-2, 20)) for i, a in enumerate(rng.randrange(50) for _ in range(20))]
    got = in_range(spark.createDataFrame([(i,) for i in range(60)], "x int"), spark.createDataFrame(ranges, "r int, a int, b int"), at="x", low="a", high="b", width=7)
    assert sorted((r.x, r.r) for r in got.collect()) == sorted((x, r) for x in range(60) for r, a, b in ranges if a <= x < b)
    one = spark.range(20).select((F.col("id") % 3).alias("k"), "id")
    assert salted(one, spark.createDataFrame([(0, "a"), (1, "b")], "k long, n string"), "k", 4, "left").count() == 20
    with pytest.raises(ValueError):
        salted(one, one, "k", 4, "full")


def test_parsers(spark):
    texts = [" true", "TRUE", "t", "1", "1e400", "-inf", "NaN", "1.5 ", "x", "ff", "zz", "-12"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    c = F.col("t")
    rows = df.select("t", parse.to_bool(c).alias("b"), parse.to_float(c).alias("f"), parse.to_int_base(c, 16).alias("h"), parse.to_int(c, "int").alias("i")).collect()
    by = {r.t: r for r in rows}
    assert by[" true"].b and by["TRUE"].b and by["t"].b is None and by["1"].b is None
    assert by["1e400"].f == float("inf") and by["-inf"].f == -float("inf") and by["NaN"].f != by["NaN"].f and by["1.5 "].f == 1.5 and by["x"].f is None
    assert by["ff"].h == 255 and by["zz"].h == 0 and by["-12"].h == -18 and by["-12"].i == -12


#: Unit -> (number, its text).
PRETTY = {
    "unit": [(0, "0"), (1, "1"), (999, "999"), (1000, "1.00K"), (10**6, "1.00M"), (10**9, "1.00B"), (-5000, "-5000")],
    "unit_fraction": [(1.2345678, "1.234568"), (1500.0, "1.50K")],
    "unit_rate": [(0, "0"), (1, "1.00 /sec"), (1000, "1.00 K/sec"), (10**6, "1.00 M/sec"), (10**9, "1.00 B/sec"), (1.2345678, "1.23 /sec")],
    "bytes": [(0, "0"), (1, "1.00 B"), (-2, "-2.00 B"), (1024, "1.00 KB"), (1536, "1.50 KB"), (1024**2, "1.00 MB"), (1024**3, "1.00 GB"), (-(1024**2), "-1.00 MB"), (1.2345678, "1.23 B")],
    "byte_rate": [(0, "0.00 /sec"), (1, "1.00 B/sec"), (1024, "1.00 KB/sec"), (1024**2, "1.00 MB/sec"), (1024**3, "1.00 GB/sec"), (1536.0, "1.50 KB/sec")],
    "s": [(0.00001, "0ms"), (0.021, "21ms"), (0.31, "310ms"), (1.5, "1s500ms"), (60, "1m"), (3600, "1h"), (86400, "24h"), (1000, "16m40s"), (1.5009, "1s500ms"), (12345, "3h25m"), (1234567.8989, "342h56m"), (123823456789, "34395404h39m")],
    "ms": [(0, "0"), (0.1, "0ms"), (1, "1ms"), (123.4, "123ms"), (1234.9, "1s234ms"), (12345.6789, "12s345ms"), (1234567.89, "20m34s"), (123400, "2m3s"), (123456789, "34h17m"), (2147483647, "596h31m")],
    "us": [(0.00001, "0.010ns"), (0.021, "21.000ns"), (1, "1000.000ns"), (123.4, "123.400us"), (1234.9, "1.234ms"), (1234567.89, "1s234ms"), (123400, "123.400ms"), (123456789, "2m3s"), (10**9, "16m40s")],
    "ns": [(0.0001, "0.000ns"), (0.31, "0.310ns"), (1, "1.000ns"), (123.4, "123.400ns"), (1234.9, "1.234us"), (123400, "123.400us"), (123456789, "123.456ms"), (10**9, "1s000ms"), (12123456789.9, "12s123ms"), (123823456789.9, "2m3s")],
    "ticks": [(1000, "1.00K clock cycles"), (1500, "1.50K clock cycles"), (4 * 10**9, "2s000ms")],
    "double": [(1.0, "1.00 ")],
}


@pytest.mark.parametrize("name", sorted(PRETTY))
def test_pretty(spark, name):
    show = {
        "unit": pretty.unit, "unit_fraction": lambda v: pretty.unit(v, fraction=True), "unit_rate": lambda v: pretty.unit(v, True), "bytes": pretty.bytes_, "byte_rate": lambda v: pretty.bytes_(v, True),
        "s": pretty.seconds, "ms": pretty.milliseconds, "us": pretty.microseconds, "ns": pretty.nanoseconds, "ticks": lambda v: pretty.ticks(v, 2 * 10**6), "double": pretty.double,
    }[name]
    for kind in (int, float):
        rows = [(v, t) for v, t in PRETTY[name] if isinstance(v, kind)] + [(None, None)]
        df = spark.createDataFrame(rows, f"v {'long' if kind is int else 'double'}, t string")
        got = df.select("t", show(F.col("v")).alias("u")).collect()
        assert [r.u for r in got] == [r.t for r in got]


def test_pretty_lists(spark):
    df = spark.sql("SELECT array(1L, 1000L, 1000000L) AS v, cast(array() AS array<bigint>) AS e, true AS b")
    assert tuple(df.select(pretty.listed(F.col("v"), pretty.unit), pretty.listed(F.col("e")), pretty.boolean(F.col("b"))).first()) == ("[1, 1.00K, 1.00M]", "[]", "true")


def test_states(spark):
    beats = spark.sql("SELECT * FROM VALUES ('a', timestamp_ntz'2024-01-01 00:00:00'), ('b', timestamp_ntz'2024-01-01 00:00:19') AS t(p, at)")
    now = F.expr("timestamp_ntz'2024-01-01 00:00:29'")
    assert {r.p: r.state for r in health.states_at(beats, "p", "at", now).collect()} == {"a": "FAILED", "b": "SUSPECTED"}


def test_missed_beats_count_ticks(spark, tmp_path):
    """A beat's millisecond is cut, then compared; and of beats at one time, those without an id come last."""
    import duckdb

    from heddle import catalog

    spark.sql("""SELECT * FROM VALUES
      (1L, 1L, timestamp_ntz'2024-01-01 00:00:00.0009'), (2L, 1L, timestamp_ntz'2024-01-01 01:00:00.0010'), (3L, 1L, timestamp_ntz'2024-01-01 02:00:00.0019'),
      (4L, 2L, timestamp_ntz'1960-01-01 00:00:00.0009'), (5L, 2L, timestamp_ntz'1960-01-01 01:00:00.0010'),
      (6L, 3L, timestamp_ntz'1969-12-31 23:59:59.9995'), (7L, 3L, timestamp_ntz'1970-01-01 00:59:59.9995'), (8L, 3L, timestamp_ntz'1970-01-01 02:00:00'),
      (9L, 4L, timestamp_ntz'2024-01-01 00:00:00'), (10L, 4L, timestamp_ntz'2024-01-01 09:00:00'), (null, 4L, timestamp_ntz'2024-01-01 09:00:00'), (11L, 4L, null),
      (12L, null, timestamp_ntz'2024-01-01 00:00:00'), (13L, null, timestamp_ntz'2024-01-01 04:00:00') AS t(event_id, user_id, ts)""").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = [tuple(r) for r in catalog.QUERIES["health_missed"](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert sorted(got, key=str) == sorted(con.execute(catalog.SQL["health_missed"]).fetchall(), key=str)
    assert {i: m for i, m, _ in got} == {1: None, 2: 1, 3: 0, 4: None, 5: 1, 6: None, 7: 0, 8: 1, 9: None, 10: 8, None: 0, 11: None, 12: None, 13: 3}


def test_streams(spark, tmp_path):
    path, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    rows = spark.sql("SELECT 1 AS k, timestamp_ntz'2024-01-01 00:00:00' AS ts, 1.0D AS value")
    rows.write.parquet(path)
    windows.new_files(spark, path, rows.schema, ck, out)
    rows.write.mode("append").parquet(path)
    windows.new_files(spark, path, rows.schema, ck, out)
    assert spark.read.parquet(out).count() == 2
    rows.selectExpr("2 AS k", "ts + INTERVAL 1 MINUTE AS ts", "value").write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    q = health.stream_states(stream, "k", "ts").writeStream.format("memory").queryName("states").outputMode("update").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.sql("SELECT k, beats, state FROM states").collect()) == [(1, 2, "FAILED"), (1, 2, "OK"), (2, 1, "OK")]


def test_finished_streams_of_nothing(spark, tmp_path):
    rows = spark.sql("SELECT 1 AS k, timestamp_ntz'2024-01-01 00:00:00' AS ts, 1.0D AS value").where("k > 1")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    assert windows.finished(stream.groupBy("k").count()).count() == 0


def test_sinks(spark):
    one = spark.range(5).select("id", (F.col("id") % 2).alias("k"))
    both = stored_copy(one, one, partition_by=["k"])
    assert both.columns == ["id", "k"] and both.where("k = 1").count() == 4
    assert stored_copy(one.limit(0), format="orc").count() == 0


def test_business_queries_name_their_tables():
    assert business.tables_of("SELECT 1 FROM {a}, {b} x, {a}") == ["a", "b"]
