"""The engine's catalog, stream DDL, windows, state and recovery on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from tidemill.engine import Engine
from tidemill.operators.collections import histogram
from tidemill.operators.graph import Graph, grid, star
from tidemill.sources.live import replayed
from tidemill.streaming.ddl import parse
from tidemill.streaming.streams import StreamQuery, scratch, union_tagged
from tidemill.streaming.windows import running_state, windowed, windowed_sum


def test_ddl():
    kind, d, quiet = parse("CREATE STREAM IF NOT EXISTS s (key STRING, value INT) ROW FORMAT DELIMITED FIELDS TERMINATED BY ' ' STORED AS TEXTFILE LOCATION '/x' TBLPROPERTIES ('a'='b')")
    assert (kind, d.name, d.columns, d.delimiter, d.kind, d.location, d.properties, quiet) == ("create", "s", "key STRING, value INT", " ", "text", "/x", {"a": "b"}, True)
    assert parse("drop stream if exists S")[1].name == "s"
    assert parse("SELECT 1") is None
    with pytest.raises(ValueError):
        parse("ALTER STREAM s RENAME TO t")


def test_registry(spark):
    e = Engine(spark)
    e.sql("CREATE STREAM s (k STRING) LOCATION '/tmp'")
    with pytest.raises(ValueError):
        e.sql("CREATE STREAM s (k STRING) LOCATION '/tmp'")
    assert [r[0] for r in e.sql("SHOW STREAMS").collect()] == ["s"]
    e.sql("DROP STREAM s")
    with pytest.raises(ValueError):
        e.sql("DROP STREAM s")
    e.sql("DROP STREAM IF EXISTS s")
    assert e.sql("SELECT 1 AS x").first()[0] == 1


def test_two_streams_and_recovery(spark):
    one = spark.createDataFrame([(0, "a", 1), (1, "b", 2)], "batch int, k string, v int")
    live = replayed(one, "batch", scratch(spark))
    both = {"x": live.select("k", "v"), "y": live.select("k", F.col("v").alias("w"))}
    assert union_tagged(both).columns == ["__stream", "x", "y"]
    place, mark, seen = scratch(spark), scratch(spark), []
    q = StreamQuery(spark, {"s": live}, "SELECT k, sum(v) AS t FROM s GROUP BY k")
    assert sorted(map(tuple, q.table(place, mark).select("batch_id", "k", "t").collect())) == [(0, "a", 1), (1, "b", 2)]
    q.start(lambda df, n: seen.append(n), mark).awaitTermination()
    assert not seen  # a restart on the same checkpoint has nothing left to do


def test_windows(spark):
    rows = [(0, "a", 1), (1, "a", 1), (1, "b", 1), (3, "a", 1)]
    df = spark.createDataFrame(rows, "batch int, k string, v int")
    got = sorted(map(tuple, windowed(df, "batch", ["k"], [F.sum("v").alias("s")], 2, 1, 5).collect()))
    assert got == [(1, "a", 1), (2, "a", 2), (2, "b", 1), (3, "a", 1), (3, "b", 1), (4, "a", 1), (5, "a", 1)]
    kept = sorted(map(tuple, windowed_sum(df, "batch", "k", "v", 2, 2, 6).collect()))
    assert kept == [(2, "a", 2), (2, "b", 1), (4, "a", 1), (4, "b", 0), (6, "a", 0), (6, "b", 0)]
    assert sorted(map(tuple, windowed(df, "batch", [], [F.count("*").alias("n")], 2, 3, 6).collect())) == [(3, 2)]


def test_state_removes_keys(spark):
    parts = [spark.createDataFrame(x, "k string, v int") for x in ([("a", 1), ("b", 5)], [("a", 2)], [("c", 1)])]
    out = running_state(parts, "k", F.sum("v"), F.lit(0).cast("long"), lambda s, n: F.when(F.coalesce(s, F.lit(0)) + F.coalesce(n, F.lit(0)) < 5, F.coalesce(s, F.lit(0)) + F.coalesce(n, F.lit(0))))
    assert sorted(map(tuple, out.collect())) == [("a", 3), ("c", 1)]


def test_histogram_edges(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 1.0, 2.0, 2.0, 3.0, 9.0)], "x double")
    assert sorted(map(tuple, histogram(df, "x", [0.0, 1.0, 2.0, 3.0]).collect())) == [(0, 1), (1, 1), (2, 3)]


def test_graphs(spark):
    assert grid(spark, 3, 3).edges.count() == 12
    assert {r["id"]: r["in_degree"] for r in star(spark, 5).degrees().collect()}[0] == 4
    cycle = Graph.from_edges(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5)], "src long, dst long"))
    assert dict(map(tuple, cycle.strongly_connected().collect())) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    assert dict(map(tuple, cycle.connected_components().collect())) == dict.fromkeys(range(1, 6), 1)
    assert dict(map(tuple, cycle.triangles().collect())) == {1: 1, 2: 1, 3: 1, 4: 0, 5: 0}


def test_components_of_long_paths_and_cycles(spark):
    edges = [(i, i + 1) for i in range(199)] + [(1000 + i, 1000 + (i + 1) % 200) for i in range(200)] + [(2000 + (i + 1) % 200, 2000 + i) for i in range(200)]
    g = Graph.from_edges(spark.createDataFrame([*edges, (199, 1000)], "src long, dst long"))
    assert {(r["id"], r["value"]) for r in g.connected_components().collect()} == {(i, 0) for i in [*range(200), *range(1000, 1200)]} | {(i, 2000) for i in range(2000, 2200)}
    got = [tuple(r) for r in g.strongly_connected().select("id", "component").collect()]
    assert sorted(got) == [(i, i) for i in range(200)] + [(i, 1000) for i in range(1000, 1200)] + [(i, 2000) for i in range(2000, 2200)]
    path = Graph.from_edges(spark.createDataFrame([(i, i + 1) for i in range(59)], "src long, dst long"))
    far = path.pregel(F.col("id"), lambda s, d: F.when(s < d, s), F.min, F.least)
    assert far.where("value <> 0").count() == 0 and path.pregel(F.col("id"), lambda s, d: F.when(s < d, s), F.min, F.least, most=2).where("value <> 0").count() == 57


def test_strong_components_by_force(spark):
    r = random.Random(5)
    edges = {(r.randrange(60), r.randrange(60)) for _ in range(80)}
    ids = sorted({x for e in edges for x in e})
    reach = {i: {i} for i in ids}
    for _ in ids:
        for a, b in edges:
            reach[a] |= reach[b]
    want = [(i, min(j for j in reach[i] if i in reach[j])) for i in ids]
    g = Graph.from_edges(spark.createDataFrame(sorted(edges), "src long, dst long"))
    assert len(set(c for _, c in want)) < len(ids) and sorted(tuple(x) for x in g.strongly_connected().select("id", "component").collect()) == want


def test_strong_components_take_few_rounds(spark, monkeypatch):
    """Long paths once took a round for every vertex; here they end in cycles, cross, and hold vertices of one edge in and out between branches."""
    from tidemill.operators import graph as G

    calls = []
    monkeypatch.setattr(G, "written", lambda df, f=G.written: (calls.append(1), f(df))[1])
    path = [(i, i + 1) for i in range(400)]
    cycle = [(1000 + i, 1000 + (i + 1) % 100) for i in range(100)]
    ears = [(0, 2000), *[(2000 + i, 2001 + i) for i in range(50)], (2050, 200), (200, 3000), *[(3000 + i, 3001 + i) for i in range(50)], (3050, 0)]
    g = Graph.from_edges(spark.createDataFrame([*path, *cycle, *ears, (400, 1000)], "src long, dst long"))
    want = {i: 0 for i in [*range(201), *range(2000, 2051), *range(3000, 3051)]} | {i: i for i in range(201, 401)} | {i: 1000 for i in range(1000, 1100)}
    assert dict(map(tuple, g.strongly_connected().select("id", "component").collect())) == want
    assert len(calls) < 80


def test_triangles_in_blocks(spark, monkeypatch):
    """Against brute force, over several blocks and chunks; pairs of edges that meet are in no shuffle."""
    from tidemill.operators import triangles as T

    r = random.Random(3)
    edges = sorted({(r.randrange(40), r.randrange(40)) for _ in range(500)} | {(0, i) for i in range(100)})
    near = {i: set() for e in edges for i in e}
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want = {i: sum(len(near[i] & near[j]) for j in near[i]) // 2 for i in near}
    g = Graph.from_edges(spark.createDataFrame(edges, "src long, dst long"))
    got = g.triangles()
    assert dict(map(tuple, got.collect())) == want and "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
    few = T.triangles(g.edges.toDF("a", "b"), 150)
    assert dict(map(tuple, few.collect())) == {i: n for i, n in want.items() if n}
    import numpy as np

    monkeypatch.setattr(T, "AT_ONCE", 3)  # chunks of an edge or two, looked up by search
    code = np.array(sorted({(min(e), max(e)) for e in edges if e[0] != e[1]}))
    assert dict(enumerate(T._counted(code[:, 0], code[:, 1], 100).tolist())) == want
