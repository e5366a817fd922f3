"""Operators whose edges the queries don't show: order beyond one partition, restarts, failures, hot keys, sources."""

import math
import os
import socket
import struct
import threading

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemill.engine import Engine
from tidemill.functions.udfs import partial_aggregate
from tidemill.operators import collections as C
from tidemill.operators import graph as G
from tidemill.operators import ml
from tidemill.operators.components import components
from tidemill.sources.custom import BlockFile, Pushed, Receiver, Sink, connect, connect_sink, converted_socket
from tidemill.sources.files import derby_copy, empty_table, jdbc_range, multi_insert, read_table, regex_table, whole_files, write_table
from tidemill.sources.hadoop import hadoop_file, save_hadoop_file
from tidemill.sources.live import replayed
from tidemill.sources.pipes import pipe
from tidemill.storage import partitions, scratch, settings, shared_dir
from tidemill.streaming.ddl import parse
from tidemill.streaming.state import KeyedState, Windows, on_progress, stop_gracefully
from tidemill.streaming.streams import StreamQuery, incremental


def listed(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_zip_with_index_beyond_a_sampled_partition(spark):
    n = 3_000_000
    df = spark.range(n).select(F.xxhash64("id").alias("k"), F.concat(F.lit("payload "), F.col("id").cast("string")).alias("v")).repartition(9)
    out = C.zip_with_index(df, F.col("k"))
    assert tuple(out.agg(F.countDistinct("index"), F.min("index"), F.max("index")).first()) == (n, 0, n - 1)
    above = F.lag("k").over(C.Window.partitionBy(F.floor(F.col("index") / 1000)).orderBy("index"))
    assert out.withColumn("before", above).where("before > k").isEmpty()
    assert C.zip_with_index(df.limit(0), F.col("k")).count() == 0


def test_zipped_needs_equal_lengths(spark):
    with pytest.raises(ValueError):
        C.zipped(spark.range(3).toDF("a"), spark.range(4).toDF("b"), [F.col("a")], [F.col("b")])


def test_runs_cross_blocks(spark):
    df = spark.range(9000).select((F.col("id") * 2).alias("v"))
    out = C.runs(df, F.col("v"), "v", 3)
    assert out.count() == 8998 and out.where("run[0] <> index * 2 or run[2] <> index * 2 + 4").isEmpty()
    assert C.runs(df.limit(2), F.col("v"), "v", 3).count() == 0


def test_reduce_by_key(spark):
    rows = [("a", 12), ("b", None), ("a", 18), (None, 7), ("b", 10), (None, 21), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(3)
    assert listed(C.reduce_by_key(df, "k", "v", math.gcd)) == [("a", 6), ("b", 10), ("c", None), (None, 7)]
    assert listed(C.reduce_by_key(df, "k", "v", lambda a, b: a + b, 100)) == [("a", 130), ("b", 110), ("c", 100), (None, 128)]
    assert C.reduce_by_key(df.limit(0), "k", "v", math.gcd).count() == 0


def test_salted_join_of_a_hot_key(spark):
    big = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 100).alias("k"), "id")
    small = spark.createDataFrame([(-1, "hot"), (5, "five"), (5, "twice"), (1000, "none")], "k long, name string")
    got = C.salted_join(big, small, "k", 4)
    assert listed(got.groupBy("name").count()) == listed(big.join(small, "k").groupBy("name").count())


def test_partition_arrays_and_pruning(spark):
    df = spark.range(100, numPartitions=5)
    parts = {r["part"]: r["items"] for r in C.partition_arrays(df, "id").collect()}
    assert sorted(parts) == [0, 1, 2, 3, 4] and sorted(x for p in parts.values() for x in p) == list(range(100))
    assert sorted(r[0] for r in C.pruned(df, [1, 3]).collect()) == sorted(parts[1] + parts[3])


def test_zip_partitions(spark):
    a, b = spark.range(0, 12, numPartitions=3), spark.range(100, 106, numPartitions=3)
    sizes = lambda x, y: pa.table({"x": [x.num_rows], "y": [y.num_rows], "least": [min(x["id"].to_pylist())]})
    assert listed(C.zip_partitions(a, b, sizes, "x long, y long, least long")) == [(4, 2, 0), (4, 2, 4), (4, 2, 8)]
    with pytest.raises(ValueError):
        C.zip_partitions(a, spark.range(4, numPartitions=2), sizes, "x long, y long, least long")


def test_flat_map(spark):
    df = spark.createDataFrame([(2, "ab"), (0, None)], "n int, s string")
    assert listed(C.flat_map(df, lambda r: [(r["s"], i) for i in range(r["n"])], "s string, i int")) == [("ab", 0), ("ab", 1)]
    assert C.flat_map(df.limit(0), lambda r: [(1,)], "x int").count() == 0


def test_rows_for_the_caller(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "k string, v int")
    assert sorted(C.lookup(df, "k", "a", "v")) == [1, 3] and C.collect_as_map(df, "k", "v") == {"a": 3, "b": 2}
    with pytest.raises(ValueError):
        C.collect_as_map(df, "k", "v", most=1)
    assert len(C.take_sample(spark.range(50), 7)) == 7 and len(C.take_sample(spark.range(3), 7)) == 3 and C.take_sample(spark.range(0), 2) == []
    n, low, high = C.count_within(spark.range(1000), 60)
    assert n == low == high == 1000
    parts = C.random_split(spark.range(2000), [1, 1, 2])
    assert sum(p.count() for p in parts) == 2000 and parts[0].intersect(parts[1]).isEmpty() and 400 < parts[0].count() < 600


def test_pipe(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string").coalesce(1)
    assert listed(pipe(df, "cat")) == [("1\ta",), ("2\t\\N",)]
    assert listed(pipe(df, ["sh", "-c", 'cat > /dev/null; echo "$X $TIDEMILL_PARTITION"'], {"X": "x"})) == [("x 0",)]
    assert listed(pipe(df, "cat", line=lambda r: f"<{r['k']}>", before=["head"])) == [("<1>",), ("<2>",), ("head",)]
    with pytest.raises(Exception, match="status 3"):
        pipe(df, ["sh", "-c", "echo no >&2; exit 3"]).collect()
    assert pipe(df, ["sh", "-c", "exit 3"], check=False).collect() == []
    with pytest.raises(Exception, match="no-such-program"):
        pipe(df, "no-such-program").collect()


def test_partial_aggregate(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 8.0), (None, 3.0), (2, None)], "k int, v double").repartition(3)
    out = partial_aggregate(df, ["k"], ["v"], list, lambda s, r: s + r["v"].dropna().tolist(), lambda a, b: a + b, lambda s: float(len(s)), "double")
    assert listed(out) == [(1, 2.0), (2, 0.0), (None, 1.0)]


def test_catalog_tables(spark):
    e = Engine(spark)
    df = e.rows([(1, "a"), (2, "b")], "k int, p string")
    name = "cat" + scratch(spark).rsplit("/", 1)[1]
    e.save_as_table(name, df, by=["p"])
    with pytest.raises(Exception, match="already exists"):
        e.save_as_table(name, df)
    e.insert_into(name, e.rows([(3, "b")], "k int, p string"), overwrite=True)
    assert listed(e.table(name)) == [(1, "a"), (3, "b")]
    e.cache(name)
    assert spark.catalog.isCached(name)
    e.uncache(name)
    e.sql(f"INSERT INTO {name} VALUES (4, 'c')")
    assert e.table(name).count() == 3 and e.empty("x int").count() == 0
    e.sql(f"DROP TABLE {name}")
    assert "Project" in e.explain("SELECT id + 1 AS x FROM range(3)")
    assert [(n, c) for n, c, _ in e.traced("SELECT id FROM range(5) WHERE id > 2")][-2:] == [("Filter", 2), ("Project", 2)]
    with pytest.raises(ValueError):
        e.sql("!ls")


def test_files(spark, tmp_path):
    path = scratch(spark)
    assert empty_table(spark, f"{path}/e", "k int").count() == 0
    write_table(spark.range(3), f"{path}/t")
    write_table(spark.range(2), f"{path}/t", overwrite=True)
    assert read_table(spark, f"{path}/t").count() == 2
    spark.createDataFrame([("a 1",), ("zz",)], "value string").coalesce(1).write.text(f"{path}/x")
    assert listed(regex_table(spark, f"{path}/x", r"^(\w) (\d)$", ["a", "b"])) == [("a", "1"), (None, None)]
    assert [r["content"] for r in whole_files(spark, f"{path}/x/*.txt").collect()] == ["a 1\nzz\n"]
    multi_insert(spark.range(4), [("id > 1", ["id"], f"{path}/m1"), (None, ["id + 1 AS n"], f"{path}/m2")])
    assert (spark.read.parquet(f"{path}/m1").count(), spark.read.parquet(f"{path}/m2").count()) == (2, 4)
    text = "org.apache.hadoop.io.Text"
    for new, package in ((True, "mapreduce.lib"), (False, "mapred")):
        save_hadoop_file(spark.createDataFrame([("k", "v")], "k string, v string"), f"{path}/h{new}", f"org.apache.hadoop.{package}." + ("output." if new else "") + "SequenceFileOutputFormat", text, text, new)
        got = hadoop_file(spark, f"{path}/h{new}", f"org.apache.hadoop.{package}." + ("input." if new else "") + "SequenceFileInputFormat", text, text, "k string, v string", new)
        assert listed(got) == [("k", "v")]
    with pytest.raises(Exception, match="(?i)driver|jdbc"):
        jdbc_range(spark, "jdbc:none:x", "t", "k", 0, 9, 2)


def test_settings_come_back(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with settings(spark, {"spark.sql.shuffle.partitions": "3", "spark.tidemill.none": "x"}):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
    assert spark.conf.get("spark.sql.shuffle.partitions") == before and spark.conf.get("spark.tidemill.none", None) is None
    assert shared_dir(spark)


def test_components_take_few_rounds(spark):
    for edges in ([(i, i + 1) for i in range(1000)], [(i, 1000) for i in range(1000)]):
        rounds = []
        assert components(spark.createDataFrame(edges, "a long, b long"), rounds).where("label = 0").count() == 1001 and sum(rounds) <= 20
    assert components(spark.createDataFrame([("x", "y"), ("y", "a")], "a string, b string")).where("label = 'a'").count() == 3


def test_pagerank(spark):
    g = G.star(spark, 6)
    assert {r["id"]: round(r["rank"], 6) for r in g.pagerank(tolerance=1e-9).collect()} == {0: 0.15 + 0.85 * 5 * 0.15} | dict.fromkeys(range(1, 6), 0.15)
    with pytest.raises(ValueError):
        g.pagerank()


def test_graph_parts(spark):
    g = G.Graph.from_edges(spark.createDataFrame([(1, 2, "a"), (1, 2, "b"), (2, 3, "a"), (3, 3, "c")], "src long, dst long, w string"))
    assert listed(g.group_edges(F.count("*").alias("n")).edges) == [(1, 2, 2), (2, 3, 1), (3, 3, 1)]
    assert listed(g.reverse().edges.select("src", "dst"))[0] == (2, 1) and g.mask(g.subgraph("id < 3")).edges.count() == 2
    assert listed(g.map_vertices(d=F.col("id") * 2).map_triplets(s=F.col("src_attr.d") + F.col("dst_attr.d")).edges.select("src", "s"))[-1] == (3, 12)
    few = g.filtered(lambda x: x.join_vertices(x.degrees().select("id", "degree")), "degree > 2")
    assert listed(few.vertices) == [(2,), (3,)] and few.edges.count() == 2
    assert g.random_vertex() in (1, 2, 3) and g.map_edges(n=F.lit(1)).edges.columns[-1] == "n"
    assert {r["id"]: len(r["edges"]) for r in g.edges_of("in").collect()} == {2: 2, 3: 2}
    assert g.edges.select(G.edge_partition(F.col("src"), F.col("dst"), 7).alias("p")).where("p between 0 and 6").count() == 4
    path = scratch(spark)
    spark.createDataFrame([("# no edge",), ("1 2",), ("2\t3",)], "value string").write.text(path)
    assert listed(G.Graph.from_file(spark, path).edges) == [(1, 2), (2, 3)]


def test_learners(spark):
    df = spark.range(200).select((F.col("id") % 2).cast("double").alias("label"), (F.col("id") % 2 * 3 + F.rand(1)).alias("a"), F.rand(2).alias("b"))
    x = ml.assembled(df, ["a", "b"])
    for kind in ("logistic", "svm", "bayes", "tree", "ridge", "lasso", "tree_regression"):
        model = ml.fit(kind, x, **({"regParam": 0.01} if kind in ("ridge", "lasso") else {}))
        right = model.transform(x).where("abs(prediction - label) < 0.5").count()
        assert right >= 180, kind
    ratings = spark.createDataFrame([(u, i, float((u * i) % 3 + 1)) for u in range(8) for i in range(6)], "user int, item int, rating float")
    for implicit in (False, True):
        assert ml.fit("als", ratings, rank=3, maxIter=3, seed=1, implicitPrefs=implicit).transform(ratings).where("prediction is not null").count() == 48
    assert ml.principal_components(df, ["a", "b"], 1).explainedVariance[0] > 0.9
    folds = ml.k_folds(df, 4)
    assert sum(t.count() for _, t in folds) == 200 and all(a.count() + b.count() == 200 for a, b in folds)
    u, s, v = ml.svd(df, ["a", "b"], 2)
    back = u.select((F.col("u0") * float(s[0] * v[0, 0]) + F.col("u1") * float(s[1] * v[0, 1])).alias("a")).agg(F.sum("a")).first()[0]
    assert abs(back - df.agg(F.sum("a")).first()[0]) < 1e-6
    shifted = df.select("label", (F.col("a") + 1e9).alias("a"))
    assert abs(ml.linear_regression(shifted, "label", ["a"])["a"] - ml.linear_regression(df, "label", ["a"])["a"]) < 1e-6
    w, past = ml.gradient_descent(df, ["a", "b"], "label", "hinge", rounds=30, penalty="l1", strength=0.01)
    assert past[-1] < past[0] and len(w) == 2
    assert ml.gradient_descent(df.limit(0), ["a"], "label")[1] == []


def test_state_goes_on_after_a_restart(spark):
    path, source = scratch(spark), scratch(spark)
    rows = spark.createDataFrame([(0, "a", 1), (0, "b", 5), (1, "a", 2), (2, None, 4)], "batch int, k string, v int")
    add = lambda old, new: F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0))

    def state(stream):
        return KeyedState(stream, "k", F.sum("v"), add, F.lit(0).cast("long"), path=path)

    first = replayed(rows.where("batch < 2"), "batch", source)
    assert listed(state(first).final()) == [("a", 3), ("b", 5)]
    assert listed(state(first).final()) == [("a", 3), ("b", 5)]  # nothing new
    assert listed(state(replayed(rows.where("batch = 2"), "batch", source)).final()) == [("a", 3), ("b", 5), (None, 4)]
    gone = KeyedState(replayed(rows, "batch", scratch(spark)), "k", F.sum("v"), lambda old, new: F.when(F.coalesce(new, F.lit(0)) > 0, new))
    assert listed(gone.final()) == [(None, 4)]  # a key goes once its batch brings nothing


def test_windows_on_a_stream(spark):
    rows = spark.createDataFrame([(0, "a", 1), (1, "a", 1), (1, "b", 1), (2, "b", 2), (3, "a", 4)], "batch int, k string, v int")
    live = lambda: replayed(rows, "batch", scratch(spark))
    s = ({"s": F.sum("v")}, {"s": F.sum("s")})
    assert listed(Windows(live(), ["k"], *s, 2, 1).table()) == [(1, "a", 1), (2, "a", 2), (2, "b", 1), (3, "a", 1), (3, "b", 3), (4, "a", 4), (4, "b", 2)]
    assert listed(Windows(live(), ["k"], *s, 1, 2).table()) == [(2, "a", 1), (2, "b", 1), (4, "a", 4)]
    kept = [(1, "a", 1), (2, "a", 1), (2, "b", 1), (3, "a", 0), (3, "b", 2), (4, "a", 4), (4, "b", 0)]
    assert listed(Windows(live(), ["k"], *s, 1, 1, inverse=True).table()) == kept
    assert listed(Windows(live(), ["k"], *s, 1, 1, inverse=True, drop_zero=True).table()) == [k for k in kept if k[2]]
    path = scratch(spark)
    seen = []
    for part in (rows.where("batch < 2"), rows.where("batch >= 2")):  # a restart between two batches
        source = replayed(part, "batch", f"{path}/source")
        Windows(source, ["k"], *s, 2, 1, path=path).run(lambda df, n: seen.append((n, listed(df)))).awaitTermination()
    assert [n for n, _ in seen] == [0, 1, 2, 3] and seen[2][1] == [(3, "a", 1), (3, "b", 3)]


def test_stream_ddl_forms(spark):
    kind, d, _ = parse("CREATE STREAM s (a DECIMAL(10,2) COMMENT 'x, (y)', b MAP<STRING,ARRAY<INT>>, c STRUCT<d: INT, e: STRING>) COMMENT 'about' ROW FORMAT DELIMITED FIELDS TERMINATED BY '\\t' LOCATION 'tcp://h:9' TBLPROPERTIES ('a'='(b)', 'c' = 'd')")
    assert (d.comment, d.delimiter, d.location, d.properties) == ("about", "\t", "tcp://h:9", {"a": "(b)", "c": "d"})
    assert [f.dataType.simpleString() for f in d.schema().fields] == ["decimal(10,2)", "map<string,array<int>>", "struct<d:int,e:string>"]
    e = Engine(spark)
    e.sql("CREATE STREAM s (a INT COMMENT 'first', b STRING) STORED AS JSON LOCATION '/tmp/none'")
    e.sql("CREATE STREAM IF NOT EXISTS s (z INT) LOCATION '/x'")
    e.sql("CREATE STREAM t LIKE s LOCATION '/tmp/other'")
    assert listed(e.sql("DESCRIBE STREAM t")) == [("a", "int", "first"), ("b", "string", None)] and e.streams["t"].location == "/tmp/other" and e.streams["t"].kind == "json"
    for bad in ("CREATE STREAM u", "CREATE STREAM u LIKE none", "CREATE STREAM u AS SELECT 1", "CREATE STREAM u (a INT", "DESCRIBE STREAM none"):
        with pytest.raises(ValueError):
            e.sql(bad)


def test_only_relations_make_a_stream_query(spark):
    e = Engine(spark)
    live = replayed(spark.createDataFrame([(0, 1), (1, 2)], "batch int, ticks int"), "batch", scratch(spark))
    e.register_stream("ticks", live)
    spark.range(1).selectExpr("id AS ticks").createOrReplaceTempView("plain")
    assert e.streams_in("SELECT ticks AS ticks FROM plain ticks_ /* ticks */") == []
    assert e.streams_in("WITH x AS (SELECT * FROM ticks) SELECT * FROM x") == ["ticks"] == e.streams_in("SELECT 1 FROM plain WHERE 1 IN (SELECT ticks FROM ticks)")
    e.sql("CREATE STREAM a AS SELECT batch, ticks + 1 AS t FROM ticks")
    e.sql("CREATE STREAM b AS SELECT batch, t * 2 AS t FROM a")
    assert listed(e.sql("SELECT batch, t FROM b").table().select("batch", "t")) == [(0, 4), (1, 6)]
    with pytest.raises(ValueError):
        e.sql("INSERT INTO plain SELECT ticks FROM ticks")


def test_incremental_modes(spark):
    rows = spark.createDataFrame([(0, "a"), (1, "a"), (1, "b")], "batch int, k string")
    live = lambda: replayed(rows, "batch", scratch(spark))
    counts = live().groupBy("k").agg(F.count("*").alias("n"))
    assert listed(incremental(counts, mode="complete")) == [("a", 2), ("b", 1)]
    assert listed(incremental(live().groupBy("k").agg(F.count("*").alias("n")), mode="update").select("batch_id", "k", "n")) == [(0, "a", 1), (1, "a", 2), (1, "b", 1)]


def test_sources_of_ones_own(spark, tmp_path):
    path = os.path.join(tmp_path, "blocks")
    with open(path, "wb") as f:
        f.write(b"".join(struct.pack(">I", 3) + b"b%02d" % i for i in range(10)))
    connect(spark, "blocks_of_test", BlockFile, "position long, body binary")
    df = spark.readStream.format("blocks_of_test").option("path", path).option("most", "4").load()
    got, heard = [], []
    listener = on_progress(spark, heard.append)
    q = StreamQuery(spark, {"x": df}, "SELECT position, cast(body AS string) AS v FROM x").start(lambda d, n: got.extend(listed(d)), trigger={"processingTime": "0 seconds"})
    stop_gracefully(q)
    spark.streams.removeListener(listener)
    assert sorted(got) == [(i, "b%02d" % i) for i in range(10)] and any(h["event"] == "started" for h in heard)
    pushed = Pushed(spark, "k int")
    pushed.put([(1,), (2,)])
    pushed.put([(3,)])
    assert listed(StreamQuery(spark, {"p": pushed.stream()}, "SELECT k FROM p").table().select("k")) == [(1,), (2,), (3,)]


def test_receiver_starts_again_and_loses_nothing(spark):
    tries = []

    def feed(put):
        tries.append(1)
        put([(len(tries),)])
        if len(tries) < 3:
            raise OSError("gone")

    pushed = Pushed(spark, "k int")
    r = Receiver(pushed, feed, pause=0.05).start()
    r.stop()
    assert len(r.errors) == 2 and listed(StreamQuery(spark, {"p": pushed.stream()}, "SELECT k FROM p").table().select("k")) == [(1,), (2,), (3,)]


def test_sink_of_ones_own(spark, tmp_path):
    class LineFiles(Sink):
        """Each part as a file of its own, which counts once its batch is done."""

        def __init__(self, options):
            self.path = options["path"]

        def write(self, rows):
            name = os.path.join(self.path, f"part-{os.urandom(6).hex()}")
            with open(name, "w") as f:
                f.writelines(f"{r[0]}\n" for r in rows)
            return name

        def done(self, messages, batch):
            with open(os.path.join(self.path, f"batch-{batch}"), "w") as f:
                for m in sorted(messages):
                    f.write(open(m).read())

    connect_sink(spark, "line_files_of_test", LineFiles)
    live = replayed(spark.createDataFrame([(0, 1), (0, 2), (1, 3)], "batch int, v int"), "batch", scratch(spark))
    live.select("v").writeStream.format("line_files_of_test").option("path", str(tmp_path)).option("checkpointLocation", scratch(spark)).trigger(availableNow=True).start().awaitTermination()
    got = [sorted(open(os.path.join(tmp_path, f"batch-{b}")).read().split()) for b in (0, 1)]
    assert got == [["1", "2"], ["3"]]


def test_socket_with_a_converter(spark):
    server = socket.create_server(("127.0.0.1", 0))
    port = server.getsockname()[1]

    def serve():
        for _ in range(8):  # each reader connects for itself
            try:
                c, _ = server.accept()
            except OSError:
                return
            c.sendall(b"1,a;2,b;3,c;")
            held.append(c)

    held = []
    threading.Thread(target=serve, daemon=True).start()
    rows = converted_socket(spark, "127.0.0.1", port, lambda t: [(int(t.split(",")[0]), t.split(",")[1])], "k int, v string", ";")
    got = []
    q = rows.writeStream.foreachBatch(lambda d, n: got.extend(listed(d))).option("checkpointLocation", scratch(spark)).start()
    for _ in range(60):
        if len(got) >= 3:
            break
        q.awaitTermination(0.5)
    q.stop()
    server.close()
    assert sorted(set(got)) == [(1, "a"), (2, "b"), (3, "c")]


def test_derby_is_read_outside_of_its_jvm(spark):
    """An executor is another JVM than the driver: the database must open in one that Spark's own has nothing to do with."""
    import subprocess

    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "K int, V string")
    url = derby_copy(df, "T1")
    assert sorted(map(tuple, jdbc_range(spark, url, "T1", "K", 2, 3, 2, driver="org.apache.derby.jdbc.EmbeddedDriver").collect())) == [(2, None), (3, "c")]
    jvm = spark.sparkContext._jvm
    jars = jvm.java.lang.System.getProperty("java.class.path")
    java = jvm.java.lang.System.getProperty("java.home") + "/bin/java"
    out = subprocess.run([java, "-Dderby.stream.error.file=/dev/null", "-cp", jars, "org.apache.derby.tools.ij"], input=f"connect '{url}'; select count(*) + 40 from T1;", capture_output=True, text=True, timeout=120).stdout
    assert "43" in out


def _joins(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_components_send_no_tables_to_the_driver(spark, monkeypatch):
    from tidemill.operators import components as K

    plans = []
    monkeypatch.setattr(K, "written", lambda df, f=K.written: (plans.append(_joins(df)), f(df))[1])
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)], "src long, dst long")
    found = G.Graph.from_edges(edges).connected_components()
    plans.append(_joins(found))
    assert {r["value"] for r in found.collect()} == {0} and len(plans) > 5
    assert not [p for p in plans if "Broadcast" in p] and spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"


def test_neighbours_tasks_follow_the_edges(spark):
    edges = [(i % 10, i) for i in range(100)] + [(3, 1), (1, 3), (1, 3)]
    want = {}
    for a, b in edges:
        want.setdefault(a, set()).add(b)
        want.setdefault(b, set()).add(a)
    found = G.Graph.from_edges(spark.createDataFrame(edges, "src long, dst long")).neighbours(10)
    assert {r["id"]: r["neighbours"] for r in found.collect()} == {k: sorted(v) for k, v in want.items()}
    assert "hashpartitioning(src" in _joins(found) and ", 21), REPARTITION" in _joins(found)  # 206 rows, ten a task; no other shuffle
    assert _joins(found).split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1
    big = spark.range(10).withColumn("x", F.lit("y" * 100))
    assert int(partitions(big, 10)["spark.sql.shuffle.partitions"]) > 4 and partitions(big, 1 << 40)["spark.sql.shuffle.partitions"] == spark.conf.get("spark.sql.shuffle.partitions")


def test_theta_joins_of_streams_run_on_all_cores(spark):
    """A batch that is one file had all its pairs made by one task."""
    live = {n: replayed(spark.range(1000).select("id", F.lit(0).alias("batch")), "batch", scratch(spark)) for n in ("a", "b")}
    path = scratch(spark)
    out = StreamQuery(spark, live, "SELECT a.id AS x, b.id AS y FROM a JOIN b ON a.id + 990 < b.id").table(path)
    assert sorted(map(tuple, out.select("x", "y").collect())) == [(x, y) for x in range(1000) for y in range(1000) if x + 990 < y]
    plans = []
    StreamQuery(spark, live, "SELECT count(*) AS n FROM a JOIN b ON a.id < b.id").start(lambda df, n: plans.append((df.first()[0], _joins(df)))).awaitTermination()
    assert [n for n, _ in plans] == [499500] and "REPARTITION_BY_NUM" in plans[0][1]


def test_svd_writes_no_table_of_edges(spark, monkeypatch):
    """Against the same steps in plain Python; what a round writes has a row for each end, not one for each edge."""
    rows = [(i % 7, 100 + j, float((i * j) % 5)) for i in range(7) for j in range(9)]
    sizes = []
    monkeypatch.setattr(G, "written", lambda df, f=G.written: (out := f(df), sizes.append(out.count()))[0])
    g = G.Graph.from_edges(spark.createDataFrame(rows, "src long, dst long, r double"))
    first, mean = g.svd_plus_plus("r", 2, 0)
    got = {(r["kind"], r["id"]): r for r in g.svd_plus_plus("r", 2, 1)[0].collect()}
    old = {(r["kind"], r["id"]): r for r in first.collect()}
    assert sizes.count(63) == 2 and max(x for x in sizes if x != 63) == 16  # the edges once a call
    u, i = ({k[1]: r for k, r in old.items() if k[0] == kind} for kind in ("user", "item"))
    e = {(s, d): r - min(5, max(0, mean + u[s]["bias"] + i[d]["bias"] + sum(q * (p + y) for q, p, y in zip(i[d]["p"], u[s]["p"], u[s]["y"])))) for s, d, r in rows}
    near = lambda x, y: all(abs(a - b) < 1e-9 for a, b in zip(x, y, strict=True))
    for s in u:
        mine = [d for a, d in e if a == s]
        assert near(got["user", s]["p"], [u[s]["p"][k] + sum(0.007 * (e[s, d] * i[d]["p"][k] - 0.015 * u[s]["p"][k]) for d in mine) for k in (0, 1)])
        assert near([got["user", s]["bias"]], [u[s]["bias"] + sum(0.007 * (e[s, d] - 0.005 * u[s]["bias"]) for d in mine)])
    for d in i:
        mine = [s for s, b in e if b == d]
        assert near(got["item", d]["p"], [i[d]["p"][k] + sum(0.007 * (e[s, d] * (u[s]["p"][k] + u[s]["y"][k]) - 0.015 * i[d]["p"][k]) for s in mine) for k in (0, 1)])
        assert near(got["item", d]["y"], [i[d]["y"][k] + sum(0.007 * (e[s, d] * u[s]["norm"] * i[d]["p"][k] - 0.015 * i[d]["y"][k]) for s in mine) for k in (0, 1)])
        assert near([got["item", d]["bias"]], [i[d]["bias"] + sum(0.007 * (e[s, d] - 0.005 * i[d]["bias"]) for s in mine)])
