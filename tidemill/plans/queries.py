"""Every registered query with its DuckDB spelling. A query takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions.udfs import table_function, vectorised, where_rows
from ..operators import collections as C
from ..operators import graph as G
from ..operators import ml
from ..operators.graph import Graph
from ..sources.files import read_table
from ..sources.live import replayed
from ..storage import scratch, written
from ..streaming.state import KeyedState, Windows
from ..streaming.streams import StreamQuery
from .relational import PAIRS, ROWS_ONLY, SAME

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _sql(text: str):
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]
    return lambda spark, sf_dir: Engine(spark).load(sf_dir, *used).sql(text)


for _n, _t in SAME.items():
    QUERIES[_n], ORACLE[_n] = _sql(_t), _t
for _n, (_t, _o) in PAIRS.items():
    QUERIES[_n], ORACLE[_n] = _sql(_t), _o
for _n, _t in ROWS_ONLY.items():
    QUERIES[_n] = _sql(_t)


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLE[fn.__name__] = oracle
        return fn

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


@query("SELECT coalesce(c.k, s.k) AS k, coalesce(c.l, '') AS customers, coalesce(s.l, '') AS suppliers FROM (SELECT c_nationkey AS k, array_to_string(list_sort(list(c_custkey)), ',') AS l FROM customer GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS k, array_to_string(list_sort(list(s_suppkey)), ',') AS l FROM supplier GROUP BY 1) s ON c.k = s.k")
def join_cogroup(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("x"))
    s = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("x"))
    ids = lambda c: F.concat_ws(",", F.sort_array(F.transform(c, lambda r: r["x"])).cast("array<string>"))
    return C.cogroup(c, s, "k").select("k", ids("rows0").alias("customers"), ids("rows1").alias("suppliers"))


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
def subtract_by_key(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("c_nationkey"))
    return C.subtract_by_key(_t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), s, "c_nationkey")


@query("SELECT c_nationkey AS k FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
def subtract(spark, sf_dir):
    return C.subtract(_t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersection(spark, sf_dir):
    return C.intersection(_t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS index FROM orders")
def zip_with_index(spark, sf_dir):
    return C.zip_with_index(_t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), F.desc("o_totalprice"), F.col("o_orderkey")).select("o_orderkey", "index")


@query("SELECT count(*) AS n, count(*) AS ids FROM lineitem")
def zip_with_unique_id(spark, sf_dir):
    return C.zip_with_unique_id(_t(spark, sf_dir, "lineitem").select("l_orderkey")).agg(F.count("*").alias("n"), F.countDistinct("uid").alias("ids"))


@query("SELECT user_id, event_id, a + b + c AS total FROM (SELECT user_id, event_id, event_id AS a, lead(event_id) OVER w AS b, lead(event_id, 2) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE c IS NOT NULL")
def sliding_n(spark, sf_dir):
    runs = C.sliding(_t(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id", "event_id", 3)
    return runs.select("user_id", "event_id", F.aggregate("run", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("SELECT c AS \"column\", n, round(mean, 6) AS mean, round(v, 4) AS variance, mi AS \"min\", ma AS \"max\" FROM (SELECT 'l_quantity' AS c, count(*) AS n, avg(l_quantity) AS mean, var_pop(l_quantity) AS v, min(l_quantity) AS mi, max(l_quantity) AS ma FROM lineitem UNION ALL SELECT 'l_discount', count(*), avg(l_discount), var_pop(l_discount), min(l_discount), max(l_discount) FROM lineitem)")
def stats(spark, sf_dir):
    s = C.stats(_t(spark, sf_dir, "lineitem"), "l_quantity", "l_discount")
    return s.select("column", "n", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"), "min", "max")


@query("SELECT b::INT AS bucket, count(l_quantity) AS n FROM range(4) t(b) LEFT JOIN lineitem ON l_quantity >= [1, 10, 20, 30][b + 1] AND (l_quantity < [10, 20, 30, 50][b + 1] OR (b = 3 AND l_quantity = 50)) GROUP BY b")
def histogram_edges(spark, sf_dir):
    return C.histogram(_t(spark, sf_dir, "lineitem"), "l_quantity", [1.0, 10.0, 20.0, 30.0, 50.0])


@query("WITH m AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) SELECT least(floor((o_totalprice - lo) / (hi - lo) * 5), 4)::INT AS bucket, count(*) AS n FROM orders, m GROUP BY 1")
def histogram_even(spark, sf_dir):
    return C.even_histogram(_t(spark, sf_dir, "orders"), "o_totalprice", 5)


@query("SELECT DISTINCT l_returnflag, true AS near FROM lineitem")
def approx_distinct(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem")  # noqa: E741
    exact = l.groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("e"))
    near = F.abs(F.col("n") - F.col("e")) <= 0.15 * F.col("e")  # three standard errors
    return C.approx_distinct(l, "l_partkey", ["l_returnflag"]).join(exact, "l_returnflag").select("l_returnflag", near.alias("near"))


@query("SELECT true AS inside, true AS narrow")
def approx_sum(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem")  # noqa: E741
    exact = l.agg(F.sum("l_quantity").alias("e"))
    found = C.approx_sum(l, "l_quantity", 0.2, z=5)
    return found.crossJoin(exact).select(F.col("e").between(F.col("low"), F.col("high")).alias("inside"), (F.col("high") - F.col("low") < 0.5 * F.col("e")).alias("narrow"))


@query("SELECT true AS size, true AS once, true AS members, true AS again")
def sample(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey")
    one, two, many = o.sample(0.1, 42), o.sample(0.1, 42), o.sample(True, 0.5, 3)
    (a,), (n,), (same,), (m,), (inside,) = (d.agg(F.count("*")).first() for d in (o, one, one.intersect(two), many, one.unionAll(many).join(o, "o_orderkey", "left_semi")))
    (different,) = one.agg(F.countDistinct("o_orderkey")).first()
    return spark.createDataFrame([(abs(n - a / 10) < 5 * a**0.5 and abs(m - a / 2) < 5 * a**0.5, different == n, inside == n + m, same == n)], "size boolean, once boolean, members boolean, again boolean")


@query("SELECT o_orderkey, (o_orderkey % 4 + 1)::INT AS bucket FROM orders")
def sample_buckets(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey")
    out = None
    for b in range(1, 5):
        part = C.bucket_sample(o, b, 4, "o_orderkey").withColumn("bucket", F.lit(b))
        out = part if out is None else out.union(part)
    return out


@query("SELECT n_regionkey AS k, 1::BIGINT AS parts, 0::BIGINT AS disorder, count(*) AS n FROM nation GROUP BY 1")
def sort_by_partition(spark, sf_dir):
    return _placed(Engine(spark).load(sf_dir, "nation").sql("SELECT n_regionkey AS k, n_name AS v FROM nation DISTRIBUTE BY n_regionkey SORT BY n_name"))


@query("SELECT n_regionkey AS k, 1::BIGINT AS parts, 0::BIGINT AS disorder, count(*) AS n FROM nation GROUP BY 1")
def cluster_by(spark, sf_dir):
    return _placed(Engine(spark).load(sf_dir, "nation").sql("SELECT n_regionkey AS k, n_regionkey AS v FROM nation CLUSTER BY n_regionkey"))


def _placed(df: DataFrame) -> DataFrame:
    """For each k its partitions and the rows that stand after one of their partition with a greater v; the rows are written as they lie."""
    rows = written(df.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    before = F.lag("v").over(Window.partitionBy("part").orderBy("at"))
    return rows.withColumn("b", before).groupBy("k").agg(F.countDistinct("part").alias("parts"), F.count(F.when(F.col("b") > F.col("v"), 1)).alias("disorder"), F.count("*").alias("n"))


@query("SELECT 8::INT AS parts, true AS together, count(*) AS n FROM orders")
def repartition_hint(spark, sf_dir):
    df = Engine(spark).load(sf_dir, "orders").sql("SELECT /*+ REPARTITION(8, o_custkey) */ o_custkey, o_orderkey FROM orders")
    per = df.withColumn("part", F.spark_partition_id()).groupBy("o_custkey").agg(F.countDistinct("part").alias("p"), F.count("*").alias("n"))
    return per.agg(F.lit(df.rdd.getNumPartitions()).alias("parts"), (F.max("p") == 1).alias("together"), F.sum("n").alias("n"))


@query("SELECT o_custkey AS k, xor(bit_xor(o_orderkey), 5)::BIGINT AS value FROM orders GROUP BY o_custkey")
def fold_by_key(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("value"))
    return C.reduce_by_key(o, "k", "value", lambda a, b: a ^ b, 5)


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_salted(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return C.salted_join(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), c, "o_custkey", 4).select("o_orderkey", "c_name")


@query("SELECT e.event_id, b.event_id AS before FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') b ON e.user_id = b.user_id AND e.event_id >= b.event_id")
def join_as_of(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    b = e.where("event_type = 'purchase'").select("user_id", "event_id", F.col("event_id").alias("before"))
    return C.as_of(e, b, ["user_id"], "event_id", ["before"]).select("event_id", F.col("asof_before").alias("before"))


@query("SELECT p_partkey FROM part WHERE p_size * 3 > 100")
def udf_filter(spark, sf_dir):
    big = vectorised(lambda s: s * 3 > 100, "boolean")
    return _t(spark, sf_dir, "part").where(big("p_size")).select("p_partkey")


@query("SELECT p_partkey, p_size FROM part WHERE p_size % 2 = 0 AND p_retailprice > 1000")
def udf_row_filter(spark, sf_dir):
    return where_rows(_t(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), lambda r: (r["p_size"] % 2 == 0) & (r["p_retailprice"] > 1000)).drop("p_retailprice")


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def udtf_split(spark, sf_dir):
    def split(rows):
        return rows.assign(word=rows["p_name"].str.split(" ")).explode("word")[["p_partkey", "word"]]

    return table_function(_t(spark, sf_dir, "part").select("p_partkey", "p_name"), split, "p_partkey long, word string")


@query("SELECT lower(n_nationkey::VARCHAR) AS k, lower(n_name) AS v FROM nation")
def script_transform(spark, sf_dir):
    from ..sources.files import piped

    return piped(_t(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "tr A-Z a-z", ["k", "v"])


@query("SELECT 'seen ' || n_nationkey || '|' || n_name || '!' AS value FROM nation UNION ALL SELECT 'seen head!'")
def pipe_program(spark, sf_dir):
    from ..sources.pipes import pipe

    rows = _t(spark, sf_dir, "nation").select("n_nationkey", "n_name").coalesce(1)
    return pipe(rows, ["sh", "-c", 'while read -r x; do echo "$WORD $x!"; done'], {"WORD": "seen"}, "|", before=["head"])


@query("SELECT c_nationkey, round(exp(avg(ln(c_acctbal + 2000))), 4) AS mean FROM customer GROUP BY 1")
def udf_aggregate(spark, sf_dir):
    import numpy as np

    from ..functions.udfs import partial_aggregate

    c = _t(spark, sf_dir, "customer").select("c_nationkey", (F.col("c_acctbal") + 2000).alias("v"))
    out = partial_aggregate(c, ["c_nationkey"], ["v"], lambda: (0.0, 0), lambda s, rows: (s[0] + float(np.log(rows["v"]).sum()), s[1] + len(rows)), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda s: float(np.exp(s[0] / s[1])), "double")
    return out.select("c_nationkey", F.round("value", 4).alias("mean"))


@query("SELECT c_mktsegment, round(median(c_acctbal), 4) AS mid FROM customer GROUP BY 1")
def udf_grouped(spark, sf_dir):
    from ..functions.udfs import aggregate_function

    engine = Engine(spark).load(sf_dir, "customer")
    engine.register_function("middle", aggregate_function(lambda v: float(v.median()), "double"), "double")
    return engine.sql("SELECT c_mktsegment, round(middle(c_acctbal), 4) AS mid FROM customer GROUP BY c_mktsegment")


@query("SELECT n_nationkey, unnest(range(1, n_regionkey + 1))::INT AS i FROM nation")
def udf_table_class(spark, sf_dir):
    from ..functions.udfs import table_class

    class Counted:
        def eval(self, n: int):
            for i in range(n):
                yield (i + 1,)

    engine = Engine(spark).load(sf_dir, "nation")
    engine.register_function("counted", table_class(Counted, "i int"), "i int")
    return engine.sql("SELECT n_nationkey, i FROM nation, LATERAL counted(n_regionkey)")


@query("SELECT a.o_orderkey, b.c_custkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders) a JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey DESC) AS r FROM customer) b USING (r)")
def zip_rows(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select("c_custkey")
    o = _t(spark, sf_dir, "orders").select("o_orderkey").orderBy("o_orderkey").limit(c.count())  # a zip needs as many rows
    return C.zipped(o, c, [F.col("o_orderkey")], [F.desc("c_custkey")]).select("o_orderkey", "c_custkey")


@query("SELECT i AS index, a + b + c AS total FROM (SELECT row_number() OVER w - 1 AS i, o_totalprice AS a, lead(o_totalprice) OVER w AS b, lead(o_totalprice, 2) OVER w AS c FROM orders WINDOW w AS (ORDER BY o_totalprice)) WHERE c IS NOT NULL")
def sliding_whole(spark, sf_dir):
    return C.runs(_t(spark, sf_dir, "orders"), F.col("o_totalprice"), "o_totalprice", 3).select("index", F.expr("run[0] + run[1] + run[2]").alias("total"))


@query("SELECT count(*) AS n, true AS disjoint, true AS near FROM orders")
def random_split(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey")
    parts = C.random_split(o, [0.6, 0.3, 0.1])
    both = parts[0].withColumn("p", F.lit(0)).union(parts[1].withColumn("p", F.lit(1))).union(parts[2].withColumn("p", F.lit(2)))
    return both.agg(F.count("*").alias("n"), (F.count("*") == F.countDistinct("o_orderkey")).alias("disjoint"), (F.abs(F.avg((F.col("p") == 0).cast("int")) - 0.6) < 0.06).alias("near"))


@query("SELECT coalesce(c.k, s.k, n.k) AS key, c.a, s.b, n.d FROM (SELECT c_nationkey AS k, min(c_custkey) AS a FROM customer GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS k, min(s_suppkey) AS b FROM supplier GROUP BY 1) s ON c.k = s.k RIGHT JOIN (SELECT n_nationkey AS k, n_name AS d FROM nation) n ON n.k = coalesce(c.k, s.k) WHERE c.k IS NOT NULL OR s.k IS NOT NULL")
def join_unique(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.min("c_custkey").alias("a"))
    s = _t(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("b"))
    n = _t(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("d"))
    return C.unique_join([(c, "c_nationkey", True), (s, "s_nationkey", True), (n, "n_nationkey", False)])


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def count_by_value(spark, sf_dir):
    return C.count_by_value(_t(spark, sf_dir, "orders"), "o_orderstatus")


@query("SELECT (SELECT count(*) FROM orders WHERE o_custkey = 7) AS found, (SELECT count(DISTINCT c_custkey) FROM customer) AS keys, 5::BIGINT AS sampled, (SELECT count(*) FROM orders) AS counted")
def to_caller(spark, sf_dir):
    o, c = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer")
    found = C.lookup(o, "o_custkey", 7, "o_orderkey")
    keys = C.collect_as_map(c, "c_custkey", "c_name")
    waiting = C.background(o.count)
    return spark.createDataFrame([(len(found), len(keys), len(C.take_sample(o, 5)), waiting.result())], "found long, keys long, sampled long, counted long")


@query("SELECT l_returnflag, count(*) AS n, round(sum(l_tax), 4) AS t FROM lineitem GROUP BY 1")
def combine_by_key(spark, sf_dir):
    return C.combine_by_key(_t(spark, sf_dir, "lineitem"), "l_returnflag", n=F.count("*"), t=F.round(F.sum("l_tax"), 4))


@query("SELECT o_totalprice > 100000 AS key, count(*) AS n FROM orders GROUP BY 1")
def group_by_function(spark, sf_dir):
    return C.group_by(_t(spark, sf_dir, "orders"), F.col("o_totalprice") > 100000, F.count("*").alias("n"))


@query("SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS s FROM orders")
def glom(spark, sf_dir):
    parts = C.partition_arrays(_t(spark, sf_dir, "orders").repartition(5), "o_orderkey")
    return parts.select(F.explode("items").alias("x")).agg(F.count("*").alias("n"), F.sum("x").alias("s"))


@query("SELECT DISTINCT l_returnflag, true AS mean, true AS count FROM lineitem")
def approx_by_sample(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem")  # noqa: E741
    exact = l.groupBy("l_returnflag").agg(F.avg("l_quantity").alias("m"), F.count("*").alias("n"))
    mean = C.approx_mean(l, "l_quantity", 0.3, ["l_returnflag"], z=5).toDF("l_returnflag", "e1", "low1", "high1")
    count = C.approx_counts(l, ["l_returnflag"], 0.3, z=5).toDF("l_returnflag", "e2", "low2", "high2")
    return exact.join(mean, "l_returnflag").join(count, "l_returnflag").select("l_returnflag", F.col("m").between(F.col("low1"), F.col("high1")).alias("mean"), F.col("n").between(F.col("low2"), F.col("high2")).alias("count"))


@query("""SELECT n_nationkey + 1 AS a, n_nationkey - 1 AS s, n_nationkey * 2 AS m, n_nationkey / 2.0::DOUBLE AS d, n_nationkey % 3 AS r, -n_nationkey AS n, n_nationkey > 3 AND NOT n_nationkey >= 20 AS b, n_nationkey = 4 OR n_nationkey <> 5 AS o,
n_name LIKE '%1%' AS l, regexp_matches(n_name, '2$') AS x, n_nationkey::VARCHAR AS c, n_nationkey IN (1, 2) AS i, n_nationkey BETWEEN 3 AND 5 AS w FROM nation UNION ALL SELECT 0, 0, 0, 0, 0, 0, true, true, true, true, '0', true, true FROM region""")
def dsl_operations(spark, sf_dir):
    k, v = F.col("n_nationkey"), F.col("n_name")
    n = _t(spark, sf_dir, "nation").select(
        (k + 1).alias("a"), (k - 1).alias("s"), (k * 2).alias("m"), (k / 2).alias("d"), (k % 3).alias("r"), (-k).alias("n"), ((k > 3) & ~(k >= 20)).alias("b"), ((k == 4) | (k != 5)).alias("o"),
        v.like("%1%").alias("l"), v.rlike("2$").alias("x"), k.cast("string").alias("c"), k.isin(1, 2).alias("i"), k.between(3, 5).alias("w"),
    )
    zero, yes = F.lit(0), F.lit(True)
    r = _t(spark, sf_dir, "region").select(zero, zero, zero, zero.cast("double"), zero, zero, yes, yes, yes, yes, F.lit("0"), yes, yes)
    return n.unionAll(r)


@query("SELECT c_mktsegment AS key, unnest(string_split(lower(c_name), '#')) AS value FROM customer")
def flow_key_values(spark, sf_dir):
    keyed = C.key_by(_t(spark, sf_dir, "customer").select("c_name", "c_mktsegment"), F.col("c_mktsegment"))
    return C.flat_map_values(C.map_values(keyed, lambda v: F.lower(v["c_name"])), lambda v: F.split(v, "#"))


@query("SELECT n_nationkey AS k, unnest(range(n_nationkey % 3))::INT AS i FROM nation")
def flow_flat_map(spark, sf_dir):
    return C.flat_map(_t(spark, sf_dir, "nation").select("n_nationkey"), lambda r: [(r["n_nationkey"], i) for i in range(r["n_nationkey"] % 3)], "k int, i int")


@query("SELECT 3::INT AS fewer, 7::INT AS more, true AS together, (SELECT count(*) FROM orders) AS n, (SELECT count(*) FROM nation WHERE n_regionkey = 1) AS some, true AS ordered, (SELECT count(*) FROM orders) AS seen")
def flow_partitions(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").repartition(9)
    placed = o.repartition(7, "o_custkey")
    per = placed.withColumn("part", F.spark_partition_id()).groupBy("o_custkey").agg(F.countDistinct("part").alias("p"), F.count("*").alias("n")).agg(F.max("p").alias("p"), F.sum("n").alias("n")).first()
    some = C.collect_some(_t(spark, sf_dir, "nation"), F.col("n_regionkey") == 1, F.col("n_name"))
    names = [r["n_name"] for r in C.in_order(_t(spark, sf_dir, "nation"), F.col("n_name"))]
    seen = spark.sparkContext.accumulator(0)

    def count(rows):
        seen.add(sum(1 for _ in rows))

    o.foreachPartition(count)
    row = (o.coalesce(3).rdd.getNumPartitions(), placed.rdd.getNumPartitions(), bool(per["p"] == 1), per["n"], len(some), names == sorted(names), seen.value)
    return spark.createDataFrame([row], "fewer int, more int, together boolean, n long, some long, ordered boolean, seen long")


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1")
def flow_kept(spark, sf_dir):
    """A cached table (read back from memory, in columns) and a written one, each planned on by what follows."""
    kept = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").persist()
    kept.count()
    even = written(kept.where("o_orderkey % 2 = 0"))
    kept.unpersist()
    return even.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


# tables of the catalog


@query("SELECT n_nationkey AS K, n_name AS V FROM nation WHERE n_nationkey BETWEEN 3 AND 17")
def jdbc_table(spark, sf_dir):
    """Into and out of the embedded database that Spark brings along."""
    from ..sources.files import derby_copy, jdbc_range

    name = _named(spark).upper()
    n = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("K"), F.col("n_name").alias("V"))
    return written(jdbc_range(spark, derby_copy(n, name), name, "K", 3, 17, 4, driver="org.apache.derby.jdbc.EmbeddedDriver"))


@query("SELECT n_regionkey AS r, count(*) AS n FROM nation WHERE n_name <> ';' GROUP BY 1")
def script_of_statements(spark, sf_dir):
    engine, name = Engine(spark).load(sf_dir, "nation"), _named(spark)
    path = scratch(spark)
    text = f"-- two; statements\nSET spark.tidemill.none = 1; CREATE TABLE {name} USING parquet AS SELECT * FROM nation WHERE n_name <> ';';\nSELECT n_regionkey AS r, count(*) AS n FROM {name} GROUP BY n_regionkey;"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    out = written(engine.sql(f"SOURCE {path}"))
    spark.conf.unset("spark.tidemill.none")
    engine.sql(f"DROP TABLE {name}")
    return out


@query("SELECT r_regionkey, r_name FROM region")
def table_empty_then_filled(spark, sf_dir):
    from ..sources.files import empty_table, write_table

    path = scratch(spark)
    empty_table(spark, path, "r_regionkey int, r_name string")
    write_table(_t(spark, sf_dir, "region"), path)
    return spark.read.schema("r_regionkey int, r_name string").parquet(path)


def _named(spark) -> str:
    return "t" + scratch(spark).rsplit("/", 1)[1]


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey + 100, 'x', n_regionkey FROM nation WHERE n_regionkey = 1")
def table_insert(spark, sf_dir):
    engine, name = Engine(spark).load(sf_dir, "nation"), _named(spark)
    engine.save_as_table(name, engine.table("nation"))
    engine.insert_into(name, engine.sql("SELECT cast(n_nationkey + 100 AS int), 'x', n_regionkey FROM nation WHERE n_regionkey = 1"))
    return _taken(engine, name)


def _taken(engine: Engine, name: str) -> DataFrame:
    """A table's rows, kept apart from the catalog, which loses the table again."""
    out = written(engine.table(name))
    engine.sql(f"DROP TABLE {name}")
    return out


@query("SELECT n_name, n_regionkey AS region FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT upper(n_name) || '!', 2 FROM nation WHERE n_regionkey = 2")
def table_partitions(spark, sf_dir):
    engine, name = Engine(spark).load(sf_dir, "nation"), _named(spark)
    engine.sql(f"CREATE TABLE {name} (n_name STRING, region INT) USING parquet PARTITIONED BY (region)")
    engine.insert_into(name, engine.sql("SELECT n_name, n_regionkey FROM nation"))
    engine.sql(f"INSERT OVERWRITE TABLE {name} PARTITION (region = 2) SELECT concat(upper(n_name), '!') FROM nation WHERE n_regionkey = 2")
    return _taken(engine, name)


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def table_as_select(spark, sf_dir):
    engine, name = Engine(spark).load(sf_dir, "nation"), _named(spark)
    engine.sql(f"CREATE TABLE {name} USING parquet AS SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
    return _taken(engine, name)


@query("SELECT 'a' AS t, n_nationkey AS k FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'b', n_nationkey FROM nation WHERE n_regionkey = 2")
def multi_insert_text(spark, sf_dir):
    engine, name = Engine(spark).load(sf_dir, "nation"), _named(spark)
    engine.sql(f"CREATE TABLE {name} (t STRING, k INT) USING parquet")
    engine.sql(f"FROM nation INSERT INTO {name} SELECT 'a', n_nationkey WHERE n_regionkey = 1 INSERT INTO {name} SELECT 'b', n_nationkey WHERE n_regionkey = 2")
    return _taken(engine, name)


@query("SELECT r_regionkey::VARCHAR AS key, r_name AS value FROM region UNION ALL SELECT r_regionkey::VARCHAR, r_name FROM region")
def hadoop_files(spark, sf_dir):
    from ..sources.hadoop import object_file, save_object_file, save_sequence_file, sequence_file

    r, path = _t(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("key"), F.col("r_name").alias("value")), scratch(spark)
    save_sequence_file(r, f"{path}/s", "key", "value")
    save_object_file(r, f"{path}/o")
    return sequence_file(spark, f"{path}/s").union(object_file(spark, f"{path}/o", "key string, value string"))


@query("SELECT n_nationkey AS k, n_name AS v FROM nation UNION ALL SELECT NULL, NULL")
def regex_lines(spark, sf_dir):
    from ..sources.hadoop import lines, regex_rows

    path = scratch(spark)
    _t(spark, sf_dir, "nation").select(F.concat(F.lit("<"), F.col("n_nationkey").cast("string"), F.lit("> "), F.col("n_name")).alias("value")).union(spark.createDataFrame([("no match",)], "value string")).write.text(path)
    return regex_rows(lines(spark, path), r"<(\d+)> (.*)", ["k", "v"], ["int", "string"])


@query("SELECT n_nationkey::BIGINT AS position, n_name AS value FROM nation WHERE n_nationkey < 20")
def stream_custom_source(spark, sf_dir):
    import struct
    import tempfile

    from ..sources.custom import BlockFile, connect

    names = [r[0] for r in _t(spark, sf_dir, "nation").where("n_nationkey < 20").orderBy("n_nationkey").select("n_name").collect()]
    with tempfile.NamedTemporaryFile(delete=False) as f:  # twenty records, for readers on this machine
        f.write(b"".join(struct.pack(">I", len(n.encode())) + n.encode() for n in names))
    connect(spark, "tidemill_blocks", BlockFile, "position long, body binary")
    blocks = spark.readStream.format("tidemill_blocks").option("path", f.name).load()
    return StreamQuery(spark, {"blocks": blocks}, "SELECT position, cast(body AS string) AS value FROM blocks").table().drop("batch_id")


@query("SELECT r_regionkey, r_name, 'copy' AS tag FROM region")
def sink_round_trip(spark, sf_dir):
    from ..sources.files import write_table

    path, df = scratch(spark), _t(spark, sf_dir, "region").withColumn("tag", F.lit("copy"))
    for kind in ("parquet", "orc", "json", "csv"):
        write_table(df, f"{path}/{kind}", kind)
        df = read_table(spark, f"{path}/{kind}", kind, "r_regionkey int, r_name string, tag string")
    return df


@query("SELECT * FROM (SELECT 'a' AS t, n_nationkey AS k FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'b', n_nationkey FROM nation WHERE n_regionkey = 2)")
def multi_insert(spark, sf_dir):
    from ..sources.files import multi_insert as run

    path = scratch(spark)
    run(_t(spark, sf_dir, "nation"), [("n_regionkey = 1", ["n_nationkey AS k"], f"{path}/t=a"), ("n_regionkey = 2", ["n_nationkey AS k"], f"{path}/t=b")])
    return spark.read.parquet(path).select(F.col("t").cast("string").alias("t"), "k")


# streams: events replayed as six batches of five days each

BATCH = "least(floor((epoch(ts) - epoch(timestamp '2024-01-01 00:00:00')) / 432000), 5)::BIGINT"
BATCHES = 6


def _batched(spark, sf_dir) -> DataFrame:
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lit("2024-01-01 00:00:00"))
    e = _t(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", "value", F.least(F.floor(seconds / 432000), F.lit(5)).cast("long").alias("batch"))


def _live(spark, sf_dir) -> DataFrame:
    return replayed(_batched(spark, sf_dir), "batch", scratch(spark))


def _stream(spark, sf_dir, text: str, *tables: str) -> DataFrame:
    engine = Engine(spark).load(sf_dir, *tables)
    engine.register_stream("ticks", _live(spark, sf_dir))
    return engine.sql(text).table().drop("batch_id")


@query(f"SELECT {BATCH} AS batch, event_id, value FROM events WHERE value > 50 AND event_type = 'click'")
def stream_filter(spark, sf_dir):
    return _stream(spark, sf_dir, "SELECT batch, event_id, value FROM ticks WHERE value > 50 AND event_type = 'click'")


@query(f"SELECT {BATCH} AS batch, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_batch_agg(spark, sf_dir):
    return _stream(spark, sf_dir, "SELECT batch, event_type, count(*) AS n, round(sum(value), 4) AS total FROM ticks GROUP BY batch, event_type")


@query(f"SELECT {BATCH} AS batch, event_id, c_name FROM events JOIN customer ON user_id = c_custkey")
def stream_table_join(spark, sf_dir):
    return _stream(spark, sf_dir, "SELECT batch, event_id, c_name FROM ticks JOIN customer ON user_id = c_custkey", "customer")


@query(f"SELECT batch, user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY value DESC, user_id) AS rn FROM (SELECT DISTINCT {BATCH} AS batch, user_id, value FROM events)) WHERE rn <= 3")
def stream_distinct_topk(spark, sf_dir):
    return _stream(spark, sf_dir, "SELECT DISTINCT batch, user_id, value FROM ticks ORDER BY value DESC, user_id LIMIT 3")


@query(f"WITH e AS (SELECT *, {BATCH} AS batch FROM events) SELECT a.batch, a.event_id AS click, b.event_id AS purchase FROM e a JOIN e b ON a.batch = b.batch AND a.user_id = b.user_id WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
def stream_stream_join(spark, sf_dir):
    live = _live(spark, sf_dir)
    parts = {"clicks": "click", "purchases": "purchase"}

    def work(clicks, purchases):
        return clicks.select("batch", "user_id", F.col("event_id").alias("click")).join(purchases.select("user_id", F.col("event_id").alias("purchase")), "user_id").select("batch", "click", "purchase")

    def of_batch(ticks):
        return work(**{n: ticks.where(F.col("event_type") == t) for n, t in parts.items()})

    return StreamQuery(spark, {"ticks": live}, of_batch).table().drop("batch_id")


def _windows(length: int, slide: int, keys: str) -> str:
    ends = f"SELECT unnest(range({slide}, {BATCHES + 1}, {slide})) AS window_end"
    return f"SELECT window_end, {keys} count(*) AS n FROM (SELECT *, {BATCH} AS batch FROM events) e JOIN ({ends}) w ON batch < window_end AND batch >= window_end - {length} GROUP BY ALL"


def _counted(spark, sf_dir, length, slide, keys):
    return Windows(_live(spark, sf_dir), keys, {"n": F.count("*")}, {"n": F.sum("n")}, length, slide).table()


@query(_windows(2, 2, "event_type,"))
def window_tumbling(spark, sf_dir):
    return _counted(spark, sf_dir, 2, 2, ["event_type"])


@query(_windows(3, 1, "event_type,"))
def window_sliding(spark, sf_dir):
    return _counted(spark, sf_dir, 3, 1, ["event_type"])


@query(_windows(2, 3, "event_type,"))
def window_nonoverlap(spark, sf_dir):
    return _counted(spark, sf_dir, 2, 3, ["event_type"])


@query(_windows(4, 2, ""))
def window_count(spark, sf_dir):
    return _counted(spark, sf_dir, 4, 2, [])


@query(f"""WITH e AS (SELECT user_id, value, {BATCH} AS batch FROM events), s AS (SELECT user_id, min(batch) AS f FROM e GROUP BY 1)
SELECT w.window_end, s.user_id, round(coalesce(sum(e.value), 0), 4) AS total FROM s JOIN (SELECT unnest(range(1, {BATCHES + 1})) AS window_end) w ON w.window_end > s.f
LEFT JOIN e ON e.user_id = s.user_id AND e.batch < w.window_end AND e.batch >= w.window_end - 2 GROUP BY 1, 2""")
def window_invertible(spark, sf_dir):
    moving = Windows(_live(spark, sf_dir), ["user_id"], {"total": F.sum("value")}, {"total": F.sum("total")}, 2, 1, inverse=True)
    return moving.table().withColumn("total", F.abs(F.round("total", 4)))


@query(f"WITH e AS (SELECT *, {BATCH} AS batch FROM events) SELECT window_end, round(sum(value), 4) AS total, max(value) AS most FROM e JOIN (SELECT unnest(range(1, {BATCHES + 1})) AS window_end) w ON batch < window_end AND batch >= window_end - 2 GROUP BY 1")
def window_reduce(spark, sf_dir):
    moving = Windows(_live(spark, sf_dir), [], {"s": F.sum("value"), "m": F.max("value")}, {"s": F.sum("s"), "m": F.max("m")}, 2, 1).table()
    return moving.select("window_end", F.round("s", 4).alias("total"), F.col("m").alias("most"))


@query(f"WITH e AS (SELECT *, {BATCH} AS batch FROM events) SELECT window_end, event_type, array_to_string(list_sort(list(DISTINCT user_id)), ',') AS users FROM e JOIN (SELECT unnest(range(2, {BATCHES + 1}, 2)) AS window_end) w ON batch < window_end AND batch >= window_end - 3 WHERE user_id % 20 = 0 GROUP BY 1, 2")
def window_group(spark, sf_dir):
    few = _live(spark, sf_dir).where("user_id % 20 = 0")
    moving = Windows(few, ["event_type"], {"u": F.collect_set("user_id")}, {"u": F.array_distinct(F.flatten(F.collect_list("u")))}, 3, 2).table()
    return moving.select("window_end", "event_type", F.concat_ws(",", F.sort_array("u").cast("array<string>")).alias("users"))


@query("SELECT user_id, count(*) AS state FROM events GROUP BY user_id")
def state_running_count(spark, sf_dir):
    count = lambda old, new: F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0))
    return KeyedState(_live(spark, sf_dir), "user_id", F.count("*"), count, F.lit(0).cast("long")).final()


@query(f"""WITH e AS (SELECT user_id, {BATCH} AS batch FROM events), p AS (SELECT user_id, batch, count(*) AS n FROM e GROUP BY 1, 2),
latest AS (SELECT user_id, max(batch) AS last FROM p GROUP BY 1) SELECT user_id, n AS state FROM p JOIN latest USING (user_id) WHERE batch = last AND last = {BATCHES - 1}""")
def state_removed(spark, sf_dir):
    return KeyedState(_live(spark, sf_dir), "user_id", F.count("*"), lambda old, new: new).final()


@query("SELECT c_custkey AS user_id, (c_nationkey + coalesce(n, 0))::BIGINT AS state FROM customer LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) e ON c_custkey = user_id UNION ALL SELECT user_id, count(*) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer) GROUP BY 1")
def state_from_table(spark, sf_dir):
    start = _t(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("user_id"), F.col("c_nationkey").cast("long").alias("state"))
    count = lambda old, new: F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0))
    return KeyedState(_live(spark, sf_dir), "user_id", F.count("*"), count, F.lit(0).cast("long"), start).final()


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_incremental(spark, sf_dir):
    from ..streaming.streams import incremental

    return incremental(_live(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n")), mode="complete")


def _two_streams(spark, sf_dir) -> dict[str, DataFrame]:
    """Two sources: clicks and purchases, replayed side by side. Every batch has a file in each."""
    e = _batched(spark, sf_dir)
    return {n: replayed(e.where(F.col("event_type") == t), "batch", scratch(spark)) for n, t in (("clicks", "click"), ("purchases", "purchase"))}


def _joined(spark, sf_dir, text: str) -> DataFrame:
    engine = Engine(spark)
    for n, s in _two_streams(spark, sf_dir).items():
        engine.register_stream(n, s)
    return engine.sql(text).table().drop("batch_id")


_CP = f"WITH e AS (SELECT *, {BATCH} AS batch FROM events), c AS (SELECT * FROM e WHERE event_type = 'click'), p AS (SELECT * FROM e WHERE event_type = 'purchase')"
for _how in ("LEFT", "RIGHT", "FULL"):

    def _outer(spark, sf_dir, how=_how):
        return _joined(spark, sf_dir, f"SELECT coalesce(c.batch, p.batch) AS batch, c.event_id AS click, p.event_id AS purchase FROM clicks c {how} OUTER JOIN purchases p ON c.user_id = p.user_id AND c.value < p.value")

    QUERIES[f"stream_join_{_how.lower()}"] = _outer
    ORACLE[f"stream_join_{_how.lower()}"] = f"{_CP} SELECT coalesce(c.batch, p.batch) AS batch, c.event_id AS click, p.event_id AS purchase FROM c {_how} JOIN p ON c.batch = p.batch AND c.user_id = p.user_id AND c.value < p.value"


@query(f"{_CP} SELECT c.batch, c.event_id AS click, p.event_id AS purchase FROM c JOIN p ON c.batch = p.batch AND c.value + 99 < p.value")
def stream_join_theta(spark, sf_dir):
    return _joined(spark, sf_dir, "SELECT c.batch, c.event_id AS click, p.event_id AS purchase FROM clicks c JOIN purchases p ON c.value + 99 < p.value")


@query(f"{_CP} SELECT c.batch, count(*) AS pairs FROM c JOIN p ON c.batch = p.batch WHERE c.user_id < 50 AND p.user_id < 50 GROUP BY 1")
def stream_cartesian(spark, sf_dir):
    return _joined(spark, sf_dir, "SELECT c.batch, count(*) AS pairs FROM (SELECT * FROM clicks WHERE user_id < 50) c CROSS JOIN (SELECT * FROM purchases WHERE user_id < 50) p GROUP BY c.batch")


@query(f"{_CP} SELECT coalesce(a.batch, b.batch) AS batch, coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.l, '') AS clicks, coalesce(b.l, '') AS purchases FROM (SELECT batch, user_id, array_to_string(list_sort(list(event_id)), ',') AS l FROM c GROUP BY 1, 2) a FULL JOIN (SELECT batch, user_id, array_to_string(list_sort(list(event_id)), ',') AS l FROM p GROUP BY 1, 2) b ON a.batch = b.batch AND a.user_id = b.user_id")
def stream_cogroup(spark, sf_dir):
    def work(clicks, purchases):
        both = C.cogroup(clicks.select("batch", "user_id", "event_id"), purchases.select("batch", "user_id", "event_id"), "user_id")
        ids = lambda c: F.concat_ws(",", F.sort_array(F.transform(c, lambda r: r["event_id"])).cast("array<string>"))
        batch = F.coalesce(F.get("rows0", F.lit(0))["batch"], F.get("rows1", F.lit(0))["batch"])
        return both.select(batch.alias("batch"), "user_id", ids("rows0").alias("clicks"), ids("rows1").alias("purchases"))

    return StreamQuery(spark, _two_streams(spark, sf_dir), work).table().drop("batch_id")


@query(f"{_CP} SELECT batch, event_id FROM c UNION ALL SELECT batch, event_id FROM p")
def stream_union(spark, sf_dir):
    from ..streaming.state import union

    both = union(list(_two_streams(spark, sf_dir).values()))
    return StreamQuery(spark, {"rows": both}, "SELECT batch, event_id FROM rows").table().drop("batch_id")


@query(f"SELECT {BATCH} AS batch, event_type, count(*) AS n, max(value) AS most FROM events GROUP BY 1, 2")
def stream_reduce(spark, sf_dir):
    def work(ticks):
        return ticks.groupBy("batch", "event_type").agg(F.count("*").alias("n"), F.max("value").alias("most"))

    return StreamQuery(spark, {"ticks": _live(spark, sf_dir)}, work).table().drop("batch_id")


@query(f"SELECT {BATCH} AS batch, user_id, upper(event_type) AS kind, n_name FROM events JOIN nation ON n_nationkey = user_id % 25 WHERE value > 90 ORDER BY 1")
def stream_transform_with_table(spark, sf_dir):
    nation = _t(spark, sf_dir, "nation").select("n_nationkey", "n_name")

    def work(ticks):
        return ticks.where("value > 90").join(nation, F.col("user_id") % 25 == F.col("n_nationkey")).select("batch", "user_id", F.upper("event_type").alias("kind"), "n_name").sortWithinPartitions("user_id")

    return StreamQuery(spark, {"ticks": _live(spark, sf_dir)}, work).table().drop("batch_id")


@query(f"SELECT {BATCH} AS batch, count(*) AS n FROM events WHERE {BATCH} BETWEEN 1 AND 3 GROUP BY 1")
def stream_slice(spark, sf_dir):
    from ..streaming.state import between

    results = StreamQuery(spark, {"ticks": _live(spark, sf_dir)}, "SELECT batch, count(*) AS n FROM ticks GROUP BY batch").table()
    return between(results, 1, 3).drop("batch_id")


@query(f"SELECT {BATCH} AS batch, event_type, count(*) AS n FROM events WHERE value > 20 GROUP BY 1, 2")
def stream_as_select(spark, sf_dir):
    engine = Engine(spark)
    engine.register_stream("ticks", _live(spark, sf_dir))
    engine.sql("CREATE STREAM high AS SELECT batch, event_type, value FROM ticks WHERE value > 20")
    return engine.sql("SELECT batch, event_type, count(*) AS n FROM high GROUP BY batch, event_type").table().drop("batch_id")


@query(f"SELECT {BATCH} AS batch, sum(event_id)::BIGINT AS ids, count(*) FILTER (event_id % 5 <> 0) AS known, sum(user_id + event_id)::BIGINT AS items, sum(event_id % 3)::BIGINT AS amount FROM events GROUP BY 1")
def stream_nested_types(spark, sf_dir):
    path = scratch(spark)
    maybe = F.when(F.col("event_id") % 5 == 0, "null").otherwise(F.col("user_id").cast("string"))
    text = lambda *c: F.concat_ws(",", *[x.cast("string") for x in c])
    line = F.concat_ws("|", F.col("batch").cast("string"), F.col("event_id").cast("string"), maybe, text(F.col("user_id"), F.col("event_id")), F.concat(F.lit("k:"), (F.col("event_id") % 3).cast("string")))
    _batched(spark, sf_dir).select(line).write.text(path)
    engine = Engine(spark)
    engine.sql(f"""CREATE STREAM lines (batch BIGINT COMMENT 'its number, (from 0)', event_id DECIMAL(12,0), user BIGINT, pair ARRAY<BIGINT>, kinds MAP<STRING,BIGINT>)
        ROW FORMAT DELIMITED FIELDS TERMINATED BY '|' COLLECTION ITEMS TERMINATED BY ',' MAP KEYS TERMINATED BY ':' STORED AS TEXTFILE LOCATION '{path}'""")
    engine.sql("CREATE STREAM same LIKE lines")
    return engine.sql("SELECT batch, cast(sum(event_id) AS bigint) AS ids, count(user) AS known, sum(pair[0] + pair[1]) AS items, sum(kinds['k']) AS amount FROM same GROUP BY batch").table().drop("batch_id")


@query(f"SELECT {BATCH} AS batch, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1")
def stream_ddl(spark, sf_dir):
    path = scratch(spark)
    rows = _batched(spark, sf_dir).where("event_type = 'view'").select(F.concat_ws(" ", F.col("batch").cast("string"), F.col("event_id").cast("string")))
    rows.write.text(path)
    engine = Engine(spark)
    engine.sql(f"CREATE STREAM IF NOT EXISTS views (batch BIGINT, event_id BIGINT) ROW FORMAT DELIMITED FIELDS TERMINATED BY ' ' STORED AS TEXTFILE LOCATION '{path}'")
    return engine.sql("SELECT batch, count(*) AS n FROM views GROUP BY batch").table().drop("batch_id")


# graphs: customers and the suppliers of what they ordered

EDGES = "(SELECT DISTINCT o_custkey AS src, 10000000 + l_suppkey AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"


def _graph(spark, sf_dir) -> Graph:
    e = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return Graph.from_edges(e.select(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + 10000000).alias("dst")).distinct())


def _orders_graph(spark, sf_dir) -> Graph:
    """Nations and their regions: stars."""
    return Graph.from_edges(_t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("src"), (F.col("n_regionkey") + 100).cast("long").alias("dst")))


@query(f"SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree, count(*) AS degree FROM (SELECT src AS id, 0 AS i, 1 AS o FROM {EDGES} UNION ALL SELECT dst, 1, 0 FROM {EDGES}) GROUP BY id")
def graph_degrees(spark, sf_dir):
    return _graph(spark, sf_dir).degrees()


def _ranks(rounds: int) -> str:
    steps = ["r0 AS (SELECT id, 1.0::DOUBLE AS rank FROM v)"]
    steps += [f"r{i} AS (SELECT v.id, 0.15 + 0.85 * coalesce(sum(r{i - 1}.rank / o.n), 0) AS rank FROM v LEFT JOIN e ON e.dst = v.id LEFT JOIN r{i - 1} ON r{i - 1}.id = e.src LEFT JOIN o ON o.src = e.src GROUP BY v.id)" for i in range(1, rounds + 1)]
    return f"WITH e AS {EDGES}, v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), o AS (SELECT src, count(*) AS n FROM e GROUP BY src), {', '.join(steps)} SELECT id, round(rank, 6) AS rank FROM r{rounds}"


@query(_ranks(3))
def graph_pagerank(spark, sf_dir):
    return _graph(spark, sf_dir).pagerank(3).withColumn("rank", F.round("rank", 6))


@query(_ranks(40).replace("round(rank, 6)", "round(rank, 2)"))
def graph_pagerank_tolerance(spark, sf_dir):
    return _graph(spark, sf_dir).pagerank(tolerance=1e-4).withColumn("rank", F.round("rank", 2))


@query("SELECT id, min(id) OVER (PARTITION BY g) AS value FROM (SELECT n_nationkey::BIGINT AS id, n_regionkey AS g FROM nation UNION ALL SELECT DISTINCT n_regionkey::BIGINT + 100, n_regionkey FROM nation)")
def graph_components(spark, sf_dir):
    return _orders_graph(spark, sf_dir).connected_components()


@query("SELECT n_nationkey::BIGINT AS id, n_nationkey::BIGINT AS component FROM nation UNION ALL SELECT DISTINCT n_regionkey::BIGINT + 100, n_regionkey::BIGINT + 100 FROM nation")
def graph_strong_components(spark, sf_dir):
    return _orders_graph(spark, sf_dir).strongly_connected()


def _chains_graph(spark, sf_dir) -> Graph:
    """Customers of the same nation, each linked to the next by key: long chains. In nations of even key the last is linked to the first."""
    by_key = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    following = F.lead("c_custkey").over(by_key)
    first = F.when(F.col("c_nationkey") % 2 == 0, F.first("c_custkey").over(by_key))
    e = _t(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("src"), F.coalesce(following, first).cast("long").alias("dst"))
    return Graph.from_edges(e.where("dst is not null"))


#: Customers with the first and the number of their nation; one alone has an edge only where the chain is closed.
CHAINS = "(SELECT c_custkey::BIGINT AS id, c_nationkey % 2 = 0 AS closed, min(c_custkey) OVER n::BIGINT AS least, count(*) OVER n AS size FROM customer WINDOW n AS (PARTITION BY c_nationkey))"


@query(f"SELECT id, least AS value FROM {CHAINS} WHERE closed OR size > 1")
def graph_chain_components(spark, sf_dir):
    return _chains_graph(spark, sf_dir).connected_components()


@query(f"SELECT id, CASE WHEN closed THEN least ELSE id END AS component FROM {CHAINS} WHERE closed OR size > 1")
def graph_chain_strong_components(spark, sf_dir):
    return _chains_graph(spark, sf_dir).strongly_connected()


@query("""WITH e AS (SELECT DISTINCT least(a.l_suppkey, b.l_suppkey) AS x, greatest(a.l_suppkey, b.l_suppkey) AS y FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey WHERE a.l_shipdate > b.l_shipdate ),
t AS (SELECT a.x AS p, a.y AS q, b.y AS r FROM e a JOIN e b ON a.y = b.x JOIN e c ON c.x = a.x AND c.y = b.y), v AS (SELECT x AS id FROM e UNION SELECT y FROM e),
n AS (SELECT id, count(*) AS triangles FROM (SELECT p AS id FROM t UNION ALL SELECT q FROM t UNION ALL SELECT r FROM t) GROUP BY id)
SELECT v.id, coalesce(n.triangles, 0) AS triangles FROM v LEFT JOIN n ON n.id = v.id""")
def graph_triangles(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate")  # noqa: E741
    r = l.toDF("l_orderkey", "dst", "d2")
    e = l.join(r, "l_orderkey").where("l_suppkey <> dst and l_shipdate > d2").select(F.col("l_suppkey").alias("src"), "dst").distinct()
    return Graph.from_edges(e).kept().triangles()


@query(f"SELECT dst AS id, min(src) AS message FROM {EDGES} GROUP BY dst")
def graph_messages(spark, sf_dir):
    return _graph(spark, sf_dir).aggregate_messages(F.col("src_attr.id"), None, F.min)


@query(f"SELECT src AS id, array_to_string(list_sort(list(dst)), ',') AS ids FROM (SELECT src, dst FROM {EDGES} UNION SELECT dst, src FROM {EDGES}) GROUP BY src")
def graph_neighbours(spark, sf_dir):
    return _graph(spark, sf_dir).neighbours().select("id", F.concat_ws(",", F.col("neighbours").cast("array<string>")).alias("ids"))


@query(f"SELECT id, sum(m)::BIGINT AS message FROM (SELECT dst AS id, src AS m FROM {EDGES} WHERE src % 2 = 0 UNION ALL SELECT src, dst FROM {EDGES} WHERE src % 2 = 0) GROUP BY id")
def graph_messages_active(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return g.aggregate_messages(F.col("src_attr.id"), F.col("dst_attr.id"), F.sum, g.vertices.where("id % 2 = 0 and id < 10000000"), "out")


@query(f"SELECT src AS id, count(*) AS n, min(dst) AS least FROM {EDGES} GROUP BY src")
def graph_edges_of(spark, sf_dir):
    e = _graph(spark, sf_dir).edges_of("out")
    return e.select("id", F.size("edges").cast("long").alias("n"), F.array_min(F.transform("edges", lambda x: x["dst"])).alias("least"))


@query("SELECT c_custkey AS id, c_acctbal + 1 AS v FROM customer WHERE c_custkey % 3 = 0")
def graph_vertex_diff(spark, sf_dir):
    old = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))
    return G.changed(old, old.withColumn("v", F.when(F.col("id") % 3 == 0, F.col("v") + 1).otherwise(F.col("v"))))


@query("SELECT c_custkey AS id, coalesce(sum(o_orderkey), 0)::BIGINT AS v FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def graph_vertex_join(spark, sf_dir):
    v = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    sums = G.by_vertex(v, _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey"), F.sum("o_orderkey"))
    return G.with_vertices(v, sums, v=F.coalesce("value", F.lit(0).cast("long")))


@query("SELECT a.o_custkey AS src, a.o_orderkey AS dst, a.o_totalprice + 1 AS w FROM orders a WHERE a.o_orderstatus = 'F'")
def graph_edge_join(spark, sf_dir):
    e = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), "o_totalprice", "o_orderstatus")
    return G.join_edges(e.drop("o_orderstatus"), e.where("o_orderstatus = 'F'").select("src", "dst"), w=F.col("o_totalprice") + 1)


@query("SELECT true AS distinct, true AS inside, true AS heavy, true AS degrees")
def graph_generators(spark, sf_dir):
    r, l = G.rmat(spark, 8, 2000), G.log_normal(spark, 200, 2.0, 0.5)  # noqa: E741
    e = r.edges.agg((F.count("*") == F.countDistinct("src", "dst")).alias("distinct"), (F.max(F.greatest("src", "dst")) < 256).alias("inside"), (F.avg((F.col("src") < 128).cast("int")) > 0.52).alias("heavy"))
    return e.crossJoin(l.edges.agg((F.count("*") / 200).between(5, 12).alias("degrees")))


@query("SELECT true AS better, (SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM orders)) AS users")
def graph_svd_plus_plus(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), (10_000_000 + F.floor(F.col("o_orderkey") / 8)).alias("dst"), (F.col("o_totalprice") / 100_000).alias("r"))
    g = G.Graph.from_edges(o.groupBy("src", "dst").agg(F.avg("r").alias("r")))
    out, mean = g.svd_plus_plus("r", 4, 3)
    u, i = out.where("kind = 'user'"), out.where("kind = 'item'")
    p = g.edges.join(u.select(F.col("id").alias("src"), F.col("p").alias("pu"), "y", F.col("bias").alias("bu")), "src").join(i.select(F.col("id").alias("dst"), F.col("p").alias("qi"), F.col("bias").alias("bi")), "dst")
    guess = F.lit(mean) + F.col("bu") + F.col("bi") + F.expr("aggregate(zip_with(qi, zip_with(pu, y, (a, b) -> a + b), (a, b) -> a * b), 0D, (s, x) -> s + x)")
    return p.agg((F.avg((F.col("r") - guess) ** 2) < F.avg((F.col("r") - mean) ** 2)).alias("better"), F.countDistinct("src").alias("users"))


@query("SELECT id, (id + (SELECT sum(id) FROM (SELECT DISTINCT n_regionkey::BIGINT + 100 AS id FROM nation UNION SELECT n_nationkey FROM nation)))::BIGINT AS value FROM (SELECT DISTINCT n_regionkey::BIGINT + 100 AS id FROM nation) UNION ALL SELECT n_nationkey, n_nationkey FROM nation")
def graph_supersteps(spark, sf_dir):
    g = _orders_graph(spark, sf_dir)
    return g.supersteps(F.col("id"), lambda s, d: F.lit(1), F.sum, lambda v, m, total: F.when(m.isNotNull(), v + total).otherwise(v), F.sum, most=1)


@query(f"SELECT src, dst FROM {EDGES} WHERE src % 2 = 0")
def graph_subgraph(spark, sf_dir):
    return _graph(spark, sf_dir).subgraph(vertex="id % 2 = 0 or id > 10000000").edges.select("src", "dst")


@query("SELECT 'l_quantity' AS \"column\", round(avg(l_quantity), 6) AS mean, round(var_samp(l_quantity), 4) AS variance, count(*) FILTER (l_quantity <> 0) AS nonzeros FROM lineitem UNION ALL SELECT 'l_tax', round(avg(l_tax), 6), round(var_samp(l_tax), 4), count(*) FILTER (l_tax <> 0) FROM lineitem")
def ml_summary(spark, sf_dir):
    s = ml.column_summary(_t(spark, sf_dir, "lineitem"), "l_quantity", "l_tax")
    return s.select("column", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"), "nonzeros")


@query("SELECT 'l_quantity' AS a, 'l_quantity' AS b, round(covar_samp(l_quantity, l_quantity), 4) AS cov FROM lineitem UNION ALL SELECT 'l_quantity', 'l_tax', round(covar_samp(l_quantity, l_tax), 4) FROM lineitem UNION ALL SELECT 'l_tax', 'l_tax', round(covar_samp(l_tax, l_tax), 4) FROM lineitem")
def ml_covariance(spark, sf_dir):
    return ml.covariance(_t(spark, sf_dir, "lineitem"), "l_quantity", "l_tax").withColumn("cov", F.round("cov", 4))


@query("SELECT 'slope' AS name, round(regr_slope(l_extendedprice, l_quantity), 3) AS value FROM lineitem UNION ALL SELECT 'intercept', round(regr_intercept(l_extendedprice, l_quantity), 3) FROM lineitem")
def ml_linreg(spark, sf_dir):
    m = ml.linear_regression(_t(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity"])
    return spark.createDataFrame([("slope", round(m["l_quantity"], 3)), ("intercept", round(m["intercept"], 3))], "name string, value double")


@query("SELECT count(*) AS n, 5::BIGINT AS clusters, true AS nearer FROM part")
def ml_kmeans(spark, sf_dir):
    x = ml.assembled(_t(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])
    one, three = (ml.fit("kmeans", x, k=k, seed=1) for k in (2, 5))
    return three.transform(x).agg(F.count("*").alias("n"), F.countDistinct("prediction").alias("clusters")).withColumn("nearer", F.lit(bool(three.summary.trainingCost < 0.8 * one.summary.trainingCost)))


@query("""WITH g AS (SELECT sum(p_size * p_size)::DOUBLE AS a, sum(p_size * p_retailprice) AS b, sum(p_retailprice * p_retailprice) AS d FROM part)
SELECT 0::BIGINT AS i, round(sqrt((a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b)), 3) AS s FROM g UNION ALL SELECT 1, round(sqrt((a * d - b * b) / ((a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b))), 3) FROM g""")
def ml_svd(spark, sf_dir):
    _, s, _ = ml.svd(_t(spark, sf_dir, "part").select("p_size", "p_retailprice"), ["p_size", "p_retailprice"], 2)
    return spark.createDataFrame([(i, round(float(x), 3)) for i, x in enumerate(s)], "i long, s double")


@query("SELECT p_partkey, round(2.0 * p_size + p_retailprice, 4) AS c0, round(p_size - 0.5 * p_retailprice, 4) AS c1 FROM part")
def ml_multiply(spark, sf_dir):
    import numpy as np

    out = ml.multiply(_t(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], np.array([[2.0, 1.0], [1.0, -0.5]]))
    return out.select("p_partkey", F.round("c0", 4).alias("c0"), F.round("c1", 4).alias("c1"))


@query("WITH p AS (SELECT p_size AS s, p_retailprice > 909 AS y FROM part) SELECT round(sum(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END) / count(*), 6)::DOUBLE AS auc FROM p a, p b WHERE a.y AND NOT b.y")
def ml_auc(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_size", (F.col("p_retailprice") > 909).cast("int").alias("y"))
    return spark.createDataFrame([(round(ml.areas(ml.binary_curve(p, "p_size", "y"))[0], 6),)], "auc double")


@query("WITH s AS (SELECT p_size AS threshold, sum((p_retailprice > 909)::INT) AS p, count(*) AS n FROM part GROUP BY 1), t AS (SELECT threshold, sum(p) OVER w AS tp, sum(n) OVER w AS k, (SELECT sum(p) FROM s) AS p FROM s WINDOW w AS (ORDER BY threshold DESC)) SELECT threshold, round(5.0 * tp / (k + 4 * p), 6)::DOUBLE AS f FROM t")
def ml_f_measure(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_size", (F.col("p_retailprice") > 909).cast("int").alias("y"))
    return ml.f_measures(ml.binary_curve(p, "p_size", "y"), 2.0).withColumn("f", F.round("f", 6))


@query("SELECT 'slope' AS name, round(regr_slope(l_tax, l_quantity / 50), 4) AS value FROM lineitem UNION ALL SELECT 'intercept', round(regr_intercept(l_tax, l_quantity / 50), 4) FROM lineitem")
def ml_lbfgs(spark, sf_dir):
    x = _t(spark, sf_dir, "lineitem").select("l_tax", (F.col("l_quantity") / 50).alias("q"), F.lit(1.0).alias("one"))
    w, _ = ml.lbfgs(x, ["q", "one"], "l_tax", tolerance=1e-14)
    return spark.createDataFrame([("slope", round(float(w[0]), 4)), ("intercept", round(float(w[1]), 4))], "name string, value double")


@query("SELECT true AS falls, true AS near")
def ml_gradient_descent(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_retailprice")
    mean, spread = p.agg(F.avg("p_retailprice"), F.stddev("p_retailprice")).first()
    x = p.select((F.col("p_retailprice") > mean).cast("double").alias("y"), ((F.col("p_retailprice") - mean) / spread).alias("a"), F.lit(1.0).alias("one")).persist()
    w, past = ml.gradient_descent(x, ["a", "one"], "y", "logistic", step=4.0, rounds=40)
    best, loss = ml.lbfgs(x, ["a", "one"], "y", "logistic", strength=0.001)
    right = x.select((((F.col("a") * float(w[0]) + float(w[1])) > 0) == (F.col("y") > 0.5)).cast("int").alias("r")).agg(F.avg("r")).first()[0]
    x.unpersist()
    return spark.createDataFrame([(bool(past[-1] < 0.8 * past[0] and loss[-1] < past[0]), bool(right > 0.9))], "falls boolean, near boolean")


@query("SELECT p_partkey % 2 AS label, p_size::DOUBLE AS a, (p_partkey % 3)::DOUBLE AS b, count(*) AS n FROM part GROUP BY ALL")
def ml_labelled_text(spark, sf_dir):
    path = scratch(spark)
    p = _t(spark, sf_dir, "part").select((F.col("p_partkey") % 2).alias("label"), F.col("p_size").alias("a"), (F.col("p_partkey") % 3).alias("b"))
    ml.save_labelled(p, path, "label", ["a", "b"])
    return ml.load_labelled(spark, path, ["a", "b"]).select(F.col("label").cast("long").alias("label"), "a", "b").groupBy("label", "a", "b").agg(F.count("*").alias("n"))


@query("WITH s AS (SELECT p_size AS threshold, sum((p_retailprice > 909)::INT) AS p, count(*) AS n FROM part GROUP BY 1) SELECT threshold, sum(p) OVER w::BIGINT AS tp, (sum(n) OVER w - sum(p) OVER w)::BIGINT AS fp FROM s WINDOW w AS (ORDER BY threshold DESC)")
def ml_binary_curve(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_size", (F.col("p_retailprice") > 909).cast("int").alias("y"))
    return ml.binary_curve(p, "p_size", "y").select("threshold", "tp", "fp")
