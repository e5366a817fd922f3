"""Property graphs as two DataFrames: vertices (id, ...) and edges (src, dst, ...)."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import NO_BROADCAST, dropped, partitions, settings, written
from .components import components
from .triangles import triangles


@dataclass
class Graph:
    vertices: DataFrame
    edges: DataFrame
    derived: bool = False  # vertices are the edges' ends

    @staticmethod
    def from_edges(edges: DataFrame) -> Graph:
        ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
        return Graph(ids, edges, True)

    def kept(self) -> Graph:
        """The same graph from written tables: what edges and vertices are made of is computed once."""
        edges = written(self.edges)
        vertices = Graph.from_edges(edges).vertices if self.derived else self.vertices
        return Graph(written(vertices), edges)

    @staticmethod
    def from_file(spark, path: str) -> Graph:
        parts = F.split(F.trim("value"), r"\s+")
        lines = spark.read.text(path).where("value not like '#%' and trim(value) <> ''")
        return Graph.from_edges(lines.select(parts[0].cast("long").alias("src"), parts[1].cast("long").alias("dst")))

    def degrees(self) -> DataFrame:
        """id, in_degree, out_degree, degree; one aggregation."""
        ends = self.edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(self.edges.select("dst", F.lit(0), F.lit(1)))
        return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.count("*").alias("degree"))

    def triplets(self) -> DataFrame:
        s = self.vertices.select(F.col("id").alias("src"), F.struct(*self.vertices.columns).alias("src_attr"))
        d = self.vertices.select(F.col("id").alias("dst"), F.struct(*self.vertices.columns).alias("dst_attr"))
        return self.edges.join(s, "src").join(d, "dst")

    def reverse(self) -> Graph:
        other = [c for c in self.edges.columns if c not in ("src", "dst")]
        return Graph(self.vertices, self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *other))

    def subgraph(self, vertex: Column | str | None = None, edge: Column | str | None = None) -> Graph:
        v = self.vertices if vertex is None else self.vertices.where(vertex)
        e = self.edges if edge is None else self.edges.where(edge)
        ids = v.select("id")
        return Graph(v, e.join(ids.toDF("src"), "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi"))

    def mask(self, other: Graph) -> Graph:
        return Graph(self.vertices.join(other.vertices, "id", "left_semi"), self.edges.join(other.edges, ["src", "dst"], "left_semi"))

    def group_edges(self, *aggregates: Column) -> Graph:
        return Graph(self.vertices, self.edges.groupBy("src", "dst").agg(*aggregates))

    def join_vertices(self, table: DataFrame, how: str = "left") -> Graph:
        return Graph(self.vertices.join(table, "id", how), self.edges)

    def aggregate_messages(self, to_dst: Column | None, to_src: Column | None, aggregate: Callable[[Column], Column], active: DataFrame | None = None, direction: str = "either") -> DataFrame:
        """id, message: messages over src_attr, dst_attr and the edge, combined map-side at each receiver.

        active: ids of the vertices whose edges count, by their src (out), their dst (in), either or both ends. With messages
        both ways the triplets are joined once and give both from one row.
        """
        g = self
        if active is not None:
            ids = active.select("id").distinct().withColumn("__on", F.lit(True))
            e = self.edges.join(ids.toDF("src", "__s"), "src", "left").join(ids.toDF("dst", "__d"), "dst", "left")
            s, d = F.col("__s").isNotNull(), F.col("__d").isNotNull()
            g = Graph(self.vertices, e.where({"out": s, "in": d, "either": s | d, "both": s & d}[direction]).drop("__s", "__d"))
        sides = [F.struct(F.col(who).alias("id"), message.alias("m")) for who, message in (("dst", to_dst), ("src", to_src)) if message is not None]
        sent = g.triplets().select(F.inline(F.array(*sides)))
        return sent.where("m is not null").groupBy("id").agg(aggregate(F.col("m")).alias("message"))

    def map_vertices(self, **columns: Column) -> Graph:
        return Graph(self.vertices.withColumns(columns), self.edges)

    def map_edges(self, **columns: Column) -> Graph:
        return Graph(self.vertices, self.edges.withColumns(columns))

    def map_triplets(self, **columns: Column) -> Graph:
        """Edge columns from the edge and both ends (src_attr, dst_attr)."""
        return Graph(self.vertices, self.triplets().withColumns(columns).drop("src_attr", "dst_attr"))

    def filtered(self, prepare: Callable[[Graph], Graph], vertex: Column | str | None = None, edge: Column | str | None = None) -> Graph:
        """The vertices and edges that a condition on a prepared graph (one with degrees, say) leaves, with this graph's own columns."""
        return self.mask(prepare(self).subgraph(vertex, edge))

    def edges_of(self, direction: str = "either") -> DataFrame:
        """id, edges: each vertex's edges out, in, or either way."""
        e = F.struct(*self.edges.columns)
        sides = [self.edges.select(F.col(c).alias("id"), e.alias("e")) for c, use in (("src", direction != "in"), ("dst", direction != "out")) if use]
        rows = sides[0] if len(sides) == 1 else sides[0].union(sides[1])
        return rows.groupBy("id").agg(F.collect_list("e").alias("edges"))

    def random_vertex(self, seed: int = 42):
        row = self.vertices.select("id").orderBy(F.xxhash64("id", F.lit(seed))).first()
        return None if row is None else row[0]

    def neighbours(self, rows: int = 1_000_000) -> DataFrame:
        """id, neighbours (sorted, distinct, either direction). A task gathers about `rows` of them, however many edges there are."""
        with settings(self.edges.sparkSession, partitions(self.edges)):
            edges = written(self.edges.select("src", "dst"))
        parts = -(-2 * edges.count() // rows) or 1
        both = edges.union(edges.select("dst", "src")).repartition(parts, "src").distinct()
        return both.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("neighbours"))

    def pregel(self, start: Column, send: Callable[[Column, Column], Column], combine: Callable[[Column], Column], apply: Callable[[Column, Column], Column], most: int | None = None) -> DataFrame:
        """id, value: each round, messages to dst from value pairs; vertices apply them; ends when no value changes, or after `most` rounds."""
        values = written(self.vertices.select("id", start.alias("value")))
        edges = written(self.edges.select("src", "dst"))
        for _ in itertools.count() if most is None else range(most):
            t = edges.join(values.toDF("src", "sv"), "src").join(values.toDF("dst", "dv"), "dst")
            sent = t.select("dst", send(F.col("sv"), F.col("dv")).alias("m")).where("m is not null").groupBy(F.col("dst").alias("id")).agg(combine(F.col("m")).alias("m"))
            moved = written(values.join(sent, "id", "left").select("id", F.when(F.col("m").isNull(), F.col("value")).otherwise(apply(F.col("value"), F.col("m"))).alias("value"), F.col("value").alias("old")))
            changed = moved.where(~F.col("value").eqNullSafe(F.col("old"))).isEmpty()
            values = moved.select("id", "value")
            if changed:
                break
        return values

    def connected_components(self) -> DataFrame:
        """id, value: the smallest id reachable, edges taken both ways; repeated contraction, so long paths take few rounds."""
        found = components(self.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
        return self.vertices.select("id").join(found.toDF("id", "label").hint("merge"), "id", "left").select("id", F.coalesce("label", "id").alias("value"))

    def _first_above(self) -> DataFrame:
        """id, value: of all vertices that reach a vertex, itself too, the first by (hash, id).

        Besides its neighbours' values each vertex takes its value's own, which reaches it as well: values travel further
        every round, and hashes keep long paths in key order from being the worst case.
        """
        values = written(self.vertices.select("id", F.struct(F.xxhash64("id").alias("h"), F.col("id").alias("v")).alias("value")))
        edges = written(self.edges.select("src", "dst"))
        while True:
            near = edges.join(values.toDF("src", "m"), "src").select(F.col("dst").alias("id"), "m")
            far = values.select("id", F.col("value.v").alias("at")).where("id <> at").join(values.toDF("at", "m"), "at").select("id", "m")
            least = near.union(far).groupBy("id").agg(F.min("m").alias("m"))
            moved = written(values.join(least, "id", "left").select("id", F.least("value", F.coalesce("m", "value")).alias("value"), F.col("value").alias("old")))
            values = moved.select("id", "value")
            if moved.where("value <> old").isEmpty():
                return values.select("id", F.col("value.v").alias("value"))

    def _chains(self) -> tuple[DataFrame, DataFrame, DataFrame, Graph]:
        """Paths through vertices with one edge in and one out, put together; edges are distinct, none is a loop.

        Gives id, low: the vertices of cycles that nothing else touches, and their smallest; id, last: the vertices of paths,
        and the last of theirs; last, u, w: the ends of the paths; and the graph of all other vertices, with an edge for
        each path. Pointers are doubled, so a path of n vertices takes log2(n) rounds; those that have not arrived all
        differ, so no key is joined by more than two rows. A round in which none arrives leaves only cycles, and one in which no
        cycle's minimum falls either has seen them whole.
        """
        ends = self.edges.select(F.col("src").alias("id"), F.col("dst").alias("to"), F.lit(1).alias("o"), F.lit(0).alias("i"))
        ends = ends.union(self.edges.select("dst", F.lit(None).cast(self.edges.schema["dst"].dataType), F.lit(0), F.lit(1)))
        inner = written(ends.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"), F.max("to").alias("to")).where("o = 1 and i = 1").select("id", "to"))
        following = inner.join(inner.select(F.col("id").alias("to"), F.lit(True).alias("on")), "to", "left")
        at = F.when(F.col("on"), F.col("to")).otherwise(F.col("id"))
        at_last = written(following.select("id", at.alias("at"), F.col("on").isNull().alias("ended"), F.least("id", at).alias("low")))
        while True:
            above = at_last.select(F.col("id").alias("at"), F.col("at").alias("at2"), F.col("ended").alias("ended2"), F.col("low").alias("low2"))
            on = at_last.where("not ended").select("id", "at", "low").join(above, "at")
            on = on.select("id", F.col("at2").alias("at"), F.col("ended2").alias("ended"), F.least("low", "low2").alias("low"), F.expr("ended2 or low2 < low").alias("moved"))
            jumped = written(on.union(at_last.where("ended").select("id", "at", "ended", "low", F.lit(False))))
            dropped(at_last)
            at_last = jumped
            if at_last.where("moved").isEmpty():
                break
        paths = at_last.where("ended").select("id", F.col("at").alias("last"))
        into = self.edges.join(inner.select(F.col("id").alias("src")), "src", "left_anti")
        first = into.join(paths.toDF("dst", "last"), "dst").select("last", F.col("src").alias("u"))
        links = written(first.join(inner.toDF("last", "w"), "last"))
        plain = into.join(inner.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst")
        edges = written(plain.union(links.where("u <> w").select("u", "w")).distinct())
        rest = Graph(written(self.vertices.join(inner.select("id"), "id", "left_anti").select("id")), edges)
        return at_last.where("not ended").select("id", "low"), paths, links, rest

    def _coloured(self) -> DataFrame:
        """id, root: strong components that forward colours, then backward reach within a colour find; at least one if there is a vertex."""
        colour = self._first_above()
        same = self.edges.join(colour.toDF("src", "c"), "src").join(colour.toDF("dst", "c2"), "dst").where("c = c2").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        back = Graph(self.vertices, same)._first_above()  # a colour's own vertex is its first, so it is found wherever it can be reached
        return written(back.toDF("id", "root").join(colour.toDF("id", "colour"), "id").where("root = colour").select("id", "root"))

    def strongly_connected(self) -> DataFrame:
        """id, component (smallest id).

        Each round puts paths together, takes away vertices without an edge in or out (each a component of its own) and, unless
        that left less than half, one coloured step's components. Then paths are opened again, the last first: their
        vertices belong to their ends' component if both ends share one, else each is its own.
        """
        with settings(self.vertices.sparkSession, NO_BROADCAST):
            left = Graph(written(self.vertices.select("id")), written(self.edges.select("src", "dst").where("src <> dst").distinct()))
            done, levels, before = left.vertices.limit(0).select("id", F.col("id").alias("root")), [], left.vertices.count()
            while before:
                cycles, paths, links, left = left._chains()
                levels.append((paths, links))
                both = left.edges.select(F.col("src").alias("id")).intersect(left.edges.select("dst"))
                kept = written(left.vertices.join(both, "id", "left_semi"))
                done = done.union(cycles).union(left.vertices.join(kept, "id", "left_anti").select("id", F.col("id").alias("root")))
                left, now = left._within(kept), kept.count()
                if now * 2 > before:
                    hit = left._coloured()
                    done = done.union(hit)
                    left = left._within(written(left.vertices.join(hit.select("id"), "id", "left_anti")))
                    now = left.vertices.count()
                before = now
            for paths, links in reversed(levels):
                if paths.isEmpty():
                    continue
                done = written(done)
                shared = links.join(done.toDF("u", "root"), "u").join(done.toDF("w", "other"), "w").where("root = other").select("last", "root")
                done = done.union(paths.join(shared, "last", "left").select("id", F.coalesce("root", "id")))
            done = written(done)
            return written(done.join(done.groupBy("root").agg(F.min("id").alias("component")), "root").select("id", "component"))

    def _within(self, vertices: DataFrame) -> Graph:
        """These vertices and the edges between them, written."""
        ids = vertices.select("id")
        return Graph(vertices, written(self.edges.join(ids.toDF("src"), "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi").select("src", "dst")))

    def pagerank(self, rounds: int | None = None, reset: float = 0.15, tolerance: float | None = None) -> DataFrame:
        """id, rank: unnormalised ranks that start at 1; a given number of rounds, or until no rank moves by more than `tolerance`."""
        if (rounds is None) == (tolerance is None):
            raise ValueError("either rounds or a tolerance")
        g = Graph(self.vertices, self.edges.select("src", "dst"), self.derived).kept()
        edges, ids = g.edges, g.vertices.select("id")
        out = edges.groupBy("src").agg(F.count("*").alias("n"))
        weighted = written(edges.join(out, "src").select("src", "dst", (1 / F.col("n")).alias("w")))
        ranks = ids.select("id", F.lit(1.0).alias("rank"))
        for _ in itertools.count() if rounds is None else range(rounds):
            sums = weighted.join(ranks.toDF("src", "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("w") * F.col("rank")).alias("s"))
            new = (reset + (1 - reset) * F.coalesce("s", F.lit(0.0))).alias("rank")
            if tolerance is None:
                moved = written(ids.join(sums, "id", "left").select("id", new))
            else:
                moved = written(ranks.withColumnRenamed("rank", "old").join(sums, "id", "left").select("id", new, "old"))
                if moved.where(F.abs(F.col("rank") - F.col("old")) > tolerance).isEmpty():
                    return moved.select("id", "rank")
            dropped(ranks)
            path, ranks = moved, moved.select("id", "rank")
            ranks._tidemill_path = path._tidemill_path  # type: ignore[attr-defined]
        return ranks

    def supersteps(self, start: Column, send: Callable[[Column, Column], Column], combine: Callable[[Column], Column], compute: Callable[[Column, Column, Column], Column], total: Callable[[Column], Column], most: int) -> DataFrame:
        """id, value: like pregel, with one aggregate over all values before each step: compute(value, message or null, aggregate)."""
        values = written(self.vertices.select("id", start.alias("value")))
        edges = written(self.edges.select("src", "dst"))
        for _ in range(most):
            (everything,) = values.agg(total(F.col("value"))).first()
            t = edges.join(values.toDF("src", "sv"), "src").join(values.toDF("dst", "dv"), "dst")
            sent = t.select("dst", send(F.col("sv"), F.col("dv")).alias("m")).where("m is not null").groupBy(F.col("dst").alias("id")).agg(combine(F.col("m")).alias("m"))
            moved = written(values.join(sent, "id", "left").select("id", compute(F.col("value"), F.col("m"), F.lit(everything)).alias("value"), F.col("value").alias("old")))
            values = moved.select("id", "value")
            if moved.where(~F.col("value").eqNullSafe(F.col("old"))).isEmpty():
                break
        return values

    def svd_plus_plus(self, rating: str, rank: int = 8, rounds: int = 5, low: float = 0.0, high: float = 5.0, rates: tuple[float, float, float, float] = (0.007, 0.007, 0.005, 0.015), seed: int = 1) -> tuple[DataFrame, float]:
        """Latent factors of users (src) and items (dst) by batch gradient steps, and the mean rating.

        id, kind (user or item), p (the factors), y (an item's implicit factors, of a user their scaled sum), bias, norm. A
        rating is predicted as the mean, both biases and the item's p times the user's p and y.
        """
        g1, g2, g6, g7 = rates
        edges = written(self.edges.select("src", "dst", F.col(rating).cast("double").alias("r")))
        (mean,) = edges.agg(F.avg("r")).first()
        noise = lambda c, k: F.transform(F.sequence(F.lit(0), F.lit(rank - 1)), lambda i: (F.pmod(F.xxhash64(c, i, F.lit(seed + k)), F.lit(1 << 20)) / float(1 << 20) - 0.5) * 0.2)
        per = lambda c: edges.groupBy(F.col(c).alias("id")).agg(F.count("*").alias("n"), F.sum("r").alias("s"))
        bias, norm = (F.col("s") / F.col("n") - F.lit(mean)).alias("bias"), (1 / F.sqrt(F.col("n"))).alias("norm")
        users = written(per("src").select("id", "n", noise(F.col("id"), 0).alias("p"), bias, norm))
        items = written(per("dst").select("id", "n", noise(F.col("id"), 1).alias("p"), noise(F.col("id"), 2).alias("y"), bias))
        add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
        times = lambda k, a: F.transform(a, lambda x: k * x)
        summed = lambda c, name: F.array(*[F.sum(F.col(c)[i]) for i in range(rank)]).alias(name)
        stepped = lambda own, up: F.zip_with(own, up, lambda w, x: w + g2 * (x - g7 * F.col("n") * w))
        moved_bias = (F.col("bias") + g1 * (F.col("e") - g6 * F.col("n") * F.col("bias"))).alias("bias")

        def implicit() -> DataFrame:
            y = edges.join(items.select(F.col("id").alias("dst"), "y"), "dst").groupBy(F.col("src").alias("id")).agg(summed("y", "y"))
            return users.join(y, "id").select("id", "p", times(F.col("norm"), F.col("y")).alias("y"), "bias", "norm")

        for _ in range(rounds):
            # An end's own values leave its sums over edges: edges carry its partner's values alone, and both ends' sums are one aggregation.
            w = add(F.col("p"), F.col("y"))
            u = implicit().select(F.col("id").alias("src"), *[w[k].alias(f"w{k}") for k in range(rank)], F.col("bias").alias("bu"), "norm")
            t = edges.join(u, "src").join(items.select(F.col("id").alias("dst"), *[F.col("p")[k].alias(f"q{k}") for k in range(rank)], F.col("bias").alias("bi")), "dst")
            dot = reduce(lambda a, b: a + b, [F.col(f"q{k}") * F.col(f"w{k}") for k in range(rank)])
            t = t.withColumn("e", F.col("r") - F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), F.lit(mean) + F.col("bu") + F.col("bi") + dot)))
            e, end = F.col("e"), lambda user, c, v, n: F.struct(F.lit(user).alias("user"), F.col(c).alias("id"), *[(F.col("e") * F.col(f"{v}{k}")).alias(f"v{k}") for k in range(rank)], F.col("e").alias("e"), n.alias("en"))
            both = t.select(F.inline(F.array(end(True, "src", "q", F.lit(0.0)), end(False, "dst", "w", e * F.col("norm")))))
            sums = written(both.groupBy("user", "id").agg(F.array(*[F.sum(f"v{k}") for k in range(rank)]).alias("v"), F.sum("e").alias("e"), F.sum("en").alias("en")))
            du, di = sums.where("user").drop("user", "en"), sums.where("not user").drop("user")
            before = users, items
            users = written(users.join(du, "id").select("id", "n", stepped(F.col("p"), F.col("v")).alias("p"), moved_bias, "norm"))
            items = written(items.join(di, "id").select("id", "n", stepped(F.col("p"), F.col("v")).alias("p"), stepped(F.col("y"), times(F.col("en"), F.col("p"))).alias("y"), moved_bias))
            dropped(sums, *before)
        out = implicit().select("id", F.lit("user").alias("kind"), "p", "y", "bias", "norm")
        return out.union(items.select("id", F.lit("item"), "p", "y", "bias", F.lit(None).cast("double"))), mean

    def triangles(self) -> DataFrame:
        """id, triangles through it."""
        per = triangles(self.edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))).toDF("id", "t")
        return self.vertices.select("id").join(per, "id", "left").select("id", F.coalesce("t", F.lit(0)).alias("triangles"))


def edge_partition(src: Column, dst: Column, parts: int, strategy: str = "2d") -> Column:
    """The partition of an edge under a vertex cut: 1d, 2d, random or canonical."""
    h = lambda *c: F.pmod(F.xxhash64(*c), F.lit(parts))
    if strategy == "1d":
        return h(src)
    if strategy == "random":
        return h(src, dst)
    if strategy == "canonical":
        return h(F.least(src, dst), F.greatest(src, dst))
    side = int(parts**0.5 + 0.999999)
    return F.pmod(F.pmod(F.xxhash64(src), F.lit(side)) * side + F.pmod(F.xxhash64(dst), F.lit(side)), F.lit(parts))


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new whose vertex also stands in old, with another value. Both have id and the same columns."""
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in new.columns if c != "id"]
    differs = ~reduce(lambda a, b: a & b, same, F.lit(True))
    return new.alias("n").join(old.alias("o"), F.col("n.id") == F.col("o.id")).where(differs).select("n.*")


def with_vertices(vertices: DataFrame, other: DataFrame, how: str = "left", **columns: Column) -> DataFrame:
    """Vertices joined to another table by id (left or inner); columns, if given, are what is kept beside id."""
    out = vertices.join(other, "id", how)
    return out.select("id", *[c.alias(n) for n, c in columns.items()]) if columns else out


def by_vertex(vertices: DataFrame, messages: DataFrame, aggregate: Column) -> DataFrame:
    """id, value: messages (id, ...) of known vertices, aggregated by receiver."""
    return messages.join(vertices.select("id"), "id", "left_semi").groupBy("id").agg(aggregate.alias("value"))


def join_edges(left: DataFrame, right: DataFrame, **columns: Column) -> DataFrame:
    """Edges that stand in both tables, by (src, dst)."""
    out = left.join(right, ["src", "dst"])
    return out.select("src", "dst", *[c.alias(n) for n, c in columns.items()]) if columns else out


def rmat(spark, scale: int, edges: int, shares: tuple[float, float, float] = (0.45, 0.15, 0.15), seed: int = 42) -> Graph:
    """A recursive-matrix graph of 2 ** scale vertices and at most `edges` different edges, without loops."""
    a, b, c = shares
    src = dst = F.lit(0).cast("long")
    for k in range(scale):
        r = F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 30)) / float(1 << 30)
        src = src * 2 + F.when(r < a + b, 0).otherwise(1)
        dst = dst * 2 + F.when((r < a) | ((r >= a + b) & (r < a + b + c)), 0).otherwise(1)
    e = spark.range(edges).select(src.alias("src"), dst.alias("dst")).where("src <> dst").distinct()
    return Graph(spark.range(1 << scale), e)


def log_normal(spark, vertices: int, mu: float = 4.0, sigma: float = 1.3, seed: int = 42) -> Graph:
    """Out-degrees by a log-normal distribution (less than the number of vertices), targets at random."""
    degree = F.least(F.lit(vertices - 1), F.exp(mu + sigma * F.randn(seed)).cast("int"))
    e = spark.range(vertices).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.greatest(degree, F.lit(0)))).alias("k")).where("k > 0")
    return Graph(spark.range(vertices), e.select("src", F.pmod(F.xxhash64("src", "k", F.lit(seed)), F.lit(vertices)).alias("dst")))


def grid(spark, rows: int, columns: int) -> Graph:
    n = spark.range(rows * columns)
    right = n.where(F.col("id") % columns < columns - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    down = n.where(F.col("id") < (rows - 1) * columns).select("id", F.col("id") + columns)
    return Graph(n, right.union(down))


def star(spark, n: int) -> Graph:
    return Graph(spark.range(n), spark.range(1, n).select(F.col("id").alias("src"), F.lit(0).cast("long").alias("dst")))
