"""Triangles of a graph, block by block: no pair of edges is ever shuffled."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import dropped, written

#: Edges of a block, about; a task holds one block.
BLOCK = 4_000_000
#: Paths of two edges, and cells of a table of edges, that a task looks at at once.
AT_ONCE = 1 << 21


def _counted(a, b, n: int):
    """Triangles through each of n vertices. a, b: the ends of distinct edges, as numbers below n."""
    import numpy as np

    degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
    place = np.empty(n, np.int64)
    place[np.argsort(degree, kind="stable")] = np.arange(n)
    a, b = place[a], place[b]
    key = np.sort(np.minimum(a, b) * n + np.maximum(a, b))  # edges from fewer to more neighbours, which bounds the paths that a hub opens
    x, y = key // n, key % n
    first = np.searchsorted(x, np.arange(n + 1))
    out = np.diff(first)
    total = np.zeros(n, np.int64)
    ahead = np.concatenate([[0], np.cumsum(out[y])])
    start = 0
    while start < len(key):
        end = max(start + 1, int(np.searchsorted(ahead, ahead[start] + AT_ONCE, "right")) - 1)
        xs, ys = x[start:end], y[start:end]
        lengths = out[ys]
        edge = np.repeat(np.arange(end - start), lengths)
        z = y[np.arange(len(edge)) - np.repeat(ahead[start:end] - ahead[start], lengths) + np.repeat(first[ys], lengths)]
        low, high = int(xs[0]), int(xs[-1]) + 1
        near = slice(first[low], first[high])
        if (high - low) * n <= 16 * AT_ONCE:
            table = np.zeros((high - low) * n, bool)
            table[key[near] - low * n] = True
            hit = table[(xs[edge] - low) * n + z]
        else:
            want, known = xs[edge] * n + z, key[near]
            hit = known[np.minimum(np.searchsorted(known, want), len(known) - 1)] == want
        each = np.bincount(edge[hit], minlength=end - start)
        np.add.at(total, xs, each)
        np.add.at(total, ys, each)
        total += np.bincount(z[hit], minlength=n)
        start = end
    return total[place]


def _block(table):
    """id, n of one block: triangles whose vertices have just the block's three colours."""
    import numpy as np
    import pyarrow as pa

    m = table.num_rows
    ends = pa.chunked_array([*table["a"].chunks, *table["b"].chunks]).combine_chunks().dictionary_encode()
    code, n = ends.indices.to_numpy().astype(np.int64), len(ends.dictionary)
    a, b, same = code[:m], code[m:], table["same"].to_numpy()
    found = _counted(a, b, n)
    if not same.all() and same.any():  # two colours: less the triangles within the one that has edges of its own here
        found -= _counted(a[same], b[same], n)
    at = np.flatnonzero(found)
    return pa.table({"id": ends.dictionary.take(pa.array(at)), "n": pa.array(found[at], pa.int64())})


def triangles(edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """edges: a, b of one type. Returns id, n: each vertex on a triangle, and how many go through it. Direction, repeats and loops don't count.

    Vertices get one of c colours by hash. For every three colours, repeats allowed, a block has the edges between them, so every
    triangle is whole in just one block. A block has 6 / c^2 of the edges at most; c grows with their root, so a task's
    memory is bounded, and what is shuffled is c times the edges, not the pairs of edges that meet.
    """
    both = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    c = max(2, math.ceil(math.sqrt(6 * both.count() / block)))
    colour = lambda v: F.pmod(F.xxhash64(v), F.lit(c))
    three = F.array_sort(F.array(F.col("p"), F.col("q"), F.col("r")))
    dealt = both.select("a", "b", colour("a").alias("p"), colour("b").alias("q")).withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(c - 1).cast("long"))))
    dealt = dealt.select("a", "b", (F.col("p") == F.col("q")).alias("same"), (three[0] * c * c + three[1] * c + three[2]).alias("block"))
    kind = both.schema["a"].dataType.simpleString()
    counted = dealt.repartition(c * (c + 1) * (c + 2) // 6, "block").groupBy("block").applyInArrow(_block, f"id {kind}, n bigint")
    out = written(counted.groupBy("id").agg(F.sum("n").alias("n")))
    dropped(both)
    return out
