"""Documents packed into token sequences of a fixed length.

The search works on the histogram of piece lengths, which has at most as many entries as a sequence has tokens. Best-fit
bins fill it first, as patterns with multiplicities; a local search over all underfull patterns then moves documents and
exchanges one for one or two for one in all bins of a pattern at once, each time raising the sum of squared fills, until
no bin can go or none is left to gain. Pieces take their places by their rank among pieces of equal length, so no rows are gathered.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import trimmed, tune, written

LENGTH, END = 4096, 1


def pieces(docs: DataFrame, vocabulary: str, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids and an end id, cut only beyond `length`."""
    sc = docs.sparkSession.sparkContext
    definition = sc.broadcast(open(vocabulary, encoding="utf-8").read())

    def run(batches):
        from .tokens import WordEncoder

        encoder = WordEncoder(definition.value)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encoder.encode(text or "") + END.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    cut = ids[at : at + 4 * length]
                    rows.append((doc, k, at // 4, len(cut) // 4, zlib.crc32(cut)))
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    tune(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Bins as (how many, length -> pieces): each takes the longest piece left, then the longest that still fits."""
    left, sizes, out = dict(counts), sorted(counts), []
    while sizes:
        room, use, i = capacity, {}, len(sizes) - 1
        while i >= 0:
            n = min(left[sizes[i]], room // sizes[i])
            if n:
                use[sizes[i]] = n
                room -= n * sizes[i]
            i = min(i, bisect.bisect_right(sizes, room)) - 1
        times = min(left[x] // n for x, n in use.items())
        for x, n in use.items():
            left[x] -= times * n
            if not left[x]:
                sizes.remove(x)
        out.append((times, use))
    return out


class _Pool:
    """Patterns with multiplicities. Sums of single pieces and of pairs stand end to end in one array each, by place of pattern."""

    def __init__(self, capacity: int):
        self.capacity, self.at, self.uses, self.times = capacity, {}, [], []
        self.fill = np.zeros(0, np.int64)
        self.sums = [(np.zeros(0, np.int64), np.zeros((0, k), np.int64), np.zeros(0, np.int64)) for k in (1, 2)]

    def add(self, use: tuple[tuple[int, int], ...], times: int) -> bool:
        """True if the pattern is new, or if it had a single bin and can now be exchanged with itself."""
        if use in self.at:
            self.times[self.at[use]] += times
            return self.times[self.at[use]] == times + 1
        self.at[use] = len(self.uses)
        self.uses.append(use)
        self.times.append(times)
        self.fill = np.append(self.fill, sum(x * n for x, n in use))
        if self.fill[-1] == self.capacity:
            return True
        x, n = np.array(use, np.int64).reshape(-1, 2).T
        i, j = np.triu_indices(len(x))
        some = (i != j) | (n[i] > 1)
        for k, pieces in ((0, x[:, None]), (1, np.stack([x[i[some]], x[j[some]]], axis=1))):
            pieces = pieces[np.argsort(pieces.sum(axis=1), kind="stable")]
            old = self.sums[k]
            self.sums[k] = (np.append(old[0], pieces.sum(axis=1)), np.concatenate([old[1], pieces]), np.append(old[2], np.full(len(pieces), self.at[use])))
        return True

    def remove(self, use: tuple[tuple[int, int], ...], times: int) -> None:
        at = self.at[use]
        self.times[at] -= times
        if not self.times[at]:
            del self.at[use]
            self.fill[at] = self.capacity  # a full bin takes no part

    def packed(self) -> _Pool:
        out = _Pool(self.capacity)
        for use, at in self.at.items():
            out.add(use, self.times[at])
        return out

    def best(self, use: tuple[tuple[int, int], ...]) -> tuple[int, int, tuple[int, ...], tuple[int, ...]] | None:
        """The exchange that gains most between a pattern and any: places of the less and the more filled bin, what goes, what comes."""
        me, found, most = self.at[use], None, 0
        mine = [(s[lo:hi], p[lo:hi]) for s, p, o in self.sums for lo, hi in [np.searchsorted(o, [me, me + 1])]]
        full, room = self.fill[me], self.capacity - self.fill
        gives = (self.fill >= full) & (room > 0)  # to these
        gives[me] = self.times[me] > 1
        takes = (self.fill <= full) & (self.fill > 0)  # from these
        takes[me] = False
        none = (np.zeros(len(room), np.int64), np.zeros((len(room), 0), np.int64), np.arange(len(room)))
        for (given, give), (taken, take, owner) in ((mine[0], none), (mine[0], self.sums[0]), (mine[1], self.sums[0]), (mine[0], self.sums[1])):
            if len(given) and len(taken):
                i = np.searchsorted(given, taken + room[owner], "right") - 1
                gain = np.where((i >= 0) & gives[owner], given[i] - taken, 0)
                k = int(gain.argmax())
                if gain[k] > most:
                    most, found = int(gain[k]), (me, int(owner[k]), tuple(give[i[k]].tolist()), tuple(take[k].tolist()))
        if room[me] > 0:
            empty = (np.zeros(1, np.int64), np.zeros((1, 0), np.int64))
            for (given, give, owner), (taken, take) in ((self.sums[0], empty), (self.sums[0], mine[0]), (self.sums[1], mine[0]), (self.sums[0], mine[1])):
                if len(given) and len(taken):
                    i = np.searchsorted(taken, given - room[me], "left")
                    fits = (i < len(taken)) & takes[owner]
                    i = np.minimum(i, len(taken) - 1)
                    gain = np.where(fits, given - taken[i], 0)
                    k = int(gain.argmax())
                    if gain[k] > most:
                        most, found = int(gain[k]), (int(owner[k]), me, tuple(give[k].tolist()), tuple(take[i[k]].tolist()))
        return found


def exchanged(patterns: list[tuple[int, dict[int, int]]], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Moves, one-for-one and two-for-one exchanges between all underfull bins, towards the fuller one of a pair.

    Bins of one pattern are exchanged together: of two patterns, as many pairs of bins as the rarer one has; of one
    pattern with itself, half of its bins with the other half. A pattern is compared with all others when it comes up
    and again only when it changes, least filled first. It ends when no exchange gains, or when no packing has fewer bins.
    """
    key = lambda use: tuple(sorted(use.items()))
    pool = _Pool(capacity)
    for n, use in patterns:
        pool.add(key(use), n)
    size = lambda use: sum(x * n for x, n in use)
    bins = sum(pool.times)
    goal = -(-sum(size(u) * pool.times[at] for u, at in pool.at.items()) // capacity)
    open_ = [(size(u), u) for u in pool.at if size(u) < capacity]
    heapq.heapify(open_)
    while open_ and bins > goal:
        use = open_[0][1]
        found = pool.best(use) if use in pool.at else None
        if found is None:
            heapq.heappop(open_)
            continue
        i, j, give, take = found
        a, b = pool.uses[i], pool.uses[j]
        n = pool.times[i] // 2 if i == j else min(pool.times[i], pool.times[j])
        less, more = Counter(dict(a)), Counter(dict(b))
        less.subtract(give), less.update(take), more.subtract(take), more.update(give)
        pool.remove(a, n), pool.remove(b, n)
        for new in (key(+less), key(+more)):
            if not new:
                bins -= n
            elif pool.add(new, n) and size(new) < capacity:
                heapq.heappush(open_, (size(new), new))
        if len(pool.uses) > 2 * len(pool.at) + 64:
            pool = pool.packed()
    return [(pool.times[at], dict(use)) for use, at in pool.at.items()]


def local_search(bins: list[Counter], capacity: int) -> list[Counter]:
    """exchanged() over single bins."""
    return [Counter(use) for times, use in exchanged([(1, dict(b)) for b in bins], capacity) for _ in range(times)]


def plan(counts: dict[int, int], capacity: int = LENGTH) -> list[tuple[int, dict[int, int]]]:
    """Patterns of bins for pieces by length: best fit, then exchanges between all underfull bins if a packing could have fewer."""
    return exchanged(best_fit(counts, capacity), capacity)


def packed(docs: DataFrame, vocabulary: str, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece of every document.

    A null or empty text is one end id. Rows that repeat a doc_id are packed each for itself. Of pieces of equal
    length it doesn't matter which goes where; ties of repeated rows take their places in any order. Columns besides
    doc_id and text are ignored; an empty table gives an empty result.
    """
    table = written(pieces(docs, vocabulary, length))
    counts = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    blocks = max(1, int(4 * total**0.5))
    block = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks))
    cells = table.select("length", block.alias("block")).groupBy("length", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    cells = written(cells.select("length", "block", F.coalesce(before, F.lit(0)).alias("before")))
    place = F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "piece"))
    ranked = table.withColumn("block", block).withColumn("place", place).join(cells, ["length", "block"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place") - 1).alias("rank"))

    used: Counter = Counter()
    rows, base = [], 0
    for times, use in plan(counts, length):
        offset = 0
        for x in sorted(use, reverse=True):
            rows.append((x, used[x], use[x], base, offset))
            used[x] += times * use[x]
            offset += x * use[x]
        base += times
    rows.sort()
    where = docs.sparkSession.sparkContext.broadcast(np.array(rows, np.int64).reshape(-1, 5))

    def run(batches):
        size, first, uses, base, offset = where.value.T
        key = size * (1 << 40) + first
        for batch in batches:
            n, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            i = np.searchsorted(key, n * (1 << 40) + rank, "right") - 1
            nth = rank - first[i]
            cols = [*batch.columns[:5], pa.array(base[i] + nth // uses[i]), pa.array(offset[i] + nth % uses[i] * n)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(trimmed(run), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
