"""Near-duplicate groups of documents: band keys find the candidates, whole shingle sets confirm them.

The steps, all of them Spark jobs whose state is in written tables:

1. Each text gets its set of word shingles (64-bit hashes), a 128-bit digest of the set, its bottom-k sketch (the k
   smallest values of one hash function) and its band keys, each made of the minima of WIDE hash functions. Texts with
   equal sets are one *node* from here on.
2. Lists of the nodes that have a band key in common. A pair at the threshold shares each of the BANDS keys with a
   probability of 0.8 ** WIDE, none at odds of some 6 in 10^7. Texts that share a few common shingles alone hardly share
   a key, so that lists grow with groups of similar texts and not with how often a shingle occurs in the table.
3. Edges from the lists, cut where sizes leave a gap that no link spans. Lists of SHORT nodes or less give pairs; those
   with less than SURE keys in common go on to the union sketch (the k smallest values of both), which drops estimates
   more than five deviations below the threshold. A longer list is joined to its smallest set as a star, never expanded
   to pairs. So no link leaves its *tentative group*, a component of these edges. Tentative groups may hold unlinked
   texts; the next step decides.
4. Exact similarity. The texts of a tentative group of MOST bytes or less meet in one task, which compares real words:
   words are numbered through a dictionary, shingles by tuples of numbers, with prefix, length and positional filters.
   Larger groups fall apart by inverted lists of whole sets, where nothing is estimated: each node enters the lists of
   only its rarest shingles in the group (prefix filter), with ELL more than one shared shingle would need, and pairs
   that share less than ELL of them are dropped. What is still large is
   dealt out in blocks, each with the same few texts of the group as pivots, which merge a group of copies across its
   blocks. The texts outside of the group's largest component are then a query set: in blocks, they are compared with all
   blocks of the group. No task holds more than about MOST bytes, and no pair of one component is compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..storage import settings
from .common import binaries, dropped, slices, trimmed, tune, without, written
from .text import GOLD, U, mix, shingle_sets

K = 64  # values in a sketch
BANDS, WIDE = 36, 5  # band keys of a text, and minima in each
SURE = 6  # band keys in common from which a pair's sketches are not looked at
NEAR = 0.55  # estimates from here on are looked into; five deviations below 0.8
ELL = 8  # shingles that a linked pair shares in its lists, by lists longer by as many less one
SHORT = 32  # nodes of a list that is expanded to pairs
HELD = 200_000  # rows of lists in a task's memory
MOST = 4 << 20  # bytes of texts, or of their shingle sets, that meet in one task
ROWS = 200_000  # of a table of numbers that is broadcast, some 10 MB
#: Spark's own runtime filter, 8 MB at most, keeps texts outside of tentative groups out of the shuffle. At more documents
#: than it can tell apart it lets more texts pass, and the results stay the same.
BLOOM = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1m",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1t",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumItems": "40000000",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumBits": str(8 * (8 << 20)),
}


def _beside(table: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, for a join with texts or sketches: broadcast up to ROWS rows, else joined by a shuffle."""
    return F.broadcast(table) if table.count() <= ROWS else table


def _digest(values: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(values.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def row_key() -> Column:
    """A row's key for finding its text again: doc_id, or a hash of the text where that is null."""
    return F.coalesce(F.col("doc_id"), F.xxhash64("text"))


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """BANDS keys of 32 bits for each set, none of which is empty. A set's values are hashes, so that products with odd numbers order them anew."""
    odd = mix(np.arange(1, BANDS * WIDE + 1).astype(U) * GOLD) | U(1)
    out = np.zeros((len(sets), BANDS), np.uint32)
    sizes = np.cumsum([0, *(len(s) for s in sets)])
    lo = 0
    while lo < len(sets):
        hi = max(lo + 1, int(np.searchsorted(sizes, sizes[lo] + (1 << 15), "right")) - 1)
        flat, at = np.concatenate(sets[lo:hi]), sizes[lo:hi] - sizes[lo]
        product, least = np.empty_like(flat), np.empty((len(odd), hi - lo), U)
        for i, x in enumerate(odd):
            np.minimum.reduceat(np.multiply(flat, x, out=product), at, out=least[i])
        least, key = least.reshape(BANDS, WIDE, hi - lo), np.zeros((BANDS, hi - lo), U)
        for j in range(WIDE):
            key = mix(key * GOLD + least[:, j])
        out[lo:hi] = (key >> U(32)).T
        lo = hi
    return out


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, key, text_hash, size (bytes), n_shingles, hi, lo (digest), sketch (sorted values, 8 bytes each), bands (4 bytes each); the last four null for texts without words."""
    names = ["doc_id", "key", "text_hash", "size", "n_shingles", "hi", "lo", "sketch", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in slices(batch.column(4)):
                sets = shingle_sets(data, at, width)
                digests = [_digest(s) if len(s) else (None, None) for s in sets]
                cols = [batch.column(c).slice(lo, hi - lo) for c in range(4)]
                cols += [pa.array([len(s) for s in sets], pa.int64()), *(pa.array([d[i] for d in digests], pa.int64()) for i in (0, 1))]
                bands = iter(band_keys([s for s in sets if len(s)]))
                cols += [binaries([s[:K].tobytes() if len(s) else None for s in sets]), binaries([next(bands).tobytes() if len(s) else None for s in sets])]
                yield pa.RecordBatch.from_arrays(cols, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.select("doc_id", row_key().alias("key"), F.xxhash64("text").alias("text_hash"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"), "text")
    return rows.mapInArrow(trimmed(run), "doc_id long, key long, text_hash long, size long, n_shingles long, hi long, lo long, sketch binary, bands binary")


def _listed(nodes: DataFrame, percent: int) -> DataFrame:
    """v, node, n: an entry for each band key of a node. Sets of less than 4 shingles (at 80 percent) are linked to none but equal ones."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([np.frombuffer(x, np.uint32) for x in batch.column(2).to_pylist()]).astype(np.int64)
            of = pa.array(np.repeat(np.arange(len(keys)), BANDS))
            yield pa.RecordBatch.from_arrays([pa.array((keys + (np.arange(BANDS) << 32)).ravel()), batch.column(0).take(of), batch.column(1).take(of)], ["v", "node", "n"])

    able = nodes.where(F.col("n") * (100 - percent) >= percent)
    return able.select("node", "n", "bands").mapInArrow(trimmed(run), "v long, node long, n long")


def _met(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """a, b, star from rows (v, node, n) in order of v and n: pairs of short lists, stars of long ones, in bounded memory."""

    def edges(v, node, n):
        cut = np.ones(len(v), bool)
        cut[1:] = (v[1:] != v[:-1]) | (100 * n[:-1] < percent * n[1:])
        first = np.flatnonzero(cut)
        size = np.diff(np.append(first, len(v)))
        size, first = np.repeat(size, size), np.repeat(first, size)
        at = np.flatnonzero(size > SHORT)
        found = [(node[at], node[first[at]], np.ones(len(at), bool))]
        at = np.flatnonzero((size > 1) & (size <= SHORT))
        for d in range(1, SHORT):
            at = at[at + d < first[at] + size[at]]
            p = at[100 * n[at] >= percent * n[at + d]]
            found.append((node[p], node[p + d], np.zeros(len(p), bool)))
        a, b, star = (np.concatenate(x) for x in zip(*found, strict=True))
        a, b, star = (x[a != b] for x in (a, b, star))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(star)], ["a", "b", "star"])

    def run(batches):
        parts, rows = [], 0
        for batch in batches:
            parts.append([batch.column(c).to_numpy() for c in range(3)])
            rows += batch.num_rows
            if rows < HELD:
                continue
            v, node, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            end = int(np.searchsorted(v, v[-1]))  # the last list may go on
            if end:
                yield edges(v[:end], node[:end], n[:end])
            v, node, n = v[end:], node[end:], n[end:].copy()
            if len(v) > HELD // 2:  # a list that fills the memory: its last run of sizes goes on with its centre
                yield edges(v, node, n)
                gaps = np.flatnonzero(100 * n[:-1] < percent * n[1:]) + 1
                last = int(gaps[-1]) if len(gaps) else 0
                if len(v) - last > SHORT:
                    keep = np.append(last, np.arange(len(v) - SHORT, len(v)))
                    n[last] = n[keep[1]]
                else:
                    keep = np.arange(last, len(v))
                v, node, n = v[keep], node[keep], n[keep]
            parts, rows = [[v, node, n]], len(v)
        if rows:
            yield edges(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    return run


def _similar(nodes: DataFrame, percent: int) -> DataFrame:
    """node, label: components of the pairs that share band keys, and of the stars over long lists."""
    lists = _listed(nodes, percent).repartition("v").sortWithinPartitions("v", "n")
    met = lists.mapInArrow(trimmed(_met(percent)), "a long, b long, star boolean")
    found = written(met.groupBy("a", "b").agg((F.max("star") | (F.count("*") >= SURE)).alias("sure")))
    confirmed = _estimated(nodes)(written(found.where("not sure").select("a", "b")))
    out = components(confirmed.union(found.where("sure").select("a", "b")))
    dropped(found)
    return out


def _entries(sets: DataFrame, percent: int) -> DataFrame:
    """v, df, node, n, ell, pos: entries of the inverted lists, from label, node, n and shingles; lists are apart by label.

    Shingles of one node alone link nothing and rank before all others, so that only their number counts.
    """

    def run(batches):
        for batch in batches:
            sets = [np.frombuffer(x, U) for x in batch.column(2).to_pylist()]
            held = np.array([len(x) for x in sets])
            if not held.sum():
                continue
            of = np.repeat(np.arange(len(sets)), held)
            v, of = mix(np.concatenate(sets) + np.repeat(batch.column(3).to_numpy().view(U) * GOLD, held)), pa.array(of)
            yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), batch.column(0).take(of), batch.column(1).take(of)], ["v", "node", "n"])

    values = sets.select("node", "n", "shingles", "label").mapInArrow(trimmed(run), "v long, node long, n long")
    often = written(values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"))
    # dealt out by node as plain rows, which are smaller than lists of one row each
    ranked = values.join(often.hint("merge"), "v").repartition("node").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"))
    shared = f"cast(ceil({percent} * n / 100) as long)"  # by any linked pair
    ranked = ranked.withColumn("alone", F.col("n") - F.size("vs")).withColumn("shared", F.expr(shared)).withColumn("ell", F.expr(f"least({ELL}, shared)"))
    ranked = ranked.withColumn("take", F.expr("cast(greatest(0, n - shared + ell - alone) as int)"))
    entries = ranked.select("node", "n", "ell", "alone", F.posexplode(F.expr("slice(vs, 1, take)")).alias("i", "x"))
    out = written(entries.select("x.v", "x.df", "node", "n", "ell", (F.col("alone") + F.col("i")).alias("pos")))
    dropped(often)
    return out


def _tentative(entries: DataFrame, percent: int) -> DataFrame:
    """node, label: components of the pairs with ell entries in common, and of the stars over long lists."""
    near = f"100 * least(p.n, q.n) >= {percent} * greatest(p.n, q.n)"
    pair = "struct(least(p.node, q.node) as a, greatest(p.node, q.node) as b, least(p.ell, q.ell) as ell)"
    pairs = f"flatten(transform(xs, (p, i) -> transform(filter(slice(xs, i + 2, {SHORT}), q -> {near}), q -> {pair})))"
    lists = entries.where(F.col("df") <= SHORT).groupBy("v").agg(F.collect_list(F.struct("node", "n", "ell")).alias("xs")).where("size(xs) > 1")
    found = lists.select(F.explode(F.expr(pairs)).alias("p")).select("p.*").groupBy("a", "b").agg(F.count("*").alias("c"), F.min("ell").alias("ell")).where("c >= ell").select("a", "b")
    long = entries.where(F.col("df") > SHORT)
    centres = written(long.groupBy("v").agg(F.min("node").alias("b"), F.max("node").alias("last")).where("b <> last").select("v", "b"))
    stars = long.join(centres, "v").where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    return components(found.union(stars))


def _estimated(sketched: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Keeps the pairs whose union sketch estimates NEAR or more."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [np.frombuffer(x + y, U) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            size = np.array([len(x) for x in rows])
            both = np.full((len(rows), 2 * K), ~U(0))
            for i, x in enumerate(rows):
                both[i, : len(x)] = x
            both.sort(axis=1)
            real = np.arange(2 * K) < size[:, None]
            twin = np.zeros(both.shape, bool)
            twin[:, 1:] = (both[:, 1:] == both[:, :-1]) & real[:, 1:]
            rank = np.cumsum(real & ~twin, axis=1)  # place in the union
            k = np.minimum(K, rank[:, -1])
            hits = (twin & (rank <= K)).sum(axis=1)
            yield batch.select([0, 1]).filter(pa.array(hits >= NEAR * k))

    def confirm(pairs: DataFrame) -> DataFrame:
        ids = written(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        found = sketched.join(_beside(ids), "node")
        x, y = (found.select(F.col("node").alias(c), F.col("sketch").alias(f"s{c}")) for c in "ab")
        return pairs.join(x, "a").join(y, "b").select("a", "b", "sa", "sb").mapInArrow(trimmed(run), "a long, b long")

    return confirm


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, label, hi, lo, small, text of the rows in wanted; other texts under the same key come along."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select(row_key().alias("key"), "text")
    # true of every group: Spark makes its Bloom filter only from a side that has a comparison
    return texts.join(_beside(wanted).where("total > 0"), "key").select("node", "label", "hi", "lo", "small", "text")


def exact_links(texts: list[bytes], width: int, percent: int, known: list | None = None) -> np.ndarray:
    """For each text the index of the first text of its component; real words and shingles are compared, no hashes.

    known: components found before, by any name (None: none); texts of one of them are not compared with each other.
    """
    number: dict[bytes, int] = {}
    codes, sizes, short = [], [], {}
    for i, t in enumerate(texts):
        words = [number.setdefault(w, len(number)) for w in t.lower().split()]
        sizes.append(len(words))
        if 0 < len(words) < width:
            short.setdefault(tuple(words), []).append(i)
        codes.append(np.array(words, np.int64))
    label, named = np.arange(len(texts)), {}
    for i, k in enumerate(known or ()):
        if k is not None:
            label[i] = named.setdefault(k, i)
    for same in short.values():  # one shingle each, equal or disjoint
        to = min(label[same])
        for x in {int(x) for x in label[same]}:
            label[label == x] = to
    sizes, flat = np.array(sizes), np.concatenate(codes) if codes else np.zeros(0, np.int64)
    run, most = flat, max(1, len(number))
    for j in range(1, width):
        _, run = np.unique(run[:-1] * most + flat[j:], return_inverse=True)
    if len(flat) < width:
        return label
    at = np.concatenate([[0], np.cumsum(sizes)])
    spots = [np.arange(at[i], at[i + 1] - width + 1) for i in range(len(texts))]
    owner = np.repeat(np.arange(len(texts)), [len(s) for s in spots])
    key = np.unique(owner * (int(run.max()) + 1) + run[np.concatenate(spots)]) if len(owner) else np.zeros(0, np.int64)
    owner, shingle = np.divmod(key, int(run.max()) + 1)
    return _linked(owner, shingle, len(texts), label, percent)


def _linked(owner: np.ndarray, shingle: np.ndarray, texts: int, label: np.ndarray, percent: int) -> np.ndarray:
    """Components among sets (owner, shingle; sorted by owner) by a prefix-filtered join in order of size.

    Only texts of other components are compared, newest component first, so that in a group of copies each text needs
    few comparisons. The rank of a shingle is by frequency, rarest first.
    """
    n = np.bincount(owner, minlength=texts)
    often = np.bincount(shingle)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    ranked = rank[shingle]
    order = np.lexsort((ranked, owner))
    ranked = ranked[order]
    at = np.concatenate([[0], np.cumsum(n)])
    alone = often[np.argsort(often, kind="stable")] < 2  # by rank
    parent = label.tolist()

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    lists: dict[int, list[int]] = {}
    places: dict[int, list[int]] = {}
    for i in np.lexsort((np.arange(texts), n)).tolist():
        size = int(n[i])
        if not size:
            continue
        own = ranked[at[i] : at[i + 1]]
        probe = size - -(-percent * size // 100) + 1
        seen: set[int] = set()
        for pos, r in enumerate(own[:probe].tolist()):
            if alone[r] or r not in lists:
                continue
            for j, there in zip(lists[r], places[r]):
                if j in seen or 100 * n[j] < percent * size:
                    continue
                need = -(-percent * (size + int(n[j])) // (100 + percent))
                if min(size - pos, int(n[j]) - there) < need:
                    continue
                seen.add(j)
        while seen:
            mine, open_ = top(i), {}
            for j in seen:
                if (t := top(j)) != mine:
                    open_.setdefault(t, []).append(j)
            if not open_:
                break
            seen = set()
            for js in open_.values():
                j = js.pop()
                other = ranked[at[j] : at[j + 1]]
                shared = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * shared >= percent * (size + len(other) - shared):
                    a, b = sorted((top(i), top(j)))
                    parent[b] = a
                else:
                    seen.update(js)
        index = size - -(-2 * percent * size // (100 + percent)) + 1  # later sets are as large or larger
        for pos, r in enumerate(own[:index].tolist()):
            if not alone[r]:
                lists.setdefault(r, []).append(i)
                places.setdefault(r, []).append(pos)
    return np.array([top(i) for i in range(texts)])


def _within(width: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """node, label from rows (node, label, hi, lo, known, text) in order of label, one group in memory at a time."""

    def settled(group: list[tuple]) -> pa.RecordBatch:
        texts, known = {}, {}
        for node, _, hi, lo, component, text in group:
            if node not in texts:
                data = np.frombuffer(text, np.uint8)
                if _digest(shingle_sets(data, np.array([0, len(data)]), width)[0]) == (hi, lo):
                    texts[node], known[node] = text, component
        nodes = np.array(list(texts), np.int64)
        first = exact_links(list(texts.values()), width, percent, list(known.values()))
        least = np.full(len(nodes), np.iinfo(np.int64).max)
        np.minimum.at(least, first, nodes)
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least[first])], ["node", "label"])

    def run(batches):
        group: list[tuple] = []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(5)] + [batch.column(5).cast(pa.binary()).to_pylist()]
            for row in zip(*columns, strict=True):
                if group and group[0][1] != row[1]:
                    yield settled(group)
                    group = []
                group.append(row)
        if group:
            yield settled(group)

    return run


def _together(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """node, label: each label's texts meet in one task. texts: node, label, hi, lo, text and, if any, known."""
    known = F.col("known") if "known" in texts.columns else F.lit(None).cast("long").alias("known")
    rows = texts.select("node", "label", "hi", "lo", known, "text").repartition("label").sortWithinPartitions("label")
    return written(rows.mapInArrow(trimmed(_within(width, percent)), "node long, label long"))


def _in_blocks(texts: DataFrame, groups: DataFrame, width: int, percent: int, most: int) -> DataFrame:
    """node, label of groups (node, label, bytes) that are too large for a task; texts: node, hi, lo, text."""
    part = max(1, most // 2)
    total = groups.groupBy("label").agg(F.sum("bytes").alias("total"))
    rows = written(groups.join(total, "label").withColumn("blocks", F.ceil(F.col("total") / part).cast("int")))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    # a quarter of `most` as pivots, chosen by hash
    pivot = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1 << 30)) < F.lit(float(1 << 30)) * (most // 4) / F.col("total")
    cells = rows.select("node", F.explode(F.when(pivot, every).otherwise(F.array(block))).alias("block"), "label")
    cells = written(cells.select("node", F.xxhash64("label", "block").alias("label")))
    found = _together(texts.join(_beside(cells), "node"), width, percent)
    merged = components(found.toDF("a", "b"))
    dropped(found)
    rows = rows.join(merged.withColumnRenamed("label", "known"), "node", "left").withColumn("known", F.coalesce("known", "node"))
    sizes = rows.groupBy("label", "known").agg(F.sum("bytes").alias("size"))
    largest = sizes.groupBy("label").agg(F.max(F.struct("size", F.col("known").alias("largest"))).alias("m")).select("label", "m.largest")
    rows = written(rows.join(largest, "label").withColumn("asks", F.col("known") != F.col("largest")))
    asked = written(rows.where("asks").groupBy("label").agg(F.ceil(F.sum("bytes") / part).cast("int").alias("parts")))
    rows = rows.join(asked, "label")
    place = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    ask = rows.where("asks").select("node", "label", "known", place.alias("part"), F.explode(every).alias("block"))
    answer = rows.select("node", "label", "known", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), block.alias("block"))
    both = written(ask.union(answer).select("node", F.xxhash64("label", "part", "block").alias("label"), "known").distinct())
    more = _together(texts.join(_beside(both), "node"), width, percent)
    out = components(more.union(merged).toDF("a", "b"))
    dropped(more, asked)
    return out


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """node, label, n, size, shingles: whole sets as hashes, once for each node, and the bytes of its text."""

    def run(batches):
        for batch in batches:
            node, label, hi, lo = (batch.column(c).to_pylist() for c in range(4))
            for first, end, data, at in slices(batch.column(4)):
                rows = [(node[first + i], label[first + i], len(s), int(at[i + 1] - at[i]), s.tobytes()) for i, s in enumerate(shingle_sets(data, at, width)) if _digest(s) == (hi[first + i], lo[first + i])]
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["node", "label", "n", "size", "shingles"])

    return texts.mapInArrow(trimmed(run), "node long, label long, n long, size long, shingles binary").dropDuplicates(["node"])


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, most: int = MOST) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text; other columns are ignored).

    Two texts are linked if 100 * shared shingles >= percent * shingles of either; percent must be 80 or more, for
    which the sketch's margins are set. component_id is the smallest doc_id reachable over links, kept whether it is
    the row's own. Null and empty texts, and texts of white space only, have no shingles and stand alone. Repeated
    rows share a component, and each is kept if its doc_id is. A row whose doc_id is null is linked like any other; if
    no row of its component has an id, component_id is null and all its rows are marked kept. An empty table gives an
    empty result. most: bytes of texts that one task may hold to compare them.
    """
    return _components(docs, width, percent, most).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def _components(docs: DataFrame, width: int, percent: int, most: int) -> DataFrame:
    """doc_id, text_hash, size, n_shingles, component_id, component (null for texts without words) for every row of docs."""
    if percent < 80:
        raise ValueError("percent must be at least 80")
    spark = docs.sparkSession
    tune(spark)
    rows = written(sketches(docs, width))
    nodes = rows.where("hi is not null").groupBy("hi", "lo").agg(
        F.min("doc_id").alias("doc_id"), F.min("key").alias("key"), F.max("size").alias("size"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"), F.count("*").alias("copies")
    )
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()))  # numbers stand once written
    whole, rows = rows, written(rows.drop("key", "sketch", "bands"))
    dropped(whole)
    tentative = _similar(nodes, percent)
    member = nodes.select("node", "key", "hi", "lo", F.greatest("size", F.col("n") * 8).alias("bytes")).join(tentative, "node")
    member = written(member)
    sizes = written(member.groupBy("label").agg(F.sum("bytes").alias("bytes")))
    wanted = written(member.join(sizes.withColumnRenamed("bytes", "total"), "label").select("key", "node", "label", "hi", "lo", "total", (F.col("total") <= most).alias("small")))
    labels = _settled(docs, wanted, width, percent, most)
    dropped(member, sizes, wanted, tentative)
    named = written(nodes.select("node", "hi", "lo", "doc_id", "copies").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    least = written(named.groupBy("label").agg(F.min("doc_id").alias("component_id")))
    named = written(named.join(least, "label").select("hi", "lo", "label", "component_id", "copies"))
    # nodes with a thousandth of the rows or more, a thousand at most, are joined by broadcast
    (texts,) = nodes.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()
    often = F.col("copies") >= max(1000, texts // 1000)
    many = named.where(often).select("hi", "lo", F.col("label").alias("l"), F.col("component_id").alias("c"))
    few = named.where(~often).select("hi", "lo", "label", "component_id")
    columns = ["doc_id", "text_hash", "size", "n_shingles"]
    hot = rows.join(F.broadcast(many), ["hi", "lo"], "left")
    rest = hot.where("l is null").select(*columns, "hi", "lo").join(few, ["hi", "lo"], "left")
    rest = rest.select(*columns, F.when(F.col("hi").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.col("label").alias("component"))
    return rest.union(hot.where("l is not null").select(*columns, "c", "l"))


def _settled(docs: DataFrame, wanted: DataFrame, width: int, percent: int, most: int) -> DataFrame:
    """node, label: the components of linked texts in tentative groups."""
    large = not wanted.where("not small").isEmpty()
    with settings(docs.sparkSession, BLOOM):
        if not large:
            return _together(_texts(docs, wanted), width, percent)
        texts = written(_texts(docs, wanted))
    labels = _together(texts.where("small"), width, percent)
    rest = texts.where("not small").select("node", "label", "hi", "lo", "text")
    sets = written(_sets(rest, width))
    entries = _entries(sets, percent)
    found = _tentative(entries, percent)
    member = sets.select("node", F.greatest("size", F.col("n") * 8).alias("bytes")).join(found, "node")
    sizes = member.groupBy("label").agg(F.sum("bytes").alias("total"))
    again = written(member.join(sizes, "label").withColumn("small", F.col("total") <= most).drop("total"))
    dropped(entries, found)
    rest = rest.drop("label")
    few = written(again.where("small").select("node", "label"))
    labels = labels.union(_together(rest.join(_beside(few), "node"), width, percent))
    huge = written(again.where("not small").select("node", "label", "bytes"))
    if not huge.isEmpty():
        labels = labels.union(_in_blocks(rest, huge, width, percent, most))
    return labels


def near_dedup(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near duplicates, columns unchanged: the one with the smallest doc_id.

    Null ids come after all others; of rows of one group that share the smallest id the one with the smaller hash of its
    text stays, of rows that repeat id and text one. Rows without words (null, empty or white space) all stay. A row is
    told apart by id and text: another text under the id of a row that goes is no part of its group and stays. An empty
    table gives an empty result.
    """
    found = written(_components(docs, width, percent, MOST).where("component is not null").select("doc_id", "text_hash", "size", "component"))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "size")
    best = found.groupBy("component").agg(F.min(key).alias("best"), F.max(key).alias("last"), F.count("*").alias("c")).where("c > 1")
    several = written(found.join(best, "component").withColumn("stays", key.eqNullSafe(F.col("best"))))
    gone = written(several.where("not stays").select("doc_id", "text_hash", "size").distinct())
    repeated = written(several.where("stays").groupBy("doc_id", "text_hash", "size").count().where("count > 1").drop("count"))
    dropped(found, several)
    id_, text = docs["doc_id"].cast("long"), docs["text"]

    def matched(other: DataFrame) -> Column:
        return id_.eqNullSafe(other["doc_id"]) & (F.xxhash64(text) == other["text_hash"]) & (F.octet_length(text) == other["size"])

    if repeated.isEmpty():
        return without(docs, gone, id_, F.col("doc_id"), matched(gone))
    both = written(gone.unionByName(repeated))
    once = without(docs, both, id_, F.col("doc_id"), matched(both))
    return once.unionByName(docs.join(repeated, matched(repeated), "left_semi").dropDuplicates(["doc_id", "text"]))
