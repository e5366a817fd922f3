"""Language-model scores of documents: a word model, and a subword lattice over an existing vocabulary.

The lattice model takes the pieces of an existing vocabulary. Their weights are fitted by expectation maximisation: forward
and backward sums give how often each piece is expected over *all* segmentations of every training word. A word's
lattice probability is the sum over all its segmentations, by forward recursion in log space; a word that stands in
training texts is also one unit of its own, by its count. A document's probability is the product over words and end.

Distinct words are counted and their lattices summed once, in Spark. Words with at least 1/400,000 of all tokens
(400,000 at most, whatever the input) are scored map-side from a broadcast; the others are joined by their hash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, trimmed, tune, written
from .text import GOLD, LOWER, SPACES, U, mix, span_hashes, spans

FOLDS, HELD_OUT, WORDS = 7, 2, 400_000
EM, SHARE = 2, 0.5  # rounds of expectation maximisation; weight of the word's own count
SPACE = "▁"  # stands before a word in the vocabulary


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte spans as an Arrow string array."""
    size = ends - starts
    at = np.concatenate([[0], np.cumsum(size)])
    flat = data[np.repeat(starts - at[:-1], size) + np.arange(at[-1])]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(flat.tobytes()))


def _words(docs: DataFrame) -> DataFrame:
    """h, word, c, t: every distinct word, how often it stands in training texts and in all."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]] = []

        def merged():
            h, c, t = (np.concatenate([x[i] for x in held]) for i in range(3))
            v, first, of = np.unique(h, return_index=True, return_inverse=True)
            words = pa.concat_arrays([x[3] for x in held]).take(pa.array(first))
            return v, np.bincount(of, c, len(v)).astype(np.int64), np.bincount(of, t, len(v)).astype(np.int64), words

        def out():
            h, c, t, words = merged()
            for lo in range(0, len(h), 50_000):
                cut = slice(lo, lo + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(h[cut].view(np.int64)), words.slice(lo, 50_000).cast(pa.string()), pa.array(c[cut]), pa.array(t[cut])], ["h", "word", "c", "t"])
            held.clear()

        for batch in batches:
            train = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi, data, at in slices(batch.column(1)):
                low = LOWER[data]
                starts, ends, of = spans(low, at, SPACES)
                v, first, inverse = np.unique(span_hashes(low, starts, ends), return_index=True, return_inverse=True)
                counted = np.repeat(train[lo:hi], np.diff(of))
                held.append((v, np.bincount(inverse, counted, len(v)), np.bincount(inverse, minlength=len(v)), _strings(low, starts[first], ends[first])))
            if sum(len(x[0]) for x in held) > 1_000_000:
                held[:] = [merged()]
                if len(held[0][0]) > 500_000:
                    yield from out()
        if held:
            yield from out()

    return docs.select("train", "text").mapInArrow(trimmed(run), "h long, word string, c long, t long").groupBy("h", "word").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))


class Lattice:
    """log10 weights of pieces (of bytes for what no piece spells) and sums over all segmentations of a word.

    `many` works on arrays: words of one length together, pieces found by a hash of each stretch. `log10` takes one word of
    any length, character by character.
    """

    def __init__(self, weights: dict[str, float], byte_weights: list[float]):
        self.names = list(weights)
        self.weights = {p: w * math.log(10) for p, w in weights.items()}
        self.bytes = np.array(byte_weights) * math.log(10)
        self.longest = max(map(len, weights), default=1)
        by_size: dict[int, list[int]] = {}
        for i, p in enumerate(self.names):
            by_size.setdefault(len(p), []).append(i)
        self.tables = {}
        for size, own in by_size.items():
            points = np.array([[ord(c) for c in self.names[i]] for i in own], np.uint32).reshape(len(own), size)
            h = points[:, 0].astype(U)
            for k in range(1, size):
                h = mix(h + GOLD) + points[:, k]
            order = np.argsort(h)
            self.tables[size] = (h[order], np.array(own)[order], np.array([self.weights[self.names[i]] for i in np.array(own)[order]]))

    def log10(self, word: str) -> float:
        s = SPACE + word
        n, get = len(s), self.weights.get
        forward = [-math.inf] * (n + 1)
        forward[0] = 0.0
        for i in range(n):
            here = forward[i]
            if here == -math.inf:
                continue
            for j in range(i + 1, min(n, i + self.longest) + 1):
                w = get(s[i:j])
                if w is None:
                    if j > i + 1:
                        continue
                    w = float(sum(self.bytes[b] for b in s[i].encode()))  # a character without a piece
                w += here
                old = forward[j]
                if old == -math.inf:
                    forward[j] = w
                else:
                    high, low = (w, old) if w > old else (old, w)
                    forward[j] = high + math.log1p(math.exp(low - high))
        return forward[n] / math.log(10)

    def _arcs(self, points: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each piece length, at each place: the piece (or -1) and its weight. points: words of one length, by row."""
        out, h = [], None
        for size in range(1, min(self.longest, points.shape[1]) + 1):
            h = points.astype(U) if size == 1 else mix(h[:, :-1] + GOLD) + points[:, size - 1 :]
            piece, weight = np.full(h.shape, -1), np.full(h.shape, -np.inf)
            if size in self.tables:
                known, own, weights = self.tables[size]
                i = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = known[i] == h
                piece[hit], weight[hit] = own[i[hit]], weights[i[hit]]
            if size == 1 and (lone := piece < 0).any():
                odd, of = np.unique(points[lone], return_inverse=True)
                weight[lone] = np.array([sum(self.bytes[b] for b in chr(c).encode("utf-8", "replace")) for c in odd.tolist()])[of]
            out.append((piece, weight))
        return out

    def _groups(self, words: list[str], longest: int = 256, rows: int = 4096):
        """Indexes and code points of words of one length; longer words come with none."""
        size = np.array([len(w) + 1 for w in words])
        for n in np.unique(size).tolist():
            own = np.flatnonzero(size == n)
            for lo in range(0, len(own), rows):
                some = own[lo : lo + rows]
                yield some, None if n > longest else np.frombuffer("".join(SPACE + words[i] for i in some.tolist()).encode("utf-32-le"), np.uint32).reshape(len(some), n)

    @staticmethod
    def _forward(arcs: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
        alpha = np.full((len(arcs[0][0]), n + 1), -np.inf)
        alpha[:, 0] = 0
        for j in range(1, n + 1):
            for k in range(min(j, len(arcs))):
                np.logaddexp(alpha[:, j], alpha[:, j - k - 1] + arcs[k][1][:, j - k - 1], out=alpha[:, j])
        return alpha

    def many(self, words: list[str]) -> np.ndarray:
        """log10 of the sum over all segmentations, for each word."""
        out = np.empty(len(words))
        for own, points in self._groups(words):
            if points is None:
                out[own] = [self.log10(words[i]) for i in own.tolist()]
            else:
                out[own] = self._forward(self._arcs(points), points.shape[1])[:, -1] / math.log(10)
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """How often each piece, then each byte, stands in all segmentations of the words, by their probabilities (forward and backward sums)."""
        total = np.zeros(len(self.names) + 256)
        for own, points in self._groups(words):
            parts = [(points, counts[own])] if points is not None else [(np.array([[ord(c) for c in SPACE + words[i]]], np.uint32), counts[[i]]) for i in own.tolist()]
            for x, c in parts:
                n, arcs = x.shape[1], self._arcs(x)
                alpha = self._forward(arcs, n)
                beta = np.full(alpha.shape, -np.inf)
                beta[:, n] = 0
                for i in range(n - 1, -1, -1):
                    for k in range(min(n - i, len(arcs))):
                        np.logaddexp(beta[:, i], beta[:, i + k + 1] + arcs[k][1][:, i], out=beta[:, i])
                for k, (piece, weight) in enumerate(arcs):
                    share = np.exp(alpha[:, : n - k] + weight + beta[:, k + 1 :] - alpha[:, [n]]) * c[:, None]
                    hit = piece >= 0
                    total[: len(self.names)] += np.bincount(piece[hit], share[hit], len(self.names))
                    if k == 0 and not hit.all():
                        odd, of = np.unique(x[~hit], return_inverse=True)
                        for point, amount in zip(odd.tolist(), np.bincount(of, share[~hit]).tolist()):
                            for b in chr(point).encode("utf-8", "replace"):
                                total[len(self.names) + b] += amount
        return total


def _gathered(batches, rows: int = 20_000):
    """Batches of about `rows` words: arrays work best on many words of one length."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _piece_counts(words: DataFrame, model) -> dict[int, float]:
    """How often the existing model uses each of its pieces in the training words."""

    def run(batches):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model.value)
        counts = np.zeros(sp.vocab_size(), np.int64)
        for batch in batches:
            ids = sp.encode(batch.column(0).to_pylist(), num_threads=1)
            weight = np.repeat(batch.column(1).to_numpy(), [len(x) for x in ids])
            counts += np.bincount(np.array([i for x in ids for i in x], np.int64), weight, len(counts)).astype(np.int64)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used].astype(float))], ["i", "c"])

    rows = words.where("c > 0").select("word", "c").mapInArrow(trimmed(run), "i long, c double").groupBy("i").agg(F.sum("c").alias("c"))
    return {r["i"]: r["c"] for r in rows.collect()}  # as many rows as the vocabulary at most


def _expected(words: DataFrame, lattice) -> np.ndarray:
    """The expectation step over all training words."""

    def run(batches):
        total = 0
        for batch in _gathered(batches):
            total = total + lattice.value.expected(batch.column(0).to_pylist(), batch.column(1).to_numpy())
        if not np.isscalar(total):
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["i", "c"])

    rows = words.where("c > 0").select("word", "c").mapInArrow(trimmed(run), "i long, c double").groupBy("i").agg(F.sum("c").alias("c")).collect()
    out = np.zeros(len(lattice.value.names) + 256)
    for r in rows:  # pieces and bytes at most
        out[r["i"]] = r["c"]
    return out


def trained_lattice(words: DataFrame, model_bytes: bytes, model, rounds: int = EM) -> Lattice:
    """The vocabulary's pieces, weighted by expectation maximisation over all training words.

    It starts from the shares of the pieces in the segmentations that the existing model chooses; each round replaces them
    by the smoothed shares expected over all segmentations.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model_bytes)
    counts = _piece_counts(words, model)
    usable = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
    octet = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(sp.vocab_size()) if sp.is_byte(i)}
    names = [sp.id_to_piece(i) for i in usable]
    shares = np.array([counts.get(i, 0.0) for i in usable] + [counts.get(octet.get(b), 0.0) for b in range(256)])
    sc = words.sparkSession.sparkContext
    for r in range(rounds + 1):
        weight = np.log10((shares + 1) / (shares.sum() + len(shares)))
        lattice = Lattice(dict(zip(names, weight[: len(names)].tolist(), strict=True)), weight[len(names) :].tolist())
        if r < rounds:
            shares = _expected(words, sc.broadcast(lattice))
    return lattice


def mixed(lattice: np.ndarray, c: np.ndarray, total: int, share: float) -> np.ndarray:
    """log10 of a word's probability: `share` of it by the word's own training count, the rest by its lattice."""
    rest = lattice + math.log10(1 - share)
    known = (c > 0) & (total > 0)
    own = np.log10(np.where(known, c, 1) / max(total, 1) * share)
    high = np.maximum(rest, own)
    return np.where(known, high + np.log10(10 ** (rest - high) + 10 ** (own - high)), rest)


def lm_scores(docs: DataFrame, vocabulary: str, most: int = WORDS, share: float = SHARE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs (doc_id, text).

    vocabulary is a sentencepiece model file. Documents whose crc32(doc_id as text) mod 7 is 2 are held out of all
    counts. base_score adds log10((c + 1) / (N + V + 1)) over the words and the end; score is the model's log10 probability
    of the text: every word's probability (mixed: its lattice sum, and with weight `share` the whole word as one unit of
    the corpus) and the chance that the text goes on, then the chance of its end. Null counts as empty, which is an end alone. A null doc_id is not held out. Repeated rows each count and each
    get a row. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    tune(spark)
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), (~held_out).alias("train"), "text")
    words = written(_words(docs))
    in_training = F.sum(F.when(F.col("c") > 0, 1).otherwise(0))
    count, everything, different = (x or 0 for x in words.agg(F.sum("c"), F.sum("t"), in_training).first())
    (ends,) = docs.agg(F.count(F.when(F.col("train"), 1))).first()
    n, v = count + ends, different + (ends > 0)
    denominator = math.log10(n + v + 1)
    goes_on, stops = math.log10((count + 1) / (n + 2)), math.log10((ends + 1) / (n + 2))

    with open(vocabulary, "rb") as f:
        model_bytes = f.read()
    lattice = spark.sparkContext.broadcast(trained_lattice(words, model_bytes, spark.sparkContext.broadcast(model_bytes)))

    def weigh(batches):
        for batch in _gathered(batches):
            lp = mixed(lattice.value.many(batch.column(1).to_pylist()), batch.column(2).to_numpy(), count, share)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(lp, pa.float64())], ["h", "c", "t", "lp"])

    weighed = written(words.select("h", "word", "c", "t").mapInArrow(trimmed(weigh), "h long, c long, t long, lp double"))
    frequent = F.col("t") >= max(2, -(-everything // most))
    common = weighed.where(frequent).toArrow()
    order = np.argsort(common.column("h").to_numpy().view(np.uint64))
    known = spark.sparkContext.broadcast((common.column("h").to_numpy().view(np.uint64)[order], common.column("c").to_numpy()[order], common.column("lp").to_numpy()[order]))

    def score(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        h, c, lp = known.value
        for batch in batches:
            for lo, hi, data, at in slices(batch.column(2)):
                low = LOWER[data]
                starts, ends_, of = spans(low, at, SPACES)
                x = span_hashes(low, starts, ends_)
                i = np.searchsorted(h, x)
                i[i == len(h)] = 0
                hit = h[i] == x if len(h) else np.zeros(len(x), bool)
                sums = []
                for value in (c[i] > 0, np.log10(c[i] + 1.0), lp[i]) if len(h) else (np.zeros(len(x)),) * 3:
                    total = np.concatenate([[0], np.cumsum(np.where(hit, value, 0))])
                    sums.append(total[of[1:]] - total[of[:-1]])
                missed = np.concatenate([[0], np.cumsum(~hit)])[of]
                rare = pa.ListArray.from_arrays(pa.array(missed.astype(np.int32)), pa.array(x[~hit].view(np.int64)))
                cols = [pa.array(np.arange(row, row + hi - lo)), batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(np.diff(of)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]), rare]
                row += hi - lo
                yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "held_out", "n", "k", "b", "s", "rare"])

    rows = written(docs.select("doc_id", "held_out", "text").mapInArrow(trimmed(score), "row long, doc_id long, held_out boolean, n long, k long, b double, s double, rare array<long>"))
    tokens = rows.select("row", F.explode("rare").alias("h"))
    rest = tokens.join(weighed.where(~frequent).select("h", "c", "lp"), "h").groupBy("row")
    rest = rest.agg(F.sum((F.col("c") > 0).cast("long")).alias("k2"), F.sum(F.log10(F.col("c") + 1.0)).alias("b2"), F.sum("lp").alias("s2"))
    both = rows.drop("rare").join(rest, "row", "left").na.fill(0, ["k2", "b2", "s2"])
    tokens_in = F.col("n") + 1
    return both.select(
        "doc_id", "held_out", tokens_in.alias("n_tokens"), (F.col("k") + F.col("k2") + int(ends > 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("b") + F.col("b2") + math.log10(ends + 1) - tokens_in * denominator).alias("base_score"), (F.col("s") + F.col("s2") + F.col("n") * goes_on + stops).alias("score"),
    )
