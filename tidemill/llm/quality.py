"""Document quality by regularised quadratic discriminant analysis over statistics of the text alone."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, slices, trimmed, tune, written
from .text import LOWER, SPACES, span_hashes, spans

FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "exclaim", "bars", "symbols", "digits", "high_bytes", "stops", "newlines", "distinct", "echo", "top_word", "ends",
)
FOLDS, SHRINK, FLOOR, CUT = 5, 0.1, 1e-4, 0.3


def _mask(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_UPPER, _DIGITS, _HIGH = _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _mask("0123456789"), np.arange(256) >= 128
_CLASSES = (_UPPER, _mask("!?"), _mask("|"), _mask("*$#%&@^~=+<>{}[]\\"), _DIGITS, _HIGH, _mask(".,;:"), _mask("\n"))


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text; shares are taken to their square roots."""
    n = np.diff(at)

    def per_text(flags: np.ndarray, of: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return sums[of[1:]] - sums[of[:-1]]

    shares = [per_text(c[data], at) / np.maximum(n, 1) for c in _CLASSES]
    starts, ends, of = spans(data, at, SPACES)
    words = np.diff(of)
    some = np.maximum(words, 1)
    h = span_hashes(LOWER[data], starts, ends)
    doc = np.repeat(np.arange(len(n)), words)
    echo = np.concatenate([[False], (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])]) if len(h) else np.zeros(0, bool)
    order = np.lexsort((h, doc))
    g, d = h[order], doc[order]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])]) if len(h) else np.zeros(0, bool)
    runs = np.flatnonzero(new)
    top = np.zeros(len(n))
    np.maximum.at(top, d[runs], np.diff(np.append(runs, len(h))))
    stop = _mask(".")[data[ends - 1]] if len(h) else np.zeros(0, bool)
    columns = [np.log1p(n), np.log1p(words), np.log1p(per_text(ends - starts, of) / some), *(np.sqrt(s) for s in shares)]
    columns += [np.sqrt(x / some) for x in (per_text(new, of), per_text(echo, of), top, per_text(stop, of))]
    return np.column_stack(columns)


@dataclass
class Model:
    means: np.ndarray
    whiten: np.ndarray  # inverse Cholesky factors, kept so that scoring is one product a class
    offsets: np.ndarray  # log prior less half the log determinant

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.means):
            return np.full(len(x), float(self.offsets[0]))
        z = [o - 0.5 * (((x - m) @ w.T) ** 2).sum(axis=1) for m, w, o in zip(self.means, self.whiten, self.offsets, strict=True)]
        return 1 / (1 + np.exp(np.clip(z[0] - z[1], -500, 500)))


def fitted(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float = SHRINK) -> Model:
    """From each class's count, sum and sum of outer products. With a class missing, every score is the smoothed share of 1."""
    counts = [moments[c][0] if c in moments else 0 for c in (0, 1)]
    if not all(counts):
        return Model(np.zeros((0, 0)), np.zeros((0, 0)), np.array([(counts[1] + 1) / (sum(counts) + 2)]))
    means = [moments[c][1] / moments[c][0] for c in (0, 1)]
    covs = [moments[c][2] / moments[c][0] - np.outer(m, m) for c, m in zip((0, 1), means, strict=True)]
    pooled = np.diag(np.maximum(sum(n * np.diag(c) for n, c in zip(counts, covs, strict=True)) / sum(counts), FLOOR))
    whiten, offsets = [], []
    for n, cov in zip(counts, covs, strict=True):
        factor = np.linalg.cholesky((1 - shrink) * cov + shrink * pooled + FLOOR * np.eye(len(cov)))
        whiten.append(np.linalg.inv(factor))
        offsets.append(np.log(n / sum(counts)) - np.log(np.diag(factor)).sum())
    return Model(np.array(means), np.array(whiten), np.array(offsets))


def fold(doc_id="doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS))


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, x: the features of every document."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, at in slices(batch.column(1)):
                x = features(data, at)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(run), "doc_id long, x array<double>")


def train(rows: DataFrame, labels: DataFrame) -> Model:
    """From _rows() and labels (doc_id, quality); held-out documents and labels other than 0 and 1 are left out."""
    marked = labels.where("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(fold() != 0)

    def run(batches):
        for batch in batches:
            x, y = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1), batch.column(1).to_numpy()
            for c in (0, 1):
                if len(own := x[y == c]):
                    flat = np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), c, np.int32)), pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["c", "i", "v"])

    sums = rows.join(marked, "doc_id").select("x", "quality").mapInArrow(trimmed(run), "c int, i int, v double").groupBy("c", "i").agg(F.sum("v").alias("v"))
    d, moments = len(FEATURES), {}
    for r in sorted(sums.collect()):  # twice 1 + d + d * d rows
        moments.setdefault(r["c"], []).append(r["v"])
    return fitted({c: (v[0], np.array(v[1 : d + 1]), np.array(v[d + 1 :]).reshape(d, d)) for c, v in moments.items()})


def quality_scores(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text); other columns never enter.

    Null texts count as empty, which have a score like any other. Repeated rows get equal rows; a row whose doc_id is
    null is scored and not learned from (held_out is null). Every label row counts, also where several are of one
    document. Without labels of both classes all scores are the smoothed share of label 1. Empty table, empty result.
    """
    spark = docs.sparkSession
    tune(spark)
    rows = written(_rows(docs))
    model = spark.sparkContext.broadcast(train(rows, labels))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.score(x))], ["doc_id", "score"])

    out = rows.mapInArrow(trimmed(run), "doc_id long, score double")
    return out.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def quality_filter(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """docs without the rows scored below cut, columns unchanged; the texts do not shuffle.

    A null or empty text is scored like any other and stays or goes by it; null ids, repeated rows and ties change nothing,
    since each row is judged by its text alone. Without labels of both classes every row has the smoothed share of label 1.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    tune(spark)
    rows = written(_rows(docs))
    model = spark.sparkContext.broadcast(train(rows, labels))
    dropped(rows)
    at_text = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for lo, hi, data, at in slices(batch.column(at_text)):
                yield batch.slice(lo, hi - lo).filter(pa.array(model.value.score(features(data, at)) >= cut))

    return docs.mapInArrow(trimmed(run), docs.schema)
