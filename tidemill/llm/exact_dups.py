"""Exact duplicates of texts up to white space. DataFrame functions only.

Misra-Gries (Spark's freqItems aggregate, one mergeable summary of 1/support counters) names every digest that could
hold a thousandth of the rows. Those few are counted exactly, and their winners are broadcast so that their rows never
shuffle; every other digest, with fewer rows than that, takes the ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, without, written

SUPPORT = 0.001
WHITE = " \t\n\x0b\x0c\r"


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the text without ASCII white space; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return F.sha2(text, 256)


def exact_duplicates(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs (doc_id, text; others are ignored).

    Of equal texts the row with the most code points stays, then the one with the smallest doc_id; a null doc_id
    comes after all others. Null texts equal empty ones. Rows that repeat both doc_id and text all count in
    group_size and are all marked kept if their doc_id is. An empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    rows = written(docs.select(F.col("doc_id").alias("doc_id"), F.length(text).alias("n"), digest(F.col("text")).alias("text_sha256")))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id"))
    sums = [best.alias("best"), F.count("*").alias("group_size")]
    found = rows.stat.freqItems(["text_sha256"], support).first()
    frequent = list(found[0] or []) if found else []
    many = rows.where(F.col("text_sha256").isin(frequent)).groupBy("text_sha256").agg(*sums).select("text_sha256", F.col("best.doc_id").alias("keep_id"), "group_size")
    hot = rows.select("doc_id", "text_sha256").join(F.broadcast(many), "text_sha256", "left")
    rest = rows.where(~F.col("text_sha256").isin(frequent))
    few = rest.groupBy("text_sha256").agg(*sums).select("text_sha256", F.col("best.doc_id").alias("keep_id"), "group_size")
    out = hot.where("group_size is not null").unionByName(rest.select("doc_id", "text_sha256").join(few, "text_sha256"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts, columns unchanged: the row that exact_duplicates keeps.

    Null texts equal empty ones and those of white space alone; a null doc_id comes after all others. Of rows that repeat
    doc_id and text one stays, of rows of one doc_id whose texts differ in white space the first by length, then by text.
    An empty table gives an empty result; columns may have any names.
    """
    marked = written(exact_duplicates(docs))
    gone = written(marked.where("not kept").select("doc_id", "text_sha256").distinct())
    repeated = written(marked.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1").drop("count"))
    dropped(marked)
    sha = digest(docs["text"])

    def matched(other: DataFrame) -> Column:
        return docs["doc_id"].eqNullSafe(other["doc_id"]) & (sha == other["text_sha256"])

    key = F.col("doc_id")
    if repeated.isEmpty():
        return without(docs, gone, docs["doc_id"], key, matched(gone))
    both = written(gone.unionByName(repeated))
    once = without(docs, both, docs["doc_id"], key, matched(both))
    # a winner's own rows, few and alike: the best of each by one sort-free aggregate
    again = docs.join(repeated, matched(repeated), "left_semi").select(docs["doc_id"].alias("doc_id"), sha.alias("sha"), F.struct((-F.length(F.coalesce(docs["text"], F.lit("")))).alias("n"), docs["text"].alias("t"), F.struct(*docs.columns).alias("row")).alias("x"))
    return once.unionByName(again.groupBy("doc_id", "sha").agg(F.min("x").alias("x")).select("x.row.*"))
