"""Byte-level BPE: a table of distinct words is encoded once, and the ids go back to each word's position.

Spark splits all texts, counts the distinct words and encodes each word of the table once, in parallel. Words that
hold at least 1/200,000 of all occurrences (200,000 words at most, whatever the input) are joined back by broadcast.
A rarer word is encoded where it stands: sending each of its positions to the table and back would shuffle the whole
corpus twice. Decoding looks every id up in the id-to-piece table of the vocabulary.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binaries, trimmed, tune, written
from .tokens import CHAR_TO_BYTE, GPT_PATTERN

WORDS = 200_000


def word_table(docs: DataFrame, definition, most: int = WORDS) -> DataFrame:
    """word, ids (4 bytes each): the words with at least 1/most of all occurrences, each encoded once."""
    counts = docs.select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("(?U)" + GPT_PATTERN), F.lit(0))).alias("word"))
    counts = written(counts.groupBy("word").agg(F.count("*").alias("c")))
    # occurrences by powers of two of the count: the bound below holds without sorting the words
    total = F.sum("c")
    seen = counts.groupBy(F.floor(F.log2("c")).alias("p")).agg(total.alias("c"), F.count("*").alias("n")).collect()
    least = max(2, -(-sum(r["c"] for r in seen) // most))

    def run(batches):
        from .tokens import Encoder

        encoder = Encoder(definition.value, GPT_PATTERN)
        for batch in batches:
            words = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), binaries([encoder.piece(w) for w in words])], ["word", "ids"])

    return counts.where(F.col("c") >= least).select("word").mapInArrow(trimmed(run), "word string, ids binary")


def id_to_piece(definition: str) -> list[bytes]:
    """The bytes of every id."""
    d = json.loads(definition)
    table = {i: bytes(CHAR_TO_BYTE[c] for c in piece) for piece, i in d["model"]["vocab"].items()}
    table |= {t["id"]: t["content"].encode() for t in d["added_tokens"]}
    return [table.get(i, b"") for i in range(max(table) + 1)]


def encoded(docs: DataFrame, vocabulary: str, most: int = WORDS) -> DataFrame:
    """doc_id, ids (array of int), decoded (string) for every row of docs; see bpe_digests for the edge cases."""
    return _apply(docs, vocabulary, most, "doc_id long, ids array<int>, decoded string", _full)


def bpe_digests(docs: DataFrame, vocabulary: str, most: int = WORDS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of docs (doc_id, text; others are ignored).

    Null and empty texts have no ids. Repeated rows each give a row; an empty table gives an empty result. The
    vocabulary's special tokens are recognised inside texts, as the library does by default.
    """
    return _apply(docs, vocabulary, most, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", _digests)


def _full(doc: pa.Array, ids: list[bytes], decoded: list[bytes]) -> list[pa.Array]:
    return [doc, pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32())), pa.array([x.decode("utf-8", "replace") for x in decoded], pa.string())]


def _digests(doc: pa.Array, ids: list[bytes], decoded: list[bytes]) -> list[pa.Array]:
    sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string())
    return [doc, pa.array([len(x) // 4 for x in ids], pa.int64()), sha(ids), sha(decoded)]


def _apply(docs: DataFrame, vocabulary: str, most: int, schema: str, finish) -> DataFrame:
    spark = docs.sparkSession
    tune(spark)
    text = open(vocabulary, encoding="utf-8").read()
    definition = spark.sparkContext.broadcast(text)
    found = word_table(docs, definition, most).toArrow()
    table = spark.sparkContext.broadcast((found.column("word").to_pylist(), found.column("ids").to_pylist()))
    pieces = spark.sparkContext.broadcast(id_to_piece(text))
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches):
        from .tokens import Encoder

        encoder = Encoder(definition.value, GPT_PATTERN)
        common, piece_of = dict(zip(*table.value, strict=True)), pieces.value
        split, get, rare = encoder.pattern.findall, common.get, encoder.piece
        for batch in batches:
            ids, decoded = [], []
            for text in batch.column(1).to_pylist():
                out = []
                for part, special in encoder.parts(text or ""):
                    if special is None:
                        out += [get(w) or rare(w) for w in split(part)]
                    else:
                        out.append(special.to_bytes(4, "little"))
                ids.append(b"".join(out))
                decoded.append(b"".join([piece_of[i] for i in np.frombuffer(ids[-1], "<u4").tolist()]))
            yield pa.RecordBatch.from_arrays(finish(batch.column(0), ids, decoded), names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(run), schema)
