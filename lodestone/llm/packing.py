"""Packing by power-of-two decomposition.

A document's token ids are cut into pieces whose lengths are powers of two: as many pieces
of the longest length as fit, then the binary digits of what is left, longest first. Each
piece is a sequence of its own, so no sequence crosses documents and none needs padding;
sequences of one length are numbered one after another, so that a trainer draws batches of
equal lengths.

One pass tokenises and cuts; its pieces carry the number of their task and their place in
it, from which counts a task and length (a table of tasks x lengths) give dense numbers.

Defined results: a null or empty text is its end id alone, one piece of length 1; repeated
documents are packed each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import lists, ready
from .store import materialize
from .tokens import END_ID, shared_encoder, vocabulary_path

LONGEST = 4096
IDS_PER_BATCH = 1 << 20


def binary_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Lengths of the pieces of n tokens, longest first; longest is a power of two."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", longest: int = LONGEST, end_id: int = END_ID, path: str | None = None, ids: bool = True) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (0), and with ids the token ids themselves."""
    if longest & (longest - 1) or longest < 1:
        raise ValueError("longest must be a power of two")
    ready(docs.sparkSession)
    path = path or vocabulary_path()
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(x, T.LongType()) for x in ("start", "length", "ids_crc32", "doc_tokens", "task", "place"))])
    if ids:
        schema.add("ids", T.ArrayType(T.IntegerType()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, places = shared_encoder(path), TaskContext.get().partitionId(), {}
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            at, held = [], 0

            def flush(batch=batch):
                nonlocal out, at, held
                arrays = [pa.array(x, pa.int64()) for x in out[1:7]]
                if ids:
                    arrays.append(lists(out[7], pa.int32()))
                made = pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *arrays], names=schema.names)
                out, at, held = [[] for _ in schema], [], 0
                return made

            coded, starts = encoder.encode_all(batch.column(1), end_id)
            bounds = starts.tolist()
            for row, (first, last) in enumerate(zip(bounds, bounds[1:])):
                n, start = last - first, 0
                for length in binary_lengths(n, longest):
                    piece = coded[first + start : first + start + length]
                    places[length] = place = places.get(length, -1) + 1
                    at.append(row)
                    for column, x in zip(out[1:], (start, length, zlib.crc32(piece), n, task, place, piece if ids else None)):
                        column.append(x)
                    start += length
                    held += length
                    if held >= IDS_PER_BATCH:
                        yield flush()
            if at:
                yield flush()

    pieces = materialize(docs.select(docs[f"`{doc_id}`"], docs[f"`{text}`"]).mapInArrow(cut, schema), "pieces")
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    lengths = counts.groupBy("length").agg(F.sum("n").alias("all"))
    longer = lengths.select("length", F.coalesce(F.sum("all").over(Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # a row a length
    first = counts.withColumn("lower", F.coalesce(F.sum("n").over(before), F.lit(0))).join(longer, "length")
    first = materialize(first.select("length", "task", (F.col("base") + F.col("lower")).alias("first")), "first-numbers")  # of known size: sent to the pieces if it is small
    numbered = pieces.join(first, ["length", "task"])
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *(["ids"] if ids else [])]
    return numbered.select(*columns)
