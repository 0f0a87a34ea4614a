"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

Features of a text are its words, word pairs, and runs of one to three word shapes (kind of
first and last sign, capitals, whether the word repeats the one before), each hashed into
2^BITS weights. A feature's value is its share of the text's words, so that a score is a
sparse dot product: the weights of all n-grams, summed, over the number of words.

Training takes a bounded sample: of the labelled texts the `most` that come first by a hash of their id, label
and text. Their features are made by the executors and written; the updates go over them text by text, in an
order that id, label and text decide, and the driver holds about PART_BYTES of them at once, or one text's if that is more. So
weights are the same in each run. Scoring covers every row. Nothing but the text enters a score.

Defined results: null and empty texts score by the bias alone; rows without a label or with
another label than 0 or 1 aren't learned; with no labelled rows all weights are 0 and the
score is 0.5; repeated label rows and repeated documents count once, an id's different texts or labels each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import annotate
from .store import discard, materialize
from .words import NOT_SPACE, WordHasher, grams, mix

BITS, SCALE, MOST, EPOCHS = 18, 8.0, 4000, 4
PART_BYTES = 8 << 20


class Features(WordHasher):
    """Hashed n-grams of words and word shapes."""

    def __init__(self, bits: int = BITS):
        super().__init__(NOT_SPACE)
        self.bits = bits
        kind = np.zeros(256, np.uint64)  # of a byte: letter, capital, digit, or the sign itself
        kind[33:127] = np.arange(33, 127)
        kind[48:58], kind[65:91], kind[97:123], kind[128:] = 2, 3, 1, 1
        self._kind = kind
        self._upper = np.zeros(256, np.int32)
        self._upper[65:91] = 1

    def hashes(self, data, starts):
        """As in WordHasher, with a second row: the shapes."""
        hashed, text = super().hashes(data, starts)
        if not len(hashed):
            return np.empty((2, 0), np.uint64), text
        inside = self._word[data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cut = starts[(starts > 0) & (starts < len(data))]
        begins[cut] = inside[cut]
        ends[cut - 1] = inside[cut - 1]
        first, last = np.flatnonzero(begins), np.flatnonzero(ends)
        capitals = np.cumsum(self._upper[data], dtype=np.int64)
        many = (capitals[last] - capitals[first] + self._upper[data[first]]) > 1
        again = np.zeros(len(hashed), np.uint64)
        again[1:] = (hashed[1:] == hashed[:-1]) & (text[1:] == text[:-1])
        inner = self._kind[data[np.maximum(last - 1, first)]]
        shape = self._kind[data[first]] | (self._kind[data[last]] << np.uint64(8)) | (inner << np.uint64(16)) | (many.astype(np.uint64) << np.uint64(24)) | (again << np.uint64(25))
        return np.stack([hashed, mix(shape + np.uint64(1))]), text

    def texts(self, column):
        column = column.fill_null("") if column.null_count else column
        column = column.cast(pa.large_string())
        rows = len(column)
        offsets = np.frombuffer(column.buffers()[1], np.int64, rows + 1, column.offset * 8)
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        for i in range(rows):
            piece = data[offsets[i] : offsets[i + 1]]
            parts = [self.hashes(piece, np.zeros(1, np.int64))[0]] if len(piece) <= 1 << 20 else [*self._long(piece)]
            yield np.concatenate([*parts, np.empty((2, 0), np.uint64)], axis=1)

    def index(self, words: np.ndarray) -> np.ndarray:
        """Numbers of all n-grams of a text, repeats included."""
        own, shape = words
        runs = [grams(own, 1), grams(own, 2), *(grams(shape, k) ^ np.uint64(0x5851F42D4C957F2D) for k in (1, 2, 3))]
        return (np.concatenate(runs) >> np.uint64(64 - self.bits)).astype(np.int64)


def train(examples: Callable[[int], Iterable[tuple[int, np.ndarray, np.ndarray]]], bits: int = BITS, epochs: int = EPOCHS, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.05, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """(weights, bias) by follow-the-regularised-leader. examples(epoch): (label, distinct feature numbers, values) one by one."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bz = bn = 0.0
    for epoch in range(epochs):
        for y, at, x in examples(epoch):
            zi, ni = z[at], n[at]
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            bias = -bz / ((beta + np.sqrt(bn)) / alpha)
            g = 1 / (1 + np.exp(-np.clip(w @ x + bias, -35, 35))) - y
            gx = g * x
            n[at] = ni + gx * gx
            z[at] = zi + gx - (np.sqrt(n[at]) - np.sqrt(ni)) / alpha * w
            bz += g - (np.sqrt(bn + g * g) - np.sqrt(bn)) / alpha * bias
            bn += g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return w, -bz / ((beta + np.sqrt(bn)) / alpha)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, label: str, doc_id: str = "doc_id", text: str = "text", most: int = MOST) -> tuple[np.ndarray, float]:
    """Learns from at most `most` labelled texts that aren't held out."""
    known = labels.select(labels[f"`{doc_id}`"].alias("id"), labels[f"`{label}`"].cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    known = known.distinct().orderBy(F.xxhash64("id"), "id", "y").limit(most)
    texts = docs.select(docs[f"`{doc_id}`"].alias("id"), docs[f"`{text}`"].alias("t")).withColumn("h", F.xxhash64("t"))
    pairs = texts.join(F.broadcast(known), "id")
    if not pairs.groupBy("id", "y", "h").agg(F.count("*").alias("n")).where("n > 1").isEmpty():  # repeated rows; else no text is moved
        pairs = pairs.groupBy("id", "y", "h").agg(F.min("t").alias("t"))

    def make():
        features = Features()

        def work(column):
            at, share = [], []
            for words in features.texts(column):
                found, times = np.unique(features.index(words), return_counts=True)
                at.append(found.astype("<i4").tobytes())
                share.append((times * (SCALE / max(1, words.shape[1]))).astype("<f4").tobytes())
            return [pa.array(at, pa.binary()), pa.array(share, pa.binary())]

        return work

    fields = [T.StructField("at", T.BinaryType()), T.StructField("x", T.BinaryType())]
    table = materialize(annotate(pairs, ["t"], make, fields, ["id", "y", "h"]), "examples")
    order = lambda *more: [F.xxhash64("id", "y", "h", *more), "id", "y", "h"]
    size = table.agg(F.count("*").alias("n"), F.sum(F.octet_length("at") + F.octet_length("x")).alias("bytes")).first()
    if size["n"] > most:  # ids with several texts
        table = materialize(table.join(F.broadcast(table.select("id", "y", "h").orderBy(*order()).limit(most)), ["id", "y", "h"], "left_semi"), "examples")
    parts = max(1, -(-(size["bytes"] or 0) // PART_BYTES))

    def examples(epoch: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        rows = table.withColumn("o", order(F.lit(epoch))[0]).repartitionByRange(parts, "o").sortWithinPartitions("o", "id", "y", "h")
        for r in rows.select("y", "at", "x").toLocalIterator(prefetchPartitions=True):
            yield r.y, np.frombuffer(r.at, "<i4"), np.frombuffer(r.x, "<f4").astype(np.float64)

    made = train(examples)
    discard(table)
    return made


def score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """docs' columns in keep and the probability of label 1. The model is 2^BITS weights, whatever the corpus."""
    sent = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))

    def make():
        features, (w, bias) = Features(), sent.value

        def work(column):
            out = []
            for words in features.texts(column):
                dot = float(w[features.index(words)].sum(dtype=np.float64)) * SCALE / max(1, words.shape[1]) + bias
                out.append(1 / (1 + np.exp(-min(35.0, max(-35.0, dot)))))
            return [pa.array(out, pa.float64())]

        return work

    return annotate(docs, [text], make, [T.StructField(name, T.DoubleType())], keep)
