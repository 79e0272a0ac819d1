"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

Features are the text's own word unigrams and bigrams (with the text's borders as words), hashed to 2^BITS slots, for two views of
a word: its lower-cased letters, and the set of character classes in it; and whether neighbouring words are equal. Each of these
five streams is divided by its length, so that a score does not depend on a text's length alone. A score is the logistic function of the sparse
dot product of these counts and the weights.

Training takes at most SAMPLE labelled rows (a documented bound: the first by a hash of doc_id), makes their features in the
workers and runs the FTRL updates in one task over rows in hash order, so reruns agree. Scoring covers every row and whole texts.

Defined results: a null or empty text is scored by its borders alone; a label that is null is no label; where labels of one doc_id
disagree, the mean decides (0.5 or more: 1); a null doc_id is not held out and has no label; with no label at all every score is 0.5; repeated rows get equal scores;
very long texts are scored whole, in blocks of rows; an empty table gives an empty result; other columns are ignored by `scores` and kept by `keep_good`.

At scale: scoring is a map with no shuffle; the weights (2^BITS + 1 doubles, 2 MB at most) are broadcast; the training rows are
bounded, whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, blocks, byte_column, mix, small_batches, span_hashes, table, words

BITS = 18
SAMPLE = 8_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
THRESHOLD = 0.7

_BORDER = np.uint64(0x5851F42D4C957F2D)
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_EQUAL = np.array([0x2545F4914F6CDD1D, 0x369DEA0F31A53F85], np.uint64)


def _classes() -> np.ndarray:
    """A bit for small letters, capitals, digits, bytes beyond ASCII, and each punctuation mark."""
    out, mark = np.zeros(256, np.uint64), 4
    for b in range(256):
        c = chr(b)
        if b >= 128:
            out[b] = 8
        elif c.islower():
            out[b] = 1
        elif c.isupper():
            out[b] = 2
        elif c.isdigit():
            out[b] = 4
        elif b > 32 and b != 127:
            out[b], mark = 1 << mark, mark + 1
    return out


CLASSES = _classes()


def streams(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Five streams of (slots, row offsets) for the rows of a byte column."""
    starts, ends, counts = words(data, offsets)
    rows = len(offsets) - 1
    single = np.concatenate([[0], np.cumsum(counts)])
    paired = single + np.arange(rows + 1)
    at = np.arange(len(starts)) + np.repeat(np.arange(rows), counts) + 1
    shift = np.uint64(64 - BITS)
    out = []
    letters = span_hashes(LOWER[data], starts, ends)
    kinds = mix(np.bitwise_or.reduceat(CLASSES[data], starts) + _LEFT) if len(starts) else np.zeros(0, np.uint64)
    for view in (letters, kinds):
        chain = np.full(len(starts) + rows + 1, _BORDER)
        chain[at] = view
        out.append((mix(view + _RIGHT) >> shift, single))
        out.append((mix(chain[:-1] * _LEFT + chain[1:] * _RIGHT) >> shift, paired))
        if view is letters:
            out.append((mix(_EQUAL[(chain[:-1] == chain[1:]).astype(np.int64)]) >> shift, paired))
    return out


def dots(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The dot product of each row's features and the weights; the last weight is the constant's."""
    total = np.full(len(offsets) - 1, float(weights[-1]))
    for slots, cuts in streams(data, offsets):
        full = np.flatnonzero(cuts[1:] > cuts[:-1])
        if len(full):
            total[full] += np.add.reduceat(weights[slots], cuts[full]) / (cuts[full + 1] - cuts[full])
    return total


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = byte_column(batch.column(2))
        slots, values = [], []
        for i, j in blocks(offsets):
            made = streams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            for r in range(j - i):
                parts = [s[c[r] : c[r + 1]] for s, c in made]
                slot, where = np.unique(np.concatenate([*parts, [np.uint64(1 << BITS)]]), return_inverse=True)
                share = np.concatenate([*(np.full(len(p), 1 / max(1, len(p))) for p in parts), [1.0]])
                slots.append(slot.astype(np.int32).tobytes())
                values.append(np.bincount(where, share).astype(np.float32).tobytes())
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(slots, pa.binary()), pa.array(values, pa.binary())], names=["turn", "label", "slots", "vals"])


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights from rows of (slots, values, label), updated row by row: proximal FTRL with per-slot rates."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weight(z, n):
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(epochs):
        for slots, values, label in rows:
            values = values.astype(float)
            zs, ns = z[slots], n[slots]
            w = weight(zs, ns)
            p = 1 / (1 + np.exp(-np.clip(w @ values, -35, 35)))
            g = (p - label) * values
            new = ns + g * g
            z[slots] = zs + g - (np.sqrt(new) - np.sqrt(ns)) / ALPHA * w
            n[slots] = new
    return weight(z, n)


def _train(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["turn", "label", "slots"], kind="stable")
    rows = [(np.frombuffer(s, np.int32), np.frombuffer(v, np.float32), float(y)) for s, v, y in zip(frame["slots"], frame["vals"], frame["label"], strict=True)]
    return pd.DataFrame({"weights": [ftrl(rows).tobytes()]})


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights learnt from the labelled rows of docs that are not held out."""
    small_batches(docs.sparkSession)
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("_id"))
        .agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(sample)
    )
    # rows that repeat a doc_id count once, so that the bound holds for rows too
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).groupBy("_id", "label").agg(F.min("text").alias("text"))
    made = rows.select(F.xxhash64("_id").alias("turn"), "label", "text").mapInArrow(_features, "turn long, label int, slots binary, vals binary")
    # one task by design: at most `sample` rows of bounded number, in one order
    found = made.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(_train, "weights binary").collect()
    return np.frombuffer(found[0][0]) if found else np.zeros((1 << BITS) + 1)


def scored(docs: DataFrame, weights: np.ndarray, columns: list[str]) -> DataFrame:
    """The named columns of docs and `score`, made from the column text alone."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(weights.tobytes())
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)], F.col("text").alias("_text"))
    carried = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.frombuffer(held.value)
        for batch in batches:
            data, offsets = byte_column(batch.column(carried))
            total = [dots(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], weights) for i, j in blocks(offsets)]
            total = np.concatenate([np.zeros(0), *total])
            yield pa.record_batch([*batch.columns[:carried], pa.array(1 / (1 + np.exp(-np.clip(total, -700, 700))))], names=[*(f"c{i}" for i in range(carried)), "score"])

    made = rows.mapInArrow(run, rows.drop("_text").withColumn("score", F.lit(0.0)).schema)
    return made.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], "score")


def scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    out = scored(docs, train(docs, labels, sample), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows that the classifier does not reject, with docs' columns."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(train(docs, labels, sample).tobytes())
    position = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.frombuffer(held.value)
        for batch in batches:
            data, offsets = byte_column(batch.column(position))
            total = [dots(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], weights) for i, j in blocks(offsets)]
            good = 1 / (1 + np.exp(-np.clip(np.concatenate([np.zeros(0), *total]), -700, 700))) >= THRESHOLD
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
