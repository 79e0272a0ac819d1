"""Exact dedup by a Golomb-coded exchange of fingerprints.

Texts are equal when identical after deleting [\\x20\\x09-\\x0D]. Rounds:
1. Every partition takes the 64-bit XXH64 of each normalised text (and its SHA-256 for the result) and stores the rows without
   the texts.
2. It sends each owner (a range of the hash space) its sorted distinct hashes, Golomb-Rice coded, with a bit for those that the
   partition itself holds more than once.
3. The owner merges the lists and answers every partition with a bitmap: which of its hashes occur twice or more anywhere.
4. Partitions read the bitmaps and name their suspects; only the suspects' texts are shuffled, combined by their bytes before the
   shuffle, and compared byte by byte.

Defined results: null counts as the empty text, and empty texts are equal to each other; of equal texts the row with the most code
points stays, then the smallest doc_id (null ids first), then, of rows that repeat a doc_id, the first in storage order; an empty
table gives an empty result; very long texts are hashed and compared whole; extra columns are ignored by `groups` and kept by `deduplicate`,
whatever their names.

At scale: messages cost about 2 + log2(range / n) bits a hash; no task gathers more than one owner's lists or one partition's
bitmaps, and the number of owners follows from the rows; a group of copies with a third of all rows is one hash per partition in the exchange,
one row per task in the byte comparison, and meets its result by a broadcast of the few hot groups. The suspects' hashes are broadcast only while they fit BROADCAST_HASHES (8 bytes each), else joined by a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, hot_rows, left_join, one_of_each, small_batches, stored, table, text_key

BROADCAST_HASHES = 4_000_000
#: Rows of the table for an owner: bounds what a task gathers.
OWNER_ROWS = 2_000_000


# ---------------------------------------------------------------- Golomb-Rice coding


def golomb_encode(values: np.ndarray) -> bytes:
    """Sorted distinct uint64 values: count and parameter (8 + 1 bytes), then unary quotients and fixed-width remainders of the gaps."""
    n = len(values)
    if not n:
        return (0).to_bytes(8, "little") + b"\0"
    gaps = values.copy()
    gaps[1:] -= values[:-1] + np.uint64(1)
    mean = float(gaps.astype(np.float64).mean())
    k = int(min(63, max(0, np.floor(np.log2(mean * 0.6931471805599453 + 1e-9)))))
    quotients = gaps >> np.uint64(k)
    if int(quotients.max()) > 64 * n + 4096:  # one huge gap among small ones: a wider remainder keeps the unary part short
        k = max(k, int(gaps.max()).bit_length() - 12)
        quotients = gaps >> np.uint64(k)
    ends = np.cumsum(quotients + np.uint64(1)).astype(np.int64) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    low = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel() if k else np.zeros(0, np.uint8)
    return n.to_bytes(8, "little") + bytes([k]) + len(unary).to_bytes(8, "little") + np.packbits(unary).tobytes() + np.packbits(low).tobytes()


def golomb_decode(message: bytes) -> np.ndarray:
    n, k = int.from_bytes(message[:8], "little"), message[8]
    if not n:
        return np.zeros(0, np.uint64)
    bits = int.from_bytes(message[9:17], "little")
    cut = 17 + (bits + 7) // 8
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(message, np.uint8, cut - 17, 17), count=bits))
    gaps = np.diff(ends, prepend=-1).astype(np.uint64) - np.uint64(1)
    if k:
        low = np.unpackbits(np.frombuffer(message, np.uint8, offset=cut), count=n * k).reshape(n, k)
        gaps = (gaps << np.uint64(k)) | (low.astype(np.uint64) << np.arange(k, dtype=np.uint64)).sum(1, dtype=np.uint64)
    gaps[1:] += np.uint64(1)
    return np.cumsum(gaps, dtype=np.uint64)


# ---------------------------------------------------------------- rounds

_PRINTS = "part int, place long, doc_id long, size int, print long, sha string, owner int, hashes binary, several binary"


def _prints(batches: Iterator[pa.RecordBatch], owners: int) -> Iterator[pa.RecordBatch]:
    """The rows of a partition without their texts, then its messages to the owners."""
    place, part, seen = 0, None, [np.zeros(0, np.uint64)]
    names = [x.split()[0] for x in _PRINTS.split(", ")]
    for batch in batches:
        ids, texts, n = batch.column(1), batch.column(2).to_pylist(), len(batch)
        part = batch.column(0)[0].as_py() if n else part
        prints, shas, sizes = np.empty(n, np.uint64), [], np.empty(n, np.int32)
        for i, text in enumerate(texts):
            raw = (text or "").encode().translate(None, WHITE)
            prints[i], sizes[i] = xxhash.xxh64_intdigest(raw), len(text or "")
            shas.append(hashlib.sha256(raw).hexdigest())
        seen.append(prints)
        places = np.arange(place, place + n, dtype=np.int64)
        place += n
        none = pa.nulls(n, pa.binary())
        yield pa.record_batch([batch.column(0), pa.array(places), ids, pa.array(sizes), pa.array(prints.view(np.int64)), pa.array(shas, pa.string()), pa.nulls(n, pa.int32()), none, none], names=names)
    distinct, counts = np.unique(np.concatenate(seen), return_counts=True)
    owner = owner_of(distinct, owners)
    cuts = np.searchsorted(owner, np.arange(owners + 1))
    full = [o for o in range(owners) if cuts[o] < cuts[o + 1]]
    for at in range(0, len(full), 256):
        some = full[at : at + 256]
        lists = [slice(cuts[o], cuts[o + 1]) for o in some]
        yield pa.record_batch(
            [pa.array([part] * len(some), pa.int32()), *(pa.nulls(len(some), t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string())), pa.array(some, pa.int32()), pa.array([golomb_encode(distinct[x]) for x in lists], pa.binary()), pa.array([np.packbits(counts[x] > 1).tobytes() for x in lists], pa.binary())],
            names=names,
        )


def owner_of(hashes: np.ndarray, owners: int) -> np.ndarray:
    """Owners hold equal ranges of the hash space, so that a sorted list falls into one run for each owner."""
    return ((hashes >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)


def prints(docs: DataFrame) -> DataFrame:
    """Round 1 and 2, stored: rows (owner null) with part, place (row identity), doc_id, size (code points of the original), print, sha; and the messages."""
    spark = docs.sparkSession
    small_batches(spark)
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // OWNER_ROWS))
    rows = docs.select(F.spark_partition_id().alias("part"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(rows.mapInArrow(lambda batches: _prints(batches, owners), _PRINTS), "dedup-prints")


def _answer(frame: pd.DataFrame) -> pd.DataFrame:
    """An owner's round: a bitmap for each partition that sent a list."""
    lists = [golomb_decode(m) for m in frame["hashes"]]
    several = [np.unpackbits(np.frombuffer(s, np.uint8), count=len(x)).astype(bool) for s, x in zip(frame["several"], lists, strict=True)]
    every, counts = np.unique(np.concatenate(lists), return_counts=True)
    twice = counts > 1
    for x, s in zip(lists, several, strict=True):
        twice[np.searchsorted(every, x[s])] = True
    return pd.DataFrame({"part": frame["part"], "owner": frame["owner"], "bitmap": [np.packbits(twice[np.searchsorted(every, x)]).tobytes() for x in lists]})


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition reads its bitmaps: the hashes that they mark."""
    for batch in batches:
        for hashes, bitmap in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            values = golomb_decode(hashes)
            marked = np.unpackbits(np.frombuffer(bitmap, np.uint8), count=len(values)).astype(bool)
            yield pa.record_batch([pa.array(values[marked].view(np.int64))], names=["print"])


def suspect_hashes(rows: DataFrame) -> DataFrame:
    """The distinct hashes that occur twice or more in `rows` (of prints), by the exchange."""
    sent = rows.where("owner is not null").select("part", "owner", "hashes", "several")
    answers = sent.groupBy("owner").applyInPandas(_answer, "part int, owner int, bitmap binary")
    read = sent.join(answers, ["part", "owner"]).select("hashes", "bitmap").mapInArrow(_marked, "print long")
    return stored(read.distinct(), "dedup-suspects")


def _normal(batches: Iterator[pa.RecordBatch], wanted=None) -> Iterator[pa.RecordBatch]:
    """print, sha, size, doc_id and the normalised bytes of the rows whose hash is wanted (None: of all rows)."""
    hashes = None if wanted is None else np.frombuffer(wanted.value, np.int64)
    for batch in batches:
        ids = batch.column(0)
        raw = [(t or "").encode().translate(None, WHITE) for t in batch.column(1).to_pylist()]
        values = np.fromiter((xxhash.xxh64_intdigest(r) for r in raw), np.uint64, len(raw)).view(np.int64)
        take = np.arange(len(raw))
        if hashes is not None:
            at = np.minimum(np.searchsorted(hashes, values), max(0, len(hashes) - 1))
            take = np.flatnonzero(hashes[at] == values) if len(hashes) else take[:0]
        texts = batch.column(1).to_pylist() if len(take) else []
        yield pa.record_batch(
            [pa.array(values[take]), pa.array([hashlib.sha256(raw[i]).hexdigest() for i in take], pa.string()), pa.array([len(texts[i] or "") for i in take], pa.int32()), ids.take(pa.array(take)), pa.array([raw[i] for i in take], pa.binary())],
            names=["print", "sha", "size", "doc_id", "raw"],
        )


def verified(docs: DataFrame, suspects: DataFrame) -> DataFrame:
    """One row for each text that several rows share, compared by bytes: print, sha, group_size, keep_size, keep_id."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "print long, sha string, size int, doc_id long, raw binary"
    if suspects.count() <= BROADCAST_HASHES:
        held = np.sort(suspects.toArrow().column(0).to_numpy())
        wanted = spark.sparkContext.broadcast(held.tobytes())
        texts = rows.mapInArrow(lambda batches: _normal(batches, wanted), schema)
    else:
        texts = rows.mapInArrow(_normal, schema).join(suspects, "print", "left_semi")
    grouped = texts.groupBy("print", "sha", "raw").agg(F.count("*").alias("group_size"), F.min(F.struct((-F.col("size")).alias("minus"), "doc_id")).alias("best"))
    return grouped.where("group_size > 1").select("print", "sha", "group_size", (-F.col("best.minus")).alias("keep_size"), F.col("best.doc_id").alias("keep_id"))


def groups(docs: DataFrame) -> DataFrame:
    """One row per row of docs: part, place, doc_id, keep_id, group_size, kept, sha."""
    both, by = prints(docs), ["print", "sha"]
    shared = stored(verified(docs, suspect_hashes(both)), "dedup-groups")
    rows = both.where("owner is null").select("part", "place", "doc_id", "size", "print", "sha")
    hot = shared.where(F.col("group_size") >= hot_rows(rows.count()))
    one = left_join(rows, shared, by, hot).withColumns({"group_size": F.coalesce("group_size", F.lit(1).cast("long"))})
    best = (F.col("group_size") == 1) | ((F.col("size") == F.col("keep_size")) & F.col("doc_id").eqNullSafe(F.col("keep_id")))
    one = one.withColumn("best", best).withColumn("keep_id", F.when(F.col("group_size") == 1, F.col("doc_id")).otherwise(F.col("keep_id")))
    # of rows that repeat the id (and text) that stays, the first in storage order
    ties = stored(one.where("best and group_size > 1").groupBy(*by).agg(F.min(F.struct("part", "place")).alias("first")), "dedup-first")
    one = left_join(one, ties, by, hot)
    kept = F.col("best") & ((F.col("group_size") == 1) | (F.struct("part", "place") == F.col("first")))
    return one.select("part", "place", "doc_id", "keep_id", "group_size", kept.alias("kept"), "sha")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with docs' columns. Of rows that repeat both id and normalised text, the longest stays, then the one whose
    columns come first as JSON.

    The dropped keys, far fewer than the rows, are what the texts are joined with.
    """
    keyed = groups(docs).select(text_key(F.col("doc_id"), F.col("sha")).alias("key"), "kept").groupBy("key").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n"))
    keyed = stored(keyed, "dedup-keys")
    sha = F.sha2(F.translate(F.coalesce("text", F.lit("")), " \t\n\x0b\x0c\r", "").cast("binary"), 256)
    return one_of_each(docs, keyed.where("not kept"), keyed.where("kept and n > 1"), sha, F.length(F.coalesce("text", F.lit(""))))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


OP7_SQL = """
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256, length(coalesce(text, '')) AS size
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY size DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
