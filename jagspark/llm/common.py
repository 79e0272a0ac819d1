"""Helpers shared by the training-data operators: shared folder, Arrow byte buffers, word scanning."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of every contract here: [\x20\x09-\x0D].
WHITE = bytes([0x20, *range(0x09, 0x0E)])
IS_WHITE = np.zeros(256, dtype=bool)
IS_WHITE[list(WHITE)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Rows in an Arrow batch: bounds the memory of one Python call when texts are long.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lower the rows of an Arrow batch, so that long texts do not pile up in one batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key) or 0) not in range(1, BATCH_ROWS + 1):
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); where it is unset, as in tests, an own one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            where = held.get()
        elif not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        else:
            where = "file://" + tempfile.mkdtemp(prefix="jagspark-")
            spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


_made: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    _made.append(f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def clean(spark: SparkSession) -> None:
    """Delete the tables that this process has stored in the shared folder; results read from them are gone too."""
    while _made:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_made.pop())
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts the lineage, survives lost executors, is computed once."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_key(doc_id: Column, sha: Column) -> Column:
    """One string for a row's doc_id (null: 'null') and the digest of its text."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), sha)


def free_name(columns: list[str], name: str) -> str:
    """A column name like `name` that none of columns has."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def one_of_each(docs: DataFrame, gone: DataFrame, repeated: DataFrame, sha: Column | None = None, size: Column | None = None) -> DataFrame:
    """docs without the rows whose key is in `gone`, and one row for each key in `repeated`, with docs' columns.

    The key is text_key of doc_id and `sha` (else the SHA-256 of the text). Of rows that share a key the one of greatest `size` stays, then the
    one whose columns come first as JSON, so that reruns agree; rows that share that too are alike.
    """
    columns = docs.columns
    key = free_name(columns, "key")
    sha = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256) if sha is None else sha
    left = docs.withColumn(key, text_key(F.col("doc_id"), sha)).join(gone.select(F.col("key").alias(key)), key, "left_anti")
    repeated = stored(repeated.select(F.col("key").alias(key)).distinct(), "repeated-keys")
    if repeated.isEmpty():
        return left.select(*columns)
    order = F.struct(-(F.lit(0) if size is None else size), F.sha2(F.to_json(F.struct(*columns)), 256))
    several = left.join(repeated, key, "left_semi").groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("row"))
    return left.join(repeated, key, "left_anti").select(*columns).unionAll(several.select("row.*"))


#: A key is hot when it has this share of the rows (and HOT_ROWS at least), so that there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE, HOT_ROWS = 0.001, 1000


def hot_rows(n: int) -> int:
    """From how many rows on a key is hot in a table of n rows."""
    return max(HOT_ROWS, int(n * HOT_SHARE))


def left_join(left: DataFrame, right: DataFrame, on: list[str], hot: DataFrame) -> DataFrame:
    """left's rows with right's columns; right has at most one row a key. The rows of hot keys, of which there are 1 / HOT_SHARE at most, meet a
    broadcast of their few rows and are not shuffled; the others join as usual."""
    hot = F.broadcast(hot.select(*on))
    known = F.broadcast(right.join(hot, on, "left_semi"))
    return left.join(hot, on, "left_semi").join(known, on, "left").unionByName(left.join(hot, on, "left_anti").join(right, on, "left"))


def byte_column(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty. offsets has len + 1 entries and starts at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = 1 << 20):
    """Row ranges (i, j) of at most `limit` bytes each; a longer row comes alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, counts): byte spans of the words [^\\x20\\x09-\\x0D]+ of all rows in order, and each row's number of words."""
    black = ~IS_WHITE[data]
    first = black.copy()
    first[1:] &= ~black[:-1]
    last = black.copy()
    last[:-1] &= ~black[1:]
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[edge] = black[edge]
    last[edge[edge > 0] - 1] = black[edge[edge > 0] - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.diff(np.searchsorted(starts, offsets))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        made = []
        for base in (_BASE, _BASE_INVERSE):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        if n > 1 << 23:  # a giant text: do not keep its tables
            return made[0], made[1]
        _powers = (made[0], made[1])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, by prefix sums of a polynomial modulo 2^64: work in proportion to the bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
