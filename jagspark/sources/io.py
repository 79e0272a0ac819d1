"""Sources and sinks: Parquet with narrowed schemas and deterministic file order, in-memory tables, creation, seeded numbers, partitioned readers."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discover(spark: SparkSession, path: str | Sequence[str]) -> list[str]:
    """The Parquet files of a file, folder or pattern, sorted; a list keeps its order. None found raises FileNotFoundError.

    Goes through Hadoop's file systems, so any store that Spark reads will do.
    """
    if not isinstance(path, str):
        return [f for p in path for f in discover(spark, p)]
    where, fs = _fs(spark, path)
    found = fs.globStatus(where) or []
    files: list[str] = []
    for status in found:
        if status.isDirectory():
            files += [str(s.getPath()) for s in fs.listStatus(status.getPath()) if str(s.getPath()).endswith(".parquet")]
        else:
            files.append(str(status.getPath()))
    if not files:
        raise FileNotFoundError(path)
    return sorted(files)


def is_folder(spark: SparkSession, path: str) -> bool:
    where, fs = _fs(spark, path)
    return fs.getFileStatus(where).isDirectory()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a local session without one gets its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="jagspark-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


def narrowed(schema: T.StructType, columns: Sequence[str] | None) -> T.StructType:
    """The schema with just the named leaves, given as paths like 'met' or 'jets.pt', in schema order."""
    if columns is None:
        return schema
    wanted: dict[str, list[str] | None] = {}
    for c in columns:
        head, _, rest = c.partition(".")
        if head not in schema.names:
            raise KeyError(f"no column {head}")
        if not rest:
            wanted[head] = None
        elif wanted.get(head, []) is not None:
            wanted.setdefault(head, []).append(rest)

    def cut(kind: T.DataType, leaves: list[str] | None) -> T.DataType:
        if leaves is None:
            return kind
        if isinstance(kind, T.ArrayType):
            return T.ArrayType(cut(kind.elementType, leaves), kind.containsNull)
        if isinstance(kind, T.StructType):
            return narrowed(kind, leaves)
        raise KeyError(f"no fields in {kind.simpleString()}")

    return T.StructType([T.StructField(f.name, cut(f.dataType, wanted[f.name]), f.nullable) for f in schema.fields if f.name in wanted])


def from_parquet(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None, ordinal: str | None = None) -> DataFrame:
    """A ragged table. The schema is the first file's; `columns` narrows it to leaves before the scan, also for sizes and filters.

    ordinal: adds a dense row number in the order of files and rows, from Parquet's own row index and one count per file.
    """
    files = discover(spark, path)
    schema = narrowed(spark.read.parquet(files[0]).schema, columns)
    df = spark.read.schema(schema).parquet(*files)
    if ordinal is None:
        return df
    # metadata names files as encoded URIs; they are matched whole, as the listing names them
    rows = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    counts = {_plain(unquote(r["_file"])): (r["_file"], r["count"]) for r in rows.groupBy("_file").count().collect()}  # one row a file
    listed = {_plain(f) for f in files}
    if not counts.keys() <= listed:
        raise ValueError(f"the scan names files that the listing lacks: {sorted(counts.keys() - listed)[:3]}")
    if len(listed) < len(files):
        raise ValueError("a file is listed twice: its rows have no one place")
    offsets, at = [], 0
    for f in files:
        if name := counts.get(_plain(f)):  # a file without rows has no place
            offsets.append((name[0], at))
            at += name[1]
    table = spark.createDataFrame(offsets, "_file string, _offset long")
    # one row a file: it is broadcast, since by a shuffle all rows of a file would meet in one task
    return rows.join(F.broadcast(table), "_file").withColumn(ordinal, F.col("_offset") + F.col("_row")).drop("_file", "_row", "_offset")


def _plain(uri: str) -> str:
    """A path as the listing names it: a local one with one slash after its scheme."""
    return re.sub(r"^file:/+", "file:/", uri)


def from_parquet_flat(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """The same for flat columns only: a nested one is refused by name."""
    df = from_parquet(spark, path, columns)
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType, T.StringType, T.BinaryType)):
            raise TypeError(f"column {f.name} is {f.dataType.simpleString()}, not a flat number")
    return df


def num_rows(spark: SparkSession, path: str | Sequence[str]) -> int:
    """Rows by the files' footers: a count reads no column."""
    return spark.read.parquet(*discover(spark, path)).count()


def schema_of(spark: SparkSession, path: str | Sequence[str]) -> T.StructType:
    return spark.read.parquet(discover(spark, path)[0]).schema


def to_parquet(df: DataFrame, destination: str, partitions: int | None = None, column: str | None = None, compute: bool = True, steps_per_file: int | None = None, prefix: str = "part", ordinal: str | None = None):
    """Write parts and return their paths in order; compute=False returns the write as a function.

    column: the one column to write, which must then be a flat number. steps_per_file: this many of the input's partitions to a file. prefix: the
    files' names are prefix-00000.parquet and so on, in the order of the parts. ordinal: rows are dealt to parts by ranges of this column.
    """
    if column is not None:
        df = df.select(column)
        if isinstance(df.schema[0].dataType, (T.ArrayType, T.StructType, T.MapType, T.StringType, T.BinaryType)):
            raise TypeError(f"{column} is {df.schema[0].dataType.simpleString()}, not a flat number")

    def write() -> list[str]:
        parts = df
        if steps_per_file is not None:
            parts = df.coalesce(max(1, -(-df.rdd.getNumPartitions() // steps_per_file)))
        elif ordinal is not None:
            parts = df.repartitionByRange(*([partitions] if partitions else []), ordinal).sortWithinPartitions(ordinal)
        elif partitions is not None:
            parts = df.repartition(partitions)
        parts.write.mode("overwrite").parquet(destination)
        return _renamed(df.sparkSession, discover(df.sparkSession, destination), destination, prefix)

    return write() if compute else write


def _renamed(spark: SparkSession, files: list[str], destination: str, prefix: str) -> list[str]:
    """Spark's part files, in the order of their numbers, under plain names."""
    out = []
    for i, f in enumerate(files):
        old, fs = _fs(spark, f)
        new, _ = _fs(spark, f"{destination.rstrip('/')}/{prefix}-{i:05d}.parquet")
        fs.rename(old, new)
        out.append(str(fs.makeQualified(new)))
    return out


def from_record(spark: SparkSession, **columns) -> DataFrame:
    """Named columns of equal length, with `ordinal` from 0."""
    frame = pd.DataFrame({k: list(v) if np.ndim(v) > 1 else v for k, v in columns.items()})
    frame.insert(0, "ordinal", np.arange(len(frame)))
    return spark.createDataFrame(frame)


def from_array(spark: SparkSession, values, name: str = "x") -> DataFrame:
    """An array's rows: numbers for one dimension, lists for more."""
    return from_record(spark, **{name: np.asarray(values) if np.ndim(values) == 1 else np.asarray(values).tolist()})


def from_lists(spark: SparkSession, rows: Sequence[dict], schema: str | T.StructType) -> DataFrame:
    """A ragged table from Python rows."""
    return spark.createDataFrame([tuple(r.values()) for r in rows], schema)


def full(spark: SparkSession, n: int, value: float, name: str = "x") -> DataFrame:
    return spark.range(n).select(F.col("id").alias("ordinal"), F.lit(value).alias(name))


def zeros(spark: SparkSession, n: int, name: str = "x") -> DataFrame:
    return full(spark, n, 0.0, name)


empty = zeros


def ones(spark: SparkSession, n: int, name: str = "x") -> DataFrame:
    return full(spark, n, 1.0, name)


def arange(spark: SparkSession, start: float, stop: float | None = None, step: float = 1, name: str = "x") -> DataFrame:
    start, stop = (0, start) if stop is None else (start, stop)
    n = max(0, int(np.ceil((stop - start) / step)))
    return spark.range(n).select(F.col("id").alias("ordinal"), (F.lit(start) + F.col("id") * F.lit(step)).alias(name))


def linspace(spark: SparkSession, start: float, stop: float, num: int = 50, name: str = "x") -> DataFrame:
    step = (stop - start) / max(1, num - 1)
    at = F.when(F.col("id") == num - 1, F.lit(float(stop))) if num > 1 else F.when(F.lit(False), F.lit(0.0))
    return spark.range(num).select(F.col("id").alias("ordinal"), at.otherwise(F.lit(float(start)) + F.col("id") * F.lit(step)).alias(name))


class Random:
    """Seeded numbers, equal to NumPy's generator for the same seed and order of draws; each draw is one bounded driver array."""

    MOST = 10_000_000

    def __init__(self, spark: SparkSession, seed: int):
        self.spark, self.seed, self.draws = spark, seed, 0

    def _draw(self, kind: str, size: int, *args) -> DataFrame:
        if size > self.MOST:
            raise ValueError(f"at most {self.MOST} numbers a draw; use rand or randn for more, which are not NumPy's")
        generator = np.random.default_rng([self.seed, self.draws])
        self.draws += 1
        return from_array(self.spark, getattr(generator, kind)(*args, size=size))

    def normal(self, size: int, loc: float = 0.0, scale: float = 1.0) -> DataFrame:
        return self._draw("normal", size, loc, scale)

    def standard_normal(self, size: int) -> DataFrame:
        return self._draw("normal", size, 0.0, 1.0)

    def uniform(self, size: int, low: float = 0.0, high: float = 1.0) -> DataFrame:
        return self._draw("uniform", size, low, high)

    def integers(self, size: int, low: int, high: int) -> DataFrame:
        return self._draw("integers", size, low, high)


class _Range(InputPartition):
    def __init__(self, start: int, stop: int):
        super().__init__((start, stop))
        self.start, self.stop = start, stop


class PartitionedSource(DataSource):
    """Base of user-defined readers: give name(), schema(), size() and read_range(start, stop) -> iterator of tuples.

    Register the class with spark.dataSource.register and read it by format(name).option("steps", n): each step is a task.
    """

    def size(self) -> int:
        raise NotImplementedError

    def read_range(self, start: int, stop: int) -> Iterator[tuple]:
        raise NotImplementedError

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _StepReader(self)


class _StepReader(DataSourceReader):
    def __init__(self, source: PartitionedSource):
        self.source = source

    def partitions(self) -> list[_Range]:
        n, steps = self.source.size(), int(self.source.options.get("steps", 1))
        cuts = [n * i // steps for i in range(steps + 1)]
        return [_Range(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        return self.source.read_range(partition.start, partition.stop)


class Sources:
    """Named sources of a session: DataFrames, or functions that make one when first used; each is a temporary view for SQL too."""

    def __init__(self, spark: SparkSession):
        self.spark, self._held = spark, {}

    def add(self, name: str, data, **params) -> None:
        """data: a DataFrame or a function of params. A name is given once."""
        if name in self._held:
            raise ValueError(f"source {name} is there already")
        self._held[name] = (data, params)

    def __getitem__(self, name: str) -> DataFrame:
        data, params = self._held[name]
        df = data if isinstance(data, DataFrame) else data(**params)
        self._held[name] = (df, {})
        df.createOrReplaceTempView(name)
        return df

    def names(self) -> list[str]:
        return list(self._held)


def partition_datasets(spark: SparkSession, datasets: dict[str, str | Sequence[str]], steps_per_file: int = 1) -> dict[str, list[tuple[str, int, int]]]:
    """make_partitions of several named datasets."""
    return {name: make_partitions(spark, path, steps_per_file) for name, path in datasets.items()}


def make_partitions(spark: SparkSession, path: str | Sequence[str], steps_per_file: int = 1) -> list[tuple[str, int, int]]:
    """(file, step, steps): blind parts, whose rows are known when read."""
    return [(f, i, steps_per_file) for f in discover(spark, path) for i in range(steps_per_file)]


def read_partition(spark: SparkSession, part: tuple[str, int, int], columns: Sequence[str] | None = None) -> DataFrame:
    """The rows of one part: row i of n goes to step i * steps // n, by the file's own row index and footer count."""
    file, step, steps = part
    n = num_rows(spark, file)
    low, high = -(-step * n // steps), -(-(step + 1) * n // steps)
    df = spark.read.schema(narrowed(schema_of(spark, file), columns)).parquet(file)
    at = F.col("_metadata.row_index")
    return df.where((at >= low) & (at < high))
