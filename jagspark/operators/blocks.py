"""Order-aware operations on flat columns, without a global sort in one task.

Rows carry an ordinal (a unique whole number). Its range is cut into at most BLOCKS equal blocks; what crosses blocks (running totals,
counts, last values) is one row per block, so a window over those rows is bounded whatever the table's size, and the rest of the
work is a window per block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCKS = 1024


def blocked(df: DataFrame, ordinal: str, blocks: int = BLOCKS) -> DataFrame:
    """df with `_block`, growing with the ordinal; one aggregate finds the range."""
    low, high = df.agg(F.min(ordinal), F.max(ordinal)).first()
    width = 1 if low is None else max(1, -(-(high - low + 1) // blocks))
    return df.withColumn("_block", F.floor((F.col(ordinal) - F.lit(low or 0)) / F.lit(width)))


def _before(per_block: DataFrame, total: Column, start: Column) -> DataFrame:
    """(_block, _before): the total of all earlier blocks; one row per block, BLOCKS at most."""
    w = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return per_block.select("_block", F.coalesce(total.over(w), start).alias("_before"))


def with_position(df: DataFrame, key: str, name: str = "ordinal") -> DataFrame:
    """A dense position 0..n-1 in the order of a numeric key."""
    cut = blocked(df, key)
    counts = cut.groupBy("_block").agg(F.count("*").alias("_n"))
    offsets = _before(counts, F.sum("_n"), F.lit(0).cast("long"))
    place = F.row_number().over(Window.partitionBy("_block").orderBy(key)) - 1
    return cut.join(offsets, "_block").withColumn(name, place + F.col("_before")).drop("_block", "_before")


_SCANS: dict[str, tuple[Callable[[Column], Column], Callable[[Column], Column], Callable[[Column, Column], Column], float]] = {
    # per element, aggregate, combination of the earlier blocks' value and the running one, start
    # whole numbers stay whole
    "cumsum": (lambda x: x, F.sum, lambda a, b: a + b, 0),
    "cumprod": (lambda x: x, F.product, lambda a, b: a * b, 1.0),
    "nancumsum": (lambda x: F.when(F.isnan(x.cast("double")), F.lit(0)).otherwise(x), F.sum, lambda a, b: a + b, 0),
    "nancumprod": (lambda x: F.nanvl(x.cast("double"), F.lit(1.0)), F.product, lambda a, b: a * b, 1.0),
}


def scan(df: DataFrame, ordinal: str, value: str, kind: str = "cumsum", name: str | None = None) -> DataFrame:
    """df with a running sum or product in the order of the ordinal, over the whole dataset."""
    element, combine, join, start = _SCANS[kind]
    cut = blocked(df, ordinal).withColumn("_x", element(F.col(value)))
    totals = cut.groupBy("_block").agg(combine("_x").alias("_t"))
    offsets = _before(totals, combine("_t"), F.lit(start))
    running = combine("_x").over(Window.partitionBy("_block").orderBy(ordinal).rowsBetween(Window.unboundedPreceding, 0))
    return cut.join(offsets, "_block").withColumn(name or kind, join(F.col("_before"), running)).drop("_block", "_before", "_x")


def shift(df: DataFrame, ordinal: str, value: str, name: str) -> DataFrame:
    """df with the value of the row before in the order of the ordinal (NULL for the first)."""
    cut = blocked(df, ordinal)
    last = cut.groupBy("_block").agg(F.max_by(F.struct(value), ordinal).alias("_last"))
    carried = last.select("_block", F.lag("_last").over(Window.orderBy("_block")).alias("_last"))
    w = Window.partitionBy("_block").orderBy(ordinal)
    lagged = cut.join(carried, "_block").withColumn("_lag", F.lag(F.struct(value)).over(w))
    return lagged.withColumn(name, F.coalesce("_lag", "_last")[value]).drop("_block", "_lag", "_last")


def diff(df: DataFrame, ordinal: str, value: str, n: int = 1, name: str = "diff") -> DataFrame:
    """n-th differences of neighbouring rows; the first n rows have none and go."""
    out = df.withColumn(name, F.col(value))
    for _ in range(n):
        out = shift(out, ordinal, name, "_before_")
        first = out.agg(F.min(ordinal)).first()[0]
        out = out.where(F.col(ordinal) != F.lit(first)).withColumn(name, F.col(name) - F.col("_before_")).drop("_before_")
    return out


def run_lengths(df: DataFrame, ordinal: str, value: str) -> DataFrame:
    """(run, value, n): the runs of equal neighbours in the order of the ordinal."""
    changes = shift(df.select(ordinal, value), ordinal, value, "_was")
    first = df.agg(F.min(ordinal)).first()[0]
    new = (F.col(ordinal) == F.lit(first)) | ~F.col(value).eqNullSafe(F.col("_was"))
    runs = scan(changes.withColumn("_new", new.cast("long")), ordinal, "_new", "cumsum", "run")
    return runs.groupBy((F.col("run").cast("long") - 1).alias("run"), value).agg(F.count("*").alias("n"))


def unflatten(df: DataFrame, ordinal: str, counts: DataFrame, group: str, size: str, *, value: str) -> DataFrame:
    """(group, items): flat rows regrouped into lists of the given sizes. `ordinal` is dense from 0; groups follow the order of `group`.

    Every group's first position comes from a scan; a row finds its group through the block of positions both fall in.
    """
    ends = scan(counts.select(group, size), group, size, "cumsum", "_end").withColumns({"_end": F.col("_end").cast("long")})
    ends = ends.withColumn("_start", F.col("_end") - F.col(size))
    step = 4096
    spans = ends.where(F.col(size) > 0).withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_start") / step), F.floor((F.col("_end") - 1) / step))))
    rows = df.select(F.col(ordinal).alias("_o"), F.col(value).alias("_v")).withColumn("_cell", F.floor(F.col("_o") / step))
    hit = rows.join(spans, "_cell").where((F.col("_o") >= F.col("_start")) & (F.col("_o") < F.col("_end")))
    lists = hit.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("_o", "_v"))), lambda s: s["_v"]).alias("items"))
    kind = dict(df.dtypes)[value]
    return counts.select(group).join(lists, group, "left").withColumn("items", F.coalesce("items", F.array().cast(f"array<{kind}>")))


def keep(df: DataFrame, condition: Column) -> DataFrame:
    """The rows where a boolean condition holds; a condition of another type is refused."""
    kind = df.select(condition.alias("c")).schema[0].dataType.simpleString()
    if kind != "boolean":
        raise TypeError(f"a condition is boolean, not {kind}")
    return df.where(condition)


def take_slice(df: DataFrame, ordinal: str, start: int | None = None, stop: int | None = None, step: int = 1) -> DataFrame:
    """Rows start:stop:step of a dense ordinal; negative bounds count from the end."""
    if step < 1:
        raise ValueError("the step must be positive")
    n = df.count() if (start or 0) < 0 or (stop or 0) < 0 else None
    start = 0 if start is None else max(0, start + n) if start < 0 else start
    stop = stop if stop is None or stop >= 0 else stop + n
    kept = F.col(ordinal) >= start
    kept = kept if stop is None else kept & (F.col(ordinal) < stop)
    return df.where(kept & ((F.col(ordinal) - start) % step == 0))


def take_index(df: DataFrame, ordinal: str, index: int) -> DataFrame:
    """The row at an index of a dense ordinal; out of range raises."""
    at = index if index >= 0 else index + df.count()
    row = df.where(F.col(ordinal) == at)
    if at < 0 or row.isEmpty():
        raise IndexError(f"no row {index}")
    return row


def gather(df: DataFrame, ordinal: str, indices: DataFrame, index: str) -> DataFrame:
    """The rows of df at the indices (a column of another DataFrame, repeats allowed), with the indices' columns."""
    n = df.count() if not indices.where(F.col(index) < 0).isEmpty() else 0
    wanted = indices.withColumn("_at", F.when(F.col(index) < 0, F.col(index) + n).otherwise(F.col(index)))
    return wanted.join(df, wanted["_at"] == df[ordinal]).drop("_at")


def reshape(df: DataFrame, ordinal: str, value: str, width: int) -> DataFrame:
    """(row, items): the flat column in lists of `width`, as reshape(-1, width); a remainder raises."""
    if df.count() % width:
        raise ValueError(f"the rows do not fill lists of {width}")
    lists = df.groupBy(F.floor(F.col(ordinal) / width).alias("row")).agg(F.sort_array(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.col(value).alias("v")))).alias("s"))
    return lists.select("row", F.transform("s", lambda s: s["v"]).alias("items"))


def concatenate(frames: list[DataFrame], ordinal: str) -> DataFrame:
    """Datasets end to end; ordinals (dense) go on where the dataset before ends."""
    out, offset = None, 0
    for at, frame in enumerate(frames):
        moved = frame.withColumn(ordinal, F.col(ordinal) + offset)
        out = moved if out is None else out.unionByName(moved, allowMissingColumns=True)
        offset += frame.count() if at < len(frames) - 1 else 0
    return out


def stride_sample(df: DataFrame, ordinal: str, factor: int) -> DataFrame:
    """Every factor-th row, from the first: deterministic."""
    return df.where(F.col(ordinal) % factor == 0)


def head(df: DataFrame, ordinal: str, n: int = 5) -> DataFrame:
    return df.orderBy(ordinal).limit(n)


def by_position(df: DataFrame, items: Column, **aggregates: Callable[[Column], Column]) -> DataFrame:
    """(pos, ...): reductions over rows by place in the list (axis 0 of a ragged array); missing elements are skipped."""
    flat = df.select(F.posexplode(items).alias("pos", "x"))
    return flat.groupBy("pos").agg(*[make(F.col("x")).alias(name) for name, make in aggregates.items()])
