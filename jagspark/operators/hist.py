"""Histograms with fixed bins: counts and weighted fills, in one or more dimensions, and systematic variations as rows.

A fill is a bin expression and a grouped sum, combined before the shuffle; the result has one row per bin, empty ones too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bin_of(x: Column, bins: int, low: float, high: float, closed_right: bool = True) -> Column:
    """The bin of x, NULL outside [low, high], for NaN and NULL. Edges decide where the division rounds across one.

    closed_right: x = high falls into the last bin, as NumPy has it; else it is out.
    """
    x = x.cast("double")
    width = (high - low) / bins
    edge = lambda i: F.lit(low) + i * F.lit(width)
    inside = (x >= low) & ((x <= high) if closed_right else (x < high)) & ~F.isnan(x)
    guess = F.least(F.floor((x - low) * F.lit(bins / (high - low))), F.lit(bins - 1).cast("long"))
    moved = F.when(x < edge(guess), guess - 1).when((x >= edge(guess + 1)) & (guess < bins - 1), guess + 1).otherwise(guess)
    return F.when(inside, F.greatest(moved, F.lit(0).cast("long")))


def _valued(df: DataFrame, x: list[Column], *kept: Column) -> DataFrame:
    """x0, x1, ... and the kept columns: the bins' expressions name x several times, and must not make it anew each time."""
    return df.select(*[c.cast("double").alias(f"_x{i}") for i, c in enumerate(x)], *kept)


def _weights(weight: Column | None) -> list[Column]:
    return [] if weight is None else [weight.cast("double").alias("_w")]


def histogram(df: DataFrame, x: Column, bins: int, low: float, high: float, weight: Column | None = None, closed_right: bool = True) -> DataFrame:
    """(bin, low, high, n), and with a weight sumw and sumw2."""
    aggregates = [F.count("*").alias("n")]
    if weight is not None:
        aggregates += [F.sum("_w").alias("sumw"), F.sum(F.col("_w") * F.col("_w")).alias("sumw2")]
    filled = _valued(df, [x], *_weights(weight)).withColumn("bin", bin_of(F.col("_x0"), bins, low, high, closed_right)).where("bin is not null").groupBy("bin").agg(*aggregates)
    width = (high - low) / bins
    axis = df.sparkSession.range(bins).select(F.col("id").alias("bin"), (F.lit(low) + F.col("id") * width).alias("low"), (F.lit(low) + (F.col("id") + 1) * width).alias("high"))
    out = axis.join(filled, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return out if weight is None else out.withColumns({k: F.coalesce(k, F.lit(0.0)) for k in ("sumw", "sumw2")})


def histogramdd(df: DataFrame, axes: list[tuple[Column, int, float, float]], weight: Column | None = None) -> DataFrame:
    """(bin0, bin1, ..., n) or sumw: all bins of a grid."""
    names = [f"bin{i}" for i in range(len(axes))]
    value = (F.count("*") if weight is None else F.sum("_w")).alias("n" if weight is None else "sumw")
    filled = _valued(df, [axis[0] for axis in axes], *_weights(weight))
    filled = filled.withColumns({n: bin_of(F.col(f"_x{i}"), *axis[1:]) for i, (axis, n) in enumerate(zip(axes, names, strict=True))})
    filled = filled.where(reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])).groupBy(*names).agg(value)
    grid = df.sparkSession.range(1)
    for (_, bins, _, _), n in zip(axes, names, strict=True):
        grid = grid.withColumn(n, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    last = "n" if weight is None else "sumw"
    return grid.drop("id").join(filled, names, "left").withColumn(last, F.coalesce(last, F.lit(0).cast("long" if weight is None else "double")))


def variations(df: DataFrame, axis: str, values: dict[str, Column]) -> DataFrame:
    """Every row once per variation: `axis` names it, `value` is its value. The plan has one size whatever their number."""
    made = F.array(*[F.struct(F.lit(k).alias("name"), v.cast("double").alias("value")) for k, v in values.items()])
    return df.withColumn("_v", F.explode(made)).select(*df.columns, F.col("_v.name").alias(axis), F.col("_v.value").alias("value"))


def histograms_by(df: DataFrame, axis: str, x: Column, bins: int, low: float, high: float, weight: Column | None = None, closed_right: bool = True) -> DataFrame:
    """(axis, bin, n[, sumw]) of the bins that have rows, for every value of the axis in one job."""
    filled = _valued(df, [x], F.col(axis), (weight if weight is not None else F.lit(1.0)).cast("double").alias("_w"))
    filled = filled.withColumn("bin", bin_of(F.col("_x0"), bins, low, high, closed_right)).where("bin is not null")
    return filled.groupBy(axis, "bin").agg(F.count("*").alias("n"), *[F.sum("_w").alias("sumw")] * (weight is not None))
