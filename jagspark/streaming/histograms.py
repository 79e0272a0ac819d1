"""Histograms of a stream: the fixed-bin fill as a streaming aggregate, so that results grow with each micro-batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.hist import bin_of


def fill(stream: DataFrame, x: Column, bins: int, low: float, high: float, weight: Column | None = None, time: str | None = None, window: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(bin, n, sumw): counts over a streaming DataFrame; with a time column and window, per window, behind a watermark.

    State is one row per bin (and open window). Write it with complete or update mode; windows also with append.
    """
    filled = stream.withColumn("bin", bin_of(x, bins, low, high)).withColumn("_w", (F.lit(1.0) if weight is None else weight).cast("double")).where("bin is not null")
    keys: list = ["bin"]
    if time is not None:
        filled = filled.withWatermark(time, late)
        keys = [F.window(time, window or "1 hour").alias("window"), "bin"]
    return filled.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("_w").alias("sumw"))
