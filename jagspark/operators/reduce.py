"""Reductions over all rows with NumPy's results: identities for no rows, NaN carried or skipped.

REDUCTIONS maps a name to a function of a column that gives an aggregate column; many share one `df.agg`, so one scan. Partial sums
combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.elementwise import NAN, div, truth


def _number(x: Column) -> Column:
    """x without NaN (NULL instead)."""
    return F.when(~F.isnan(x.cast("double")), x)


def _has_nan(x: Column) -> Column:
    return F.coalesce(F.bool_or(F.isnan(x.cast("double"))), F.lit(False))


def _variance(x: Column, ddof: int) -> Column:
    n = F.count(x)
    return F.when(n == 0, F.lit(NAN)).otherwise(div(F.var_pop(x.cast("double")) * n, F.greatest(n - ddof, F.lit(0).cast("long"))))


def weighted_mean(x: Column, weight: Column) -> Column:
    both = x.isNotNull() & weight.isNotNull()
    return div(F.sum(F.when(both, x * weight)), F.sum(F.when(both, weight)))


def argmin(x: Column, ordinal: Column, skip_nan: bool = False) -> Column:
    """Ordinal of the first least value; the first NaN comes before all unless skipped."""
    nan = F.isnan(x.cast("double"))
    ordered = F.struct((~nan).alias("n"), x.alias("x"), ordinal.alias("o"))
    return F.min_by(ordinal, F.when(x.isNotNull() & ~nan, ordered) if skip_nan else F.when(x.isNotNull(), ordered))


def argmax(x: Column, ordinal: Column, skip_nan: bool = False) -> Column:
    ordered = F.struct(x.cast("double").alias("x"), (-ordinal).alias("o"))  # NaN sorts last, so it wins
    return F.max_by(ordinal, F.when(x.isNotNull() & (~F.isnan(x.cast("double")) if skip_nan else F.lit(True)), ordered))


REDUCTIONS: dict[str, Callable[..., Column]] = {
    "count": F.count,
    "count_nonzero": lambda x: F.count_if(truth(x)),
    "sum": lambda x: F.coalesce(F.sum(x), F.lit(0)),
    "prod": lambda x: F.coalesce(F.product(x), F.lit(1.0)),
    "mean": lambda x: F.coalesce(F.avg(x), F.lit(NAN)),
    "var": lambda x, ddof=0: _variance(x, ddof),
    "std": lambda x, ddof=0: F.sqrt(_variance(x, ddof)),
    "min": lambda x: F.when(_has_nan(x), F.lit(NAN)).otherwise(F.min(x)),
    "max": lambda x: F.max(x),
    "ptp": lambda x: F.when(_has_nan(x), F.lit(NAN)).otherwise(F.max(x) - F.min(x)),
    "any": lambda x: F.coalesce(F.bool_or(truth(x)), F.lit(False)),
    "all": lambda x: F.coalesce(F.bool_and(truth(x)), F.lit(True)),
    "moment": lambda x, n=2: F.avg(F.pow(x, F.lit(float(n)))),
    "nansum": lambda x: F.coalesce(F.sum(_number(x)), F.lit(0.0)),
    "nanprod": lambda x: F.coalesce(F.product(_number(x)), F.lit(1.0)),
    "nanmean": lambda x: F.coalesce(F.avg(_number(x)), F.lit(NAN)),
    "nanmin": lambda x: F.coalesce(F.min(_number(x)), F.lit(NAN)),
    "nanmax": lambda x: F.coalesce(F.max(_number(x)), F.lit(NAN)),
    "nanvar": lambda x, ddof=0: _variance(_number(x), ddof),
    "nanstd": lambda x, ddof=0: F.sqrt(_variance(_number(x), ddof)),
}

#: Reductions of two columns, and those that name a row.
PAIRED: dict[str, Callable[..., Column]] = {
    "corr": F.corr,
    "covar": F.covar_pop,
    "linear_fit_slope": F.regr_slope,
    "linear_fit_intercept": F.regr_intercept,
    "mean_weighted": weighted_mean,
    "argmin": argmin,
    "argmax": argmax,
    "nanargmin": lambda x, o: argmin(x, o, skip_nan=True),
    "nanargmax": lambda x, o: argmax(x, o, skip_nan=True),
}


def linear_fit(y: Column, x: Column) -> Column:
    """struct(intercept, slope, intercept_error, slope_error) of y over x."""
    both = x.isNotNull() & y.isNotNull()
    n, sx, sxx = F.count_if(both).cast("double"), F.sum(F.when(both, x)), F.sum(F.when(both, x * x))
    delta = n * sxx - sx * sx
    return F.struct(F.regr_intercept(y, x).alias("intercept"), F.regr_slope(y, x).alias("slope"), F.sqrt(div(sxx, delta)).alias("intercept_error"), F.sqrt(div(n, delta)).alias("slope_error"))


def reduce(df: DataFrame, **outputs: Column) -> DataFrame:
    """One row with all outputs: one scan."""
    return df.agg(*[c.alias(k) for k, c in outputs.items()])


class Monoid:
    """A user's reduction: `step` takes a pandas frame to a partial row, `combine` folds frames of partials into one such row.

    Partials are made per batch and folded per group of partials in a tree, so that no task gathers more than `fan` of them.
    """

    def __init__(self, step: Callable, combine: Callable, schema: str, fan: int = 256):
        self.step, self.combine, self.schema, self.fan = step, combine, schema, fan

    def run(self, df: DataFrame) -> DataFrame:
        step, combine = self.step, self.combine

        def partial(frames):
            import pandas as pd

            held = [step(f) for f in frames if len(f)]
            while len(held) > 1:
                held = [combine(pd.concat(held[i : i + 2], ignore_index=True)) for i in range(0, len(held), 2)]
            yield from held

        parts = df.mapInPandas(partial, self.schema)
        n = max(1, parts.rdd.getNumPartitions())
        while n > self.fan:
            n = -(-n // self.fan)
            parts = parts.coalesce(n).mapInPandas(partial_fold(combine), self.schema)
        return parts.coalesce(1).mapInPandas(partial_fold(combine), self.schema)


def partial_fold(combine: Callable) -> Callable:
    def fold(frames):
        import pandas as pd

        held = None
        for frame in frames:  # a frame of partials at a time
            if len(frame):
                held = combine(frame if held is None else pd.concat([held, frame], ignore_index=True))
        if held is not None:
            yield held

    return fold
