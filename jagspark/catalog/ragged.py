"""rag_<operation>: list operations over all orders with their lineitems as lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ragged as R
from ..functions.elementwise import binary, unary
from .nested import LI_SQL, orders

class _Columns:
    """The lists that the expressions are made from; columns need a running session, so they are made when a query is."""

    def __init__(self) -> None:
        self.QTY, self.PRICE, self.DISC, self.TAX, self.N = (F.col(f"items.{f}") for f in ("qty", "price", "disc", "tax", "n"))
        self.X = F.transform(self.PRICE, lambda p: p / 1000)
        self.M = F.transform(self.QTY, lambda q: F.when(q <= 25, q))  # with missing elements
        self.Q_PRICE = F.transform(R.combinations(F.arrays_zip(self.N, self.QTY), 2), lambda pair: pair["0"]["qty"] * 100 + pair["1"]["qty"])


#: Name: one value per order, and the same as an aggregate over its lineitems.
SCALARS: dict[str, tuple[Callable[[_Columns], Column], str]] = {
    "count": (lambda c: R.count(c.M), "count(m)"),
    "count_nonzero": (lambda c: R.count_nonzero(c.DISC), "count(*) FILTER (disc <> 0)"),
    "sum": (lambda c: R.sum(c.M), "coalesce(sum(m), 0)"),
    "sum_mask_identity": (lambda c: R.sum(c.M, mask_identity=True), "sum(m)"),
    "prod": (lambda c: R.prod(c.TAX), "coalesce(product(tax), 1)"),
    "any": (lambda c: R.any(F.transform(c.QTY, lambda q: q > 45)).cast("int"), "coalesce(bool_or(qty > 45), false)::INT"),
    "all": (lambda c: R.all(F.transform(c.QTY, lambda q: q > 5)).cast("int"), "coalesce(bool_and(qty > 5), true)::INT"),
    "min": (lambda c: R.min(c.X), "min(x)"),
    "max": (lambda c: R.max(c.X), "max(x)"),
    "min_initial": (lambda c: R.min(c.QTY, initial=20.0), "least(coalesce(min(qty), 20), 20)"),
    "max_initial": (lambda c: R.max(c.QTY, initial=20.0), "greatest(coalesce(max(qty), 20), 20)"),
    "ptp": (lambda c: R.ptp(c.QTY), "max(qty) - min(qty)"),
    "mean": (lambda c: R.mean(c.M), "avg(m)"),
    "mean_weighted": (lambda c: R.mean(c.X, weight=c.QTY), "sum(x * qty) / sum(qty)"),
    "var": (lambda c: R.var(c.QTY), "var_pop(qty)"),
    "var_ddof1": (lambda c: R.var(c.QTY, ddof=1), "var_samp(qty)"),
    "std": (lambda c: R.std(c.QTY), "stddev_pop(qty)"),
    "moment": (lambda c: R.moment(c.QTY, 3), "avg(qty * qty * qty)"),
    "covar": (lambda c: R.covar(c.QTY, c.X), "covar_pop(qty, x)"),
    "corr": (lambda c: F.when(F.size(c.QTY) > 2, R.corr(c.QTY, c.N)), "CASE WHEN count(*) > 2 AND count(qty) > 2 AND var_pop(qty) > 0 AND var_pop(n) > 0 THEN corr(qty, n) END"),
    "linear_fit": (lambda c: R.linear_fit(c.N, c.QTY)["slope"], "CASE WHEN var_pop(n) > 0 THEN regr_slope(qty, n) END"),
    "linear_fit_intercept": (lambda c: R.linear_fit(c.N, c.QTY)["intercept"], "CASE WHEN var_pop(n) > 0 THEN regr_intercept(qty, n) END"),
    "linear_fit_slope_error": (lambda c: F.nullif(R.linear_fit(c.N, c.QTY)["slope_error"], F.lit(float("inf"))), "CASE WHEN count(n) * sum(n * n) > sum(n) * sum(n) THEN sqrt(count(n) / (count(n) * sum(n * n) - sum(n) * sum(n))::DOUBLE) END"),
    "linear_fit_intercept_error": (lambda c: F.nullif(R.linear_fit(c.N, c.QTY)["intercept_error"], F.lit(float("inf"))), "CASE WHEN count(n) * sum(n * n) > sum(n) * sum(n) THEN sqrt(sum(n * n) / (count(n) * sum(n * n) - sum(n) * sum(n))::DOUBLE) END"),
    "sum_whole": (lambda c: R.sum(F.transform(c.N, lambda n: n * 100000007)), "coalesce(sum(n::BIGINT * 100000007), 0)"),
    "min_identity": (lambda c: F.least(R.min(c.M, mask_identity=False), F.lit(1e6)), "coalesce(min(m), 1000000)"),
    "max_identity": (lambda c: F.greatest(R.max(c.M, mask_identity=False), F.lit(-1e6)), "coalesce(max(m), -1000000)"),
    "argmin_identity": (lambda c: R.argmin(c.M, mask_identity=False), "coalesce(min_by(pos, (m, pos)) FILTER (m IS NOT NULL), -1)"),
    "argmin": (lambda c: R.argmin(c.QTY), "min_by(pos, (qty, pos))"),
    "argmax": (lambda c: R.argmax(c.QTY), "min_by(pos, (-qty, pos))"),
    "num": (lambda c: R.num(c.QTY), "count(k2)"),
    "firsts": (lambda c: R.firsts(c.QTY), "min(qty) FILTER (pos = 0)"),
    "gather_argmin": (lambda c: F.get(R.take(c.X, R.argmin(c.QTY, keepdims=True)), 0), "min_by(x, (qty, pos))"),
    "combinations2_num": (lambda c: F.size(R.combinations(c.N, 2)), "(count(k2) * (count(k2) - 1)) // 2"),
    "combinations3_num": (lambda c: F.size(R.combinations(c.N, 3)), "(count(k2) * (count(k2) - 1) * (count(k2) - 2)) // 6"),
    "combinations_replacement_num": (lambda c: F.size(R.combinations(c.N, 2, replacement=True)), "(count(k2) * (count(k2) + 1)) // 2"),
    "argcartesian_num": (lambda c: F.size(R.argcartesian([c.M, c.N])), "count(k2) * count(k2)"),
}

#: Name: a list per order, shown as (k, pos, r), and the same rows from the lineitems.
LISTS: dict[str, tuple[Callable[[_Columns], Column], str]] = {
    "softmax": (lambda c: R.softmax(c.TAX), "SELECT k, pos, exp(tax) / sum(exp(tax)) OVER (PARTITION BY k) AS r FROM li"),
    "combinations": (lambda c: c.Q_PRICE, "SELECT a.k, row_number() OVER (PARTITION BY a.k ORDER BY a.pos, b.pos) - 1 AS pos, a.qty * 100 + b.qty AS r FROM li a JOIN li b ON a.k = b.k AND a.pos < b.pos"),
    "argcombinations": (
        lambda c: F.transform(R.argcombinations(c.N, 3), lambda t: t["0"] * 10000 + t["1"] * 100 + t["2"]),
        "SELECT a.k, row_number() OVER (PARTITION BY a.k ORDER BY a.pos, b.pos, c.pos) - 1 AS pos, a.pos * 10000 + b.pos * 100 + c.pos AS r FROM li a JOIN li b ON a.k = b.k AND a.pos < b.pos JOIN li c ON a.k = c.k AND b.pos < c.pos",
    ),
    "cartesian": (
        lambda c: F.transform(R.cartesian({"a": c.QTY, "b": c.TAX}), lambda t: t["a"] + t["b"]),
        "SELECT a.k, a.pos * a.size + b.pos AS pos, a.qty + b.tax AS r FROM li a JOIN li b ON a.k = b.k",
    ),
    "cartesian_nested": (
        lambda c: F.transform(R.cartesian([c.QTY, c.TAX], nested=True), lambda t: R.sum(F.transform(t, lambda s: s["0"] * s["1"]))),
        "SELECT a.k, a.pos, sum(a.qty * b.tax) AS r FROM li a JOIN li b ON a.k = b.k GROUP BY a.k, a.pos",
    ),
    "argcartesian": (
        lambda c: F.transform(R.argcartesian([c.M, c.N]), lambda t: t["0"] * 100 + t["1"]),
        "SELECT a.k, a.pos * a.size + b.pos AS pos, a.pos * 100 + b.pos AS r FROM li a JOIN li b ON a.k = b.k",
    ),
    "combinations_replacement": (
        lambda c: F.transform(R.argcombinations(c.N, 2, replacement=True), lambda t: t["0"] * 100 + t["1"]),
        "SELECT a.k, row_number() OVER (PARTITION BY a.k ORDER BY a.pos, b.pos) - 1 AS pos, a.pos * 100 + b.pos AS r FROM li a JOIN li b ON a.k = b.k AND a.pos <= b.pos",
    ),
    "singletons": (lambda c: R.singletons(F.when(F.col("met") > 100000, F.col("met"))), "SELECT k, 0 AS pos, met AS r FROM ev WHERE met > 100000"),
    "running": (lambda c: R.running(c.QTY), "SELECT k, pos, sum(qty) OVER (PARTITION BY k ORDER BY pos) AS r FROM li"),
    "broadcast_arrays_three": (
        lambda c: F.transform(R.zip(dict(zip("abc", R.broadcast_arrays([c.QTY, F.col("met"), c.TAX], [True, False, True])))), lambda s: s["a"] + s["b"] * s["c"]),
        "SELECT k, pos, qty + met * tax AS r FROM li",
    ),
    "zeros_like_own_type": (lambda c: R.zeros_like(c.N, None), "SELECT k, pos, 0 AS r FROM li"),
    "zip": (lambda c: F.transform(R.zip({"a": c.QTY, "m": F.col("met")}, scalars=["m"]), lambda s: s["a"] + s["m"]), "SELECT k, pos, qty + met AS r FROM li"),
    "unzip": (lambda c: R.unzip(F.col("items"), "disc")[0], "SELECT k, pos, disc AS r FROM li"),
    "with_field": (lambda c: F.transform(R.with_field(F.col("items"), c.X, "z"), lambda s: s["z"] + s["qty"]), "SELECT k, pos, x + qty AS r FROM li"),
    "without_field": (lambda c: F.transform(R.without_field(F.col("items"), "flag", "tax"), lambda s: s["qty"]), "SELECT k, pos, qty AS r FROM li"),
    "fields": (lambda c: F.transform(R.fields(F.col("items"), "tax", "qty"), lambda s: s["tax"] + s["qty"]), "SELECT k, pos, tax + qty AS r FROM li"),
    "keep": (lambda c: R.keep(c.X, F.transform(c.QTY, lambda q: q > 25)), "SELECT k, row_number() OVER (PARTITION BY k ORDER BY pos) - 1 AS pos, x AS r FROM li WHERE qty > 25"),
    "local_index": (lambda c: R.local_index(c.QTY), "SELECT k, pos, pos AS r FROM li"),
    "sort": (lambda c: R.sort(c.X), "SELECT k, row_number() OVER (PARTITION BY k ORDER BY x) - 1 AS pos, x AS r FROM li"),
    "sort_descending": (lambda c: R.sort(c.X, ascending=False), "SELECT k, row_number() OVER (PARTITION BY k ORDER BY x DESC) - 1 AS pos, x AS r FROM li"),
    "argsort": (lambda c: R.argsort(c.QTY), "SELECT k, row_number() OVER (PARTITION BY k ORDER BY qty, pos) - 1 AS pos, pos AS r FROM li"),
    "argsort_descending": (lambda c: R.argsort(c.QTY, ascending=False), "SELECT k, row_number() OVER (PARTITION BY k ORDER BY qty DESC, pos) - 1 AS pos, pos AS r FROM li"),
    "concatenate": (lambda c: R.concatenate([c.QTY, c.TAX]), "SELECT k, pos, qty AS r FROM li UNION ALL SELECT k, pos + size, tax FROM li"),
    "flatten": (lambda c: R.flatten(F.transform(c.QTY, lambda q: F.array(q, q + 1))), "SELECT k, 2 * pos + d AS pos, qty + d AS r FROM li, range(2) t(d)"),
    "unflatten": (
        lambda c: F.transform(R.unflatten(R.concatenate([c.QTY, c.QTY]), F.array(F.size(c.QTY), F.size(c.QTY))), lambda t: R.sum(t)),
        "SELECT k, d AS pos, coalesce((SELECT sum(qty) FROM li WHERE li.k = ev.k), 0) AS r FROM ev, range(2) t(d)",
    ),
    "run_lengths": (
        lambda c: R.run_lengths(F.col("items.flag")),
        "SELECT k, row_number() OVER (PARTITION BY k ORDER BY run) - 1 AS pos, count(*) AS r FROM (SELECT k, sum(new) OVER (PARTITION BY k ORDER BY pos) AS run FROM (SELECT k, pos, (flag IS DISTINCT FROM lag(flag) OVER (PARTITION BY k ORDER BY pos))::INT AS new FROM li)) GROUP BY k, run",
    ),
    "broadcast_arrays": (lambda c: R.broadcast_to(F.col("met"), c.QTY), "SELECT k, pos, met AS r FROM li"),
    "to_regular": (lambda c: R.from_regular(R.to_regular(F.array(F.col("met"), F.col("met") + 1), 2)), "SELECT k, d AS pos, met + d AS r FROM ev, range(2) t(d)"),
    "where": (lambda c: R.where(F.transform(c.QTY, lambda q: q > 25), c.X, F.col("met"), (True, True, False)), "SELECT k, pos, CASE WHEN qty > 25 THEN x ELSE met END AS r FROM li"),
    "filter": (lambda c: F.filter(c.QTY, lambda q: q > 30), "SELECT k, row_number() OVER (PARTITION BY k ORDER BY pos) - 1 AS pos, qty AS r FROM li WHERE qty > 30"),
    "take": (lambda c: R.take(c.X, R.argsort(c.QTY)), "SELECT k, row_number() OVER (PARTITION BY k ORDER BY qty, pos) - 1 AS pos, x AS r FROM li"),
    "mask": (lambda c: R.mask(c.QTY, F.transform(c.TAX, lambda t: t > 0.04)), "SELECT k, pos, CASE WHEN tax > 0.04 THEN qty END AS r FROM li"),
    "is_none": (lambda c: F.transform(R.is_none(c.M), lambda b: b.cast("int")), "SELECT k, pos, (m IS NULL)::INT AS r FROM li"),
    "fill_none": (lambda c: R.fill_none(c.M, -1.0), "SELECT k, pos, coalesce(m, -1) AS r FROM li"),
    "drop_none": (lambda c: R.drop_none(c.M), "SELECT k, row_number() OVER (PARTITION BY k ORDER BY pos) - 1 AS pos, m AS r FROM li WHERE m IS NOT NULL"),
    "pad_none": (lambda c: R.pad_none(c.QTY, 4), "SELECT k, pos, qty AS r FROM li UNION ALL SELECT k, d, NULL FROM ev, range(4) t(d) WHERE d >= (SELECT count(*) FROM li WHERE li.k = ev.k)"),
    "pad_none_clip": (lambda c: R.pad_none(c.QTY, 3, clip=True), "SELECT ev.k, d AS pos, qty AS r FROM (ev CROSS JOIN range(3) t(d)) LEFT JOIN li ON li.k = ev.k AND li.pos = d"),
    "zeros_like": (lambda c: R.zeros_like(c.M), "SELECT k, pos, CASE WHEN m IS NOT NULL THEN 0 END AS r FROM li"),
    "ones_like": (lambda c: R.ones_like(c.QTY), "SELECT k, pos, 1 AS r FROM li"),
    "full_like": (lambda c: R.full_like(c.QTY, 2.5), "SELECT k, pos, 2.5 AS r FROM li"),
    "nan_to_num": (lambda c: F.transform(c.TAX, lambda t: R.nan_to_num(unary("log", t), neginf=-99.0)), "SELECT k, pos, CASE WHEN tax = 0 THEN -99 ELSE ln(tax) END AS r FROM li"),
    "isclose": (lambda c: F.transform(c.QTY, lambda q: R.isclose(q, 25.0, rtol=0.1).cast("int")), "SELECT k, pos, (abs(qty - 25) <= 1e-8 + 2.5)::INT AS r FROM li"),
    "values_astype": (lambda c: R.values_astype(c.X, "int"), "SELECT k, pos, trunc(x) AS r FROM li"),
    "ufunc_lists": (lambda c: binary("mul", c.QTY, unary("sqrt", c.X, 1), 1), "SELECT k, pos, qty * sqrt(x) AS r FROM li"),
    "ufunc_broadcast": (lambda c: binary("sub", F.col("met"), c.PRICE, (0, 1)), "SELECT k, pos, met - price AS r FROM li"),
}


def _round(r: Column) -> Column:
    # the shift keeps exact halves of the last decimal, which many ratios of small numbers are, from depending on the last bit
    r = r.cast("double")
    return F.when(~F.isnan(r), F.round(r + 3e-8, 5) + 0.0).alias("r")


def _scalar(make: Callable[[_Columns], Column]) -> Callable[[SparkSession, str], DataFrame]:
    # the value is a column of its own, so that rounding it, which names it twice, does not make it twice
    return lambda spark, sf_dir: orders(spark, sf_dir).select("k", make(_Columns()).alias("r")).select("k", _round(F.col("r")))


def _list(make: Callable[[_Columns], Column]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        shown = orders(spark, sf_dir).select("k", F.posexplode(make(_Columns())).alias("pos", "r"))
        return shown.select("k", F.col("pos").cast("long").alias("pos"), _round(F.col("r")))

    return run


_SHOW = "CASE WHEN NOT isnan(r) THEN round(r + 3e-8::DOUBLE, 5) + 0.0::DOUBLE END AS r"

QUERIES = {f"rag_{k}": _scalar(v) for k, (v, _) in SCALARS.items()} | {f"rag_{k}": _list(v) for k, (v, _) in LISTS.items()}
ORACLE_SQL = {
    f"rag_{k}": f"WITH {LI_SQL} SELECT k, {_SHOW} FROM (SELECT ev.k, ({sql})::DOUBLE AS r FROM ev LEFT JOIN (SELECT *, k AS k2 FROM li) li ON li.k = ev.k GROUP BY ev.k)".replace("any_value(met)", "any_value(ev.met)")
    for k, (_, sql) in SCALARS.items()
} | {f"rag_{k}": f"WITH {LI_SQL} SELECT k, pos::BIGINT AS pos, {_SHOW} FROM (SELECT k, pos, r::DOUBLE AS r FROM ({sql}))" for k, (_, sql) in LISTS.items()}
