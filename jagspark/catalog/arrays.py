"""arr_*, hist*, join_* and further queries over flat columns: events in the order of event_id, lineitem, orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ragged as R
from ..functions.elementwise import NAN
from ..operators import blocks as B
from ..operators import hist as H
from ..operators import relational as J
from ..operators import reduce as D
from .nested import LI_SQL, orders


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o (ordinal), v, w (v with NaN and missing values made from the data)."""
    w = F.when(F.col("user_id") % 11 == 0, F.lit(NAN)).when(F.col("user_id") % 13 != 0, F.col("value"))
    return _read(spark, sf_dir, "events").select(F.col("event_id").alias("o"), F.col("value").alias("v"), w.alias("w"), "event_type", "user_id")


_EV = "e AS (SELECT event_id AS o, value AS v, CASE WHEN user_id % 11 = 0 THEN 'NaN'::DOUBLE WHEN user_id % 13 <> 0 THEN value END AS w, event_type, user_id FROM events)"

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, sql: str):
    def put(run):
        QUERIES[name], ORACLE_SQL[name] = run, sql
        return run

    return put


def _r(c, digits: int = 4):
    return F.round(c.cast("double") + 3e-9, digits) + 0.0


def _rs(sql: str, digits: int = 4) -> str:
    return f"round(({sql})::DOUBLE + 3e-9::DOUBLE, {digits}) + 0.0::DOUBLE"


# ---------------------------------------------------------------- reductions

_FINITE = "FILTER (NOT isnan(w))"
#: Name: (column, digits, SQL).
_REDUCE = {
    "count": (lambda: D.REDUCTIONS["count"](F.col("w")), "count(w)"),
    "count_nonzero": (lambda: D.REDUCTIONS["count_nonzero"](F.col("v") - 1), "count(*) FILTER (v <> 1)"),
    "sum": (lambda: D.REDUCTIONS["sum"](F.col("v")), "sum(v)"),
    "prod": (lambda: D.REDUCTIONS["prod"](F.lit(1.0) + F.col("v") / 1e7), "product(1 + v / 1e7::DOUBLE)"),
    "mean": (lambda: D.REDUCTIONS["mean"](F.col("v")), "avg(v)"),
    "var": (lambda: D.REDUCTIONS["var"](F.col("v")), "var_pop(v)"),
    "var_ddof1": (lambda: D.REDUCTIONS["var"](F.col("v"), 1), "var_samp(v)"),
    "std": (lambda: D.REDUCTIONS["std"](F.col("v")), "stddev_pop(v)"),
    "min": (lambda: D.REDUCTIONS["min"](F.col("v")), "min(v)"),
    "max": (lambda: D.REDUCTIONS["max"](F.col("v")), "max(v)"),
    "ptp": (lambda: D.REDUCTIONS["ptp"](F.col("v")), "max(v) - min(v)"),
    "any": (lambda: D.REDUCTIONS["any"](F.col("v") > 400).cast("int"), "bool_or(v > 400)::INT"),
    "all": (lambda: D.REDUCTIONS["all"](F.col("v") > 0).cast("int"), "bool_and(v > 0)::INT"),
    "moment": (lambda: D.REDUCTIONS["moment"](F.col("v") / 100, 3), "avg(pow(v / 100, 3))"),
    "nansum": (lambda: D.REDUCTIONS["nansum"](F.col("w")), f"sum(w) {_FINITE}"),
    "nanprod": (lambda: D.REDUCTIONS["nanprod"](F.lit(1.0) + F.col("w") / 1e7), f"product(1 + w / 1e7::DOUBLE) {_FINITE}"),
    "nanmean": (lambda: D.REDUCTIONS["nanmean"](F.col("w")), f"avg(w) {_FINITE}"),
    "nanmin": (lambda: D.REDUCTIONS["nanmin"](F.col("w")), f"min(w) {_FINITE}"),
    "nanmax": (lambda: D.REDUCTIONS["nanmax"](F.col("w")), f"max(w) {_FINITE}"),
    "nanvar": (lambda: D.REDUCTIONS["nanvar"](F.col("w")), f"var_pop(w) {_FINITE}"),
    "nanstd": (lambda: D.REDUCTIONS["nanstd"](F.col("w")), f"stddev_pop(w) {_FINITE}"),
    "argmin": (lambda: D.argmin(F.col("v"), F.col("o")), "min_by(o, (v, o))"),
    "argmax": (lambda: D.argmax(F.col("v"), F.col("o")), "min_by(o, (-v, o))"),
    "argmin_nan": (lambda: D.argmin(F.col("w"), F.col("o")), "min(o) FILTER (isnan(w))"),
    "nanargmin": (lambda: D.PAIRED["nanargmin"](F.col("w"), F.col("o")), f"min_by(o, (w, o)) {_FINITE}"),
    "nanargmax": (lambda: D.PAIRED["nanargmax"](F.col("w"), F.col("o")), f"min_by(o, (-w, o)) {_FINITE}"),
    "corr": (lambda: D.PAIRED["corr"](F.col("v"), F.col("user_id")), "corr(v, user_id)"),
    "covar": (lambda: D.PAIRED["covar"](F.col("v"), F.col("user_id")), "covar_pop(v, user_id)"),
    "linear_fit": (lambda: D.linear_fit(F.col("v"), F.col("user_id").cast("double"))["slope"], "regr_slope(v, user_id)"),
    "linear_fit_intercept": (lambda: D.linear_fit(F.col("v"), F.col("user_id").cast("double"))["intercept"], "regr_intercept(v, user_id)"),
    "linear_fit_intercept_error": (lambda: D.linear_fit(F.col("v"), F.col("user_id").cast("double"))["intercept_error"], "sqrt(sum(user_id::DOUBLE * user_id) / (count(*) * sum(user_id::DOUBLE * user_id) - pow(sum(user_id::DOUBLE), 2)))"),
    "linear_fit_slope_error": (lambda: D.linear_fit(F.col("v"), F.col("user_id").cast("double"))["slope_error"] * 1000, "1000 * sqrt(count(*) / (count(*) * sum(user_id::DOUBLE * user_id) - pow(sum(user_id::DOUBLE), 2)))"),
    "mean_weighted": (lambda: D.weighted_mean(F.col("v"), F.col("user_id")), "sum(v * user_id) / sum(user_id)"),
}
for _name, (_column, _sql) in _REDUCE.items():
    _add(f"arr_{_name}", f"WITH {_EV} SELECT {_rs(_sql, 6)} AS r FROM e")(lambda spark, sf_dir, c=_column: D.reduce(_events(spark, sf_dir), r=_r(c(), 6)))


@_add("arr_aggregate_many", f"WITH {_EV} SELECT {_rs('sum(v)')} AS total, {_rs('avg(v)')} AS mean, {_rs('max(v)')} AS top, count(*) AS n FROM e")
def _many(spark, sf_dir):
    v = F.col("v")
    return D.reduce(_events(spark, sf_dir), total=_r(D.REDUCTIONS["sum"](v)), mean=_r(D.REDUCTIONS["mean"](v)), top=_r(D.REDUCTIONS["max"](v)), n=F.count("*"))


@_add("rag_axis0", f"WITH {LI_SQL} SELECT pos::INTEGER AS pos, {_rs('sum(qty)')} AS total, {_rs('max(price)')} AS top, count(*) AS n FROM li GROUP BY pos")
def _axis0(spark, sf_dir):
    out = B.by_position(orders(spark, sf_dir), F.col("items"), total=lambda s: F.sum(s["qty"]), top=lambda s: F.max(s["price"]), n=lambda s: F.count("*"))
    return out.select("pos", _r(F.col("total")).alias("total"), _r(F.col("top")).alias("top"), "n")


# ---------------------------------------------------------------- scans, neighbours, positions

_ROWS = "ORDER BY o ROWS UNBOUNDED PRECEDING"
for _kind, _value, _sql in (
    ("cumsum", lambda: F.col("v"), f"sum(v) OVER ({_ROWS})"),
    ("cumprod", lambda: 1 + F.col("v") / 1e7, f"product(1 + v / 1e7::DOUBLE) OVER ({_ROWS})"),
    ("nancumsum", lambda: F.coalesce("w", F.lit(0.0)), f"sum(CASE WHEN w IS NULL OR isnan(w) THEN 0 ELSE w END) OVER ({_ROWS})"),
    ("nancumprod", lambda: 1 + F.coalesce("w", F.lit(0.0)) / 1e7, f"product(CASE WHEN isnan(w) THEN 1 ELSE 1 + coalesce(w, 0) / 1e7::DOUBLE END) OVER ({_ROWS})"),
):
    _add(f"arr_{_kind}", f"WITH {_EV} SELECT o, {_rs('r', 3)} AS r FROM (SELECT o, {_sql} AS r FROM e)")(
        lambda spark, sf_dir, k=_kind, x=_value: B.scan(_events(spark, sf_dir).withColumn("x", x()), "o", "x", k, "s").select("o", _r(F.col("s"), 3).alias("r"))
    )


@_add("arr_diff", f"WITH {_EV} SELECT o, {_rs('r')} AS r FROM (SELECT o, v - lag(v) OVER (ORDER BY o) AS r FROM e) WHERE r IS NOT NULL")
def _diff(spark, sf_dir):
    return B.diff(_events(spark, sf_dir), "o", "v").select("o", _r(F.col("diff")).alias("r"))


@_add("arr_run_lengths", f"WITH {_EV} SELECT run::BIGINT AS run, event_type, count(*) AS n FROM (SELECT event_type, sum(new) OVER (ORDER BY o) - 1 AS run FROM (SELECT o, event_type, (event_type IS DISTINCT FROM lag(event_type) OVER (ORDER BY o))::INT AS new FROM e)) GROUP BY 1, 2")
def _runs(spark, sf_dir):
    return B.run_lengths(_events(spark, sf_dir), "o", "event_type")


@_add("arr_unflatten", "SELECT c.g AS g, coalesce(count(e.event_id), 0) AS n, " + _rs("coalesce(sum(e.value), 0)") + " AS total FROM (SELECT user_id AS g, n, sum(n) OVER (ORDER BY user_id) AS stop FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)) c LEFT JOIN events e ON e.event_id >= c.stop - c.n AND e.event_id < c.stop GROUP BY c.g")
def _unflatten(spark, sf_dir):
    e = _events(spark, sf_dir)
    counts = e.groupBy(F.col("user_id").alias("g")).agg(F.count("*").alias("n"))
    out = B.unflatten(e, "o", counts, "g", "n", value="v")
    return out.select("g", R.num(F.col("items")).alias("n"), _r(R.sum(F.col("items"))).alias("total"))


@_add("arr_slice", f"WITH {_EV} SELECT o, v FROM e WHERE o >= 10 AND o < (SELECT count(*) FROM e) - 5 AND (o - 10) % 7 = 0")
def _slice(spark, sf_dir):
    return B.take_slice(_events(spark, sf_dir), "o", 10, -5, 7).select("o", "v")


@_add("arr_index", f"WITH {_EV} SELECT o, v FROM e WHERE o = (SELECT count(*) FROM e) - 3")
def _index(spark, sf_dir):
    return B.take_index(_events(spark, sf_dir), "o", -3).select("o", "v")


@_add("arr_take", f"WITH {_EV} SELECT a.o, b.v AS r FROM e a JOIN e b ON b.o = (a.o * 7) % (SELECT count(*) FROM e)")
def _take(spark, sf_dir):
    e = _events(spark, sf_dir)
    n = e.count()
    return B.gather(e.select(F.col("o").alias("at"), "v"), "at", e.select("o", ((F.col("o") * 7) % n).alias("i")), "i").select("o", F.col("v").alias("r"))


@_add("arr_filter", f"WITH {_EV} SELECT o, v FROM e WHERE v > 100")
def _filter(spark, sf_dir):
    return B.keep(_events(spark, sf_dir), F.col("v") > 100).select("o", "v")


@_add("arr_position_order", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders")
def _position_order(spark, sf_dir):
    """A dense place for every order, in the order of its key."""
    return B.with_position(_read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "place").select("o_orderkey", "place")


@_add("arr_position", "SELECT l_extendedprice AS v, count(*) AS n FROM lineitem GROUP BY 1")
def _position(spark, sf_dir):
    keyed = _read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("k"), "l_extendedprice")
    placed = B.with_position(keyed, "k")
    return placed.groupBy(F.col("l_extendedprice").alias("v")).agg(F.count_distinct("ordinal").alias("n"))


@_add("arr_reshape", f"WITH {_EV} SELECT o // 10 AS row, {_rs('sum(v * (o % 10))')} AS r FROM e GROUP BY 1")
def _reshape(spark, sf_dir):
    lists = B.reshape(_events(spark, sf_dir), "o", "v", 10)
    return lists.select("row", _r(R.sum(F.transform("items", lambda x, i: x * i))).alias("r"))


@_add("arr_concatenate", f"WITH {_EV} SELECT o, v FROM e UNION ALL SELECT o + (SELECT count(*) FROM e), v + 1 FROM e")
def _concatenate(spark, sf_dir):
    e = _events(spark, sf_dir).select("o", "v")
    return B.concatenate([e, e.withColumn("v", F.col("v") + 1)], "o")


@_add("arr_sample", f"WITH {_EV} SELECT o, v FROM e WHERE o % 9 = 0")
def _sample(spark, sf_dir):
    return B.stride_sample(_events(spark, sf_dir), "o", 9).select("o", "v")


@_add("arr_head", f"WITH {_EV} SELECT o, v FROM e ORDER BY o LIMIT 7")
def _head(spark, sf_dir):
    return B.head(_events(spark, sf_dir), "o", 7).select("o", "v")


@_add("arr_unique", "SELECT DISTINCT user_id FROM events")
def _unique(spark, sf_dir):
    return J.unique(_read(spark, sf_dir, "events"), "user_id")


@_add("arr_bincount", "SELECT t.v AS value, count(e.user_id) AS n FROM (SELECT unnest(range(0, (SELECT max(user_id) FROM events) + 1)) AS v) t LEFT JOIN events e ON e.user_id = t.v GROUP BY 1")
def _bincount(spark, sf_dir):
    return J.bincount(_read(spark, sf_dir, "events"), "user_id")


@_add("arr_isin", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) AS hit FROM customer")
def _isin(spark, sf_dir):
    rich = _read(spark, sf_dir, "orders").where("o_totalprice > 200000")
    return J.isin(_read(spark, sf_dir, "customer"), "c_custkey", rich, "o_custkey", "hit").select("c_custkey", "hit")


@_add("arr_searchsorted", "SELECT event_id, (value > 1)::INT + (value > 10)::INT + (value > 50)::INT + (value > 100)::INT AS at_left, (value >= 1)::INT + (value >= 10)::INT + (value >= 50)::INT + (value >= 100)::INT AS at_right FROM events")
def _searchsorted(spark, sf_dir):
    edges, v = F.array(*[F.lit(x) for x in (1.0, 10.0, 50.0, 100.0)]), F.col("value")
    return _read(spark, sf_dir, "events").select("event_id", J.searchsorted(edges, v).alias("at_left"), J.searchsorted(edges, v, "right").alias("at_right"))


@_add("arr_clip_round", "SELECT event_id, least(greatest(value, 5), 50) AS c, round_even(value, 1) AS r FROM events")
def _clip(spark, sf_dir):
    v = F.col("value")
    return _read(spark, sf_dir, "events").select("event_id", F.when(F.isnan(v), v).otherwise(F.least(F.greatest(v, F.lit(5.0)), F.lit(50.0))).alias("c"), (F.rint(v * 10) / 10).alias("r"))


@_add("arr_regular", "SELECT vec_id, " + _rs("list_sum(embedding[1:8])", 3) + " AS s, embedding[4]::DOUBLE AS x, len(embedding) AS n, " + _rs("list_sum([embedding[i] * embedding[i + 8] for i in range(1, 9)])", 3) + " AS d FROM embeddings")
def _regular(spark, sf_dir):
    """Inner geometry of a regular array: slices, index, swapped axes of the 8 x 8 view."""
    c = R.to_regular(F.col("embedding"), 64)
    grid = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(c, i * 8 + 1, F.lit(8)))
    swapped = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.transform(grid, lambda row: F.get(row, j)))
    first_two = F.transform(swapped, lambda col: F.get(col, 0).cast("double") * F.get(col, 1).cast("double"))
    return _read(spark, sf_dir, "embeddings").select("vec_id", _r(R.sum(F.slice(c, 1, 8)), 3).alias("s"), F.get(c, 3).cast("double").alias("x"), R.num(c).alias("n"), _r(R.sum(first_two), 3).alias("d"))


# ---------------------------------------------------------------- histograms


def _bin(x: str, bins: int, low: float, high: float, closed: bool = True) -> str:
    width = (high - low) / bins
    guess = f"least(floor(({x} - {low!r}::DOUBLE) * {bins / (high - low)!r}::DOUBLE)::BIGINT, {bins - 1})"
    end = "<=" if closed else "<"
    return f"""CASE WHEN {x} >= {low!r}::DOUBLE AND {x} {end} {high!r}::DOUBLE AND NOT isnan({x}) THEN
      CASE WHEN {x} < {low!r}::DOUBLE + {guess} * {width!r}::DOUBLE THEN {guess} - 1 WHEN {x} >= {low!r}::DOUBLE + ({guess} + 1) * {width!r}::DOUBLE AND {guess} < {bins - 1} THEN {guess} + 1 ELSE {guess} END END"""


@_add("hist1d", f"SELECT t.b AS bin, count(h.b) AS n FROM (SELECT unnest(range(50)) AS b) t LEFT JOIN (SELECT {_bin('o_totalprice', 50, 0.0, 250000.0)} AS b FROM orders) h ON h.b = t.b GROUP BY 1")
def _hist1d(spark, sf_dir):
    return H.histogram(_read(spark, sf_dir, "orders"), F.col("o_totalprice"), 50, 0.0, 250000.0).select("bin", "n")


@_add("hist1d_open", f"SELECT t.b AS bin, count(h.b) AS n FROM (SELECT unnest(range(10)) AS b) t LEFT JOIN (SELECT {_bin('l_quantity', 10, 0.0, 50.0, False)} AS b FROM lineitem) h ON h.b = t.b GROUP BY 1")
def _hist_open(spark, sf_dir):
    return H.histogram(_read(spark, sf_dir, "lineitem"), F.col("l_quantity"), 10, 0.0, 50.0, closed_right=False).select("bin", "n")


@_add("hist2d", f"SELECT t.a AS bin0, u.b AS bin1, count(h.a) AS n FROM (SELECT unnest(range(10)) AS a) t CROSS JOIN (SELECT unnest(range(8)) AS b) u LEFT JOIN (SELECT {_bin('l_quantity', 10, 0.0, 50.0)} AS a, {_bin('l_extendedprice', 8, 0.0, 60000.0)} AS b FROM lineitem) h ON h.a = t.a AND h.b = u.b GROUP BY 1, 2")
def _hist2d(spark, sf_dir):
    return H.histogramdd(_read(spark, sf_dir, "lineitem"), [(F.col("l_quantity"), 10, 0.0, 50.0), (F.col("l_extendedprice"), 8, 0.0, 60000.0)])


@_add("histdd", f"SELECT a AS bin0, b AS bin1, c AS bin2, count(*) AS n FROM (SELECT {_bin('l_quantity', 5, 0.0, 50.0)} AS a, {_bin('l_discount', 5, 0.0, 0.1)} AS b, {_bin('l_tax', 4, 0.0, 0.08)} AS c FROM lineitem) WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL GROUP BY 1, 2, 3")
def _histdd(spark, sf_dir):
    return H.histogramdd(_read(spark, sf_dir, "lineitem"), [(F.col("l_quantity"), 5, 0.0, 50.0), (F.col("l_discount"), 5, 0.0, 0.1), (F.col("l_tax"), 4, 0.0, 0.08)]).where("n > 0")


@_add("hist_weighted", f"SELECT b AS bin, count(*) AS n, {_rs('sum(l_discount)')} AS sumw, {_rs('sum(l_discount * l_discount)')} AS sumw2 FROM (SELECT *, {_bin('l_extendedprice', 20, 0.0, 60000.0)} AS b FROM lineitem) WHERE b IS NOT NULL GROUP BY 1")
def _hist_weighted(spark, sf_dir):
    h = H.histogram(_read(spark, sf_dir, "lineitem"), F.col("l_extendedprice"), 20, 0.0, 60000.0, F.col("l_discount")).where("n > 0")
    return h.select("bin", "n", _r(F.col("sumw")).alias("sumw"), _r(F.col("sumw2")).alias("sumw2"))


@_add("hist_systematics", "SELECT t.name AS variation, b AS bin, count(*) AS n FROM (SELECT name, " + _bin("value", 40, 0.0, 250000.0) + " AS b FROM (SELECT v.name, round(o_totalprice * v.f, 6) AS value FROM orders, (VALUES ('nominal', 1.0::DOUBLE), ('up', 1.05::DOUBLE), ('down', 0.95::DOUBLE)) v(name, f))) t WHERE b IS NOT NULL GROUP BY 1, 2")
def _hist_systematics(spark, sf_dir):
    p = F.col("o_totalprice")
    varied = H.variations(_read(spark, sf_dir, "orders"), "variation", {k: F.round(p * f, 6) for k, f in (("nominal", 1.0), ("up", 1.05), ("down", 0.95))})
    return H.histograms_by(varied, "variation", F.col("value"), 40, 0.0, 250000.0)


# ---------------------------------------------------------------- joins


def _sides(spark, sf_dir):
    left = _read(spark, sf_dir, "orders").select(F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")).alias("k"), F.col("o_orderkey").alias("lv"))
    c = F.col("c_custkey")
    right = _read(spark, sf_dir, "customer").select(F.when((c % 100 != 7) & (c % 3 == 0), c + 5).when(c % 100 != 7, c + 10_000_000).alias("k"), c.alias("rv"))
    return left, right


_SIDES = """WITH l AS (SELECT CASE WHEN o_custkey % 7 <> 0 THEN o_custkey END AS k, o_orderkey AS lv FROM orders),
r AS (SELECT CASE WHEN c_custkey % 100 = 7 THEN NULL WHEN c_custkey % 3 = 0 THEN c_custkey + 5 ELSE c_custkey + 10000000 END AS k, c_custkey AS rv FROM customer)"""
for _how, _sql in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("outer", "FULL JOIN")):
    _add(f"join_{_how}", f"{_SIDES} SELECT k, count(lv) AS n, coalesce(sum(lv), -1)::BIGINT AS lv, coalesce(sum(rv), -1)::BIGINT AS rv, count(*) AS rows FROM (SELECT coalesce(l.k, r.k, -1) AS k, lv, rv FROM l {_sql} r ON coalesce(l.k, -1) = coalesce(r.k, -1)) GROUP BY k")(
        lambda spark, sf_dir, h=_how: J.join_sums(*_sides(spark, sf_dir), "k", h).select(F.coalesce("k", F.lit(-1)).alias("k"), F.col("n_lv").alias("n"), F.coalesce("sum_lv", F.lit(-1)).alias("lv"), F.coalesce("sum_rv", F.lit(-1)).alias("rv"), "rows")
    )


@_add("join_duplicating", "SELECT a.l_orderkey AS k, count(*) AS n, " + _rs("sum(a.l_quantity * b.l_tax)") + " AS s FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey GROUP BY 1")
def _join_duplicating(spark, sf_dir):
    lines = _read(spark, sf_dir, "lineitem")
    both = J.join(lines.select(F.col("l_orderkey").alias("k"), "l_quantity"), lines.select(F.col("l_orderkey").alias("k"), "l_tax"), "k")
    return both.groupBy("k").agg(F.count("*").alias("n"), _r(F.sum(F.col("l_quantity") * F.col("l_tax"))).alias("s"))


@_add("join_grouped", "SELECT c_custkey AS k, count(o_orderkey) AS n, " + _rs("coalesce(sum(o_totalprice), 0)", 2) + " AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _join_grouped(spark, sf_dir):
    left = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_custkey").alias("row"))
    right = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_totalprice", "o_orderkey")
    out = J.grouped_join(left, right, "k", "row")
    return out.select("k", R.num(F.col("items")).alias("n"), _r(R.sum(F.col("items.o_totalprice")), 2).alias("total"))


@_add("pack_key", "SELECT l_orderkey, l_linenumber, (l_orderkey << 40) | (l_linenumber::BIGINT << 20) | l_suppkey AS key FROM lineitem")
def _pack(spark, sf_dir):
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", J.pack_key(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey"), lead_bits=24).alias("key"))


@_add("route_sha256", "SELECT o_orderkey, (('0x' || substr(sha256(unhex(lpad(hex(o_orderkey), 16, '0'))), 1, 16))::UBIGINT % 16)::INTEGER AS part FROM orders")
def _route(spark, sf_dir):
    return _read(spark, sf_dir, "orders").select("o_orderkey", J.route(F.col("o_orderkey"), 16).alias("part"))


@_add("repartition_by_key", "SELECT o_custkey, count(*) AS n, 1::BIGINT AS places FROM orders GROUP BY 1")
def _repartition(spark, sf_dir):
    """Every key lies in one part."""
    placed = J.repartition(_read(spark, sf_dir, "orders"), by="o_custkey", n=13).select("o_custkey", F.spark_partition_id().alias("part"))
    each = placed.groupBy("o_custkey", "part").agg(F.count("*").alias("n"))
    return each.groupBy("o_custkey").agg(F.sum("n").alias("n"), F.count("*").alias("places"))


@_add("repartition_n", "SELECT 6::BIGINT AS parts, count(*)::BIGINT AS n, true AS even FROM orders")
def _repartition_n(spark, sf_dir):
    """As many parts as asked for, of about equal size."""
    each = J.repartition(_read(spark, sf_dir, "orders"), n=6).select(F.spark_partition_id().alias("part")).groupBy("part").agg(F.count("*").alias("n"))
    return each.agg(F.count("*").alias("parts"), F.sum("n").alias("n"), (F.max("n") <= F.min("n") * 1.2 + 20).alias("even"))


@_add("repartition_target_bytes", "SELECT o_orderstatus, count(*) AS n, true AS several FROM orders GROUP BY 1")
def _repartition_bytes(spark, sf_dir):
    """A small target makes several parts; no row is lost."""
    cut = J.repartition(_read(spark, sf_dir, "orders"), target_bytes=16 << 10)
    return cut.groupBy("o_orderstatus").agg(F.count("*").alias("n"), (F.lit(cut.rdd.getNumPartitions()) > 1).alias("several"))
