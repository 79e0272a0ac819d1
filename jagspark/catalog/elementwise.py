"""ew_<operation>: every elementwise operation over all rows of lineitem, with zeros, NaN and infinities made from the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.elementwise import BINARY, INF, NAN, UNARY, binary, unary

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

INPUT_SQL = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
  CASE CAST(l_quantity AS INTEGER) WHEN 1 THEN 'NaN'::DOUBLE WHEN 2 THEN 'Infinity'::DOUBLE WHEN 3 THEN '-Infinity'::DOUBLE WHEN 4 THEN 0.0::DOUBLE
    WHEN 5 THEN 1.0::DOUBLE WHEN 6 THEN -1.0::DOUBLE WHEN 7 THEN 2.5::DOUBLE WHEN 8 THEN NULL ELSE (l_extendedprice - 30000.0::DOUBLE) / 16384.0::DOUBLE END AS x,
  CASE CAST(l_suppkey % 23 AS INTEGER) WHEN 1 THEN 'NaN'::DOUBLE WHEN 2 THEN 'Infinity'::DOUBLE WHEN 3 THEN '-Infinity'::DOUBLE WHEN 4 THEN 0.0::DOUBLE
    WHEN 5 THEN NULL ELSE (l_quantity - 25.0::DOUBLE) / 8.0::DOUBLE END AS y,
  (l_partkey - 700)::BIGINT AS i, (l_suppkey - 40)::BIGINT AS j, (l_linenumber - 1)::INTEGER AS n,
  CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity > 20 END AS p, CASE WHEN l_linenumber = 4 THEN NULL ELSE l_suppkey % 2 = 0 END AS q
FROM lineitem
"""


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    k = F.col("l_quantity").cast("int")
    x = F.when(k == 8, F.lit(None)).otherwise((F.col("l_extendedprice") - 30000.0) / 16384.0)
    for at, value in ((7, 2.5), (6, -1.0), (5, 1.0), (4, 0.0), (3, -INF), (2, INF), (1, NAN)):
        x = F.when(k == at, F.lit(value)).otherwise(x)
    k = F.col("l_suppkey") % 23
    y = F.when(k == 5, F.lit(None)).otherwise((F.col("l_quantity") - 25.0) / 8.0)
    for at, value in ((4, 0.0), (3, -INF), (2, INF), (1, NAN)):
        y = F.when(k == at, F.lit(value)).otherwise(y)
    return row.select(
        *KEYS, x.alias("x"), y.alias("y"), (F.col("l_partkey") - 700).alias("i"), (F.col("l_suppkey") - 40).alias("j"), (F.col("l_linenumber") - 1).cast("int").alias("n"),
        F.when(F.col("l_linenumber") != 3, F.col("l_quantity") > 20).alias("p"), F.when(F.col("l_linenumber") != 4, F.col("l_suppkey") % 2 == 0).alias("q"),
    )


def _six(r: Column) -> Column:
    """r to six decimals by the arithmetic of the SQL's round: halves of the binary product go away from zero. F.round takes r's decimal digits instead."""
    size = F.abs(r * 1e6)
    whole = F.floor(size).cast("double")
    near = F.when(size >= 2.0**52, size).otherwise(F.when(size - whole >= 0.5, whole + 1).otherwise(whole)) / 1e6
    return F.when(size == INF, r).when(r < 0, -near).otherwise(near)


def shown(r: Column) -> tuple[Column, Column]:
    """(kind, value): 'nan', 'inf', '-inf' or 'null' beside NULL, or 'fin' and the value to six decimals without a signed zero.

    The shift keeps exact halves of the last decimal from depending on the last bit."""
    kind = F.when(r.isNull(), "null").when(F.isnan(r), "nan").when(r == INF, "inf").when(r == -INF, "-inf").otherwise("fin")
    return kind.alias("kind"), F.when(kind == "fin", _six(r + 3e-10) + 0.0).alias("r")


SHOWN_SQL = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN r IS NULL THEN 'null' WHEN isnan(r) THEN 'nan' WHEN r = 'Infinity'::DOUBLE THEN 'inf' WHEN r = '-Infinity'::DOUBLE THEN '-inf' ELSE 'fin' END AS kind,
  CASE WHEN isfinite(r) THEN round(r + 3e-10::DOUBLE, 6) + 0.0::DOUBLE END AS r
FROM (SELECT *, ({})::DOUBLE AS r FROM ({}))"""

#: Operation: DuckDB expression of x, y (doubles), i, j (whole numbers), n (small whole number), p, q (booleans).
_INFINITE = "(x = 'Infinity'::DOUBLE OR x = '-Infinity'::DOUBLE)"
_NAN = "'NaN'::DOUBLE"


def _guarded_log(call: str, edge: str) -> str:
    return f"CASE WHEN x IS NULL THEN NULL WHEN isnan(x) OR x < {edge} THEN {_NAN} WHEN x = {edge} THEN '-Infinity'::DOUBLE WHEN x = 'Infinity'::DOUBLE THEN x ELSE {call} END"


def _finite(call: str, infinite: str) -> str:
    """call for finite x and NaN; infinite for infinities."""
    return f"CASE WHEN x IS NULL THEN NULL WHEN isnan(x) THEN x WHEN {_INFINITE} THEN {infinite} ELSE {call} END"


_INSIDE = "CASE WHEN x IS NULL THEN NULL WHEN isnan(x) OR abs(x) > 1 THEN 'NaN'::DOUBLE ELSE {} END"
_BOTH = "CASE WHEN x IS NULL OR y IS NULL THEN NULL WHEN isnan(x) OR isnan(y) THEN {} ELSE {} END"
_DIV = "CASE WHEN x IS NULL OR y IS NULL THEN NULL WHEN y = 0 THEN CASE WHEN isnan(x) OR x = 0 THEN 'NaN'::DOUBLE WHEN x > 0 THEN 'Infinity'::DOUBLE ELSE '-Infinity'::DOUBLE END ELSE x / y END"
_NO_REST = "isnan(x) OR isnan(y) OR y = 0 OR abs(x) = 'Infinity'::DOUBLE"
_FMOD = f"CASE WHEN x IS NULL OR y IS NULL THEN NULL WHEN {_NO_REST} THEN {_NAN} WHEN abs(y) = 'Infinity'::DOUBLE THEN x ELSE x - y * trunc(x / y) END"

UNARY_SQL = {
    "abs": "abs(x)", "fabs": "abs(x)", "neg": "-x", "pos": "x",
    "sign": "CASE WHEN isnan(x) THEN x ELSE sign(x) END", "signbit": "CASE WHEN isnan(x) THEN false ELSE x < 0 END",
    "floor": _finite("floor(x)", "x"), "ceil": _finite("ceil(x)", "x"), "trunc": _finite("trunc(x)", "x"), "rint": _finite("round_even(x, 0)", "x"),
    "exp": "exp(x)", "exp2": "pow(2.0::DOUBLE, x)", "expm1": "exp(x) - 1",
    "log": _guarded_log("ln(x)", "0"), "log1p": _guarded_log("ln(1 + x)", "-1"), "log2": _guarded_log("log2(x)", "0"), "log10": _guarded_log("log10(x)", "0"),
    "sqrt": f"CASE WHEN x < 0 THEN {_NAN} ELSE sqrt(x) END", "cbrt": "cbrt(x)", "square": "x * x",
    "reciprocal": "CASE WHEN x = 0 THEN 'Infinity'::DOUBLE ELSE 1 / x END",
    "sin": _finite("sin(x)", _NAN), "cos": _finite("cos(x)", _NAN), "tan": _finite("tan(x)", _NAN),
    "sinh": "sinh(x)", "cosh": "cosh(x)", "tanh": "tanh(x)",
    "arcsin": _INSIDE.format("asin(x)"), "arccos": _INSIDE.format("acos(x)"), "arctan": "atan(x)",
    "arcsinh": _finite("asinh(x)", "x"), "arccosh": f"CASE WHEN x < 1 THEN {_NAN} ELSE acosh(x) END",
    "arctanh": _INSIDE.format("CASE WHEN x = 1 THEN 'Infinity'::DOUBLE WHEN x = -1 THEN '-Infinity'::DOUBLE ELSE atanh(x) END"),
    "deg2rad": "radians(x)", "rad2deg": "degrees(x)",
    "isnan": "isnan(x)", "isinf": "isinf(x)", "isfinite": "isfinite(x)",
    "spacing": f"CASE WHEN x IS NULL THEN NULL WHEN isnan(x) OR isinf(x) THEN {_NAN} WHEN x = 0 THEN 5e-324 WHEN x < 0 THEN x - nextafter(x, 0.0::DOUBLE) ELSE nextafter(x, 'Infinity'::DOUBLE) - x END".replace("x - nextafter(x, 0.0::DOUBLE)", "nextafter(x, '-Infinity'::DOUBLE) - x"),
    "conj": "x", "invert": "~i", "logical_not": "NOT (x <> 0 OR isnan(x))",
}

BINARY_SQL = {
    "add": "x + y", "sub": "x - y", "mul": "x * y", "div": _DIV,
    "floordiv": f"CASE WHEN x IS NULL OR y IS NULL THEN NULL WHEN y = 0 THEN {_DIV} WHEN {_NO_REST} THEN {_NAN} WHEN abs(y) = 'Infinity'::DOUBLE THEN CASE WHEN x = 0 OR (x < 0) = (y < 0) THEN 0 ELSE -1 END ELSE floor(x / y) END",
    "mod": f"CASE WHEN x IS NULL OR y IS NULL THEN NULL WHEN {_NO_REST} THEN {_NAN} WHEN abs(y) = 'Infinity'::DOUBLE THEN CASE WHEN x = 0 OR (x < 0) = (y < 0) THEN x ELSE y END ELSE x - y * floor(x / y) END",
    "power": f"CASE WHEN x IS NULL OR y IS NULL THEN NULL WHEN y = 0 OR x = 1 THEN 1 WHEN x = -1 AND isinf(y) THEN 1 WHEN isfinite(x) AND x < 0 AND isfinite(y) AND y <> trunc(y) THEN {_NAN} WHEN x = 0 AND y < 0 THEN 'Infinity'::DOUBLE ELSE pow(x, y) END",
    "fmod": _FMOD,
    "hypot": "CASE WHEN x IS NULL OR y IS NULL THEN NULL WHEN isinf(x) OR isinf(y) THEN 'Infinity'::DOUBLE ELSE sqrt(x * x + y * y) END",
    "arctan2": "CASE WHEN isnan(x) OR isnan(y) THEN x + y ELSE atan2(x, y) END",
    "copysign": "CASE WHEN x IS NULL OR y IS NULL THEN NULL WHEN y < 0 THEN -abs(x) ELSE abs(x) END",
    "nextafter": "CASE WHEN isnan(x) OR isnan(y) THEN x + y ELSE nextafter(x, y) END",
    "ldexp": "x * pow(2.0::DOUBLE, n)",
    "fmax": "CASE WHEN x IS NULL OR y IS NULL THEN NULL WHEN isnan(x) THEN y WHEN isnan(y) THEN x ELSE greatest(x, y) END",
    "fmin": "CASE WHEN x IS NULL OR y IS NULL THEN NULL WHEN isnan(x) THEN y WHEN isnan(y) THEN x ELSE least(x, y) END",
    "maximum": _BOTH.format(_NAN, "greatest(x, y)"), "minimum": _BOTH.format(_NAN, "least(x, y)"),
    "logaddexp": _BOTH.format(_NAN, "CASE WHEN x = y THEN x + ln(2.0::DOUBLE) ELSE greatest(x, y) + ln(1 + exp(-abs(x - y))) END"),
    "logaddexp2": _BOTH.format(_NAN, "CASE WHEN x = y THEN x + 1 ELSE greatest(x, y) + log2(1 + pow(2.0::DOUBLE, -abs(x - y))) END"),
    "heaviside": f"CASE WHEN x IS NULL OR y IS NULL THEN NULL WHEN isnan(x) THEN {_NAN} WHEN x < 0 THEN 0 WHEN x = 0 THEN y ELSE 1 END",
    "gcd": "gcd(i, j)", "lcm": "lcm(i, j)",
    "gt": _BOTH.format("false", "x > y"), "lt": _BOTH.format("false", "x < y"), "ge": _BOTH.format("false", "x >= y"), "le": _BOTH.format("false", "x <= y"),
    "eq": _BOTH.format("false", "x = y"), "ne": _BOTH.format("true", "x <> y"),
    "and": "CASE WHEN p IS NULL OR q IS NULL THEN NULL ELSE p AND q END", "or": "CASE WHEN p IS NULL OR q IS NULL THEN NULL ELSE p OR q END", "xor": "p <> q",
    "bit_and": "i & j", "bit_or": "i | j", "bit_xor": "xor(i, j)",
    "lshift": "i * pow(2, n)::BIGINT", "rshift": "i >> n",
    "logical_and": "CASE WHEN x IS NULL OR y IS NULL THEN NULL ELSE (x <> 0) AND (y <> 0) END",
    "logical_or": "CASE WHEN x IS NULL OR y IS NULL THEN NULL ELSE (x <> 0) OR (y <> 0) END", "logical_xor": "(x <> 0) <> (y <> 0)",
}
BINARY_SQL["float_power"] = BINARY_SQL["power"]

_OPERANDS = {"invert": "i", **dict.fromkeys(("gcd", "lcm", "bit_and", "bit_or", "bit_xor"), ("i", "j")), **dict.fromkeys(("and", "or", "xor"), ("p", "q")), "lshift": ("i", "n"), "rshift": ("i", "n"), "ldexp": ("x", "n")}
#: Results too small or too large for six decimals are scaled by a power of two.
_SCALE = {"spacing": 2.0**52, "nextafter": 1.0}


def _query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = inputs(spark, sf_dir)
        if name in UNARY:
            r = unary(name, F.col(_OPERANDS.get(name, "x")))
        else:
            a, b = _OPERANDS.get(name, ("x", "y"))
            r = binary(name, F.col(a), F.col(b))
        # the result is a column of its own, so that showing it, which names it several times, does not make it as often
        once = df.select(*KEYS, (r.cast("double") * F.lit(_SCALE[name]) if name in _SCALE else r.cast("double")).alias("r"))
        return once.select(*KEYS, *shown(F.col("r")))

    return run


QUERIES = {f"ew_{name}": _query(name) for name in [*UNARY, *BINARY]}
ORACLE_SQL = {
    f"ew_{name}": SHOWN_SQL.format(f"({sql})::DOUBLE * {_SCALE[name]!r}::DOUBLE" if name in _SCALE else f"({sql})", INPUT_SQL) for name, sql in (UNARY_SQL | BINARY_SQL).items()
}
