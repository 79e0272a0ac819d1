"""Elementwise operations with IEEE results where SQL gives NULL or an error, as native column expressions.

UNARY and BINARY map each operation's name to a function of columns. `unary` and `binary` apply them to scalars or, with `depth`, inside
list columns; a scalar beside a list is broadcast over it. A NULL operand gives NULL throughout (comparisons and boolean
operations included: no three-valued shortcuts). Everything stays in Catalyst; no Python runs on the executors.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = math.inf, math.nan


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _d(x) -> Column:
    return _c(x).cast("double")


def _nulls(result: Column, *operands: Column) -> Column:
    """result, or NULL where an operand is NULL."""
    some = operands[0].isNull()
    for c in operands[1:]:
        some = some | c.isNull()
    return F.when(~some, result)


def _sign_bit(x: Column) -> Column:
    # SQL takes -0.0 and 0.0 as equal; their texts differ
    return (x < 0) | (x.cast("string") == "-0.0")


def _nan(*columns: Column) -> Column:
    some = F.isnan(columns[0])
    for c in columns[1:]:
        some = some | F.isnan(c)
    return some


def _whole(rounded: Column, x: Column) -> Column:
    """A BIGINT rounding of x as a double that keeps NaN, infinities, large values and the sign of zero."""
    signed = F.when((rounded == 0) & _sign_bit(x), F.lit(-0.0)).otherwise(rounded.cast("double"))
    return F.when(F.isnan(x) | (F.abs(x) >= 2.0**52), x).otherwise(signed)


def floor(x) -> Column:
    return _whole(F.floor(x := _d(x)), x)


def ceil(x) -> Column:
    return _whole(F.ceil(x := _d(x)), x)


def trunc(x) -> Column:
    x = _d(x)
    return F.when(x < 0, ceil(x)).otherwise(floor(x))


def _log(make: Callable[[Column], Column], edge: float = 0.0) -> Callable[..., Column]:
    def log(x) -> Column:
        x = _d(x)
        return F.when(F.isnan(x) | (x < edge), F.lit(NAN)).when(x == edge, F.lit(-INF)).when(x == INF, F.lit(INF)).otherwise(make(x))

    return log


log = _log(F.ln)
log1p = _log(F.log1p, -1.0)
log2 = _log(F.log2)
log10 = _log(F.log10)


def div(a, b) -> Column:
    """a / b: infinities and NaN for a zero divisor, with the signs of both."""
    a, b = _d(a), _d(b)
    infinite = F.when(_sign_bit(a) != _sign_bit(b), F.lit(-INF)).otherwise(F.lit(INF))
    by_zero = F.when((a == 0) | F.isnan(a), F.lit(NAN)).otherwise(infinite)
    return _nulls(F.when(b == 0, by_zero).otherwise(F.try_divide(a, F.nullif(b, F.lit(0.0)))), a, b)


def fmod(a, b) -> Column:
    """Remainder with the dividend's sign; NaN for a zero divisor or an infinite dividend."""
    a, b = _d(a), _d(b)
    rest = F.try_mod(a, F.nullif(b, F.lit(0.0)))
    return _nulls(F.when(_nan(a, b) | (b == 0) | (F.abs(a) == INF), F.lit(NAN)).when(F.abs(b) == INF, a).otherwise(rest), a, b)


def mod(a, b) -> Column:
    """Remainder with the divisor's sign."""
    a, b = _d(a), _d(b)
    rest = fmod(a, b)
    signed_zero = F.when(_sign_bit(b), F.lit(-0.0)).otherwise(F.lit(0.0))
    return F.when(_nan(rest), rest).when(rest == 0, signed_zero).when((rest < 0) != (b < 0), rest + b).otherwise(rest)


def floordiv(a, b) -> Column:
    """floor(a / b), from the remainder, so that rounding of the quotient cannot pass a whole number."""
    a, b = _d(a), _d(b)
    rest = fmod(a, b)
    lower = F.when((rest != 0) & ((rest < 0) != (b < 0)), F.lit(1.0)).otherwise(F.lit(0.0))
    whole = F.rint(F.try_divide(a - rest, F.nullif(b, F.lit(0.0))) - lower)
    return F.when(b == 0, div(a, b)).when(F.isnan(rest), rest).otherwise(whole)


def power(a, b) -> Column:
    """a ** b; one to any power is one, and so is minus one to an infinite one, where the JVM has NaN."""
    a, b = _d(a), _d(b)
    return _nulls(F.when((a == 1) | ((a == -1) & (F.abs(b) == INF)), F.lit(1.0)).otherwise(F.pow(a, b)), a, b)


def copysign(a, b) -> Column:
    a, b = _d(a), _d(b)
    return _nulls(F.when(_sign_bit(b), -F.abs(a)).otherwise(F.abs(a)), a, b)


def arctan2(a, b) -> Column:
    """atan2 with the signs of zeros, which SQL's loses."""
    a, b = _d(a), _d(b)
    zero = F.when(_sign_bit(b), F.lit(math.pi)).otherwise(F.lit(0.0))
    return _nulls(F.when((a == 0) & ((b == 0) | (b != b)), copysign(zero, a)).when((a == 0) & ~F.isnan(b), copysign(F.when(_sign_bit(b), F.lit(math.pi)).otherwise(F.lit(0.0)), a)).otherwise(F.atan2(a, b)), a, b)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value in the plan once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _exponent(x: Column) -> Column:
    """floor(log2(x)) of a positive finite x, exact, at least the least normal exponent."""
    two = lambda e: F.pow(F.lit(2.0), e)
    return _let(F.floor(F.log2(x)), lambda e: F.greatest(F.when(two(e) > x, e - 1).when(two(e + 1) <= x, e + 1).otherwise(e), F.lit(-1022)))


def spacing(x) -> Column:
    """Distance to the next number away from zero, with x's sign."""
    x = _d(x)
    size = F.abs(x)
    step = F.when(x == 0, F.lit(5e-324)).otherwise(F.pow(F.lit(2.0), _exponent(size) - 52))
    return _nulls(F.when(_nan(x) | (size == INF), F.lit(NAN)).when(x < 0, -step).otherwise(step), x)


def nextafter(a, b) -> Column:
    """The number next to a in the direction of b."""
    a, b = _d(a), _d(b)
    size = F.abs(a)

    def moved(e: Column) -> Column:
        step = F.pow(F.lit(2.0), e - 52)
        inward = F.when((F.pow(F.lit(2.0), e) == size) & (e > -1022), step / 2).otherwise(step)
        return F.when((b > a) == (a > 0), size + step).otherwise(size - inward)

    least = F.when(b > a, F.lit(5e-324)).otherwise(F.lit(-5e-324))
    next_size = F.when(size == INF, F.lit(1.7976931348623157e308)).otherwise(_let(_exponent(size), moved))
    finite = F.when(a == 0, least).when(a > 0, next_size).otherwise(-next_size)
    return _nulls(F.when(_nan(a, b), F.lit(NAN)).when(a == b, b).otherwise(finite), a, b)


def maximum(a, b) -> Column:
    a, b = _d(a), _d(b)
    return _nulls(F.greatest(a, b), a, b)  # NaN sorts last, so it wins


def minimum(a, b) -> Column:
    a, b = _d(a), _d(b)
    return _nulls(F.when(_nan(a, b), F.lit(NAN)).otherwise(F.least(a, b)), a, b)


def fmax(a, b) -> Column:
    a, b = _d(a), _d(b)
    return _nulls(F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.greatest(a, b)), a, b)


def fmin(a, b) -> Column:
    a, b = _d(a), _d(b)
    return _nulls(F.least(a, b), a, b)  # NaN sorts last, so it loses


def _logaddexp(exp: Callable, log_one_more: Callable) -> Callable[..., Column]:
    def add(a, b) -> Column:
        a, b = _d(a), _d(b)
        return _nulls(F.when(_nan(a, b), F.lit(NAN)).when(a == b, a + log_one_more(F.lit(1.0))).otherwise(F.greatest(a, b) + log_one_more(exp(-F.abs(a - b)))), a, b)

    return add


def heaviside(a, b) -> Column:
    a, b = _d(a), _d(b)
    return _nulls(F.when(F.isnan(a), F.lit(NAN)).when(a < 0, F.lit(0.0)).when(a == 0, b).otherwise(F.lit(1.0)), a, b)


def gcd(a, b) -> Column:
    """Euclid's steps to the nearest multiple: each halves the smaller number at least, so its bits bound them; an exhausted pair stays as it is."""
    a, b = F.abs(_c(a).cast("long")), F.abs(_c(b).cast("long"))
    pair = F.struct(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    steps = F.coalesce(F.floor(F.log2(F.least(a, b))), F.lit(0).cast("long")) + 2
    rest = lambda s: F.try_mod(s["a"], s["b"])
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.least(rest(s), s["b"] - rest(s)).alias("b")))
    return _nulls(F.aggregate(F.sequence(F.lit(1).cast("long"), steps), pair, step, lambda s: s["a"]), a, b)


def lcm(a, b) -> Column:
    a, b = _c(a).cast("long"), _c(b).cast("long")
    return _let(gcd(a, b), lambda divisor: F.when(divisor == 0, F.lit(0).cast("long")).otherwise(F.abs(a * F.call_function("div", b, divisor))))


def _compare(test: Callable[[Column, Column], Column], unequal: bool = False) -> Callable[..., Column]:
    def compare(a, b) -> Column:
        a, b = _d(a), _d(b)
        return _nulls(F.when(_nan(a, b), F.lit(unequal)).otherwise(test(a, b)), a, b)

    return compare


def _strict(combine: Callable[[Column, Column], Column]) -> Callable[..., Column]:
    return lambda a, b: _nulls(combine(_c(a), _c(b)), _c(a), _c(b))


def truth(x) -> Column:
    """Truthiness of a number or boolean; NaN is true."""
    return _c(x).cast("double") != 0


def isclose(a, b, rtol: float = 1e-05, atol: float = 1e-08, equal_nan: bool = False) -> Column:
    a, b = _d(a), _d(b)
    infinite = (F.abs(a) == INF) | (F.abs(b) == INF)
    near = F.when(infinite, a == b).otherwise(F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b))
    return _nulls(F.when(F.isnan(a) & F.isnan(b), F.lit(equal_nan)).when(_nan(a, b), F.lit(False)).otherwise(near), a, b)


def nan_to_num(x, nan: float = 0.0, posinf: float | None = None, neginf: float | None = None) -> Column:
    x, most = _d(x), 1.7976931348623157e308
    return F.when(F.isnan(x), F.lit(nan)).when(x == INF, F.lit(most if posinf is None else posinf)).when(x == -INF, F.lit(-most if neginf is None else neginf)).otherwise(x)


UNARY: dict[str, Callable[..., Column]] = {
    "abs": lambda x: F.abs(_c(x)),
    "fabs": lambda x: F.abs(_d(x)),
    "neg": lambda x: -_c(x),
    "pos": lambda x: F.positive(_c(x)),
    "sign": lambda x: F.signum(_d(x)),
    "signbit": lambda x: _sign_bit(_d(x)),
    "floor": floor,
    "ceil": ceil,
    "trunc": trunc,
    "rint": lambda x: F.rint(_d(x)),
    "exp": lambda x: F.exp(_d(x)),
    "exp2": lambda x: F.pow(F.lit(2.0), _d(x)),
    "expm1": lambda x: F.expm1(_d(x)),
    "log": log,
    "log1p": log1p,
    "log2": log2,
    "log10": log10,
    "sqrt": lambda x: F.sqrt(_d(x)),
    "cbrt": lambda x: F.cbrt(_d(x)),
    "square": lambda x: _c(x) * _c(x),
    "reciprocal": lambda x: div(F.lit(1.0), x),
    "sin": lambda x: F.sin(_d(x)),
    "cos": lambda x: F.cos(_d(x)),
    "tan": lambda x: F.tan(_d(x)),
    "sinh": lambda x: F.sinh(_d(x)),
    "cosh": lambda x: F.cosh(_d(x)),
    "tanh": lambda x: F.tanh(_d(x)),
    "arcsin": lambda x: F.asin(_d(x)),
    "arccos": lambda x: F.acos(_d(x)),
    "arctan": lambda x: F.atan(_d(x)),
    "arcsinh": lambda x: F.asinh(_d(x)),
    "arccosh": lambda x: F.acosh(_d(x)),
    "arctanh": lambda x: F.atanh(_d(x)),
    "deg2rad": lambda x: F.radians(_d(x)),
    "rad2deg": lambda x: F.degrees(_d(x)),
    "isnan": lambda x: _nulls(F.isnan(_d(x)), _d(x)),
    "isinf": lambda x: F.abs(_d(x)) == INF,
    "isfinite": lambda x: _nulls(~F.isnan(_d(x)) & (F.abs(_d(x)) != INF), _d(x)),
    "spacing": spacing,
    "conj": lambda x: _c(x),
    "invert": lambda x: F.bitwise_not(_c(x)),
    "logical_not": lambda x: ~truth(x),
}

BINARY: dict[str, Callable[..., Column]] = {
    "add": lambda a, b: _c(a) + _c(b),
    "sub": lambda a, b: _c(a) - _c(b),
    "mul": lambda a, b: _c(a) * _c(b),
    "div": div,
    "floordiv": floordiv,
    "mod": mod,
    "power": power,
    "float_power": power,
    "fmod": fmod,
    "hypot": lambda a, b: F.hypot(_d(a), _d(b)),
    "arctan2": arctan2,
    "copysign": copysign,
    "nextafter": nextafter,
    "ldexp": lambda a, b: _d(a) * F.pow(F.lit(2.0), _d(b)),
    "fmax": fmax,
    "fmin": fmin,
    "maximum": maximum,
    "minimum": minimum,
    "logaddexp": _logaddexp(F.exp, F.log1p),
    "logaddexp2": _logaddexp(lambda x: F.pow(F.lit(2.0), x), lambda x: F.log1p(x) / math.log(2.0)),
    "heaviside": heaviside,
    "gcd": gcd,
    "lcm": lcm,
    "gt": _compare(lambda a, b: a > b),
    "lt": _compare(lambda a, b: a < b),
    "ge": _compare(lambda a, b: a >= b),
    "le": _compare(lambda a, b: a <= b),
    "eq": _compare(lambda a, b: a == b),
    "ne": _compare(lambda a, b: a != b, unequal=True),
    "and": _strict(lambda a, b: a & b),
    "or": _strict(lambda a, b: a | b),
    "xor": _strict(lambda a, b: a != b),
    "bit_and": _strict(lambda a, b: a.bitwiseAND(b)),
    "bit_or": _strict(lambda a, b: a.bitwiseOR(b)),
    "bit_xor": _strict(lambda a, b: a.bitwiseXOR(b)),
    "lshift": lambda a, b: F.call_function("shiftleft", _c(a), _c(b).cast("int")),
    "rshift": lambda a, b: F.call_function("shiftright", _c(a), _c(b).cast("int")),
    "logical_and": _strict(lambda a, b: truth(a) & truth(b)),
    "logical_or": _strict(lambda a, b: truth(a) | truth(b)),
    "logical_xor": _strict(lambda a, b: truth(a) != truth(b)),
}

#: Further names of the same operations.
ALIASES = {
    "negative": "neg", "positive": "pos", "absolute": "abs", "radians": "deg2rad", "degrees": "rad2deg", "true_divide": "div", "divide": "div",
    "subtract": "sub", "multiply": "mul", "floor_divide": "floordiv", "remainder": "mod", "pow": "power", "greater": "gt", "less": "lt",
    "greater_equal": "ge", "less_equal": "le", "equal": "eq", "not_equal": "ne", "left_shift": "lshift", "right_shift": "rshift", "conjugate": "conj",
}


def unary(name: str, x, depth: int = 0) -> Column:
    """The operation on x; inside its lists where depth > 0."""
    make = UNARY[ALIASES.get(name, name)]
    return make(x) if not depth else F.transform(_c(x), lambda e: unary(name, e, depth - 1))


def binary(name: str, a, b, depth: int | tuple[int, int] = 0) -> Column:
    """The operation on a and b. depth: list levels of both, or of each; the shallower one is broadcast. Lists of unequal length raise."""
    left, right = depth if isinstance(depth, tuple) else (depth, depth)
    if not left and not right:
        return BINARY[ALIASES.get(name, name)](a, b)
    if not right:
        return F.transform(_c(a), lambda e: binary(name, e, b, (left - 1, 0)))
    if not left:
        return F.transform(_c(b), lambda e: binary(name, a, e, (0, right - 1)))
    same = F.zip_with(_c(a), _c(b), lambda x, y: binary(name, x, y, (left - 1, right - 1)))
    return F.when(F.size(a) == F.size(b), same).when(_c(a).isNotNull() & _c(b).isNotNull(), F.raise_error(F.lit("lists of unequal length")))
