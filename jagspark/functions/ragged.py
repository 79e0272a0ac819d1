"""Operations on list columns (ragged arrays), as native column expressions.

A list column holds one row's collection. Reducers here work inside each list (axis 1) and skip missing elements; `rows` has their
counterparts over all rows (axis None), and operators.positions those by place (axis 0). An empty list gives each reducer's identity;
min, max, ptp, argmin and argmax give NULL, and so does any reducer with mask_identity. A NULL list gives NULL.
"""

from __future__ import annotations

import builtins
import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .elementwise import NAN, _c, _let, div, isclose, nan_to_num, truth

__all__ = ["isclose", "nan_to_num"]


def collection(name: str, *fields: str) -> Column:
    """A list of structs made from the named leaves only, so that a Parquet scan reads no others."""
    return F.arrays_zip(*[F.col(f"{name}.{f}").alias(f) for f in fields])


def _kept(c) -> Column:
    return F.array_compact(_c(c))


def _fold(c: Column, of: Callable[[Column], Column] = lambda x: x, zero: float = 0.0) -> Column:
    return F.aggregate(c, F.lit(zero).cast("double"), lambda a, x: a + of(x.cast("double")))


def _reduced(c, make: Callable[[Column], Column], mask_identity: bool, keepdims: bool = False) -> Column:
    """make(list), with the list's expression in the plan once; NULL for a NULL list, and for one without elements where the identity is masked."""

    def of(x: Column) -> Column:
        result = F.when(F.size(_kept(x)) > 0, make(x)) if mask_identity else make(x)
        result = F.when(x.isNotNull(), result)
        return F.when(x.isNotNull(), F.array(result)) if keepdims else result

    return _let(_c(c), of)


def _natural(x: Column) -> Column:
    """x as a long where it is whole, else as it is (a double)."""
    return x + F.lit(0).cast("long")


def _accumulate(c: Column, dtype: str | None, start: int, step: Callable[[Column, Column], Column]) -> Column:
    """A fold over the elements that are present, in `dtype`, else in the elements' own kind: whole numbers stay whole."""
    value = _natural if dtype is None else (lambda x: x.cast(dtype))
    kind = value(F.get(c, F.lit(0)))  # never taken: it only gives the start the values' type
    zero = F.when(F.lit(False), kind).otherwise(F.lit(start).cast("long" if dtype is None else dtype))
    return F.aggregate(_kept(c), zero, lambda a, x: step(a, value(x)))


# ---------------------------------------------------------------- reducers


def count(c, keepdims: bool = False, mask_identity: bool = False) -> Column:
    return _reduced(c, lambda x: F.size(_kept(x)).cast("long"), mask_identity, keepdims)


def count_nonzero(c, keepdims: bool = False, mask_identity: bool = False) -> Column:
    return _reduced(c, lambda x: F.size(F.filter(_kept(x), truth)).cast("long"), mask_identity, keepdims)


def sum(c, keepdims: bool = False, mask_identity: bool = False, dtype: str | None = None) -> Column:
    """Whole numbers add up to a long, others to a double, unless dtype says otherwise (booleans need 'long')."""
    return _reduced(c, lambda x: _accumulate(x, dtype, 0, lambda a, y: a + y), mask_identity, keepdims)


def prod(c, keepdims: bool = False, mask_identity: bool = False, dtype: str | None = None) -> Column:
    return _reduced(c, lambda x: _accumulate(x, dtype, 1, lambda a, y: a * y), mask_identity, keepdims)


def any(c, keepdims: bool = False, mask_identity: bool = False) -> Column:
    return _reduced(c, lambda x: F.exists(_kept(x), truth), mask_identity, keepdims)


def all(c, keepdims: bool = False, mask_identity: bool = False) -> Column:
    return _reduced(c, lambda x: F.forall(_kept(x), truth), mask_identity, keepdims)


def _extreme(take: Callable[[Column], Column], pick: Callable[..., Column], identity: float) -> Callable[..., Column]:
    def extreme(c, keepdims: bool = False, initial=None, mask_identity: bool = True) -> Column:
        def of(x: Column) -> Column:
            found = F.when(F.exists(x, lambda v: F.isnan(v.cast("double"))), F.lit(NAN)).otherwise(take(x))
            if initial is not None:
                found = pick(F.coalesce(found, F.lit(initial)), F.lit(initial))
            # without elements: an infinity, which only a double can hold
            return found if mask_identity else F.coalesce(found.cast("double"), F.lit(identity))

        return _reduced(c, of, False, keepdims)

    return extreme


min = _extreme(F.array_min, F.least, math.inf)
max = _extreme(F.array_max, F.greatest, -math.inf)


def ptp(c, keepdims: bool = False, mask_identity: bool = True) -> Column:
    return _reduced(c, lambda x: max(x) - min(x) if mask_identity else F.coalesce(max(x) - min(x), F.lit(0.0)), False, keepdims)


def _pairs(x, w) -> Column:
    """Structs (x, w) of the elements where both are present."""
    both = F.zip_with(_c(x), _c(w), lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("w")))
    return F.filter(both, lambda s: s["x"].isNotNull() & s["w"].isNotNull())


def _moments(c, weight, of: Callable[[Column], Column]) -> tuple[Column, Column]:
    """(sum of w * of(x), sum of w); without weights every w is 1."""
    if weight is None:
        return _fold(_kept(c), of), F.size(_kept(c)).cast("double")
    pairs = _pairs(c, weight)
    return F.aggregate(pairs, F.lit(0.0), lambda a, s: a + s["w"] * of(s["x"])), F.aggregate(pairs, F.lit(0.0), lambda a, s: a + s["w"])


def mean(c, weight=None, keepdims: bool = False, mask_identity: bool = False) -> Column:
    return _reduced(c, lambda x: div(*_moments(x, weight, lambda v: v)), mask_identity, keepdims)


def moment(c, n: int, weight=None, keepdims: bool = False, mask_identity: bool = False) -> Column:
    return _reduced(c, lambda x: div(*_moments(x, weight, lambda v: F.pow(v, F.lit(float(n))))), mask_identity, keepdims)


def var(c, ddof: int = 0, weight=None, keepdims: bool = False, mask_identity: bool = False) -> Column:
    def of(x: Column) -> Column:
        def about(centre: Column) -> Column:
            top, total = _moments(x, weight, lambda v: (v - centre) * (v - centre))
            return div(top, F.greatest(total - F.lit(float(ddof)), F.lit(0.0)))

        return _let(mean(x, weight), about)  # the mean once, not once for each element

    return _reduced(c, of, mask_identity, keepdims)


def std(c, ddof: int = 0, weight=None, keepdims: bool = False, mask_identity: bool = False) -> Column:
    return F.sqrt(var(c, ddof, weight, False, mask_identity)) if not keepdims else F.transform(var(c, ddof, weight, True, mask_identity), F.sqrt)


def _sums(x, y) -> Column:
    """struct(n, x, y, xx, xy, yy): sums over the pairs where both are present."""
    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("n", "x", "y", "xx", "xy", "yy")])
    step = lambda a, s: F.struct(
        (a["n"] + 1).alias("n"), (a["x"] + s["x"]).alias("x"), (a["y"] + s["w"]).alias("y"), (a["xx"] + s["x"] * s["x"]).alias("xx"), (a["xy"] + s["x"] * s["w"]).alias("xy"), (a["yy"] + s["w"] * s["w"]).alias("yy")
    )
    return F.aggregate(_pairs(x, y), zero, step)


def covar(x, y) -> Column:
    return _let(_sums(x, y), lambda s: div(s["xy"], s["n"]) - div(s["x"], s["n"]) * div(s["y"], s["n"]))


def corr(x, y) -> Column:
    top = lambda s: s["n"] * s["xy"] - s["x"] * s["y"]
    bottom = lambda s: F.sqrt((s["n"] * s["xx"] - s["x"] * s["x"]) * (s["n"] * s["yy"] - s["y"] * s["y"]))
    return _let(_sums(x, y), lambda s: _let(bottom(s), lambda b: div(top(s), b)))


def linear_fit(x, y) -> Column:
    """struct(intercept, slope, intercept_error, slope_error) of the least-squares line."""

    def of(s: Column, delta: Column) -> Column:
        return F.struct(
            div(s["xx"] * s["y"] - s["x"] * s["xy"], delta).alias("intercept"),
            div(s["n"] * s["xy"] - s["x"] * s["y"], delta).alias("slope"),
            F.sqrt(div(s["xx"], delta)).alias("intercept_error"),
            F.sqrt(div(s["n"], delta)).alias("slope_error"),
        )

    return _let(_sums(x, y), lambda s: _let(s["n"] * s["xx"] - s["x"] * s["x"], lambda delta: of(s, delta)))


def _place(take: Callable[[Column], Column]) -> Callable[..., Column]:
    def place(c, keepdims: bool = False, mask_identity: bool = True) -> Column:
        def of(x: Column) -> Column:
            nan = F.exists(x, lambda v: F.isnan(v.cast("double")))
            first_nan = F.array_position(F.transform(x, lambda v: F.isnan(v.cast("double"))), F.lit(True))
            at = F.when(nan, first_nan).otherwise(F.array_position(x, take(x))) - 1
            return at if mask_identity else F.coalesce(at, F.lit(-1).cast("long"))

        return _reduced(c, of, False, keepdims)

    return place


#: Place of the first least or largest element; the first NaN comes before all; for an empty list NULL, or -1 where the identity is not masked.
argmin = _place(F.array_min)
argmax = _place(F.array_max)


def softmax(c) -> Column:
    """exp(x) over the list's sum of them; the peak and the sum are made once a list."""
    powers = lambda x: _let(F.array_max(x), lambda peak: F.transform(x, lambda v: F.exp(v - peak)))
    return _let(_c(c), lambda x: _let(powers(x), lambda e: _let(_fold(_kept(e)), lambda total: F.transform(e, lambda v: v / total))))


# ---------------------------------------------------------------- structure


def num(c, axis: int = 1) -> Column:
    return F.when(_c(c).isNotNull(), F.size(_c(c)).cast("long")) if axis == 1 else F.transform(_c(c), lambda x: num(x, axis - 1))


def _struct(values: Sequence[Column], fields: Sequence[str] | None) -> Column:
    names = fields or [str(i) for i in range(len(values))]
    return F.struct(*[v.alias(n) for v, n in builtins.zip(values, names, strict=True)])


def combinations(c, n: int = 2, replacement: bool = False, fields: Sequence[str] | None = None) -> Column:
    """Structs of n elements, in the order of their places; each element once unless replacement. Each rest is cut once, not once an element."""

    def pick(rest: Column, picked: list[Column]) -> Column:
        if len(picked) == n - 1:
            return F.transform(rest, lambda x: _struct([*picked, x], fields))
        later = lambda all, i: F.slice(all, i + (1 if replacement else 2), F.size(all))
        return _let(rest, lambda all: F.flatten(F.transform(all, lambda x, i: pick(later(all, i), [*picked, x]))))

    return pick(_c(c), [])


def local_index(c) -> Column:
    return F.transform(_c(c), lambda x, i: i.cast("long"))


def argcombinations(c, n: int = 2, replacement: bool = False, fields: Sequence[str] | None = None) -> Column:
    return combinations(local_index(c), n, replacement, fields)


def cartesian(lists: Sequence | Mapping, nested: bool = False, fields: Sequence[str] | None = None) -> Column:
    """Structs of one element from each list, the last list's fastest; nested: a list for each element of the first."""
    if isinstance(lists, Mapping):
        lists, fields = list(lists.values()), list(lists)
    lists = [_c(c) for c in lists]

    def pick(at: int, picked: list[Column]) -> Column:
        if at == len(lists) - 1:
            return F.transform(lists[at], lambda x: _struct([*picked, x], fields))
        deeper = F.transform(lists[at], lambda x: pick(at + 1, [*picked, x]))
        return deeper if nested and at == 0 else F.flatten(deeper)

    return pick(0, [])


def argcartesian(lists: Sequence | Mapping, nested: bool = False, fields: Sequence[str] | None = None) -> Column:
    if isinstance(lists, Mapping):
        return cartesian({k: local_index(c) for k, c in lists.items()}, nested)
    return cartesian([local_index(c) for c in lists], nested, fields)


def _same_size(first: Column, *others: Column, then: Column) -> Column:
    same = F.lit(True)
    for c in others:
        same = same & (F.size(first) == F.size(c))
    return F.when(same, then).when(first.isNotNull(), F.raise_error(F.lit("lists of unequal length")))


def zip(fields: Mapping[str, object], depth_limit: int | None = None, scalars: Sequence[str] = ()) -> Column:
    """One list of structs from several lists of equal length; names in `scalars` are broadcast. depth_limit 1: one struct of the columns."""
    columns = {k: _c(v) for k, v in fields.items()}
    if depth_limit == 1 or set(scalars) == set(columns):
        return F.struct(*[v.alias(k) for k, v in columns.items()])
    lists = {k: v for k, v in columns.items() if k not in scalars}
    first = next(iter(lists.values()))
    indexed = F.transform(first, lambda x, i: F.struct(*[(columns[k] if k in scalars else F.get(columns[k], i)).alias(k) for k in columns]))
    return _same_size(*lists.values(), then=indexed)


def unzip(c, *fields: str) -> list[Column]:
    """One list per field."""
    return [_c(c)[f] for f in fields]


def fields(c, *names: str) -> Column:
    """Lists of structs with the named fields only, in this order."""
    return F.transform(_c(c), lambda s: F.struct(*[s[n].alias(n) for n in names]))


def keep(c, condition) -> Column:
    """The elements where a list of booleans holds; lists of unequal length raise, a missing condition holds for nothing."""
    pairs = F.zip_with(_c(c), _c(condition), lambda x, k: F.struct(x.alias("x"), k.alias("k")))
    return _same_size(_c(c), _c(condition), then=F.transform(F.filter(pairs, lambda p: F.coalesce(p["k"], F.lit(False))), lambda p: p["x"]))


def with_field(c, value, where: str, broadcast: bool = False) -> Column:
    """Lists of structs with a field added or replaced: by another list, or by one value for all where broadcast."""
    c, value = _c(c), _c(value)
    if broadcast:
        return F.transform(c, lambda s: s.withField(where, value))
    return _same_size(c, value, then=F.zip_with(c, value, lambda s, v: s.withField(where, v)))


def without_field(c, *fields: str) -> Column:
    return F.transform(_c(c), lambda s: s.dropFields(*fields))


def firsts(c) -> Column:
    return F.get(_c(c), F.lit(0))


def take(c, index) -> Column:
    """Elements at the places of an index list; -1 counts from the end; NULL where there is none."""
    c = _c(c)
    return F.transform(_c(index), lambda i: F.get(c, F.when(i < 0, F.size(c) + i).otherwise(i)))


def sort(c, ascending: bool = True) -> Column:
    """NULLs last; NaN after every number, in either order."""
    c = _c(c)
    if ascending:
        return F.array_sort(c)
    numbers = F.filter(c, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")))
    rest = F.array_sort(F.filter(c, lambda x: x.isNull() | F.isnan(x.cast("double"))))
    return F.concat(F.sort_array(numbers, asc=False), rest)


def argsort(c, ascending: bool = True) -> Column:
    """Places in sorted order, stable."""
    key = lambda x: x.cast("double") if ascending else F.when(F.isnan(x.cast("double")), x.cast("double")).otherwise(-x.cast("double"))
    keyed = F.transform(_c(c), lambda x, i: F.struct(x.isNull().alias("n"), key(x).alias("x"), i.cast("long").alias("i")))
    return F.transform(F.array_sort(keyed), lambda s: s["i"])


def concatenate(lists: Sequence) -> Column:
    """Lists end to end; a NULL list gives NULL."""
    return F.concat(*[_c(c) for c in lists])


def flatten(c) -> Column:
    """One level of lists in a list less; missing inner lists count as empty."""
    return F.flatten(F.filter(_c(c), lambda x: x.isNotNull()))


def running(c, dtype: str | None = None) -> Column:
    """Running sums inside the list, as cumsum along the inner axis; a missing element makes the rest missing."""
    c = _c(c)
    value = _natural if dtype is None else (lambda x: x.cast(dtype))
    none = F.filter(F.transform(c, value), lambda x: F.lit(False))
    zero = F.struct(none.alias("sums"), F.when(F.lit(False), value(F.get(c, F.lit(0)))).otherwise(F.lit(0).cast("long" if dtype is None else dtype)).alias("last"))
    step = lambda a, x: _let(a["last"] + value(x), lambda t: F.struct(F.concat(a["sums"], F.array(t)).alias("sums"), t.alias("last")))
    return F.aggregate(c, zero, step, lambda a: a["sums"])


def unflatten(c, counts) -> Column:
    """A list cut into lists of the given sizes, which must add up."""
    c, counts = _c(c), _c(counts)
    cut = lambda ends: F.zip_with(counts, ends, lambda n, e: F.slice(c, (e - n + 1).cast("int"), n.cast("int")))
    return F.when(F.size(c) == sum(counts, dtype="long"), _let(running(counts, "long"), cut)).when(c.isNotNull(), F.raise_error(F.lit("counts do not add up")))


def run_lengths(c) -> Column:
    """Sizes of the runs of equal neighbours."""
    c = _c(c)
    starts = F.filter(local_index(c), lambda i: (i == 0) | ~F.get(c, i.cast("int")).eqNullSafe(F.get(c, (i - 1).cast("int"))))
    return F.transform(starts, lambda s, k: F.coalesce(F.get(starts, k + 1), F.size(c).cast("long")) - s)


def broadcast_to(value, c) -> Column:
    """value, once for every element of the list c."""
    value = _c(value)
    return F.transform(_c(c), lambda x: value)


def broadcast_arrays(columns: Sequence, lists: Sequence[bool], depth_limit: int | None = None) -> list[Column]:
    """All columns at one depth: values are repeated for each element of the lists, which must be of equal length. depth_limit 1: as they are."""
    columns = [_c(c) for c in columns]
    if depth_limit == 1 or not builtins.any(lists):
        return columns
    whole = [c for c, is_list in builtins.zip(columns, lists, strict=True) if is_list]
    return [_same_size(*whole, then=c if is_list else broadcast_to(c, whole[0])) for c, is_list in builtins.zip(columns, lists, strict=True)]


def to_regular(c, size: int) -> Column:
    """The list, checked to have this length."""
    c = _c(c)
    return F.when(F.size(c) == size, c).when(c.isNotNull(), F.raise_error(F.lit(f"a list has not {size} elements")))


def from_regular(c) -> Column:
    return _c(c)


def where(condition, a, b, lists: tuple[bool, bool, bool] = (True, True, True)) -> Column:
    """a where the condition holds, else b; `lists` tells which of the three are lists, the others are broadcast. A missing condition gives NULL."""
    condition, a, b = _c(condition), _c(a), _c(b)
    choose = lambda k, x, y: F.when(k, x).when(~k, y)
    if not lists[0] and not lists[1] and not lists[2]:
        return choose(condition, a, b)
    base = [c for c, is_list in ((condition, lists[0]), (a, lists[1]), (b, lists[2])) if is_list]
    at = lambda c, is_list, i: F.get(c, i) if is_list else c
    made = F.transform(base[0], lambda x, i: choose(at(condition, lists[0], i), at(a, lists[1], i), at(b, lists[2], i)))
    return _same_size(*base, then=made)


# ---------------------------------------------------------------- missing values and casts


def mask(c, condition, valid_when: bool = True) -> Column:
    """Elements where the condition is not valid_when, or missing, become NULL."""
    return _same_size(_c(c), _c(condition), then=F.zip_with(_c(c), _c(condition), lambda x, k: F.when(k == valid_when, x)))


def is_none(c) -> Column:
    return F.transform(_c(c), lambda x: x.isNull())


def fill_none(c, value) -> Column:
    value = _c(value)
    return F.transform(_c(c), lambda x: F.coalesce(x, value))


def drop_none(c) -> Column:
    return _kept(c)


def pad_none(c, target: int, clip: bool = False) -> Column:
    c = _c(c)
    missing = F.transform(F.sequence(F.lit(1), F.lit(target)), lambda i: F.get(c, i - 1))
    return F.when(F.size(c) < target, missing).otherwise(F.slice(c, 1, target) if clip else c)


def singletons(c) -> Column:
    """A value becomes a list of it, NULL an empty one."""
    return F.array_compact(F.array(_c(c)))


def full_like(c, value, dtype: str | None = "double", is_list: bool = True) -> Column:
    """value for every element that is present, in `dtype`, else in the elements' own type. is_list False is for a flat column."""

    def of(x: Column) -> Column:
        # nullif of a value and itself is a NULL of its type
        made = F.lit(value).cast(dtype) if dtype is not None else F.coalesce(F.nullif(x, x), F.lit(value))
        return F.when(x.isNotNull(), made)

    return F.transform(_c(c), of) if is_list else of(_c(c))


def zeros_like(c, dtype: str | None = "double", is_list: bool = True) -> Column:
    return full_like(c, 0, dtype, is_list)


def ones_like(c, dtype: str | None = "double", is_list: bool = True) -> Column:
    return full_like(c, 1, dtype, is_list)


#: Elements that nobody should rely on; zeros here.
empty_like = zeros_like


def values_astype(c, dtype: str, depth: int = 1) -> Column:
    """Leaves cast; what does not fit becomes NULL."""
    return _c(c).try_cast(dtype) if not depth else F.transform(_c(c), lambda x: values_astype(x, dtype, depth - 1))


def with_name(c: Column, name: str, record: str) -> Column:
    """The column under `name` with its record type noted in the metadata."""
    return c.alias(name, metadata={"record": record})


def with_parameter(c: Column, name: str, key: str, value) -> Column:
    return c.alias(name, metadata={key: value})


def without_parameters(c: Column, name: str) -> Column:
    return c.alias(name, metadata={})
