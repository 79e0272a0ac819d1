"""Regular (rectangular) lists: inner geometry with rows kept whole, casts and bounds, as native column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .elementwise import NAN, _c, _d


def subscript(c, *index: int | slice) -> Column:
    """Indexing behind the row axis: subscript(c, 0, slice(1, 3)) is a[:, 0, 1:3], with steps of either sign. Negative numbers count from the end;
    an index out of range raises."""
    c = _c(c)
    if not index:
        return c
    head, *rest = index
    if isinstance(head, slice):
        cut = _cut(c, head.start, head.stop, 1 if head.step is None else head.step)
        return F.transform(cut, lambda x: subscript(x, *rest)) if rest else cut
    return subscript(F.element_at(c, head + 1 if head >= 0 else head), *rest)


def _cut(c: Column, start: int | None, stop: int | None, step: int) -> Column:
    if not step:
        raise ValueError("a slice's step cannot be zero")
    size = F.size(c)
    least, most = (F.lit(0), size) if step > 0 else (F.lit(-1), size - 1)  # the bounds that a slice's ends are held to
    held = lambda v: F.least(F.greatest(F.lit(v) if v >= 0 else size + v, least), most)
    first = (least if step > 0 else most) if start is None else held(start)
    last = (most if step > 0 else least) if stop is None else held(stop)
    low, high = (first, last) if step > 0 else (last + 1, first + 1)
    whole = F.slice(c, (low + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int"))
    whole = whole if step > 0 else F.reverse(whole)
    return whole if abs(step) == 1 else F.filter(whole, lambda x, i: i % abs(step) == 0)


def take(c, places: Sequence[int]) -> Column:
    """The elements at these places of each row's list."""
    return F.array(*[F.element_at(_c(c), p + 1 if p >= 0 else p) for p in places])


def _at(c, axis: int, of) -> Column:
    """`of` applied to the lists `axis` levels below the row's own."""
    return of(_c(c)) if not axis else F.transform(_c(c), lambda x: _at(x, axis - 1, of))


def squeeze(c, axis: int = 0) -> Column:
    """The one element of lists of length one on an inner axis (0: the row's own list); others raise."""

    def one(x: Column) -> Column:
        return F.when(F.size(x) == 1, F.get(x, F.lit(0))).when(x.isNotNull(), F.raise_error(F.lit("the axis has not length one")))

    return _at(c, axis, one)


def expand_dims(c, axis: int = 0) -> Column:
    """A new inner axis of length one before inner axis `axis`."""
    return _at(c, axis, lambda x: F.array(x))


def swapaxes(c, a1: int = 0, a2: int = 1) -> Column:
    """Two inner axes exchanged (0: the row's own list)."""
    a1, a2 = sorted((a1, a2))
    axes = list(range(a2 + 1))
    axes[a1], axes[a2] = a2, a1
    return transpose(c, *axes)


def _turned(c: Column) -> Column:
    """Rows and columns of a matrix exchanged."""
    return F.transform(F.get(c, F.lit(0)), lambda _, j: F.transform(c, lambda row: F.get(row, j)))


def transpose(c, *axes: int) -> Column:
    """The inner axes in another order, by exchanges of neighbours; without axes the two of a matrix are exchanged."""
    order, swaps, c = list(axes or (1, 0)), [], _c(c)
    if sorted(order) != list(range(len(order))):
        raise ValueError(f"not an order of axes: {order}")
    # the exchanges that sort the order, undone from the last on, make it
    for end in range(len(order) - 1, 0, -1):
        for at in range(end):
            if order[at] > order[at + 1]:
                order[at], order[at + 1] = order[at + 1], order[at]
                swaps.append(at)
    for at in reversed(swaps):
        c = _at(c, at, _turned)
    return c


def reshape(c, *shape: int) -> Column:
    """A row's list in another inner shape; one number is the width of a matrix's rows, -1 stands for what the others leave. What does not fit raises."""
    c, shape = _c(c), (-1, *shape) if len(shape) == 1 else shape
    if sum(n == -1 for n in shape) > 1:
        raise ValueError("only one length may be left open")
    known = 1
    for n in shape:
        known *= 1 if n == -1 else n
    size, open_ = F.size(c), F.floor(F.size(c) / known).cast("int")
    fits = size % known == 0 if -1 in shape else size == known
    out = c
    for n in reversed(shape[1:]):
        out = _rows(out, open_ if n == -1 else F.lit(n))
    return F.when(fits, out).when(c.isNotNull(), F.raise_error(F.lit(f"the list does not fill the shape {shape}")))


def _rows(c: Column, width: Column) -> Column:
    n = F.floor(F.size(c) / width).cast("int")
    some = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(some, lambda i: F.slice(c, i * width + 1, width))


def ravel(c, depth: int = 1) -> Column:
    """All levels below the row in one list."""
    c = _c(c)
    for _ in range(depth):
        c = F.flatten(c)
    return c


def hstack(lists: Sequence) -> Column:
    return F.concat(*[_c(c) for c in lists])


def stack(*_):
    """Refused: a new row axis has no place in a table of rows."""
    raise TypeError("stack and vstack make a new row axis; use concatenate or hstack")


vstack = stack


def clip(x, low: float | None = None, high: float | None = None) -> Column:
    """Bounded values; NaN stays."""
    x = _d(x)
    bounded = x if low is None else F.greatest(x, F.lit(float(low)))
    bounded = bounded if high is None else F.least(bounded, F.lit(float(high)))
    return F.when(F.isnan(x), F.lit(NAN)).when(x.isNotNull(), bounded)


def round(x, decimals: int = 0) -> Column:
    """Halves to even, in NumPy's way: scale, round, scale back."""
    x, factor = _d(x), float(10 ** abs(decimals))
    return F.rint(x * factor) / factor if decimals >= 0 else F.rint(x / factor) * factor


def astype(x, dtype: str) -> Column:
    """Cast; what does not fit becomes NULL."""
    return _c(x).try_cast(dtype)
