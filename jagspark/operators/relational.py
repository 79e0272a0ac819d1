"""Equi-joins with coalesced keys, regrouped joins, key packing, routing and repartitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.elementwise import _let

HOWS = {"inner": "inner", "left": "left", "right": "right", "outer": "full"}


def join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """SQL join with duplicates: the keys once (coalesced), then left's other columns, then right's.

    NULL keys pair with NULL keys; a row without partner stays in left, right and outer joins, with its key. A column of both
    sides that is no key is refused. Catalyst picks the strategy, adaptive execution splits skewed keys.
    """
    on = [on] if isinstance(on, str) else list(on)
    if how not in HOWS:
        raise ValueError(f"how must be one of {', '.join(HOWS)}")
    shared = sorted(set(left.columns) & set(right.columns) - set(on))
    if shared:
        raise ValueError(f"columns of both sides that are no keys: {', '.join(shared)}")
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in on], *[c for c in right.columns if c not in on])
    equal = None
    for k in on:
        one = left[k].eqNullSafe(F.col(f"_r_{k}"))
        equal = one if equal is None else equal & one
    joined = left.join(renamed, equal, HOWS[how])
    return joined.select(*[F.coalesce(left[k], F.col(f"_r_{k}")).alias(k) for k in on], *[left[c] for c in left.columns if c not in on], *[c for c in right.columns if c not in on])


def join_sums(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """What grouping join's rows by key gives: the keys, `rows`, and for each other column c `n_c` (values present) and `sum_c`.

    Each side is summed by key first and its sums multiplied by the other's rows of that key, so that no pair of rows is made: a key
    with m rows left and n right (missing keys among them) costs m + n, not m * n. Sums beyond a long raise.
    """
    on = [on] if isinstance(on, str) else list(on)

    def summed(df: DataFrame, rows: str) -> DataFrame:
        rest = [c for c in df.columns if c not in on]
        return df.groupBy(*on).agg(F.count("*").alias(rows), *[F.count(c).alias(f"n_{c}") for c in rest], *[F.sum(c).alias(f"sum_{c}") for c in rest])

    joined = join(summed(left, "_l"), summed(right, "_r"), on, how)
    times = {**{c: "_r" for c in left.columns}, **{c: "_l" for c in right.columns}}
    partners = {side: F.coalesce(side, F.lit(1).cast("long")) for side in ("_l", "_r")}
    sums = [(F.coalesce(f"n_{c}", F.lit(0).cast("long")) * partners[times[c]]).alias(f"n_{c}") for c in times if c not in on]
    sums += [(F.col(f"sum_{c}") * partners[times[c]]).alias(f"sum_{c}") for c in times if c not in on]
    return joined.select(*on, (partners["_l"] * partners["_r"]).alias("rows"), *sums)


def grouped_join(left: DataFrame, right: DataFrame, on: str | list[str], ordinal: str, name: str = "items", how: str = "left") -> DataFrame:
    """Each left row with the list of its partners' other columns, sorted; rows without partners have an empty list (how = left) or go (inner).

    The right side is grouped by key first, so a left row is never multiplied.
    """
    on = [on] if isinstance(on, str) else list(on)
    rest = [c for c in right.columns if c not in on]
    lists = right.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias(name))
    kind = dict(lists.dtypes)[name]
    joined = join(left, lists, on, how)
    return joined.withColumn(name, F.coalesce(name, F.from_json(F.lit("[]"), kind))).select(ordinal, *[c for c in joined.columns if c != ordinal])


PACK_BITS, PACK_FIELDS = 20, 3


def pack_key(*fields: Column, lead_bits: int = PACK_BITS) -> Column:
    """Up to three whole numbers below 2^20 as one long, the first most significant; others raise.

    lead_bits lets the first take more, up to what the others leave of 64. Keys stay distinct; with the 64th bit set, as from
    2^23 on beside two fields, the long is negative: the same bits as the unsigned key.
    """
    if not 1 <= len(fields) <= PACK_FIELDS:
        raise ValueError(f"1 to {PACK_FIELDS} fields are packed")
    if not 1 <= lead_bits <= min(62, 64 - PACK_BITS * (len(fields) - 1)):
        raise ValueError(f"{lead_bits} bits of the first field and {PACK_BITS} of each other do not fit")
    packed = None
    for f in fields:
        f, bits = f.cast("long"), lead_bits if packed is None else PACK_BITS
        part = F.when((f >= 0) & (f < (1 << bits)), f).when(f.isNotNull(), F.raise_error(F.lit(f"a key field is not in [0, 2^{bits})")).cast("long"))
        packed = part if packed is None else F.shiftleft(packed, PACK_BITS).bitwiseOR(part)
    return packed


def route(key: Column, parts: int, salt: int = 0) -> Column:
    """The part of a packed key: the first 8 bytes of SHA-256 over the key's 8 big-endian bytes (and the salt's, if any), modulo parts."""
    eight = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    body = eight(key.cast("long")) if not salt else F.concat(eight(key.cast("long")), eight(F.lit(salt).cast("long")))
    high = F.conv(F.substring(F.sha2(body, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (high % F.lit(parts).cast("decimal(20,0)")).cast("int")


def repartition(df: DataFrame, by: str | list[str] | None = None, n: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """By key, to n parts, or to parts of about target_bytes (by the plan's size estimate; adaptive execution rebalances)."""
    keys = [by] if isinstance(by, str) else list(by or [])
    if target_bytes is not None:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        n = max(1, -(-size // target_bytes))
    if n is None:
        return df.repartition(*keys) if keys else df.hint("rebalance")
    return df.repartition(n, *keys)


def broadcast_choice(build_bytes: int, probe_bytes: int, n: int) -> bool:
    """Whether n copies of the build side cost less than moving both sides."""
    return build_bytes * n < build_bytes + probe_bytes


def sized_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner", most: int = 64 << 20) -> DataFrame:
    """join, with a broadcast of the right side only while the plan bounds its size; else as Catalyst decides."""
    size = int(str(right._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return join(left, F.broadcast(right) if size <= most and how in ("inner", "left") else right, on, how)


def isin(df: DataFrame, column: str, members: DataFrame, member: str, name: str = "isin") -> DataFrame:
    """df with a flag: whether the value is among the members. NaN and NULL are in nothing."""
    distinct = members.select(F.col(member).alias("_m")).where(F.col("_m").isNotNull()).distinct().withColumn("_hit", F.lit(True))
    joined = df.join(distinct, df[column] == F.col("_m"), "left")
    return joined.withColumn(name, F.coalesce("_hit", F.lit(False)) & ~F.coalesce(F.isnan(F.col(column).cast("double")), F.lit(False))).drop("_m", "_hit")


def unique(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values."""
    return df.select(column).distinct().orderBy(column)


def bincount(df: DataFrame, column: str) -> DataFrame:
    """(value, n) for 0 to the greatest value, with zeros."""
    counts = df.groupBy(F.col(column).cast("long").alias("value")).agg(F.count("*").alias("n"))
    top = counts.agg(F.max("value")).first()[0]
    return df.sparkSession.range(0 if top is None else top + 1).withColumnRenamed("id", "value").join(counts, "value", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def searchsorted(sorted_values: Column, x: Column, side: str = "left") -> Column:
    """Where x would go in a sorted list column, by halving: before equal elements (left) or after them (right)."""

    def halve(state: Column, values: Column) -> Column:
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        value = F.get(values, middle)
        right = (state["low"] < state["high"]) & ((value < x) if side == "left" else (value <= x))
        left = (state["low"] < state["high"]) & ~right
        return F.struct(F.when(right, middle + 1).otherwise(state["low"]).alias("low"), F.when(left, middle).otherwise(state["high"]).alias("high"))

    def of(values: Column) -> Column:
        steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + 1)).cast("int"))
        start = F.struct(F.lit(0).alias("low"), F.size(values).alias("high"))
        return F.when(x.isNotNull(), F.aggregate(steps, start, lambda a, _: halve(a, values), lambda a: a["low"]))

    return _let(sorted_values, of)
