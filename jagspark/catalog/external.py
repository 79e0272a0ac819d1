"""udf_*, io_* and creation queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import ragged as R
from ..functions import regular as G
from ..functions import udf as U
from ..sources import io as IO
from .arrays import _r, _read, _rs

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, sql: str):
    def put(run):
        QUERIES[name], ORACLE_SQL[name] = run, sql
        return run

    return put


@_add("udf_map", "SELECT event_id, " + _rs("sqrt(value) + 1") + " AS r FROM events")
def udf_map(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", _r(U.map(lambda v: np.sqrt(v) + 1, F.col("value"), name="root")).alias("r"))


@_add("udf_apply", "SELECT event_id, " + _rs("value * user_id + event_id") + " AS r FROM events")
def udf_apply(spark, sf_dir):
    made = U.apply(lambda v, u, e: v * u + e, F.col("value"), F.col("user_id"), F.col("event_id"), name="affine")
    return _read(spark, sf_dir, "events").select("event_id", _r(made).alias("r"))


@_add("udf_gufunc", "SELECT vec_id, " + _rs("list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))", 3) + " AS r FROM embeddings")
def udf_gufunc(spark, sf_dir):
    dot = U.gufunc(lambda a, b: np.einsum("ni,ni->n", a.astype(float), b.astype(float)), "(i),(i)->()", F.col("embedding"), F.col("embedding"), name="dot")
    return _read(spark, sf_dir, "embeddings").select("vec_id", _r(dot, 3).alias("r"))


CORRECTION = {"edges": [0, 2, 4, 6, 100], "values": {"nominal": [0.90, 0.95, 1.00, 1.05], "up": [0.92, 0.97, 1.02, 1.07], "down": [0.88, 0.93, 0.98, 1.03]}, "flow": "clamp"}


@_add("udf_correction", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber < 2 THEN 0.9 WHEN l_linenumber < 4 THEN 0.95 WHEN l_linenumber < 6 THEN 1.0 ELSE 1.05 END::DOUBLE AS nominal, CASE WHEN l_quantity < 2 THEN 0.92 WHEN l_quantity < 4 THEN 0.97 WHEN l_quantity < 6 THEN 1.02 ELSE 1.07 END::DOUBLE AS up FROM lineitem")
def udf_correction(spark, sf_dir):
    lines = _read(spark, sf_dir, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", U.correction(CORRECTION, F.col("l_linenumber"), category="nominal").alias("nominal"), U.correction(CORRECTION, F.col("l_quantity"), category="up").alias("up"))


def _sigmoid(content: bytes):
    a, b = np.frombuffer(content)
    return lambda x: 1 / (1 + np.exp(-(a * x[:, 0].astype(float) + b)))


@_add("udf_model", "SELECT event_id, " + _rs("1 / (1 + exp(-(0.04::DOUBLE * value::FLOAT::DOUBLE - 0.5::DOUBLE)))") + " AS r FROM events")
def udf_model(spark, sf_dir):
    payload = U.Payload("sigmoid", np.array([0.04, -0.5]).tobytes(), note="slope and offset")
    return _read(spark, sf_dir, "events").select("event_id", _r(U.model(_sigmoid, payload, F.col("value"), expected_hash=payload.content_hash)).alias("r"))


@_add("io_from_parquet", "SELECT l_orderkey, l_quantity FROM lineitem")
def from_parquet(spark, sf_dir):
    return IO.from_parquet(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_quantity"])


@_add("io_ordinal", "SELECT event_id, event_id AS ordinal FROM events")
def ordinal(spark, sf_dir):
    """Row numbers in file order; the events are stored in the order of their ids."""
    return IO.from_parquet(spark, f"{sf_dir}/events.parquet", ["event_id"], ordinal="ordinal")


@_add("io_num_rows", "SELECT count(*) AS n FROM lineitem")
def num_rows(spark, sf_dir):
    return spark.range(1).select(F.lit(IO.num_rows(spark, f"{sf_dir}/lineitem.parquet")).alias("n"))


@_add("io_creation", "SELECT i AS ordinal, 0.0::DOUBLE AS zeros, 1.0::DOUBLE AS ones, 2.5::DOUBLE AS full, " + _rs("1 + i * 0.5") + " AS arange, " + _rs("CASE WHEN i = 99 THEN 5 ELSE -5 + i * (10.0::DOUBLE / 99) END") + " AS linspace FROM range(100) t(i)")
def creation(spark, sf_dir):
    made = IO.zeros(spark, 100, "zeros")
    for other in (IO.ones(spark, 100, "ones"), IO.full(spark, 100, 2.5, "full"), IO.arange(spark, 1.0, 51.0, 0.5, "arange"), IO.linspace(spark, -5.0, 5.0, 100, "linspace")):
        made = made.join(other, "ordinal")
    return made.select("ordinal", "zeros", "ones", "full", _r(F.col("arange")).alias("arange"), _r(F.col("linspace")).alias("linspace"))


@_add("io_partitions", "SELECT event_id, value FROM events")
def partitions(spark, sf_dir):
    """Three parts of the file, read one by one and put together."""
    parts = [IO.read_partition(spark, p, ["event_id", "value"]) for p in IO.make_partitions(spark, f"{sf_dir}/events.parquet", 3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---------------------------------------------------------------- regular arrays


def _cell(name: str, sql: str, make) -> None:
    QUERIES[name] = lambda spark, sf_dir: _read(spark, sf_dir, "embeddings").select("vec_id", _r(make(F.col("embedding")), 4).alias("r"))
    ORACLE_SQL[name] = f"SELECT vec_id, {_rs(sql, 4)} AS r FROM embeddings"


_total = R.sum
_cell("reg_subscript", "list_sum(list_transform(embedding[17:24], lambda x: x::DOUBLE))", lambda c: _total(G.subscript(G.reshape(c, 8), 2)))
_cell("reg_subscript_slice", "list_sum(list_transform([embedding[i * 8 + 4] for i in range(1, 8)], lambda x: x::DOUBLE))", lambda c: _total(G.ravel(G.subscript(G.reshape(c, 8), slice(1, None), slice(3, -4)))))
_cell("reg_take", "embedding[6]::DOUBLE * 10 + embedding[64]::DOUBLE", lambda c: F.get(G.take(c, [5, -1]), 0).cast("double") * 10 + F.get(G.take(c, [5, -1]), 1).cast("double"))
_cell("reg_squeeze", "embedding[1]::DOUBLE", lambda c: F.get(G.squeeze(G.expand_dims(c)), 0))
_cell("reg_swapaxes", "list_sum(list_transform([embedding[i * 8 + 3] for i in range(0, 8)], lambda x: x::DOUBLE))", lambda c: _total(F.get(G.swapaxes(G.reshape(c, 8)), 2)))
_cell("reg_ravel", "list_sum(list_transform(embedding, lambda x: x::DOUBLE))", lambda c: _total(G.ravel(G.transpose(G.reshape(c, 16)))))
_cell("reg_hstack", "2 * list_sum(list_transform(embedding, lambda x: x::DOUBLE)) + len(embedding)", lambda c: _total(G.hstack([c, c])) + F.size(c))
_cell("reg_clip", "list_sum(list_transform(embedding, lambda x: least(greatest(x::DOUBLE, -0.1::DOUBLE), 0.05::DOUBLE)))", lambda c: _total(F.transform(c, lambda x: G.clip(x, -0.1, 0.05))))
_cell("reg_round", "list_sum(list_transform(embedding, lambda x: round_even(x::DOUBLE * 100, 0) / 100))", lambda c: _total(F.transform(c, lambda x: G.round(x, 2))))
_cell("reg_astype", "list_sum(list_transform(embedding, lambda x: trunc(x::DOUBLE * 100)))", lambda c: _total(F.transform(c, lambda x: G.astype(x.cast("double") * 100, "int"))))
_cell("reg_cumsum_inner", "list_sum(list_transform(list_zip(embedding, range(64, 0, -1)), lambda p: p[1]::DOUBLE * p[2]))", lambda c: _total(R.running(c, "double")))
