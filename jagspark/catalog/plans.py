"""Sinks, sources, looks at tables, user reductions, resumable runs, bundles and streams as queries, each with SQL for the rows that must come out."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import inspect as I
from ..operators import hist as H
from ..operators import reduce as D
from ..operators import relational as J
from ..plans import durable as P
from ..plans import readset as Q
from ..sources import io as IO
from ..streaming import histograms as S
from .arrays import _bin, _r, _read, _rs
from .nested import orders

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, sql: str):
    def put(run):
        QUERIES[name], ORACLE_SQL[name] = run, sql
        return run

    return put


def _place(spark: SparkSession, name: str) -> str:
    return f"{IO.shared_dir(spark)}/catalog/{name}-{uuid.uuid4().hex}"


@_add("io_write_steps", "SELECT event_id, value FROM events")
def write_steps(spark, sf_dir):
    """Written in parts with a prefix, read back from the returned paths."""
    events = _read(spark, sf_dir, "events").select("event_id", "value").repartition(6)
    return IO.from_parquet(spark, IO.to_parquet(events, _place(spark, "steps"), steps_per_file=2, prefix="ev"))


@_add("io_write_ordered", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal FROM orders")
def write_ordered(spark, sf_dir):
    """Written in parts by ranges of a key: the row numbers over all parts follow it."""
    files = IO.to_parquet(_read(spark, sf_dir, "orders").select("o_orderkey"), _place(spark, "ordered dir"), partitions=5, ordinal="o_orderkey")
    return IO.from_parquet(spark, files, ordinal="ordinal")


@_add("io_write_flat", "SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY 1")
def write_flat(spark, sf_dir):
    """One flat column, written and read as such."""
    files = IO.to_parquet(_read(spark, sf_dir, "lineitem"), _place(spark, "flat"), column="l_quantity")
    return IO.from_parquet_flat(spark, files).groupBy("l_quantity").agg(F.count("*").alias("n"))


@_add("io_write_ragged", "SELECT o_orderkey AS k, count(l_orderkey) AS n, " + _rs("coalesce(sum(l_quantity), 0)") + " AS total FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def write_ragged(spark, sf_dir):
    """Lists of structs, written and read back with one leaf."""
    files = IO.to_parquet(orders(spark, sf_dir).select("k", "items"), _place(spark, "ragged"))
    back = IO.from_parquet(spark, files, ["k", "items.qty"])
    return back.select("k", F.size("items").cast("long").alias("n"), _r(F.aggregate("items", F.lit(0.0), lambda a, s: a + s["qty"])).alias("total"))


class Squares(IO.PartitionedSource):
    """A user-defined source: i and its square."""

    @classmethod
    def name(cls) -> str:
        return "jagspark_squares"

    def schema(self) -> str:
        return "i long, square long"

    def size(self) -> int:
        return 1000

    def read_range(self, start: int, stop: int) -> Iterator[tuple]:
        yield from ((i, i * i) for i in range(start, stop))


@_add("io_partitioned_source", "SELECT i, i * i AS square FROM range(1000) t(i)")
def partitioned_source(spark, sf_dir):
    spark.dataSource.register(Squares)
    return spark.read.format("jagspark_squares").option("steps", 7).load()


@_add("io_sources", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def sources(spark, sf_dir):
    """Named sources of a session, one made when first used, met in SQL."""
    held = IO.Sources(spark)
    held.add("named_customers", lambda where: _read(spark, where, "customer"), where=sf_dir)
    held.add("named_nations", _read(spark, sf_dir, "nation"))
    assert [held[n] for n in held.names()]
    return spark.sql("SELECT n_name, count(*) AS n FROM named_customers JOIN named_nations ON n_nationkey = c_nationkey GROUP BY n_name")


@_add("io_random", "SELECT 5000::BIGINT AS n, true AS inside, true AS again, true AS centred")
def random(spark, sf_dir):
    """Seeded draws: in range, alike for the same seed, centred."""
    one, two = (IO.Random(spark, 11).uniform(5000, -1.0, 3.0) for _ in range(2))
    both = one.join(two.withColumnRenamed("x", "y"), "ordinal")
    return both.agg(F.count("*").alias("n"), F.bool_and((F.col("x") >= -1) & (F.col("x") < 3)).alias("inside"), F.bool_and(F.col("x") == F.col("y")).alias("again"), (F.abs(F.avg("x") - 1) < 0.1).alias("centred"))


@_add("io_from_record", "SELECT i AS ordinal, i * 0.5::DOUBLE AS a, (i % 3)::BIGINT AS b FROM range(100) t(i)")
def from_record(spark, sf_dir):
    return IO.from_record(spark, a=np.arange(100) * 0.5, b=np.arange(100) % 3)


@_add("io_from_lists", "SELECT i AS k, (i % 4)::BIGINT AS n, (i * (i % 4))::BIGINT AS total FROM range(50) t(i)")
def from_lists(spark, sf_dir):
    rows = IO.from_lists(spark, [{"k": i, "x": [i] * (i % 4)} for i in range(50)], "k long, x array<long>")
    return rows.select("k", F.size("x").cast("long").alias("n"), F.aggregate("x", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


@_add("io_schema", "SELECT (row_number() OVER () - 1)::INTEGER AS place, column_name AS name FROM (DESCRIBE lineitem)")
def schema(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(IO.schema_of(spark, f"{sf_dir}/lineitem.parquet").names)), "place int, name string")


@_add("insp_fields", "SELECT * FROM (VALUES ('items', 'n,qty,price,disc,tax,part,supp,flag', 'int', 2), ('k', '', 'bigint', 1)) t(path, fields, first, ndim)")
def fields(spark, sf_dir):
    df = orders(spark, sf_dir)
    rows = [(p, ",".join(I.fields(df, p)), I.type_of(df, f"{p}.n" if p == "items" else p), I.ndim(df, p)) for p in ("items", "k")]
    return spark.createDataFrame(rows, "path string, fields string, first string, ndim int")


@_add("insp_to_list", "SELECT row_number() OVER (ORDER BY event_id) - 1 AS place, value FROM events WHERE event_id < 200")
def to_list(spark, sf_dir):
    """The eager look at a head: its values in order."""
    held = I.to_list(_read(spark, sf_dir, "events").where("event_id < 200"), "value", "event_id")
    return spark.createDataFrame(list(enumerate(held)), "place long, value double")


@_add("red_monoid", "SELECT count(*) AS n, max(value) AS top, min(value) AS low FROM events")
def monoid(spark, sf_dir):
    """A user's reduction, folded in a tree."""
    one = lambda f: pd.DataFrame({"n": [len(f)], "top": [f["value"].max()], "low": [f["value"].min()]})
    fold = lambda f: pd.DataFrame({"n": [f["n"].sum()], "top": [f["top"].max()], "low": [f["low"].min()]})
    return D.Monoid(one, fold, "n long, top double, low double", fan=2).run(_read(spark, sf_dir, "events").select("value").repartition(5))


@_add("join_broadcast_choice", "SELECT b AS build, p AS probe, n, b * n < b + p AS copies FROM (VALUES (1000::BIGINT, 1000000::BIGINT, 8::BIGINT), (1000000, 1000, 8), (10, 70, 8), (10, 71, 8)) t(b, p, n)")
def broadcast_choice(spark, sf_dir):
    rows = [(b, p, n, J.broadcast_choice(b, p, n)) for b, p, n in ((1000, 1000000, 8), (1000000, 1000, 8), (10, 70, 8), (10, 71, 8))]
    return spark.createDataFrame(rows, "build long, probe long, n long, copies boolean")


@_add("join_sized", "SELECT o_orderkey, c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey")
def sized(spark, sf_dir):
    left = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), "o_orderkey")
    return J.sized_join(left, _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"), "c_nationkey"), "c").select("o_orderkey", "c_nationkey")


@_add("plan_resumable", "SELECT event_id, value * 2 AS twice FROM events")
def resumable(spark, sf_dir):
    """Stopped, gone on with and run again over parts of a table: every row once."""
    where, store = _place(spark, "runs in"), _place(spark, "runs out")
    files = IO.to_parquet(_read(spark, sf_dir, "events").select("event_id", "value"), where, partitions=4)
    step = lambda df: df.select("event_id", (F.col("value") * 2).alias("twice"))
    P.run_resumable(spark, files, step, store, files_per_batch=1, stop=P.StopCondition(rows=1))
    P.run_resumable(spark, files, step, store, files_per_batch=2)
    return P.results(spark, store, P.run_resumable(spark, files, step, store, files_per_batch=3).run)


@_add("plan_dead_letters", "SELECT event_id FROM events WHERE event_id <> 7")
def dead_letters(spark, sf_dir):
    """A row that always fails is cut out by halving; all others come through."""
    where, store = _place(spark, "letters in"), _place(spark, "letters out")
    files = IO.to_parquet(_read(spark, sf_dir, "events").select("event_id"), where, partitions=2)
    step = lambda df: df.select(F.when(F.col("event_id") == 7, F.raise_error(F.lit("bad row"))).otherwise(F.col("event_id")).alias("event_id"))
    return P.results(spark, store, P.run_resumable(spark, files, step, store, policy=P.Retry(again=0)).run)


@_add("plan_bundle", "SELECT o_orderstatus, count(*) AS n, " + _rs("sum(o_totalprice)", 2) + " AS total FROM orders GROUP BY 1")
def bundle(spark, sf_dir):
    """A query with its inputs and payloads, stored, checked and run again."""
    path = _place(spark, "bundle")
    P.build_bundle(spark, path, {"o": _read(spark, sf_dir, "orders").select("o_orderstatus", "o_totalprice")}, "SELECT o_orderstatus, o_totalprice FROM {o}", {"note": b"as sold"})
    return P.reproduce(spark, path).groupBy("o_orderstatus").agg(F.count("*").alias("n"), _r(F.sum("o_totalprice"), 2).alias("total"))


@_add("plan_projection", "SELECT * FROM (VALUES ('l_quantity', 0), ('none', 1)) t(expected, more)")
def projection(spark, sf_dir):
    """What a plan reads beyond what it should."""
    df = _read(spark, sf_dir, "lineitem").select("l_quantity")
    rows = [(e, len(Q.check_projection(df, [e], "pass"))) for e in ("l_quantity", "none")]
    return spark.createDataFrame(rows, "expected string, more int")


@_add("hist_stream", "SELECT b AS bin, count(*) AS n FROM (SELECT " + _bin("value", 30, 0.0, 300.0) + " AS b FROM events) WHERE b IS NOT NULL GROUP BY 1")
def stream(spark, sf_dir):
    """A histogram filled by a stream over the table's files."""
    if IO.is_folder(spark, where := f"{sf_dir}/events.parquet"):
        source = spark.readStream.schema(IO.schema_of(spark, where)).parquet(where)
    else:
        source = spark.readStream.schema(IO.schema_of(spark, where)).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    name = f"fill_{uuid.uuid4().hex}"
    query = S.fill(source, F.col("value"), 30, 0.0, 300.0).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", _place(spark, "stream")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).select("bin", "n")


@_add("hist_axis_weights", "SELECT b AS bin, count(*) AS n, " + _rs("sum(l_discount)") + " AS sumw FROM (SELECT " + _bin("l_quantity", 10, 0.0, 50.0, closed=False) + " AS b, l_discount FROM lineitem) WHERE b IS NOT NULL GROUP BY 1")
def axis_weights(spark, sf_dir):
    """Weighted fill with the last bin open."""
    h = H.histogram(_read(spark, sf_dir, "lineitem"), F.col("l_quantity"), 10, 0.0, 50.0, F.col("l_discount"), closed_right=False).where("n > 0")
    return h.select("bin", "n", _r(F.col("sumw")).alias("sumw"))
