"""Regular lists, inspection, named sources and file parts."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from jagspark.functions import inspect as N
from jagspark.functions import regular as G
from jagspark.sources import io as IO

A = np.arange(24.0).reshape(2, 3, 4)


@pytest.fixture(scope="module")
def cubes(spark):
    return spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(A)], "i long, c array<array<double>>")


@pytest.mark.parametrize(
    "make, want",
    [
        (lambda c: G.subscript(c, 1), A[:, 1]), (lambda c: G.subscript(c, -1, 2), A[:, -1, 2]), (lambda c: G.subscript(c, slice(1, None), slice(0, -1)), A[:, 1:, :-1]), (lambda c: G.subscript(c, slice(-9, 9), 0), A[:, -9:9, 0]),
        (lambda c: G.swapaxes(c), A.swapaxes(1, 2)), (lambda c: G.ravel(c), A.reshape(2, -1)), (lambda c: G.reshape(G.ravel(c), 6), A.reshape(2, 2, 6)), (lambda c: G.expand_dims(c), A[:, None]), (lambda c: G.squeeze(G.expand_dims(c)), A),
        (lambda c: G.take(c, [2, 0, -1]), A[:, [2, 0, -1]]), (lambda c: G.hstack([c, c]), np.concatenate([A, A], 1)),
    ],
)
def test_inner_geometry(cubes, make, want):
    assert [r["r"] for r in cubes.orderBy("i").select(make(F.col("c")).alias("r")).collect()] == want.tolist()


def test_refusals(cubes):
    with pytest.raises(TypeError):
        G.stack(1, 2)
    with pytest.raises(ValueError):
        G.subscript(F.col("c"), slice(0, 2, 0))
    for make in (lambda c: G.subscript(c, 9), G.squeeze, lambda c: G.reshape(G.ravel(c), 5)):
        with pytest.raises(Exception, match="length one|do.* not fill|INVALID_ARRAY_INDEX|index"):
            cubes.select(make(F.col("c"))).collect()


def test_values(spark):
    x = [0.5, 1.5, 2.5, -2.5, 1.005, math.nan, math.inf, 1234.0]
    rows = spark.createDataFrame([(v,) for v in x], "x double").select("x", G.round(F.col("x")).alias("r"), G.round(F.col("x"), 1).alias("d"), G.round(F.col("x"), -2).alias("h"), G.clip(F.col("x"), 0, 2).alias("c"), G.astype(F.col("x"), "int").alias("i")).collect()
    for r in rows:
        for name, want in (("r", np.round(r["x"])), ("d", np.round(r["x"], 1)), ("h", np.round(r["x"], -2)), ("c", np.clip(r["x"], 0, 2))):
            assert r[name] == want or math.isnan(r[name]) and math.isnan(want)
        assert r["i"] == (int(r["x"]) if math.isfinite(r["x"]) else None)


def test_inspection(spark, cubes):
    df = spark.createDataFrame([(1, [(1.0, 2)])], "k long, j array<struct<pt: double, n: int>>")
    assert N.fields(df) == ["k", "j"] and N.fields(df, "j") == ["pt", "n"] and N.type_of(df, "j.pt") == "double" and N.ndim(cubes, "c") == 3 and N.backend_of(df).startswith("spark")
    assert N.to_list(cubes, "i", "i") == [0, 1]
    with pytest.raises(ValueError):
        N.to_list(cubes, "i", "i", most=1)


def test_sources_and_parts(spark, tmp_path):
    held = IO.Sources(spark)
    held.add("numbers", lambda n: spark.range(n), n=5)
    assert held["numbers"].count() == 5 and spark.sql("SELECT sum(id) FROM numbers").first()[0] == 10 and held.names() == ["numbers"]
    with pytest.raises(ValueError):
        held.add("numbers", None)
    spark.range(11).coalesce(1).write.parquet(str(tmp_path / "n"))
    parts = IO.make_partitions(spark, str(tmp_path / "n"), 4)
    rows = [sorted(r["id"] for r in IO.read_partition(spark, p).collect()) for p in parts]
    assert sum(rows, []) == list(range(11)) and len(rows) == 4 and all(rows)
