"""Lists, flat columns, histograms, joins, sources, opaque functions and durable runs on small inputs."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from jagspark.functions import ragged as R
from jagspark.functions import regular as G
from jagspark.functions import udf as U
from jagspark.operators import blocks as B
from jagspark.operators import hist as H
from jagspark.operators import reduce as D
from jagspark.operators import relational as J
from jagspark.plans import durable as P
from jagspark.plans import readset as Q
from jagspark.sources import io as IO
from jagspark.streaming import histograms as S


def one(spark, value, kind, make):
    return spark.createDataFrame([(value,)], f"c {kind}").select(make(F.col("c")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "value, make, want",
    [
        ([3.0, None, 1.0], R.sum, 4.0), ([], R.sum, 0.0), (None, R.sum, None), ([], R.prod, 1.0), ([], R.min, None), ([], R.max, None), ([math.nan, 1.0], R.argmax, 0), ([2.0, 1.0, 1.0], R.argmin, 1), ([], R.argmin, None),
        ([1.0, None], R.count, 1), ([0.0, 2.0], R.count_nonzero, 1), ([], R.any, False), ([], R.all, True), ([1.0, None], R.all, True), ([1.0, 3.0], R.ptp, 2.0), ([1.0, 3.0], R.mean, 2.0), ([1.0, 3.0], R.var, 1.0), ([1.0, 3.0], R.std, 1.0),
        ([2.0, math.nan, 1.0, None], R.sort, [1.0, 2.0, math.nan, None]), ([2.0, 1.0, 3.0], lambda c: R.sort(c, ascending=False), [3.0, 2.0, 1.0]), ([1.0, 1.0, 2.0], R.run_lengths, [2, 1]), ([], R.run_lengths, []),
        ([5.0], lambda c: R.pad_none(c, 3), [5.0, None, None]), ([5.0, 6.0], lambda c: R.pad_none(c, 1, clip=True), [5.0]), ([5.0, 6.0], lambda c: R.pad_none(c, 1), [5.0, 6.0]), ([7.0, None], lambda c: R.fill_none(c, 0.0), [7.0, 0.0]),
        ([7.0, None], R.drop_none, [7.0]), ([7.0, None], R.is_none, [False, True]), ([], R.firsts, None), ([7.0, 8.0], lambda c: R.take(c, F.array(F.lit(-1), F.lit(5))), [8.0, None]), ([7.0], R.num, 1), ([1.0, 2.0], R.local_index, [0, 1]),
        ([1.0, 2.0, 3.0], lambda c: F.size(R.combinations(c, 2)), 3), ([1.0, 2.0, 3.0], lambda c: F.size(R.combinations(c, 4)), 0), ([1.0, 2.0], lambda c: F.size(R.combinations(c, 2, replacement=True)), 3), ([1.0, 2.0], lambda c: F.size(R.cartesian([c, c, c])), 8),
        ([1.0, 2.0, 3.0], lambda c: R.unflatten(c, F.array(F.lit(2), F.lit(0), F.lit(1))), [[1.0, 2.0], [], [3.0]]), ([1.0, None], R.ones_like, [1.0, None]), ([1.0], lambda c: R.min(c, initial=0.5), 0.5), ([], lambda c: R.sum(c, mask_identity=True), None), ([1.0], lambda c: R.sum(c, keepdims=True), [1.0]),
    ],
)
def test_lists(spark, value, make, want):
    got = one(spark, value, "array<double>", make)
    assert repr(got) == repr(want)


def test_list_errors(spark):
    with pytest.raises(Exception, match="add up"):
        one(spark, [1.0], "array<double>", lambda c: R.unflatten(c, F.array(F.lit(2))))
    with pytest.raises(Exception, match="has not 2"):
        one(spark, [1.0], "array<double>", lambda c: R.to_regular(c, 2))


def test_moments_of_pairs(spark):
    x, y = [1.0, 2.0, 4.0, 7.0], [2.0, 1.0, 5.0, 8.0]
    row = spark.createDataFrame([(x, y)], "x array<double>, y array<double>").select(R.corr(F.col("x"), F.col("y")), R.covar(F.col("x"), F.col("y")), R.linear_fit(F.col("x"), F.col("y")), R.mean(F.col("x"), F.col("y")), R.softmax(F.col("x"))).first()
    slope, intercept = np.polyfit(x, y, 1)
    assert math.isclose(row[0], np.corrcoef(x, y)[0, 1]) and math.isclose(row[1], np.cov(x, y, ddof=0)[0, 1])
    assert math.isclose(row[2]["slope"], slope) and math.isclose(row[2]["intercept"], intercept, abs_tol=1e-9) and math.isclose(row[3], np.average(x, weights=y))
    assert np.allclose(row[4], np.exp(x) / np.exp(x).sum())


@pytest.fixture(scope="module")
def flat(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=500)
    x[[5, 77]] = np.nan
    return x, spark.createDataFrame(pd.DataFrame({"o": np.arange(500) * 3 + 10, "x": x})).repartition(7)


def test_scans_and_neighbours(spark, flat):
    x, df = flat
    for kind in ("nancumsum", "nancumprod"):
        got = [r[kind] for r in B.scan(df, "o", "x", kind).orderBy("o").collect()]
        assert np.allclose(got, getattr(np, kind)(x))
    got = [r["diff"] for r in B.diff(df, "o", "x", 2).orderBy("o").collect()]
    assert np.allclose(got, np.diff(x, 2), equal_nan=True)
    placed = B.with_position(df, "o")
    assert [r["ordinal"] for r in placed.orderBy("o").collect()] == list(range(500))
    assert B.scan(df.limit(0), "o", "x").count() == 0


def test_reductions(spark, flat):
    x, df = flat
    c = F.col("x")
    names = ["nansum", "nanmean", "nanmin", "nanmax", "nanvar", "nanstd"]
    row = df.agg(*[D.REDUCTIONS[n](c).alias(n) for n in names], D.REDUCTIONS["min"](c).alias("min"), D.argmin(c, F.col("o")).alias("first"), D.argmax(c, F.col("o"), skip_nan=True).alias("top")).first()
    assert all(math.isclose(row[n], getattr(np, n)(x)) for n in names)
    assert math.isnan(row["min"]) and row["first"] == 5 * 3 + 10 and row["top"] == int(np.nanargmax(x)) * 3 + 10
    empty = df.limit(0).agg(D.REDUCTIONS["sum"](c).alias("s"), D.REDUCTIONS["prod"](c).alias("p"), D.REDUCTIONS["mean"](c).alias("m"), D.REDUCTIONS["any"](c > 0).alias("a"), D.REDUCTIONS["all"](c > 0).alias("b")).first()
    assert (empty["s"], empty["p"], empty["a"], empty["b"]) == (0, 1, False, True) and math.isnan(empty["m"])


def test_monoid(spark, flat):
    x, df = flat
    made = D.Monoid(lambda f: pd.DataFrame({"n": [len(f)], "top": [f["x"].max()]}), lambda f: pd.DataFrame({"n": [f["n"].sum()], "top": [f["top"].max()]}), "n long, top double", fan=2)
    row = made.run(df).collect()
    assert len(row) == 1 and row[0]["n"] == 500 and row[0]["top"] == np.nanmax(x)


def test_positions(spark):
    df = spark.createDataFrame([(i, i * 1.0) for i in range(12)], "o long, x double")
    pick = lambda d: [r["o"] for r in d.orderBy("o").collect()]
    assert pick(B.take_slice(df, "o", 2, -2, 3)) == list(range(12))[2:-2:3] and pick(B.take_slice(df, "o", -3)) == [9, 10, 11]
    assert pick(B.take_index(df, "o", -1)) == [11]
    with pytest.raises(IndexError):
        B.take_index(df, "o", 12)
    counts = spark.createDataFrame([(1, 5), (2, 0), (3, 7)], "g long, n long")
    lists = {r["g"]: r["items"] for r in B.unflatten(df, "o", counts, "g", "n", value="x").collect()}
    assert lists == {1: [0.0, 1.0, 2.0, 3.0, 4.0], 2: [], 3: [5.0, 6.0, 7.0, 8.0, 9.0, 10.0, 11.0]}
    assert [r["items"] for r in B.reshape(df, "o", "x", 6).orderBy("row").collect()] == [[float(i) for i in range(6)], [float(i) for i in range(6, 12)]]
    with pytest.raises(ValueError):
        B.reshape(df, "o", "x", 5)


def test_histograms_equal_numpy(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.uniform(-1, 11, 4000), np.linspace(0, 10, 51), [np.nan, np.inf, 10.0, 0.0]])
    w = rng.uniform(size=len(x))
    df = spark.createDataFrame(pd.DataFrame({"x": x, "w": w}))
    rows = H.histogram(df, F.col("x"), 50, 0.0, 10.0, F.col("w")).orderBy("bin").collect()
    ok = np.isfinite(x)
    assert [r["n"] for r in rows] == np.histogram(x[ok], 50, (0, 10))[0].tolist()
    assert np.allclose([r["sumw"] for r in rows], np.histogram(x[ok], 50, (0, 10), weights=w[ok])[0])
    grid = H.histogramdd(df, [(F.col("x"), 5, 0.0, 10.0), (F.col("w"), 4, 0.0, 1.0)]).orderBy("bin0", "bin1").collect()
    assert [r["n"] for r in grid] == np.histogram2d(x[ok], w[ok], [5, 4], [[0, 10], [0, 1]])[0].astype(int).ravel().tolist()


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_joins_pair_missing_keys(spark, how):
    left, right = pd.DataFrame({"k": [1, 1, 2, None, 5], "a": range(5)}), pd.DataFrame({"k": [1, 3, None, None, 5], "b": range(5)})
    clean = lambda f: [tuple(None if pd.isna(v) else v for v in r) for r in f.itertuples(index=False)]
    made = lambda f, n: spark.createDataFrame([(None if r[0] is None else int(r[0]), int(r[1])) for r in clean(f)], f"k long, {n} long")
    got = J.join(made(left, "a"), made(right, "b"), "k", how)
    assert got.columns == ["k", "a", "b"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(tuple(None if v is None else int(v) for v in r)) for r in clean(left.merge(right, on="k", how=how)))


def test_join_refusals_keys_and_routes(spark):
    df = spark.createDataFrame([(1, 2)], "k long, v long")
    with pytest.raises(ValueError, match="v"):
        J.join(df, df, "k")
    with pytest.raises(ValueError):
        J.join(df, df.select("k"), "k", "cross")
    assert spark.range(1).select(J.pack_key(F.lit(1), F.lit(2), F.lit(3))).first()[0] == 1 << 40 | 2 << 20 | 3
    with pytest.raises(Exception, match="2\\^20"):
        spark.range(1).select(J.pack_key(F.lit(1 << 20))).collect()
    import hashlib

    for parts in (2, 7, 1000):
        rows = spark.range(50).select("id", J.route(F.col("id"), parts).alias("p")).collect()
        assert all(r["p"] == int.from_bytes(hashlib.sha256(r["id"].to_bytes(8, "big")).digest()[:8], "big") % parts for r in rows)
    assert J.broadcast_choice(10, 1000, 8) and not J.broadcast_choice(500, 600, 8)


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("data")
    for i, n in enumerate((6, 4, 5)):
        rows = [(float(100 * i + j), [(float(j), float(-j))] * (j % 3)) for j in range(n)]
        spark.createDataFrame(rows, "x double, jet array<struct<pt: double, eta: double>>").coalesce(1).write.parquet(f"{root}/part{i}.dir")
        found = next((root / f"part{i}.dir").glob("*.parquet"))
        found.rename(root / f"f{i}.parquet")
    return str(root)


def test_parquet(spark, files, tmp_path):
    assert [f.rsplit("/", 1)[1] for f in IO.discover(spark, f"{files}/f*.parquet")] == ["f0.parquet", "f1.parquet", "f2.parquet"]
    with pytest.raises(FileNotFoundError):
        IO.discover(spark, f"{files}/none*.parquet")
    assert IO.num_rows(spark, f"{files}/f*.parquet") == 15
    df = IO.from_parquet(spark, f"{files}/f*.parquet", ["x", "jet.pt"], ordinal="o")
    assert [(r["o"], r["x"]) for r in df.orderBy("o").collect()] == list(enumerate([float(100 * i + j) for i, n in enumerate((6, 4, 5)) for j in range(n)]))
    sizes = IO.from_parquet(spark, f"{files}/f*.parquet", ["jet.pt"]).select(R.num(F.col("jet")).alias("n"))
    assert "eta" not in Q.read_columns(sizes)[0] and "pt" in Q.read_columns(sizes)[0]
    leaf = spark.read.parquet(f"{files}/f0.parquet").select(F.filter(R.collection("jet", "pt"), lambda s: s["pt"] > 1).alias("j"))
    assert "eta" not in Q.read_columns(leaf)[0]
    with pytest.raises(TypeError, match="jet"):
        IO.from_parquet_flat(spark, f"{files}/f*.parquet")
    assert len(IO.to_parquet(df, str(tmp_path / "out"), partitions=3)) == 3
    later = IO.to_parquet(df, str(tmp_path / "later"), column="x", compute=False)
    assert not (tmp_path / "later").exists() and later()


def test_creation_and_random(spark):
    assert [r["x"] for r in IO.linspace(spark, 0, 1, 7).orderBy("ordinal").collect()] == np.linspace(0, 1, 7).tolist()
    assert [r["x"] for r in IO.arange(spark, 2, 9, 3).orderBy("ordinal").collect()] == [2, 5, 8]
    first, again = IO.Random(spark, 5), IO.Random(spark, 5)
    a, b = [[r["x"] for r in g.normal(5).orderBy("ordinal").collect()] for g in (first, again)]
    assert a == b == np.random.default_rng([5, 0]).normal(size=5).tolist()
    assert [r["x"] for r in first.uniform(3).orderBy("ordinal").collect()] != [r["x"] for r in IO.Random(spark, 5).uniform(3).orderBy("ordinal").collect()]


def test_partitioned_source(spark):
    class Squares(IO.PartitionedSource):
        @classmethod
        def name(cls):
            return "squares"

        def schema(self):
            return "i long, sq long"

        def size(self):
            return 10

        def read_range(self, start, stop):
            return iter([(i, i * i) for i in range(start, stop)])

    spark.dataSource.register(Squares)
    df = spark.read.format("squares").option("steps", 3).load()
    assert sorted(map(tuple, df.collect())) == [(i, i * i) for i in range(10)]


def test_opaque_functions(spark):
    df = spark.createDataFrame([([1.0, 2.0], 3.0), ([4.0, 5.0], 6.0)], "v array<double>, s double")
    assert [r[0] for r in df.select(U.gufunc(lambda v, s: v.sum(1) * s, "(i),()->()", F.col("v"), F.col("s"))).collect()] == [9.0, 54.0]
    with pytest.raises(ValueError):
        U.gufunc(lambda v: v, "(i)->(),()", F.col("v"))
    assert U.parse_template(["$0", ["$1", 2], "up"], 2) == [("slot", 0), [("slot", 1), ("constant", 2)], ("constant", "up")]
    with pytest.raises(IndexError):
        U.parse_template(["$2"], 2)
    payload = U.Payload("m", b"1")
    with pytest.raises(ValueError, match="not sha256:0"):
        U.model(lambda c: None, payload, F.col("s"), expected_hash="sha256:0")
    assert any("unhashed-opaque:gufunc" in r for r in U.REGISTRY.risks)
    spec = {"edges": [0, 2, 4], "values": [0.5, 1.5], "flow": "error"}
    assert [r[0] for r in spark.createDataFrame([(0.0,), (2.0,), (3.9,)], "x double").select(U.correction(spec, F.col("x"))).collect()] == [0.5, 1.5, 1.5]
    with pytest.raises(Exception, match="range"):
        spark.range(1).select(U.correction(spec, F.lit(9.0))).collect()


def test_runs_resume_and_fail_softly(spark, files, tmp_path):
    store = str(tmp_path / "store")
    step = lambda df: df.select("x")
    stopped = P.run_resumable(spark, f"{files}/f*.parquet", step, store, files_per_batch=1, stop=P.StopCondition(rows=6))
    assert stopped.stopped and len(stopped.done) == 1
    again = P.run_resumable(spark, f"{files}/f*.parquet", step, store, files_per_batch=2)
    assert again.run == stopped.run and len(again.skipped) == 1 and len(again.done) == 1 and P.results(spark, store, again.run).count() == 15
    assert not P.run_resumable(spark, f"{files}/f*.parquet", step, store, files_per_batch=3).done
    other = P.run_resumable(spark, f"{files}/f*.parquet", lambda df: df.select("x").where("x < 100"), store)
    assert other.run != again.run and len(other.done) == 1 and P.results(spark, store, other.run).count() < 15
    assert P.results(spark, store, again.run).count() == 15

    def bad(df):
        return df.select(F.when(F.col("x") == 203, F.raise_error(F.lit("bad row"))).otherwise(F.col("x")).alias("x"))

    out = P.run_resumable(spark, f"{files}/f*.parquet", bad, str(tmp_path / "bad"), files_per_batch=3, policy=P.Retry(again=0, split=False))
    assert len(out.dead) == 1 and not out.done
    out = P.run_resumable(spark, f"{files}/f*.parquet", bad, str(tmp_path / "bad"), files_per_batch=3, policy=P.Retry(again=0, fresh=True))
    assert len(out.dead) == 1 and "bad row" in out.dead[0]["message"] and out.dead[0]["high"] - out.dead[0]["low"] == 1
    assert P.results(spark, str(tmp_path / "bad"), out.run).count() == 14


def test_a_batch_that_failed_before_is_not_counted_twice(spark, tmp_path):
    """Halves are committed while the whole fails; later the whole would succeed, in batches of another size too."""
    for i in range(2):
        spark.createDataFrame([(i * 100 + k,) for k in range(4)], "x long").coalesce(1).write.parquet(str(tmp_path / f"in/f{i}.parquet"))
    files = [IO.discover(spark, str(tmp_path / f"in/f{i}.parquet"))[0] for i in range(2)]
    flag = tmp_path / "broken"
    flag.write_text("")

    @F.udf("boolean")
    def ok(x):
        if flag.exists() and x == 102:
            raise ValueError("not now")
        return True

    step = lambda df: df.where(ok("x"))
    store = str(tmp_path / "store")
    first = P.run_resumable(spark, files, step, store, files_per_batch=2, policy=P.Retry(again=0))
    assert len(first.dead) == 1 and sorted(r.x for r in P.results(spark, store, first.run).collect()) == [0, 1, 2, 3, 100, 101, 103]
    flag.unlink()
    for size in (2, 1):
        P.run_resumable(spark, files, step, store, files_per_batch=size, policy=P.Retry(again=0))
        assert sorted(r.x for r in P.results(spark, store, first.run).collect()) == [0, 1, 2, 3, 100, 101, 102, 103]


def test_ordinals_follow_the_files_whatever_their_names(spark, tmp_path):
    names = ["z 1", "y+2", "x%203", "w 4", "1", "ü 5"]
    paths = []
    for k, n in enumerate(names):
        spark.createDataFrame([(k * 10 + i,) for i in range(2)], "x long").coalesce(1).write.parquet(str(tmp_path / f"a b/{n}"))
        paths += IO.discover(spark, str(tmp_path / f"a b/{n}"))
    rows = {r.o: r.x for r in IO.from_parquet(spark, paths, ordinal="o").collect()}
    assert [rows[i] for i in range(12)] == [k * 10 + i for k in range(6) for i in range(2)]
    with pytest.raises(ValueError, match="twice"):
        IO.from_parquet(spark, [paths[0], paths[0]], ordinal="o")


def test_sinks_name_their_parts(spark, tmp_path):
    df = spark.range(100).repartition(6)
    where = str(tmp_path / "out")
    later = IO.to_parquet(df, where, steps_per_file=2, prefix="ev", compute=False)
    assert not (tmp_path / "out").exists()
    files = later()
    assert [f.rsplit("/", 1)[1] for f in files] == [f"ev-{i:05d}.parquet" for i in range(3)] and IO.num_rows(spark, where) == 100
    files = IO.to_parquet(df, where, partitions=4, ordinal="id")
    assert [r.id for r in IO.from_parquet(spark, files, ordinal="o").orderBy("o").collect()] == list(range(100))
    assert len(IO.partition_datasets(spark, {"a": where, "b": files[:1]}, 2)["a"]) == 8
    with pytest.raises(TypeError):
        IO.to_parquet(spark.createDataFrame([("a",)], "s string"), where, column="s")


@pytest.mark.parametrize(
    "value, kind, make, want",
    [
        ([], "array<double>", lambda c: R.min(c, mask_identity=False), math.inf), ([], "array<double>", lambda c: R.max(c, mask_identity=False), -math.inf), ([], "array<int>", lambda c: R.argmin(c, mask_identity=False), -1),
        ([2**31 - 1, 1], "array<int>", R.sum, 2**31), ([2**53, 1], "array<long>", R.sum, 2**53 + 1), ([3, 4], "array<int>", R.prod, 12), ([True, True, None], "array<boolean>", lambda c: R.sum(c, dtype="long"), 2),
        ([1, 2, 3], "array<int>", R.running, [1, 3, 6]), ([0.5, 0.25], "array<double>", R.running, [0.5, 0.75]), ([], "array<int>", R.running, []), ([1, None], "array<int>", lambda c: R.zeros_like(c, None), [0, None]),
        ([4, 5], "array<int>", lambda c: R.broadcast_arrays([c, F.lit(7), c], [True, False, True])[1], [7, 7]), ([1.0, 3.0], "array<double>", lambda c: R.std(c, keepdims=True), [1.0]),
    ],
)
def test_reducer_parameters(spark, value, kind, make, want):
    got = one(spark, value, kind, make)
    assert got == want and type(got) is type(want)


def test_long_lists_take_linear_time(spark):
    x = np.random.default_rng(5).normal(size=20_000)
    row = spark.createDataFrame([(x.tolist(),)], "c array<double>").select(R.softmax(F.col("c")), R.var(F.col("c")), R.running(F.col("c"))).first()
    assert np.allclose(row[0], np.exp(x) / np.exp(x).sum()) and math.isclose(row[1], x.var()) and np.allclose(row[2], x.cumsum())


def test_projection_modes(spark, tmp_path):
    spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).select("a", "b")
    assert Q.check_projection(df, ["a", "b"], "raise") == [] and Q.check_projection(df, ["a"], "pass") == ["b"]
    with pytest.warns(UserWarning, match="b"):
        Q.check_projection(df, ["a"])
    with pytest.raises(ValueError, match="b"):
        Q.check_projection(df, ["a"], "raise")


def test_whole_scans_stay_whole(spark):
    df = spark.createDataFrame([(i, 2**53 + 1 if i == 0 else 1) for i in range(10)], "o long, x long")
    assert [r.cumsum for r in B.scan(df, "o", "x").orderBy("o").collect()] == [2**53 + 1 + i for i in range(10)]


def test_bundle(spark, tmp_path):
    path = str(tmp_path / "bundle")
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "k long, x double")
    P.build_bundle(spark, path, {"t": df}, "SELECT k, x * 2 AS y FROM {t}", {"p": b"abc"})
    assert sorted(map(tuple, P.reproduce(spark, path).collect())) == [(1, 4.0), (2, 6.0)]
    (tmp_path / "bundle/payloads/p.hex").write_text("00")
    for crc in (tmp_path / "bundle/payloads").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(ValueError, match="payload p"):
        P.inspect(spark, path)


def test_failures_name_the_caller(spark):
    import pickle

    with pytest.raises(Q.StageError, match="sums at .*test_engine.py") as e:
        Q.run(spark.range(1).select(F.raise_error(F.lit("no"))), "sums")
    assert pickle.loads(pickle.dumps(e.value)).step == "sums"


def test_native_plans_run_no_python(spark):
    df = spark.createDataFrame([([1.0],)], "c array<double>").select(R.sum(F.col("c")), R.sort(F.col("c")))
    assert not Q.uses_python(df)


def test_streaming_histogram(spark, tmp_path):
    spark.range(100).select((F.col("id") / 10).alias("x")).coalesce(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("x double").parquet(str(tmp_path / "in"))
    query = S.fill(stream, F.col("x"), 5, 0.0, 10.0).writeStream.format("memory").queryName("filled").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r["bin"], r["n"]) for r in spark.table("filled").collect()) == [(i, 20) for i in range(5)]


@pytest.mark.parametrize("cut", [slice(None, None, 2), slice(None, None, -1), slice(5, 1, -2), slice(-3, None, -3), slice(1, 100, 3), slice(-100, 4), slice(4, 2), slice(None, 3, -1)])
def test_slices_with_steps(spark, cut):
    for n in (0, 1, 7):
        assert one(spark, list(range(n)), "array<int>", lambda c: G.subscript(c, cut)) == list(range(n))[cut]


def test_inner_axes(spark):
    a = np.arange(24)
    for shape in ((2, 3, 4), (-1, 6), (2, -1, 4), (4, 3, -1), (8,)):
        want = a.reshape((-1, *shape) if len(shape) == 1 else shape)
        assert one(spark, a.tolist(), "array<int>", lambda c: G.reshape(c, *shape)) == want.tolist()
    cube = a.reshape(2, 3, 4)
    for axes in ((1, 0, 2), (2, 1, 0), (1, 2, 0), (2, 0, 1), (0, 2, 1)):
        assert one(spark, cube.tolist(), "array<array<array<int>>>", lambda c: G.transpose(c, *axes)) == cube.transpose(axes).tolist()
    assert one(spark, cube.tolist(), "array<array<array<int>>>", lambda c: G.swapaxes(c, 0, 2)) == cube.swapaxes(0, 2).tolist()
    assert one(spark, [[1], [2]], "array<array<int>>", lambda c: G.squeeze(c, 1)) == [1, 2]
    assert one(spark, [1, 2], "array<int>", G.expand_dims) == [[1, 2]]
    with pytest.raises(Exception, match="shape"):
        one(spark, [1, 2, 3], "array<int>", lambda c: G.reshape(c, 2))


def test_corrections_of_several_axes(spark):
    grid = {"kind": "multibinning", "inputs": [1, 2], "edges": [[0, 1, 2], [0, 10, 20, 30]], "content": [1, 2, 3, 4, 5, 6], "flow": -1}
    tree = {"kind": "category", "input": 0, "content": {"nominal": grid, "up": {"kind": "binning", "input": 1, "edges": [0, 1, 2], "content": [grid, 7], "flow": "clamp"}}, "default": 0.5}
    df = spark.createDataFrame([(0.5, 5.0, "up"), (1.5, 25.0, "nominal"), (1.5, 25.0, "up"), (0.5, 99.0, "nominal"), (None, 1.0, "nominal"), (0.0, 0.0, "x")], "a double, b double, s string")
    a, b, s = (F.col(x) for x in "abs")
    made = df.select(U.correction(tree, s, a, b), U.correction(tree, a, b, args=["nominal", "$0", "$1"])).collect()
    assert [r[0] for r in made] == [1.0, 6.0, 7.0, -1.0, None, 0.5] and [r[1] for r in made] == [1.0, 6.0, 6.0, -1.0, None, 1.0]


class Affine(U.Plugin):
    kind = "affine"

    def load(self, content):
        slope, offset = np.frombuffer(content)
        return lambda x, shift=0.0: slope * x.sum(axis=1) + offset + shift

    def samples(self):
        return [np.array([1.0, 2.0]).tobytes(), np.array([1.0, 3.0]).tobytes()]


class Moody(Affine):
    kind = "moody"

    def content_hash(self, content):
        return str(hash(content))


def test_plugins(spark):
    import pyspark.cloudpickle as pickles
    import sys

    pickles.register_pickle_by_value(sys.modules[__name__])
    try:
        with pytest.raises(ValueError, match="between processes"):
            U.register_plugin(Moody())
        U.register_plugin(Affine())
        with pytest.raises(ValueError, match="already"):
            U.register_plugin(Affine())
        content = np.array([2.0, 1.0]).tobytes()
        df = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "x double, y double")
        made = U.external("affine", content, F.col("x"), F.col("y"), args=[["$0", "$1"]], kwargs={"shift": 10})
        assert [r[0] for r in df.select(made).collect()] == [17.0, 25.0]
        with pytest.raises(ValueError, match="not sha256:0"):
            U.external("affine", content, F.col("x"), expected_hash="sha256:0")
    finally:
        U.PLUGINS.pop("affine", None)
        pickles.unregister_pickle_by_value(sys.modules[__name__])
