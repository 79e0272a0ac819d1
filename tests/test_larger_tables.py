"""What a query must keep to on larger tables: wide keys, hot keys, work done once a row."""

import math

import pytest
from pyspark.sql import functions as F

from jagspark import catalog
from jagspark.functions import ragged as R
from jagspark.functions.elementwise import binary
from jagspark.operators import relational as J


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Few rows with the keys of larger tables, in the driver's types."""
    root = str(tmp_path_factory.mktemp("larger"))
    lines = [(1, 1, 2, 3), (2_000_000, 2, 900, 60_000), (8_999_999, 7, 1_100_000, 59_999)]
    made = spark.createDataFrame([(*k, 9.0, 901.25, 0.05, 0.02, "N") for k in lines], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string")
    made.write.parquet(f"{root}/lineitem.parquet")
    spark.range(2100).select(F.col("id").alias("o_orderkey"), (F.col("id") * 7 % 40).alias("o_custkey"), F.lit(5.0).alias("o_totalprice")).write.parquet(f"{root}/orders.parquet")
    spark.range(300).select((F.col("id") * 3 % 210).alias("c_custkey")).write.parquet(f"{root}/customer.parquet")
    spark.range(0, 40, 1, 1).select(F.col("id").alias("event_id")).write.parquet(f"{root}/events.parquet")
    return root


def _plan(df, kind: str = "optimizedPlan") -> str:
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_pack_key_of_wide_order_keys(spark, tables):
    rows = catalog.queries()["pack_key"](spark, tables).collect()
    unsigned = {r["l_orderkey"]: r["key"] % (1 << 64) for r in rows}
    assert unsigned == {1: 1 << 40 | 1 << 20 | 3, 2_000_000: 2_000_000 << 40 | 2 << 20 | 60_000, 8_999_999: 8_999_999 << 40 | 7 << 20 | 59_999}
    with pytest.raises(Exception, match="2\\^24"):
        spark.range(1).select(J.pack_key(F.lit(1 << 24), F.lit(0), F.lit(0), lead_bits=24)).collect()
    with pytest.raises(ValueError, match="fit"):
        J.pack_key(F.lit(1), F.lit(2), F.lit(3), lead_bits=25)


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_joins_are_summed_before_they_pair(spark, tables, how):
    left = spark.createDataFrame([(1, 5), (1, None), (None, 7), (None, 8), (2, 3)], "k long, a long")
    right = spark.createDataFrame([(1, 10), (None, 20), (None, 30), (None, None), (3, 40)], "k long, b long")
    pairs = J.join(left, right, "k", how).groupBy("k").agg(F.count("*").alias("rows"), F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.sum("a").alias("sum_a"), F.sum("b").alias("sum_b"))
    summed = J.join_sums(left, right, "k", how)
    assert summed.dtypes == pairs.dtypes and sorted(map(repr, summed.collect())) == sorted(map(repr, pairs.collect()))
    # in the query both sides are summed below the join, so that many missing keys on both sides make no pairs
    after = _plan(catalog.queries()[f"join_{how}"](spark, tables)).split("Join ", 1)[1]
    assert after.count("Aggregate ") == 2


def test_gcd_and_lcm_of_large_numbers(spark):
    fibonacci, pell = [1, 1], [1, 2]
    while fibonacci[-1] < 2**61:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    while pell[-1] < 2**61:
        pell.append(2 * pell[-1] + pell[-2])
    pairs = [*zip(fibonacci, fibonacci[1:]), *zip(pell, pell[1:]), (2**62, 2**61 + 1), (2**63 - 1, 2**62), (-(2**60), 3 * 2**40), (0, 0), (0, 2**60), (17, 17), (2**63 - 1, 2**63 - 1)]
    rows = spark.createDataFrame([*pairs, *[(b, a) for a, b in pairs]], "a long, b long").select("a", "b", binary("gcd", F.col("a"), F.col("b")).alias("g")).collect()
    assert all(r["g"] == math.gcd(r["a"], r["b"]) for r in rows)
    wide = [(1, 2**60 + 1), (2**60 + 1, 1), (3, 3 * (2**55 + 1)), (0, 2**60 + 1), (-2, 2**60 + 1)]
    got = spark.createDataFrame(wide, "a long, b long").select("a", "b", binary("lcm", F.col("a"), F.col("b")).alias("m")).collect()
    assert [r["m"] for r in got] == [math.lcm(a, b) for a, b in wide]


@pytest.mark.parametrize("name", ["ew_gcd", "ew_lcm", "rag_corr", "rag_covar", "rag_linear_fit", "rag_linear_fit_slope_error", "rag_linear_fit_intercept_error"])
def test_folds_are_made_once(spark, tables, name):
    assert _plan(catalog.queries()[name](spark, tables)).count("aggregate(") == 1


@pytest.mark.parametrize("name", ["rag_combinations3_num", "rag_argcombinations"])
def test_combinations_cut_each_rest_once(spark, tables, name):
    assert _plan(catalog.queries()[name](spark, tables)).count("slice(") == 2


def test_combinations_of_four(spark):
    row = spark.createDataFrame([([1, 2, 3, 4, 5],)], "x array<int>").select(F.size(R.combinations(F.col("x"), 4)).alias("n"), F.size(R.combinations(F.col("x"), 3, replacement=True)).alias("m"), F.size(R.combinations(F.col("x"), 1)).alias("o")).first()
    assert tuple(row) == (5, 35, 5)


def test_ordinals_without_a_shuffle_of_all_rows(spark, tables):
    df = catalog.queries()["io_ordinal"](spark, tables)
    plan = _plan(df, "executedPlan")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert all(r["event_id"] == r["ordinal"] for r in df.collect())


def test_six_decimals_are_rounded_as_in_the_sql(spark):
    import duckdb

    from jagspark.catalog.elementwise import shown

    values = [4.1275554997, -4.1071325003, 0.25354349969999995, 1.7976931348623157e308, -1e300, 2.5, -0.0, 0.0, 5e-324, 4503599627.3704961, 123456789012.3456789, -7.0000005]
    got = spark.createDataFrame([(v,) for v in values], "r double").select("r", F.struct(*shown(F.col("r"))).alias("s")).collect()
    want = [duckdb.execute("SELECT round(?::DOUBLE + 3e-10::DOUBLE, 6) + 0.0::DOUBLE", [r["r"]]).fetchall()[0][0] for r in got]
    assert [repr(r["s"]["r"]) for r in got] == list(map(repr, want))
