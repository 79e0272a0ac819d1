"""The ragged view of the driver's tables: one row per order, its lineitems as a list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Field: lineitem column, in the order that sorts a list.
FIELDS = {"n": "l_linenumber", "qty": "l_quantity", "price": "l_extendedprice", "disc": "l_discount", "tax": "l_tax", "part": "l_partkey", "supp": "l_suppkey", "flag": "l_returnflag"}


def orders(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    """k, met, cust and `items`, a list (empty where an order has none) of structs with the named fields, n first.

    Lineitems are grouped by order once; orders join the groups on the same key, so the grouped side is not shuffled again.
    """
    fields = fields or tuple(FIELDS)
    item = F.struct(*[F.col(c).alias(f) for f, c in FIELDS.items()])
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("items"))
    events = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("met"), F.col("o_custkey").alias("cust"))
    joined = events.join(lines, events["k"] == lines["l_orderkey"], "left")
    empty = F.filter(F.array(F.struct(*[F.lit(None).cast(t).alias(f) for f, t in zip(FIELDS, ("int", "double", "double", "double", "double", "bigint", "bigint", "string"), strict=True)])), lambda x: F.lit(False))
    items = F.coalesce("items", empty)
    if fields != tuple(FIELDS):
        items = F.transform(items, lambda s: F.struct(*[s[f].alias(f) for f in fields]))
    return joined.select("k", "met", "cust", items.alias("items"))


LI_SQL = """li AS (
  SELECT o_orderkey AS k, o_totalprice AS met, o_custkey AS cust, l_linenumber AS n, l_quantity AS qty, l_extendedprice AS price, l_discount AS disc, l_tax AS tax,
    l_partkey AS part, l_suppkey AS supp, l_returnflag AS flag,
    row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_partkey, l_suppkey, l_returnflag) - 1 AS pos,
    count(*) OVER (PARTITION BY o_orderkey) AS size,
    CASE WHEN l_quantity <= 25 THEN l_quantity END AS m, l_extendedprice / 1000 AS x
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
ev AS (SELECT o_orderkey AS k, o_totalprice AS met, o_custkey AS cust FROM orders)"""
