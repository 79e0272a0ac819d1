"""Exact top-k search by inner product, with MaxScore over sharded postings.

Components become whole numbers floor(SCALE * x). A term is a dimension and a sign; its postings are the rows whose component there
has that sign, with its size. A query's positive parts come from the terms whose sign it shares; a term's bound is the query's
component times the largest size in its postings. Per shard: a first threshold comes from the exact scores of a few rows with
large parts; the terms of smallest bounds whose bounds together stay below the threshold are non-essential; the essential
postings are traversed; only rows that can still reach the threshold are probed in the others; the survivors are scored exactly.
Shards are merged by score, then smaller vec_id.

Defined results: vectors that are null or hold a null or non-finite component take no part, nor do rows without a vec_id; shorter vectors count as
filled with zeros (an empty vector scores 0); the query's own id is no candidate, also where rows repeat it; of rows that repeat a
query's id the smallest vector is the query; repeated candidates rank each; floors beyond 64 bits saturate and a score beyond 64 bits
raises; vectors of any length are read whole; an empty table gives an empty result; other columns are ignored.

At scale: rows are dealt to shards of about SHARD_ROWS by a hash of the id, queries to blocks of QUERY_BLOCK; a task holds one shard
and one block, whatever the table's size, and a vector is sent once for each block. The first shard's k-th scores are floors for all others, which
prune by them from the start. A shard returns k rows a query, and the merge keeps k per query before its shuffle.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

SCALE = 1024.0
K = 10
SHARD_ROWS = 8192
QUERY_BLOCK = 16_384


def matrix(column) -> np.ndarray:
    """Rows of equal width, filled with zeros."""
    rows = [np.asarray(x, np.int64) for x in column]
    width = max(map(len, rows), default=0)
    out = np.zeros((len(rows), width), np.int64)
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


class Postings:
    """The postings of one shard. Rows are in the order of ids, so that stable orders break ties by the smaller id."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.lists = {}
        self.peaks = {}
        for d in range(rows.shape[1]):
            for sign in (1, -1):
                at = np.flatnonzero(self.rows[:, d] * sign > 0)
                if len(at):
                    sizes = self.rows[at, d] * sign
                    top = at[np.argsort(-sizes, kind="stable")[:K]]
                    self.lists[d, sign], self.peaks[d, sign] = (at, sizes), (int(sizes.max()), top)

    def search(self, own: int, query: np.ndarray, k: int = K, floor: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row numbers, scores) of the best k rows other than `own`: by MaxScore. Rows that score below `floor` are not wanted."""
        rows = self.rows
        width = min(len(query), rows.shape[1])
        query = query[:width]
        peak = int(np.abs(query).max(initial=0)) * int(np.abs(rows).max(initial=0)) * max(1, width)
        exact = peak < 1 << 62
        if not exact:  # whole numbers of any size
            query, rows = query.astype(object), rows.astype(object)

        def score(at):
            return rows[at, :width] @ query

        terms = sorted(((abs(int(q)) * self.peaks[t][0], t) for d, q in enumerate(query) if q and (t := (d, 1 if q > 0 else -1)) in self.peaks), reverse=True)
        first = np.unique(np.concatenate([np.arange(min(len(rows), 2 * k)), *(self.peaks[t][1] for _, t in terms[:8])]))
        first = first[self.ids[first] != own]
        best = np.sort(score(first))[::-1]
        threshold = best[k - 1] if len(best) >= k else None
        if floor is not None:
            threshold = floor if threshold is None else max(threshold, floor)
        bounds = np.array([b for b, _ in terms], dtype=np.int64 if exact else object)
        rest = np.concatenate([np.cumsum(bounds[::-1])[::-1], np.zeros(1, bounds.dtype)])  # rest[i]: bounds of terms i and after
        if threshold is None or threshold <= 0:
            essential, live = 0, np.arange(len(rows))  # a row without any positive part may still be among the best
            parts = np.zeros(len(rows), bounds.dtype)
        else:
            essential = int(np.argmax(rest < threshold))  # terms before it are essential: the others alone stay below
            parts, seen = np.zeros(len(rows), bounds.dtype), np.zeros(len(rows), bool)
            for _, (d, sign) in terms[:essential]:
                at, sizes = self.lists[d, sign]
                parts[at] += sizes * abs(int(query[d]))
                seen[at] = True
            live = np.flatnonzero(seen & (parts + rest[essential] >= threshold))
            for i in range(essential, len(terms), 4):  # probe the others while rows are competitive
                if len(live) <= 4 * k:
                    break
                for _, (d, sign) in terms[i : i + 4]:
                    parts[live] += np.maximum(rows[live, d] * sign, 0) * abs(int(query[d]))
                live = live[parts[live] + rest[min(i + 4, len(terms))] >= threshold]
        live = live[self.ids[live] != own]
        scores = score(live)
        if threshold is not None:
            live, scores = live[scores >= threshold], scores[scores >= threshold]
        order = np.argsort(-scores, kind="stable")[:k]  # rows are in the order of ids
        return live[order], scores[order]


def _search(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    found = {"query_id": [], "vec_id": [], "score": []}
    if len(rows) and len(queries):
        postings = Postings(rows["vec_id"].to_numpy(), matrix(rows["parts"]))
        floors = [None if pd.isna(x) else int(x) for x in queries["floor"].astype(object)]
        for own, query, floor in zip(queries["vec_id"], matrix(queries["parts"]), floors, strict=True):
            at, scores = postings.search(own, query, floor=floor)
            found["query_id"] += [own] * len(at)
            found["vec_id"] += postings.ids[at].tolist()
            found["score"] += scores.tolist()
    if any(abs(s) >= 1 << 63 for s in found["score"]):
        raise OverflowError("a score needs more than 64 bits")
    return pd.DataFrame({k: np.array(v, np.int64) for k, v in found.items()})


def search(vectors: DataFrame, every: int = 100, k: int = K, scale: float = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the best k rows for each row whose vec_id is divisible by `every`."""
    if k != K:
        raise ValueError(f"postings are built for k = {K}")
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf)))
    valid = vectors.where(x.isNotNull() & F.col("vec_id").isNotNull()).where(finite)
    whole = stored(valid.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * F.lit(scale))).alias("parts")), "topk-vectors")
    asked = stored(whole.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("parts").alias("parts")), "topk-queries")
    n, q = whole.count(), asked.count()
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-q // QUERY_BLOCK))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = whole.select("vec_id", "parts", dealt(shards).alias("shard"))
    right = asked.select("vec_id", "parts", dealt(blocks).alias("block"))
    form = "query_id long, vec_id long, score long"

    def looked(rows: DataFrame, queries: DataFrame) -> DataFrame:
        rows = rows.withColumn("block", spread(blocks))
        return rows.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInPandas(_search, form)

    # the first shard is searched alone: the k-th best there is a floor for all other shards
    first = looked(left.where("shard = 0"), right.select("*", F.lit(0).alias("shard"), F.lit(None).cast("string").alias("floor")))
    if shards == 1:
        found = first
    else:
        first = stored(first, "topk-first")
        floors = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.min("score")).cast("string").alias("floor"))
        others = right.join(floors, "vec_id", "left").select("vec_id", "parts", "block", "floor")
        others = others.withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards - 1))))
        found = first.unionAll(looked(left.where("shard > 0"), others))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS parts FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.parts, c.parts), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
