"""Mixing sources to target weights, in DataFrame operations only.

Sizes (words) are summed per source, a repetition rate follows per source, and each document is taken floor(rate) times plus
once more if its hash-seeded uniform number falls below the rate's fraction.

Defined results: a null text has size 0; a null source is a source of its own, ordered last; a source of size 0 gets target 0 and
each of its documents is taken with rate 0; repeated rows and ties in doc_id draw the same number; a null doc_id draws as the
text 'null'; a very long text is counted whole; an empty table gives an empty result; extra columns pass through `mix`.

At scale: one pass computes sizes and stores them without the text; sums are combined before the shuffle; the targets (one row a
source) are joined by (source, salt), so that a source with a third of all rows spreads over SALTS keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST = 2.0
SEED = 20240601
SALTS = 64


def word_count(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) from 52 bits of md5(seed:doc_id)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Resharing an excess by weight until no source is above its cap ends where every uncapped source has weight * level and the
    capped ones have most * size. Sources are capped in the order of cap / weight, so the level comes from one ordered pass. Both
    windows run over one row a source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    per = (
        per.withColumn("want", F.lit(float(budget)) * F.sum("source_size").over(everything))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("want") - F.col("capped")) / F.col("open"))
    )
    # the level rises from source to source while they are capped and falls after the last capped one: its peak is the one sought
    level = F.max("level").over(everything)
    return per.withColumn("held", level).select(
        "source", "source_size", F.coalesce(F.least(F.col("weight") * F.col("held"), F.col("cap")), F.col("cap")).alias("target")
    )


def rated(sizes: DataFrame, per: DataFrame, seed: int = SEED, most: float = MOST) -> DataFrame:
    """`sizes` with its source's source_size and target, and `copies`: how often the mix takes the row."""
    key = lambda c: (F.coalesce(c, F.lit("")), c.isNull())
    named, empty = key(F.col("source"))
    right = per.select(
        named.alias("_named"), empty.alias("_empty"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"), "source_size", "target"
    )
    left = sizes.withColumns({"_named": named, "_empty": empty, "_salt": F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)).cast("int")})
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    return (
        left.join(right, ["_named", "_empty", "_salt"])
        .withColumn("_rate", rate)
        .withColumn("copies", F.floor("_rate") + (uniform(F.col("doc_id"), seed) < F.col("_rate") - F.floor("_rate")).cast("long"))
        .drop("_named", "_empty", "_salt", "_rate")
    )


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size) of every row, stored without the text."""
    return stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")


def mix(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST, seed: int = SEED) -> DataFrame:
    """The mixed documents: every row of docs as often as the mix takes it, with docs' columns.

    The texts are not shuffled for the targets: the rows are read again and joined with one row a source.
    """
    per = targets(docs.select("source", word_count(F.col("text")).alias("size")), weights, budget, most)
    per = stored(per, "mix-targets")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    taken = rated(rows, per, seed, most).where("copies > 0")
    return taken.select(F.explode(F.array_repeat("_row", F.col("copies").cast("int"))).alias("_row")).select("_row.*")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = measured(table(spark, sf_dir, "documents"))
    out = rated(sizes, targets(sizes.select("source", "size")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP2_SQL = """
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
placed AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source IS NULL, source)) - 1) % 3 + 1] AS weight,
    2.0::DOUBLE * source_size AS cap FROM per),
levels AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER before, 0.0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0)) AS level
  FROM placed WINDOW before AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
held AS (SELECT *, max(level) OVER () AS held FROM levels),
aims AS (SELECT source, source_size, coalesce(least(weight * held, cap), cap) AS target FROM held),
rates AS (
  SELECT s.doc_id, s.size, a.source_size, a.target,
    CASE WHEN a.source_size > 0 THEN least(a.target / a.source_size, 2.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate
  FROM sizes s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, source_size, target,
  ((floor(rate)::BIGINT + (('0x' || substr(md5('20240601:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE
    < rate - floor(rate))::BIGINT) * size)::BIGINT AS taken
FROM rates
"""
