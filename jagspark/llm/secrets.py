"""Secret scans over an incremental ledger of blobs.

Every version of every path is content-addressed by the SHA-256 of its text. The ledger, a folder of Parquet files, holds a row for
each blob and rule version that has been scanned, with its findings. A scan takes only the pairs that the ledger lacks, adds them,
and joins the ledger's findings back to all paths.

Rules (kinds in this order): assign, access, hex, as RULES has them; letters of assign's keywords in either case, ASCII only.
Matches are leftmost and non-overlapping per kind; those below the kind's length are dropped after matching. Offsets are code points,
ends exclusive.

Defined results: null counts as the empty text, which has no findings; repeated rows and paths give repeated results; a very long text is
scanned whole, in time linear in its length; an empty table gives an empty result; other columns are ignored.

At scale: a blob is scanned once however many paths hold it; equal blobs are combined before the shuffle, so a text that a third of
all rows share is one row a task; the join back is by blob, one ledger row each, and the paths of hot blobs meet a broadcast of the few.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_rows, left_join, new_path, small_batches, stored, table

RULE_VERSION = 1
KINDS = ("assign", "access", "hex")
#: kind: pattern, group that is measured, least length.
RULES = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}
#: Where hex has a match of full length, it has one of these steps; most texts have none and are done.
_HEX_LONG = re.compile(r"[0-9a-f]{24,}")


def find(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of every finding, sorted."""
    if not text:
        return []
    found = []
    for place, kind in enumerate(KINDS):
        pattern, group, least = RULES[kind]
        # a maximal run of hex digits is one match, so asking for its length in the pattern finds the same runs
        for m in (_HEX_LONG if kind == "hex" else pattern).finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), place, m.end()))
    return sorted(found)


_LEDGER = "blob string, rule_version int, n_assign long, n_access long, n_hex long, spans string, base_sha256 string"


def _scan(batches: Iterator[pa.RecordBatch], version: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            found = find(text)
            spans = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)
            rows.append((*(sum(k == i for _, k, _ in found) for i in range(3)), spans, hashlib.sha256(spans.encode()).hexdigest()))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        yield pa.record_batch(
            [batch.column(0), pa.array([version] * len(rows), pa.int32()), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.string())],
            names=[x.split()[0] for x in _LEDGER.split(", ")],
        )


class Ledger:
    """Scanned (blob, rule version) pairs and their findings, in a folder that only grows."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark, "secret-ledger")

    def read(self) -> DataFrame:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], _LEDGER)
        # two scans at once may both have added a blob: their findings are the same
        return self.spark.read.schema(_LEDGER).parquet(self.path).dropDuplicates(["blob", "rule_version"])

    def scan(self, versions: DataFrame, path_column: str = "doc_id", text: str = "text", version: int = RULE_VERSION) -> DataFrame:
        """One row per row of versions: path_column, blob and the findings under this rule version."""
        small_batches(self.spark)
        body = F.coalesce(F.col(text), F.lit(""))
        named = versions.select(F.col(path_column).alias("path"), F.sha2(body.cast("binary"), 256).alias("blob"), body.alias("body"))
        paths = stored(named.select("path", "blob"), "secret-paths")
        known = self.read().where(F.col("rule_version") == version).select("blob")
        unseen = named.join(known, "blob", "left_anti") if not known.isEmpty() else named
        blobs = unseen.groupBy("blob").agg(F.first("body").alias("body"))
        blobs.mapInArrow(lambda batches: _scan(batches, version), _LEDGER).write.mode("append").option("compression", "zstd").parquet(self.path)
        hot = stored(paths.groupBy("blob").agg(F.count("*").alias("n")).where(F.col("n") >= hot_rows(paths.count())).select("blob"), "secret-hot")
        found = left_join(paths, self.read().where(F.col("rule_version") == version), ["blob"], hot)
        return found.withColumnRenamed("path", path_column)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of its own for each call, or the lasting one that the session names."""
    docs = table(spark, sf_dir, "documents")
    return Ledger(spark, spark.conf.get("spark.jagspark.secrets.ledger", None)).scan(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
