"""Resumable runs over batches of files: a journal of finished batches, retries, dead letters, stop conditions, and bundles to reproduce a result."""

from __future__ import annotations

import hashlib
import json
import math
import time
import traceback
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import _fs, discover


def fingerprint(value) -> str:
    """SHA-256 of canonical JSON."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def _write(spark: SparkSession, path: str, text: str) -> None:
    where, fs = _fs(spark, path)
    part, _ = _fs(spark, f"{path}.part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(where, False)
    fs.rename(part, where)


def _read(spark: SparkSession, path: str) -> str | None:
    where, fs = _fs(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


@dataclass
class StopCondition:
    """When a run ends early: rows made, seconds, failed batches."""

    rows: int | None = None
    seconds: float | None = None
    failures: int | None = None

    def met(self, rows: int, began: float, failures: int) -> bool:
        return (self.rows is not None and rows >= self.rows) or (self.seconds is not None and time.time() - began >= self.seconds) or (self.failures is not None and failures > self.failures)


@dataclass
class Result:
    """Task ids by outcome; `run` names the step's folder in the store."""

    run: str = ""
    done: list[str] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)
    dead: list[dict] = field(default_factory=list)
    stopped: bool = False


class Retry:
    """What to do with a task that failed: `again` says how often it is tried as it is, `split` whether it is then cut in two (files, then
    rows of one file), `fresh` whether a further try shuffles the rows first, so that other executors get them. What still fails is
    quarantined: a dead letter, and the run goes on."""

    def __init__(self, again: int = 1, split: bool = True, fresh: bool = False, least_rows: int = 1):
        self.again, self.split, self.fresh, self.least_rows = again, split, fresh, least_rows


def step_id(spark: SparkSession, step: Callable[[DataFrame], DataFrame], schema) -> str:
    """A fingerprint of what a step does: its plan over an empty table, and its code where it is a Python function."""
    plan = step(spark.createDataFrame([], schema))._jdf.queryExecution().analyzed().canonicalized().toString()
    return fingerprint([plan, schema.jsonValue(), _code(getattr(step, "__code__", None)), [repr(c.cell_contents) for c in getattr(step, "__closure__", None) or ()]])


def _code(code) -> list:
    if code is None:
        return []
    return [code.co_code.hex(), list(code.co_names), [_code(c) if hasattr(c, "co_code") else repr(c) for c in code.co_consts]]


#: A task: files, and of a single file a range of its rows.
Task = tuple[tuple[str, ...], int | None, int | None]


def _input(spark: SparkSession, task: Task, schema) -> DataFrame:
    files, low, high = task
    df = spark.read.schema(schema).parquet(*files)
    at = F.col("_metadata.row_index")
    return df if low is None else df.where((at >= low) & (at < high))


def _halves(spark: SparkSession, task: Task, policy: Retry) -> list[Task]:
    files, low, high = task
    if len(files) > 1:
        return [(files[: len(files) // 2], None, None), (files[len(files) // 2 :], None, None)]
    low, high = (0, spark.read.parquet(*files).count()) if low is None else (low, high)
    middle = (low + high) // 2
    return [(files, low, middle), (files, middle, high)] if high - low >= 2 * policy.least_rows else []


def _covered(journal: list[dict]) -> dict[str, list[tuple[int, float]]]:
    """Row ranges of each file that the journal's entries hold, the whole file as (0, inf)."""
    out: dict[str, list[tuple[int, float]]] = {}
    for entry in journal:
        for f in entry["files"]:
            out.setdefault(f, []).append((0, math.inf) if entry["low"] is None else (entry["low"], entry["high"]))
    return out


def _missing(ranges: list[tuple[int, float]], n: float) -> list[tuple[int, float]]:
    """What of [0, n) the ranges leave out."""
    out, at = [], 0
    for low, high in sorted(ranges):
        if low > at:
            out.append((at, low))
        at = max(at, high)
    return [*out, (at, n)] if at < n else out


def journal(spark: SparkSession, store: str, run: str) -> list[dict]:
    """The committed tasks of a run."""
    where, fs = _fs(spark, f"{store}/{run}/_journal")
    if not fs.exists(where):
        return []
    names = sorted(str(s.getPath()) for s in fs.listStatus(where))
    return [json.loads(_read(spark, n)) for n in names if n.endswith(".json")]


def results(spark: SparkSession, store: str, run: str) -> DataFrame:
    """The rows that the run's journal has committed: what was written but not committed is not read."""
    targets = [e["target"] for e in journal(spark, store, run)]
    if not targets:
        raise FileNotFoundError(f"{store}/{run} has no committed task")
    return spark.read.parquet(*targets)


def run_resumable(spark: SparkSession, paths: str | Sequence[str], step: Callable[[DataFrame], DataFrame], store: str, files_per_batch: int = 8, policy: Retry | None = None, stop: StopCondition | None = None) -> Result:
    """step over batches of files. Each task writes a folder of its own and is then committed to a journal, which names the files (or the rows of
    one file) that it covers; a later run takes only what no committed task of the same step covers, whatever the size of its batches. A step
    that does something else is another run. Read with `results`."""
    files, began, rows, policy = discover(spark, paths), time.time(), 0, policy or Retry()
    schema = spark.read.parquet(files[0]).schema
    out = Result(run=step_id(spark, step, schema)[:16])
    before = journal(spark, store, out.run)
    out.skipped = [e["task"] for e in before]
    covered = _covered(before)
    whole = [f for f in files if f not in covered]
    queue: list[Task] = [(tuple(whole[i : i + files_per_batch]), None, None) for i in range(0, len(whole), files_per_batch)]
    for f in files:
        if f in covered and (0, math.inf) not in covered[f]:
            queue += [((f,), int(low), int(high)) for low, high in _missing(covered[f], spark.read.parquet(f).count())]
    while queue:
        task = queue.pop(0)
        if stop is not None and stop.met(rows, began, len(out.dead)):
            out.stopped = True
            break
        name = fingerprint([out.run, *task])[:16]
        target, error = f"{store}/{out.run}/task={name}", None
        for attempt in range(1 + policy.again + policy.fresh):
            try:
                df = _input(spark, task, schema)
                df = df.repartition(df.rdd.getNumPartitions()) if policy.fresh and attempt > policy.again else df
                step(df).write.mode("overwrite").parquet(target)
                error = None
                break
            except Exception as e:  # noqa: BLE001  whatever a task raises is its dead letter
                error = e
        if error is None:
            n = spark.read.parquet(target).count()
            _write(spark, f"{store}/{out.run}/_journal/{name}.json", json.dumps({"task": name, "files": task[0], "low": task[1], "high": task[2], "target": target, "rows": n}))
            out.done.append(name)
            rows += n
        elif policy.split and (halves := _halves(spark, task, policy)):
            queue[:0] = halves
        else:
            letter = {"task": name, "files": task[0], "low": task[1], "high": task[2], "error": type(error).__name__, "message": str(error)[:2000], "traceback": "".join(traceback.format_exception(error))[-8000:]}
            _write(spark, f"{store}/{out.run}/_dead/{name}.json", json.dumps(letter))
            out.dead.append(letter)
    return out


def content_hash(df: DataFrame) -> str:
    """A fingerprint of a table's rows in any order: their number and two sums of their hashes, made in the cluster."""
    columns = sorted(df.columns)
    one, two = (F.sum(F.xxhash64(*salt, *columns).cast("decimal(38,0)")) for salt in ([], [F.lit(1)]))
    n, a, b = df.agg(F.count(F.lit(1)), one, two).first()
    return fingerprint([columns, n, str(a), str(b)])


def build_bundle(spark: SparkSession, path: str, inputs: dict[str, DataFrame], query: str, payloads: dict[str, bytes] | None = None) -> str:
    """Everything a SQL query needs, in a folder: inputs as Parquet, payloads, and a manifest; returns the bundle's fingerprint."""
    manifest: dict = {"query": query, "inputs": {}, "payloads": {}}
    for name, df in inputs.items():
        df.write.mode("overwrite").parquet(f"{path}/inputs/{name}")
        manifest["inputs"][name] = {"schema": df.schema.jsonValue(), "rows": df.count()}
    for name, content in (payloads or {}).items():
        _write(spark, f"{path}/payloads/{name}.hex", content.hex())
        manifest["payloads"][name] = "sha256:" + hashlib.sha256(content).hexdigest()
    result = _run(spark, path, query, manifest["inputs"])
    manifest["result"] = content_hash(result)
    manifest["fingerprint"] = fingerprint(manifest)
    _write(spark, f"{path}/manifest.json", json.dumps(manifest, sort_keys=True))
    return manifest["fingerprint"]


def _run(spark: SparkSession, path: str, query: str, inputs: dict) -> DataFrame:
    return spark.sql(query, **{name: spark.read.parquet(f"{path}/inputs/{name}") for name in inputs})


def inspect(spark: SparkSession, path: str) -> dict:
    """The manifest, checked against its own fingerprint and the payloads' hashes."""
    manifest = json.loads(_read(spark, f"{path}/manifest.json") or "null")
    if manifest is None:
        raise FileNotFoundError(path)
    body = {k: v for k, v in manifest.items() if k != "fingerprint"}
    if fingerprint(body) != manifest["fingerprint"]:
        raise ValueError("the manifest was changed")
    for name, expected in manifest["payloads"].items():
        content = bytes.fromhex(_read(spark, f"{path}/payloads/{name}.hex") or "")
        if "sha256:" + hashlib.sha256(content).hexdigest() != expected:
            raise ValueError(f"payload {name} was changed")
    return manifest


def reproduce(spark: SparkSession, path: str) -> DataFrame:
    """The query's result from the bundle; a result that differs from the recorded one raises."""
    manifest = inspect(spark, path)
    result = _run(spark, path, manifest["query"], manifest["inputs"])
    if content_hash(result) != manifest["result"]:
        raise ValueError("the result differs from the recorded one")
    return result
