"""What a plan reads and does: leaves of the scans, pushed filters, exchanges, and the line of the caller that failed."""

from __future__ import annotations

import re
import traceback
import warnings
from collections import Counter

from pyspark.sql import DataFrame


def _plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def read_columns(df: DataFrame) -> list[str]:
    """The read schema of every scan, as Spark has it."""
    return re.findall(r"ReadSchema: (struct<.*>)", _plan(df))


def pushed_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PushedFilters: \[(.*?)\]", _plan(df))


def check_projection(df: DataFrame, expected: list[str], on_fail: str = "warn") -> list[str]:
    """The columns that the scans read beyond `expected`. on_fail: 'pass' returns them, 'warn' warns, 'raise' raises."""
    if on_fail not in ("pass", "warn", "raise"):
        raise ValueError("on_fail must be pass, warn or raise")
    read = {f.strip().split(":")[0] for r in read_columns(df) for f in re.split(r",(?![^<]*>)", r[len("struct<") : -1]) if f}
    more = sorted(read - set(expected))
    if more and on_fail != "pass":
        text = f"the plan reads more than it should: {', '.join(more)}"
        if on_fail == "raise":
            raise ValueError(text)
        warnings.warn(text, stacklevel=2)
    return more


def operators(df: DataFrame) -> Counter:
    """How often each physical operator occurs."""
    return Counter(re.findall(r"^[\s:+\-*()\d]*([A-Z]\w+)", _plan(df), re.M))


def uses_python(df: DataFrame) -> bool:
    return any(re.search("Python|Pandas|Arrow", k) for k in operators(df))


class StageError(RuntimeError):
    """A failed step: its name, the caller's line and the first line of the cause. Pickles."""

    def __init__(self, step: str, where: str, cause: str):
        super().__init__(step, where, cause)
        self.step, self.where, self.cause = step, where, cause

    def __str__(self) -> str:
        return f"{self.step} at {self.where}: {self.cause}"


def run(df: DataFrame, step: str = "query"):
    """df.collect(), with failures told by step and the line that asked."""
    caller = traceback.extract_stack(limit=2)[0]
    try:
        return df.collect()
    except Exception as e:
        raise StageError(step, f"{caller.filename}:{caller.lineno}", str(e).strip().splitlines()[0]) from e
