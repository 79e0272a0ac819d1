"""Opaque functions: vectorised maps, signature-typed functions, correction tables and model calls, in a registry with content hashes.

Everything that has a native form is one (corrections become CASE expressions); the rest are Arrow-batched pandas UDFs. A payload is loaded
once per worker.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import subprocess
import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from .elementwise import _c


@dataclass(frozen=True)
class Payload:
    """What an external function is made of, by content."""

    kind: str
    content: bytes
    framework: str = ""
    version: str = ""
    schema: str = ""
    note: str = ""

    @property
    def content_hash(self) -> str:
        return "sha256:" + hashlib.sha256(self.content).hexdigest()

    def describe(self) -> dict:
        return {"kind": self.kind, "content_hash": self.content_hash, "framework": self.framework, "version": self.version, "schema": self.schema, "note": self.note}


@dataclass
class Registry:
    """Functions that ran as opaque code; `risks` names those without a content hash."""

    entries: dict[str, Payload | None] = field(default_factory=dict)

    def note(self, name: str, payload: Payload | None = None) -> None:
        if payload is not None and self.entries.get(name, payload) not in (None, payload):
            raise ValueError(f"{name} is registered with another content")
        self.entries[name] = payload

    @property
    def risks(self) -> list[str]:
        return sorted(f"unhashed-opaque:{k}" for k, v in self.entries.items() if v is None)


REGISTRY = Registry()


def map(fn: Callable[[np.ndarray], np.ndarray], x: Column, returns: str = "double", name: str = "map") -> Column:
    """fn over the column's values, a batch at a time."""
    return apply(fn, x, returns=returns, name=name)


def apply(fn: Callable[..., np.ndarray], *columns: Column, returns: str = "double", name: str = "apply", payload: Payload | None = None) -> Column:
    """fn over several columns, a batch at a time: arrays in, an array of the batch's length out."""
    REGISTRY.note(name, payload)

    def run(*series: pd.Series) -> pd.Series:
        out = np.asarray(fn(*[s.to_numpy() for s in series]))
        if len(out) != len(series[0]):
            raise ValueError(f"{name} gave {len(out)} values for {len(series[0])} rows")
        return pd.Series(list(out) if out.ndim > 1 else out)

    run.__name__ = name
    return F.pandas_udf(run, returns)(*columns)


_SIGNATURE = re.compile(r"^\s*(\([\w\s,]*\)(?:\s*,\s*\([\w\s,]*\))*)\s*->\s*(\([\w\s,]*\))\s*$")


def gufunc(fn: Callable[..., np.ndarray], signature: str, *columns: Column, returns: str = "double", name: str = "gufunc") -> Column:
    """fn over stacked batches by a signature such as '(i),(i)->()': inputs with a core dimension are list columns of one length."""
    found = _SIGNATURE.match(signature)
    if not found:
        raise ValueError(f"not a signature with one output: {signature}")
    inputs = [tuple(d.strip() for d in g.split(",") if d.strip()) for g in re.findall(r"\(([\w\s,]*)\)", found[1])]
    if len(inputs) != len(columns):
        raise ValueError(f"{signature} has {len(inputs)} inputs, {len(columns)} are given")
    if any(len(d) > 1 for d in inputs):
        raise ValueError("inputs of one core dimension at most")

    def stacked(*arrays: np.ndarray) -> np.ndarray:
        sizes: dict[str, int] = {}
        ready = []
        for dims, a in zip(inputs, arrays, strict=True):
            a = np.stack(a) if dims and len(a) else a
            for d in dims:
                if len(a) and sizes.setdefault(d, a.shape[1]) != a.shape[1]:
                    raise ValueError(f"dimension {d} is {sizes[d]} and {a.shape[1]}")
            ready.append(a)
        return fn(*ready)

    return apply(stacked, *columns, returns=returns, name=name)


def parse_template(template: Sequence, n: int) -> list:
    """A call template: '$0' a column, ['$0', '$1'] a group, anything else a constant. Places out of range raise."""

    def read(part):
        if isinstance(part, (list, tuple)):
            return [read(p) for p in part]
        if isinstance(part, str) and (m := re.fullmatch(r"\$(\d+)", part)):
            if int(m[1]) >= n:
                raise IndexError(f"{part} of {n} inputs")
            return ("slot", int(m[1]))
        return ("constant", part)

    return [read(p) for p in template]


def correction(spec: dict | str, *inputs: Column, category: str | None = None, args: Sequence | None = None) -> Column:
    """A scale factor as a native expression.

    A spec of one binned axis is {'edges': [...], 'flow': 'clamp' or 'error', 'values': {category: [...]}} (or one list). A tree is a number or
    {'kind': 'category', 'input': i, 'content': {key: tree}, 'default': tree},
    {'kind': 'binning', 'input': i, 'edges': [...], 'content': [tree, ...], 'flow': 'clamp', 'error' or a number} or
    {'kind': 'multibinning', 'inputs': [i, ...], 'edges': [[...], ...], 'content': [tree, ...], 'flow': ...}, the last axis fastest.
    args: a call template ('$0' a column, anything else a constant) that gives the tree's inputs; without it they are the columns.
    """
    spec = json.loads(spec) if isinstance(spec, str) else spec
    if isinstance(spec, dict) and "kind" not in spec:
        values = spec["values"]
        spec = {"kind": "binning", "input": 0, "edges": spec["edges"], "content": values[category] if isinstance(values, dict) else values, "flow": spec.get("flow", "clamp")}
    given = [v if kind == "constant" else _c(inputs[v]) for kind, v in parse_template(args or [f"${i}" for i in range(len(inputs))], len(inputs))]
    return _tree(spec, given)


def _tree(node, given: list) -> Column:
    if not isinstance(node, dict):
        return F.lit(float(node))
    if node["kind"] == "category":
        key, content = given[node["input"]], node["content"]
        if not isinstance(key, Column):  # a constant picks its branch when the plan is made
            if key not in content and "default" not in node:
                raise KeyError(f"the correction has no category {key}")
            return _tree(content.get(key, node.get("default")), given)
        out = F.when(F.lit(False), F.lit(0.0))
        for k, below in content.items():
            out = out.when(key == F.lit(k), _tree(below, given))
        return out.otherwise(_tree(node["default"], given)) if "default" in node else out.when(key.isNotNull(), F.raise_error(F.lit("a category that the correction has not")).cast("double"))
    names = [node["input"]] if node["kind"] == "binning" else node["inputs"]
    edges = [node["edges"]] if node["kind"] == "binning" else node["edges"]
    size, place, outside, known = 1, F.lit(0), F.lit(False), F.lit(True)
    for name, cuts in zip(names, edges, strict=True):
        x = _c(given[name]) if isinstance(given[name], Column) else F.lit(given[name])
        x = x.cast("double")
        at = F.lit(len(cuts) - 2)
        for i in range(len(cuts) - 2, 0, -1):
            at = F.when(x < cuts[i], F.lit(i - 1)).otherwise(at)
        place, size = place * (len(cuts) - 1) + at, size * (len(cuts) - 1)
        outside, known = outside | (x < cuts[0]) | (x >= cuts[-1]), known & x.isNotNull() & ~F.isnan(x)
    if len(node["content"]) != size:
        raise ValueError("one value for each bin is needed")
    if any(isinstance(x, dict) for x in node["content"]):
        out = F.when(F.lit(False), F.lit(0.0))
        for i, below in enumerate(node["content"]):
            out = out.when(place == i, _tree(below, given))
    else:
        out = F.element_at(F.array(*[F.lit(float(x)) for x in node["content"]]), place + 1)
    flow = node.get("flow", "clamp")
    if flow == "error":
        out = F.when(outside, F.raise_error(F.lit("outside the correction's range")).cast("double")).otherwise(out)
    elif flow != "clamp":
        out = F.when(outside, _tree(flow, given)).otherwise(out)
    return F.when(known, out)


# ---------------------------------------------------------------- plugins


class Plugin:
    """How payloads of one kind are told apart and run. A plugin gives `kind`, `content_hash` (of what the payload means, not how it is stored),
    `load` (once per worker), `evaluate` (arrays in, an array out), `close`, and `samples`, two different payloads at least."""

    kind = ""

    def content_hash(self, content: bytes) -> str:
        return "sha256:" + hashlib.sha256(content).hexdigest()

    def load(self, content: bytes):
        raise NotImplementedError

    def evaluate(self, loaded, *args, **kwargs):
        return loaded(*args, **kwargs)

    def close(self, loaded) -> None:
        """Nothing to give back unless a plugin says so."""

    def samples(self) -> list[bytes]:
        return []


PLUGINS: dict[str, Plugin] = {}


def register_plugin(plugin: Plugin) -> None:
    """Accept a plugin whose hash tells its samples apart and is the same in another process; a kind is given once."""
    samples = plugin.samples()
    if len(samples) < 2:
        raise ValueError(f"{plugin.kind}: two samples at least are needed")
    here = [plugin.content_hash(x) for x in samples]
    if len(set(here)) < len(here):
        raise ValueError(f"{plugin.kind}: different samples have one hash")
    code = "import sys, pickle; p, xs = pickle.loads(sys.stdin.buffer.read()); print('\\n'.join(p.content_hash(x) for x in xs))"
    for seed in ("1", "2"):  # what hash() or id() goes into differs between processes
        env = os.environ | {"PYTHONHASHSEED": seed, "PYTHONPATH": os.pathsep.join(sys.path)}
        there = subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps((plugin, samples)), capture_output=True, env=env, check=True)
        if there.stdout.decode().split() != here:
            raise ValueError(f"{plugin.kind}: the hash differs between processes")
    if plugin.kind in PLUGINS:
        raise ValueError(f"{plugin.kind} is registered already")
    PLUGINS[plugin.kind] = plugin


def external(kind: str, content: bytes, *inputs: Column, args: Sequence | None = None, kwargs: dict | None = None, returns: str = "double", expected_hash: str | None = None) -> Column:
    """A registered plugin's payload over columns. args and kwargs are call templates: '$0' is a column's array, ['$0', '$1'] a float32 matrix of
    columns, anything else a constant. The payload is loaded once for a task and closed at its end."""
    plugin = PLUGINS[kind]
    found = plugin.content_hash(content)
    if expected_hash is not None and found != expected_hash:
        raise ValueError(f"the payload is {found}, not {expected_hash}")
    slots = parse_template(args if args is not None else [f"${i}" for i in range(len(inputs))], len(inputs))
    named = {k: parse_template([v], len(inputs))[0] for k, v in (kwargs or {}).items()}
    REGISTRY.note(f"{kind}:{found[-8:]}", Payload(kind, content))

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        loaded = plugin.load(content)
        try:
            for series in batches:
                arrays = [s.to_numpy() for s in (series if isinstance(series, tuple) else (series,))]  # one input comes bare

                def value(part, arrays=arrays):
                    if isinstance(part, list):
                        return np.column_stack([np.asarray(value(p), np.float32) for p in part])
                    return arrays[part[1]] if part[0] == "slot" else part[1]

                out = np.asarray(plugin.evaluate(loaded, *[value(p) for p in slots], **{k: value(p) for k, p in named.items()}))
                yield pd.Series(out.ravel() if out.ndim > 1 and out.size == len(arrays[0]) else list(out) if out.ndim > 1 else out)
        finally:
            plugin.close(loaded)

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, returns)(*inputs)


class OnnxPlugin(Plugin):
    """Models for onnxruntime, where it is installed: named outputs' first, float32 matrices in."""

    kind = "onnx_model"

    def load(self, content: bytes):
        import onnxruntime

        session = onnxruntime.InferenceSession(content)
        names = [x.name for x in session.get_inputs()]
        return lambda *args, **kwargs: session.run(None, dict(zip(names, args)) | kwargs)[0]

    def samples(self) -> list[bytes]:
        return [b"one", b"two"]


def model(load: Callable[[bytes], Callable[[np.ndarray], np.ndarray]], payload: Payload, *inputs: Column, template: Sequence | None = None, returns: str = "double", expected_hash: str | None = None) -> Column:
    """A model over a matrix of its inputs (float32, one row per row); load makes the function from the payload once per worker."""
    if expected_hash is not None and payload.content_hash != expected_hash:
        raise ValueError(f"the payload is {payload.content_hash}, not {expected_hash}")
    slots = parse_template(template or [[f"${i}" for i in range(len(inputs))]], len(inputs))
    REGISTRY.note(f"{payload.kind}:{payload.content_hash[7:15]}", payload)
    content = payload.content

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        call = load(content)
        for series in batches:
            series = series if isinstance(series, tuple) else (series,)  # one input comes bare
            arrays = [np.asarray(s.tolist() if s.dtype == object else s, np.float32) for s in series]

            def value(part, arrays=arrays):
                if isinstance(part, list):
                    return np.column_stack([value(p) for p in part])
                return arrays[part[1]] if part[0] == "slot" else part[1]

            yield pd.Series(np.asarray(call(*[value(p) for p in slots]), float).ravel())

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, returns)(*inputs)
