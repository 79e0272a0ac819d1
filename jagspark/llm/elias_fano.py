"""Elias-Fano sequences and a file of arrays that is memory-mapped when read."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

import numpy as np


_U = np.uint64
_ONES, _TOPS = _U(0x0101010101010101), _U(0x8080808080808080)
#: The place of the r-th one of a byte b at 8 b + r.
_IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[r] for b in range(256) for r in range(8)], np.uint8)


def select(bits: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The place of the one that has `left` ones below it in each word (uint64)."""
    left = left.astype(_U)
    s = bits - (bits >> _U(1) & _U(0x5555555555555555))
    s = (s & _U(0x3333333333333333)) + (s >> _U(2) & _U(0x3333333333333333))
    s = (s + (s >> _U(4)) & _U(0x0F0F0F0F0F0F0F0F)) * _ONES  # ones up to each byte
    place = (((left * _ONES | _TOPS) - s & _TOPS) >> _U(7)) * _ONES >> _U(56) << _U(3)
    left -= (s << _U(8)) >> place & _U(255)
    return place + _IN_BYTE[((bits >> place & _U(255)) << _U(3)) + left]


class EliasFano:
    """A non-decreasing sequence of whole numbers in about 2 + log2(universe / n) bits each, with access by place."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.width, self.low, self.high, self.ones = n, width, low, high, ones

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, np.zeros(2, np.uint64), np.zeros(1, np.uint64), np.zeros(1, np.uint32))
        width = max(0, (int(values[-1]) // n).bit_length() - 1)
        if width:
            bits = np.zeros(-(-n * width // 64) * 64 + 64, np.uint8)
            at = np.arange(n) * width
            for i in range(width):
                bits[at + i] = (values >> np.uint64(i)).astype(np.uint8) & 1
            low = np.packbits(bits, bitorder="little").view(np.uint64)
        else:
            low = np.zeros(2, np.uint64)
        places = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(-(-(int(places[-1]) + 1) // 64) * 64, np.uint8)
        bits[places] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high))[:-1]]).astype(np.uint32)
        return cls(n, width, low, high, ones)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at the places i (uint64)."""
        i = np.asarray(i, np.int64)
        word = np.searchsorted(self.ones, i.astype(self.ones.dtype), "right") - 1
        bits = self.high[word]
        at = select(bits, i - self.ones[word]).astype(np.int64)
        value = (word * 64 + at - i).astype(np.uint64) << np.uint64(self.width)
        return value | self._low(i) if self.width else value

    def _low(self, i: np.ndarray) -> np.ndarray:
        """The low bits of the values at the places i."""
        place = i * self.width
        word, shift = place >> 6, (place & 63).astype(np.uint64)
        part = self.low[word] >> shift
        part |= np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return part & np.uint64((1 << self.width) - 1)

    def _ends(self, high: np.ndarray, zeros: np.ndarray) -> np.ndarray:
        """How many values have high bits of `high` or less. `zeros`: zeros below each word of `high` bits."""
        out = np.full(len(high), self.n, np.int64)
        own = np.flatnonzero(high < 64 * len(self.high) - self.n)  # each high part ends with a zero
        k = high[own]
        word = np.searchsorted(zeros, k, "right") - 1
        out[own] = word * 64 + select(~self.high[word], k - zeros[word]).astype(np.int64) - k
        return out

    def search(self, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The first place in [low, high) whose value is `wanted` or more, else high; each has a range of its own. The zeros give the places that
        share the high bits, and only low bits are compared."""
        if not self.n or not len(wanted):
            return low.copy()
        part = np.minimum(wanted >> np.uint64(self.width), np.uint64(1 << 62)).astype(np.int64)
        zeros = 64 * np.arange(len(self.high)) - self.ones
        new = np.ones(len(part), bool)
        new[1:] = part[1:] != part[:-1]
        each, at = part[new], np.cumsum(new) - 1
        low, high = np.clip(self._ends(np.maximum(each, 1) - 1, zeros)[at] * (part > 0), low, high), np.clip(self._ends(each, zeros)[at], low, high)
        rest = wanted & np.uint64((1 << self.width) - 1)
        active = np.flatnonzero(low < high) if self.width else np.zeros(0, np.int64)
        while len(active):
            middle = (low[active] + high[active]) >> 1
            less = self._low(middle) < rest[active]
            low[active[less]] = middle[less] + 1
            high[active[~less]] = middle[~less]
            active = active[low[active] < high[active]]
        return low

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.size": np.array([self.n, self.width], np.int64), f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.ones": self.ones}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        n, width = (int(x) for x in arrays[f"{name}.size"])
        return cls(n, width, arrays[f"{name}.low"], arrays[f"{name}.high"], arrays[f"{name}.ones"])


def _store(path: str):
    """(file system, path in it); None for a folder that open() reaches."""
    if path.startswith("file:"):
        return None, "/" + path[5:].lstrip("/")
    if "://" not in path:
        return None, path
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def save(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Write arrays as one file, whole or not at all, so that a task that is tried again does no harm."""
    head, at = {}, 0
    for name, x in arrays.items():
        head[name] = [x.dtype.str, len(x), at]
        at += -(-x.nbytes // 64) * 64
    first = json.dumps(head).encode()
    first = len(first).to_bytes(8, "little") + first
    first += b"\0" * (-len(first) % 64)
    store, local = _store(path)
    part = f"{local}.{uuid.uuid4().hex}"
    if store is None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
    else:
        store.create_dir(os.path.dirname(local), recursive=True)
    with open(part, "wb") if store is None else store.open_output_stream(part) as f:
        f.write(first)
        for x in arrays.values():
            f.write(x.tobytes() + b"\0" * (-x.nbytes % 64))
    os.replace(part, local) if store is None else store.move(part, local)


def load(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped. From a store that is no mounted folder it is fetched to a temporary file, which goes when unmapped."""
    store, local = _store(path)
    gone = None
    if store is not None:
        handle, gone = tempfile.mkstemp()
        with store.open_input_stream(local) as source, os.fdopen(handle, "wb") as f:
            while piece := source.read(1 << 24):
                f.write(piece)
        local = gone
    whole = np.memmap(local, np.uint8, "r")
    if gone:
        os.unlink(gone)
    size = int.from_bytes(whole[:8].tobytes(), "little")
    base = -(-(8 + size) // 64) * 64
    out = {}
    for name, (kind, n, at) in json.loads(whole[8 : 8 + size].tobytes()).items():
        kind = np.dtype(kind)
        out[name] = np.asarray(whole[base + at : base + at + n * kind.itemsize]).view(kind)
    return out
