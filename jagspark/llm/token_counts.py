"""Token counts under a unigram segmentation, by dynamic programming over a trie of pre-tokens.

Distinct pre-tokens are sorted into a trie. A node stands for a prefix; its forward score, the best score of any split of the prefix
into vocabulary pieces, is computed once, from its ancestors' scores, and shared by every pre-token that begins so. The nodes of one depth are scored
together, in arrays: their last pieces are read backwards in a trie of the pieces' suffixes. A pre-token's terminal node holds its token
count, which is kept by pre-token; only new ones go to the next trie. A text's count is the sum over its pre-tokens. Pre-tokens of more than WIDE bytes
are inserted one by one.

The vocabulary is a file of byte strings with ranks (parameter `path`), which must hold all single bytes; it is not trained. The unigram
probabilities of its pieces are estimated here: a first pass counts the pre-tokens of every row, splits each distinct one with Zipf's law as a
guess (a piece of rank r costs ln(r + 2)) and counts the pieces; p = (count + 1) / (all + V). Costs are round(-10^6 * ln p), whole numbers, so that sums are
exact; the split of least cost counts, of equal ones that with fewer tokens, then that with the shorter last piece.

Defined results: a null or empty text has no tokens and counts nothing; repeated rows give repeated results and count each; very long texts
and pre-tokens are read whole; an empty table gives an empty result; other columns are ignored, whatever their names.

At scale: two maps over the rows; between them go the distinct pre-tokens with counts, combined per task before the shuffle, and piece counts, at
most one row a piece (V, about 50,000), which is also what the driver gets; the vocabulary and the costs (about 2 MB) are broadcast; the pre-tokens of a trie have
MAX_NODES bytes at most (or are one), and the counts that a worker keeps are started anew beyond KEPT_WORDS, which bounds its memory and changes no result.
"""

from __future__ import annotations

import base64
import functools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, byte_column, small_batches, table

#: Bytes of the pre-tokens in one trie, hence more than its nodes.
MAX_NODES = 700_000
#: Distinct pre-tokens that a task counts before it sends them on.
MAX_WORDS = 200_000
#: Pre-tokens whose counts a worker keeps.
KEPT_WORDS = 600_000
#: Pre-tokens of more characters are not kept.
LONG = 2_000
#: Pre-tokens of more bytes are inserted one at a time.
WIDE = 64
#: Bytes of text, or pre-tokens of them, whose new pre-tokens are split together.
BATCH_BYTES = 4_000_000
#: Bits for the tokens of a split of at most WIDE bytes.
TOKEN_BITS = 8


def read_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}


def guessed(pieces: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """Costs before anything is counted: Zipf's law."""
    return [round(1e6 * math.log(ranks[p] + 2)) for p in pieces]


def estimated(counts: np.ndarray) -> list[int]:
    """Costs by counts of the pieces."""
    return np.rint(-1e6 * np.log((counts + 1) / (counts.sum() + len(counts)))).astype(np.int64).tolist()


class Suffixes:
    """The suffixes of all pieces as a trie read from the last byte on: a state is a suffix (0: the empty one); piece[state] is -1 where it is no
    piece itself. Its edges lie in an open hash table."""

    def __init__(self, pieces: list[bytes]):
        if missing := 256 - sum(len(p) == 1 for p in pieces):
            raise ValueError(f"the vocabulary lacks {missing} single bytes")
        self.state_of = state_of = {b"": 0}
        edges = []
        for piece in pieces:
            shorter = 0
            for i in range(len(piece) - 1, -1, -1):
                state = state_of.setdefault(piece[i:], len(state_of))
                if state > len(edges):
                    edges.append(shorter << 8 | piece[i])
                shorter = state
        self.piece = np.full(len(state_of), -1, np.int64)
        self.piece[[state_of[p] for p in pieces]] = np.arange(len(pieces))
        self.pieces = dict(zip(state_of, self.piece.tolist(), strict=True))
        bits = len(edges).bit_length() + 2
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.edge, self.state = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        edge, state = np.array(edges, np.int64), np.arange(1, len(state_of))
        slot = self._slots(edge)
        while len(edge):
            free = self.edge[slot] < 0
            self.edge[slot[free]] = edge[free]
            left = self.edge[slot] != edge
            self.state[slot[~left]] = state[~left]
            edge, state, slot = edge[left], state[left], slot[left] + 1 & self.mask

    def _slots(self, edge: np.ndarray) -> np.ndarray:
        return (edge.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The states one byte further to the left; 0 where no piece ends so."""
        edge = state << 8 | byte
        slot = self._slots(edge)
        found = self.edge[slot]
        to = np.where(found == edge, self.state[slot], 0)
        left = np.flatnonzero((found != edge) & (found >= 0))
        slot = slot[left]
        while len(left):
            slot = slot + 1 & self.mask
            found = self.edge[slot]
            hit = found == edge[left]
            to[left[hit]] = self.state[slot[hit]]
            more = ~hit & (found >= 0)
            left, slot = left[more], slot[more]
        return to


class BatchTrie:
    """The trie of distinct pre-tokens of at most WIDE bytes, given as byte spans in sorted order. All nodes of a depth are made and scored at once."""

    def __init__(self, suffixes: Suffixes, costs: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        self.pieces = len(costs)
        #: cost and tokens of a piece as one number, which adds up and compares as the two do in turn
        weights = (costs << TOKEN_BITS) + 1
        most = int(sizes.sum()) + 1
        self.weight, byte, parent = np.zeros(most, np.int64), np.zeros(most, np.int64), np.zeros(most, np.int64)
        self.last, self.before, self.levels = np.zeros(most, np.int64), np.zeros(most, np.int64), [0, 1]
        self.node = node = np.zeros(len(sizes), np.int64)
        rows, made = np.arange(len(sizes)), 1
        for depth in range(int(sizes.max(initial=0))):
            rows = rows[sizes[rows] > depth]
            next_byte, above = data[starts[rows] + depth], node[rows]
            new = np.ones(len(rows), bool)
            new[1:] = (above[1:] != above[:-1]) | (next_byte[1:] != next_byte[:-1])
            node[rows] = made - 1 + np.cumsum(new)
            first, made = made, made + int(new.sum())
            byte[first:made], parent[first:made] = next_byte[new], above[new]
            here = slice(first, made)
            self._score(suffixes, weights, byte, parent, np.arange(first, made), self.weight[here], self.last[here], self.before[here])
            self.levels.append(made)

    def _score(self, suffixes: Suffixes, weights: np.ndarray, byte: np.ndarray, parent: np.ndarray, nodes: np.ndarray, best: np.ndarray, last: np.ndarray, before: np.ndarray) -> None:
        """Best splits of new nodes, by their last pieces from the shortest on."""
        best[:] = np.iinfo(np.int64).max
        place, at, state = np.arange(len(nodes)), nodes, np.zeros(len(nodes), np.int64)
        while len(place):
            state = suffixes.step(state, byte[at])
            alive = np.flatnonzero(state)
            place, at, state = place[alive], parent[at[alive]], state[alive]
            piece = suffixes.piece[state]
            whole = np.flatnonzero(piece >= 0)
            piece, start, to = piece[whole], at[whole], place[whole]
            total = self.weight[start] + weights[piece]
            less = np.flatnonzero(total < best[to])
            to = to[less]
            best[to], last[to], before[to] = total[less], piece[less], start[less]
            deeper = np.flatnonzero(at)
            place, at, state = place[deeper], at[deeper], state[deeper]

    def totals(self) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and cost of each pre-token, from its terminal node."""
        weight = self.weight[self.node]
        return weight & (1 << TOKEN_BITS) - 1, weight >> TOKEN_BITS

    def counted(self, times: np.ndarray) -> np.ndarray:
        """How often each piece stands in the splits of the pre-tokens, taken `times` each."""
        own = np.zeros(self.levels[-1], np.int64)
        own[self.node] = times
        found = np.zeros(self.pieces, np.int64)
        for first, end in zip(self.levels[-2:0:-1], self.levels[:1:-1], strict=True):
            used = first + np.flatnonzero(own[first:end])
            np.add.at(found, self.last[used], own[used])
            np.add.at(own, self.before[used], own[used])
        return found


class LongTrie:
    """A trie that grows by one pre-token of any length at a time."""

    def __init__(self, suffixes: Suffixes, costs: np.ndarray):
        self.pieces, self.costs = suffixes.pieces, costs.tolist()
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        #: by node: forward score, tokens, the last piece and the node before it
        self.cost, self.tokens, self.last, self.before = [0], [0], [-1], [0]

    def insert(self, raw: bytes) -> int:
        """The node of raw; scores only the nodes that no earlier pre-token has made."""
        child, cost, tokens, piece_of, costs = self.child, self.cost, self.tokens, self.pieces.get, self.costs
        path, node = [0], 0
        for depth, byte in enumerate(raw, 1):
            key = node << 8 | byte
            node = child.get(key, 0)
            if not node:
                least = fewest = last = before = -1
                for start in range(depth - 1, -1, -1):
                    piece = piece_of(raw[start:depth])
                    if piece is None:
                        break  # no piece ends so, hence none that is longer
                    if piece >= 0:
                        at = path[start]
                        total = cost[at] + costs[piece]
                        if least < 0 or total < least or total == least and tokens[at] < fewest:
                            least, fewest, last, before = total, tokens[at], piece, at
                node = child[key] = len(cost)
                cost.append(least)
                tokens.append(fewest + 1)
                self.last.append(last)
                self.before.append(before)
            path.append(node)
        return node

    def count(self, node: int, times: int, found: np.ndarray) -> None:
        """Add the pieces of the split that ends in node, taken `times`."""
        while node:
            found[self.last[node]] += times
            node = self.before[node]


class Splitter(dict):
    """Pre-token -> place in the arrays of `totals`; those that are new since the last call of it are split then, all at once."""

    def __init__(self, suffixes: Suffixes, costs: np.ndarray):
        super().__init__()
        self.suffixes, self.costs, self.single = suffixes, costs, LongTrie(suffixes, costs)
        self.long, self.nodes, self.words = LONG, MAX_NODES, KEPT_WORDS
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.new: list[str] = []
        self.tokens, self.cost = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, word: str) -> int:
        place = len(self.tokens) + len(self.new)
        self.new.append(word)
        if len(word) <= self.long:
            self[word] = place
        return place

    def places(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def totals(self) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and cost by place."""
        if self.new:
            column = pa.array(self.new, pa.large_string())
            order = pc.array_sort_indices(column)
            data, offsets = byte_column(column.take(order))
            tokens, cost = np.empty(len(column), np.int64), np.empty(len(column), np.int64)
            order = order.to_numpy()
            for at, trie in self.tries(data, offsets):
                tokens[order[at]], cost[order[at]] = trie.totals() if isinstance(trie, BatchTrie) else (self.single.tokens[trie], self.single.cost[trie])
            self.tokens, self.cost = np.concatenate([self.tokens, tokens]), np.concatenate([self.cost, cost])
            self.new = []
        return self.tokens, self.cost

    def sums(self, places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and cost of each of the texts whose pre-tokens have these places. Forgets the pre-tokens if there are too many."""
        at, ends = np.concatenate([np.zeros(0, np.int64), *places]), np.cumsum([0, *map(len, places)])
        tokens, cost = (np.diff(np.concatenate([[0], np.cumsum(x[at])])[ends]) for x in self.totals())
        if len(self.tokens) > self.words:
            self.clear()
        return tokens, cost

    def counted(self, words: pa.ChunkedArray, times: np.ndarray) -> np.ndarray:
        """How often each piece stands in the splits of distinct sorted words, taken `times` each."""
        data, offsets = byte_column(words)
        found = np.zeros(len(self.costs), np.int64)
        for at, trie in self.tries(data, offsets):
            if isinstance(trie, BatchTrie):
                found += trie.counted(times[at])
            else:
                self.single.count(trie, int(times[at]), found)
        return found

    def tries(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray | int, BatchTrie | int]]:
        """Sorted words, each once: (rows, their trie), or (row, node in `single`) of those wider than WIDE bytes."""
        sizes = np.diff(offsets)
        narrow = np.flatnonzero(sizes <= WIDE)
        bounds = np.concatenate([[0], np.cumsum(sizes[narrow])])
        for i, j in blocks(bounds, self.nodes):
            at = narrow[i:j]
            yield at, BatchTrie(self.suffixes, self.costs, data, offsets[at], sizes[at])
        for at in np.flatnonzero(sizes > WIDE).tolist():
            yield at, self.single.insert(data[offsets[at] : offsets[at + 1]].tobytes())
            if len(self.single.cost) > self.nodes:
                self.single.clear()
        self.single.clear()


@functools.lru_cache(maxsize=2)
def _vocabulary(content: bytes) -> tuple[list[bytes], dict[bytes, int]]:
    ranks = read_ranks(content)
    return sorted(ranks, key=ranks.get), ranks


@functools.lru_cache(maxsize=2)
def _suffixes(content: bytes) -> Suffixes:
    return Suffixes(_vocabulary(content)[0])


@functools.lru_cache(maxsize=2)
def _splitter(content: bytes, costs: bytes | None) -> Splitter:
    return Splitter(_suffixes(content), np.array(guessed(*_vocabulary(content)), np.int64) if costs is None else np.frombuffer(costs, np.int64))


def _ranges(members: str) -> str:
    """Sorted characters as the inside of a character class."""
    codes = np.array([*map(ord, members)])
    cuts = np.flatnonzero(np.diff(codes) > 1)
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(codes[[0, *(cuts + 1)]].tolist(), codes[[*cuts, len(codes) - 1]].tolist(), strict=True))


@functools.lru_cache(maxsize=2)
def finder(pattern: str):
    """text -> pre-tokens. Where letters, digits and white space are the only classes, the standard module finds the same faster, by a table of each
    class's members: those below 128 for ASCII text, those below 65536 for text without characters beyond."""
    every = regex.compile(pattern).findall
    if re.search(r"\\(?![sS]|p\{[LN]\})|\[(?!\^\\s\\p\{L\}\\p\{N\}\])|\(\?(?!!)", pattern):
        return every

    def below(end: int):
        known = "".join(map(chr, (c for c in range(end) if not 0xD800 <= c < 0xE000)))
        space, letter, digit = (_ranges("".join(regex.findall(x, known))) for x in (r"\s", r"\p{L}", r"\p{N}"))
        plain = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{digit}]").replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{digit}]")
        return re.compile(plain.replace(r"\s", f"[{space}]").replace(r"\S", f"[^{space}]")).findall

    narrow, wide, beyond = below(128), below(65536), re.compile("[\U00010000-\U0010ffff]").search
    return lambda text: (narrow if text.isascii() else every if beyond(text) else wide)(text)


def piece_counts(docs: DataFrame, content: Broadcast, pattern: str) -> DataFrame:
    """(piece, n): how often each piece stands in the guessed splits of all rows. Pre-tokens are counted first, so that each distinct one is split
    once, in sorted order, which shares most prefixes."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, seen = finder(pattern), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(find(text or ""))
                if len(seen) >= MAX_WORDS:
                    yield pa.record_batch([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
                    seen.clear()
        yield pa.record_batch([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = _splitter(content.value, None)
        splitter.nodes = MAX_NODES
        total = np.zeros(len(splitter.costs), np.int64)
        for some in grouped(batches, 0, MAX_NODES):
            total += splitter.counted(pa.chunked_array([b.column(0) for b in some]), np.concatenate([b.column(1).to_numpy() for b in some]))
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["piece", "n"])

    distinct = docs.select("text").mapInArrow(words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).sortWithinPartitions("word")
    return distinct.mapInArrow(pieces, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def grouped(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[list[pa.RecordBatch]]:
    """Runs of batches whose column has `size` bytes or just more."""
    some, held = [], 0
    for batch in batches:
        some.append(batch)
        held += batch.column(column).nbytes
        if held >= size:
            yield some
            some, held = [], 0
    if some:
        yield some


def counts(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_pretokens, n_tokens and score (natural-log probability of the split) of every text."""
    spark = docs.sparkSession
    small_batches(spark)
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or str(public_tokenizers.path("byte_bpe_50k.tiktoken")), pattern or public_tokenizers.PATTERN
    with open(path, "rb") as f:
        raw = f.read()
    content = spark.sparkContext.broadcast(raw)
    number = np.zeros(len(_vocabulary(raw)[0]), np.int64)
    for r in piece_counts(docs, content, pattern).collect():  # at most one row a piece
        number[r["piece"]] = r["n"]
    costs = spark.sparkContext.broadcast(np.array(estimated(number), np.int64).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, find = _splitter(content.value, costs.value), finder(pattern)
        splitter.long, splitter.nodes = LONG, MAX_NODES
        for some in grouped(batches, 1, BATCH_BYTES):
            pre, found, places, held = [], [], [], 0
            for text in (t for b in some for t in b.column(1).to_pylist()):
                words = find(text or "")
                pre.append(len(words))
                places.append(splitter.places(words))
                held += len(words)
                if held >= BATCH_BYTES:
                    found.append(splitter.sums(places))
                    places, held = [], 0
            found.append(splitter.sums(places))
            tokens, cost = map(np.concatenate, zip(*found, strict=True))
            ids = pa.chunked_array([b.column(0) for b in some], pa.int64()).combine_chunks()
            yield pa.record_batch([ids, pa.array(pre, pa.int64()), pa.array(tokens, pa.int64()), pa.array(-cost / 1e6, pa.float64())], names=["doc_id", "n_pretokens", "n_tokens", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long, score double")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(table(spark, sf_dir, "documents"))
