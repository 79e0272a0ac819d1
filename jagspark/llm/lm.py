"""LM scoring with an Elias-Fano n-gram trie.

Tokens are a text's words, A-Z lower-cased, then one end; the end is also the first word's context. The model is a bigram with Dirichlet
smoothing over add-one unigrams: P(v) = (c(v) + 1) / (N + V + 1) and P(v | u) = (c(uv) + K P(v)) / (c(u) + K); both sum to one over the
vocabulary and the unknown word. All counts cover every training row.

Level 1 holds the words, numbered in the order of 128-bit keys (BLAKE2b), with their cumulative counts; level 2 holds, for each word as
context, its successors: a monotone pointer per context into one non-decreasing sequence of successors, and 16-bit codes of the
smoothed probabilities (steps of 0.0002). Keys' first halves, pointers, successors and cumulative counts are Elias-Fano sequences in files
that workers memory-map; a successor is looked up by a search within its context's range,
among the few that share its high bits.

Defined results: a null or empty text is the end alone; a null doc_id is not held out; without any training row N = V = 0 and every token has
probability 1; repeated rows count and are scored each; a very long text, or word, is read whole; an empty table gives an empty result; other
columns are ignored.

At scale: two counting passes send each owner sorted distinct keys with counts, packed, combined per chunk before the shuffle. The number of
owners follows from the bytes of text (OWNER_BYTES each); an owner holds a range of words (or of contexts, and for owners with frequent
contexts a range of successors too, so that a word with a third of all tokens is split) and merges messages as they stream in. The files grow
with the corpus (about 13 bytes a word and 5 bytes a distinct bigram) and lie in the shared folder; workers map them and keep none in
memory. Scoring is a map without a shuffle.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, small_batches, table
from .elias_fano import EliasFano, load, save

#: Weight of the unigram distribution in a context, in tokens.
PRIOR = 64.0
CHUNK_TOKENS = 2_000_000
CHUNK_WORDS = 500_000
#: Codes 0 to CODES stand for log10 probabilities from 0 down to LEAST.
LEAST, CODES = -12.0, (1 << 16) - 1


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


class _Index(dict):
    """Word -> place, in the order of first sight; the end is the empty word, which no text holds."""

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self)
        return place


class Chunk:
    """Rows together: `at`, the place of every token's word among the distinct words; `sizes`, tokens per row; `kept`, a column of the rows.
    Words are told apart by their bytes here and by 128 bits of BLAKE2b elsewhere."""

    def __init__(self):
        self.index, self._at, self._sizes, self._kept, self.count = _Index({b"": 0}), [], [], [], 0

    def add(self, column: pa.Array, kept: pa.Array | None) -> None:
        of = self.index.__getitem__
        for text in column.cast(pa.binary()).to_pylist():
            words = text.lower().split() if text else []  # of bytes: A-Z and [\\x20\\x09-\\x0D] only
            words.append(b"")
            self._at.append(np.fromiter(map(of, words), np.int64, len(words)))
            self._sizes.append(len(words))
        self._kept.append(kept)
        self.count = sum(self._sizes)

    def full(self) -> bool:
        return self.count >= CHUNK_TOKENS or len(self.index) >= CHUNK_WORDS

    def done(self) -> Chunk:
        """The same with words in the order of their keys (`high`, `low`)."""
        keys = b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in self.index)
        high, low = np.frombuffer(keys, ">u8").astype(np.uint64).reshape(-1, 2).T
        order = np.lexsort((low, high))
        self.high, self.low = high[order], low[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.at, self.sizes, self.end = place[np.concatenate(self._at)], np.array(self._sizes, np.int64), place[0]
        self.kept = pa.concat_arrays(self._kept) if self._kept[0] is not None else None
        return self


def chunks(batches: Iterator[pa.RecordBatch], text: int, keep: int | None = None) -> Iterator[Chunk]:
    """Many batches together, until they hold CHUNK_TOKENS tokens or CHUNK_WORDS distinct words."""
    held = Chunk()
    for batch in batches:
        for i in range(0, len(batch), 100):  # a few texts at a time, so that a chunk ends soon after it is full
            part = batch.slice(i, 100)
            held.add(part.column(text), part.column(keep) if keep is not None else None)
            if held.full():
                yield held.done()
                held = Chunk()
    if held.count:
        yield held.done()


# ---------------------------------------------------------------- messages of sorted keys and counts


def pack(*columns: np.ndarray) -> bytes:
    """Whole-number columns of one length, the first sorted: bytes of equal weight together, compressed."""
    raw = []
    for i, x in enumerate(columns):
        x = x.astype(np.uint64)
        raw.append((np.diff(x, prepend=np.uint64(0)) if not i else x).view(np.uint8).reshape(-1, 8).T.tobytes())
    return len(columns[0]).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join(raw))


def unpack(message: bytes) -> list[np.ndarray]:
    n = int.from_bytes(message[:8], "little")
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(message[8:]), np.uint8).reshape(-1, 8, n)
    out = [np.ascontiguousarray(x.T).view(np.uint64).ravel() for x in raw]
    return [np.cumsum(out[0], dtype=np.uint64), *out[1:]]


def summed(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Rows in the order of all columns but the last, equal ones once, the last column summed."""
    order = np.lexsort(columns[-2::-1])
    columns = [x[order] for x in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in columns[:-1]], axis=0)
    first = np.flatnonzero(new)
    return [*(x[first] for x in columns[:-1]), np.add.reduceat(columns[-1], first)]


#: Rows of a message, and rows that an owner gathers before it merges them.
MESSAGE_ROWS = 8192
MERGE_ROWS = 1_000_000


def _messages(owner: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Messages to owners; columns are sorted, and stay so within an owner."""
    order = np.argsort(owner, kind="stable")
    owner, columns = owner[order], [x[order] for x in columns]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1, [len(owner)]])
    for a, b in zip(cuts, cuts[1:], strict=False):
        pieces = [pack(*(x[i : min(b, i + MESSAGE_ROWS)] for x in columns)) for i in range(a, b, MESSAGE_ROWS)]
        if pieces:
            yield pa.record_batch([pa.array([int(owner[a])] * len(pieces), pa.int64()), pa.array(pieces, pa.binary())], names=["owner", "keys"])


def _owned(sent: DataFrame, partitions: int, put: Callable[[int, list[np.ndarray]], list[int]], schema: str) -> DataFrame:
    """What `put` returns for each owner's merged columns. Messages are merged as they stream in, so that a task holds one owner's distinct
    keys, however many chunks sent them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, rows, out = None, [], 0, []

        def merge():
            nonlocal held, rows
            held = [summed([np.concatenate(x) for x in zip(*held, strict=True)])]
            rows = 0

        for batch in batches:
            for owner, message in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if owner != at:
                    if held:
                        merge()
                        out.append(put(at, held[0]))
                    at, held, rows = owner, [], 0
                held.append(unpack(message.as_py()))
                rows += len(held[-1][0])
                if rows >= max(MERGE_ROWS, len(held[0][0])):
                    merge()
        if held:
            merge()
            out.append(put(at, held[0]))
        if out:
            names = [x.split()[0] for x in schema.split(", ")]
            yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=names)

    return sent.repartition(partitions, "owner").sortWithinPartitions("owner").mapInArrow(run, schema)


def owner_of(hashes: np.ndarray, owners: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)


# ---------------------------------------------------------------- the trie


class Trie:
    """The files of a model, mapped. `head` is small: owners, words per owner, subs per owner, N."""

    def __init__(self, path: str, head: dict):
        self.path = path
        self.words, self.subs, self.n = np.array(head["words"], np.int64), np.array(head["subs"], np.int64), head["n"]
        self.first = np.concatenate([[0], np.cumsum(self.words)])  # the first number of an owner
        self.v = int(self.first[-1])
        self.total = self.n + self.v + 1
        self._levels: dict = {}

    def _file(self, name: str):
        if name not in self._levels:
            self._levels[name] = load(f"{self.path}/{name}")
        return self._levels[name]

    def numbers(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number or -1, count) of sorted distinct words by their keys: level 1."""
        owner = owner_of(high, len(self.words))
        number, count = np.full(len(high), -1, np.int64), np.zeros(len(high), np.int64)
        cuts = np.searchsorted(owner, np.arange(len(self.words) + 1))
        for o in range(len(self.words)):
            own = np.arange(cuts[o], cuts[o + 1])
            if not len(own) or not self.words[o]:
                continue
            level = self._file(f"words-{o}")
            highs, sums = EliasFano.of(level, "high"), EliasFano.of(level, "sums")
            at = highs.search(np.zeros(len(own), np.int64), np.full(len(own), self.words[o]), high[own])
            while len(own):  # keys that share their first 64 bits are neighbours
                inside = at < self.words[o]
                own, at = own[inside], at[inside]
                same = highs.access(at) == high[own]
                own, at = own[same], at[same]
                hit = level["low"][at] == low[own]
                number[own[hit]] = at[hit] + self.first[o]
                count[own[hit]] = (sums.access(at[hit] + 1) - sums.access(at[hit])).astype(np.int64)
                own, at = own[~hit], at[~hit] + 1
        return number, count

    def shard(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(owner of the context, sub by the word) of a bigram of numbers."""
        owner = np.searchsorted(self.first, context, "right") - 1
        return owner, word * self.subs[owner] // max(1, self.v)

    def span(self, owner: int, sub: int) -> tuple[int, int]:
        """The first number of a sub's words, and how many there are."""
        subs = int(self.subs[owner])
        a, b = -(-sub * self.v // subs), -(-(sub + 1) * self.v // subs)
        return a, b - a

    def codes(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The codes of sorted distinct bigrams of numbers, -1 where the trie has none: a search relative to the context's range."""
        code = np.full(len(context), -1, np.int64)
        owner, sub = self.shard(context, word)
        both = owner * (int(self.subs.max(initial=1)) + 1) + sub
        order = np.argsort(both, kind="stable")
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(both[order])) + 1, [len(order)]])
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = order[a:b]
            if not len(own):
                continue
            o, s = int(owner[own[0]]), int(sub[own[0]])
            level = self._file(f"pairs-{o}-{s}")
            first, size = self.span(o, s)
            pointers, successors = EliasFano.of(level, "pointers"), EliasFano.of(level, "successors")
            local = context[own] - self.first[o]
            new = np.ones(len(local), bool)
            new[1:] = local[1:] != local[:-1]
            each, at = local[new], np.cumsum(new) - 1  # neighbours share their context
            low, high = pointers.access(each).astype(np.int64)[at], pointers.access(each + 1).astype(np.int64)[at]
            wanted = (local * size + word[own] - first).astype(np.uint64)
            end, low = high, successors.search(low, high, wanted)
            inside = np.flatnonzero(low < end)
            hit = inside[successors.access(low[inside]) == wanted[inside]] if len(inside) else inside
            code[own[hit]] = level["codes"][low[hit]]
        return code


@functools.lru_cache(maxsize=1)
def _trie(path: str, words: tuple, subs: tuple, n: int) -> Trie:
    return Trie(path, {"words": words, "subs": subs, "n": n})


def trie_of(path: str, head: dict) -> Trie:
    return _trie(path, tuple(head["words"]), tuple(head["subs"]), head["n"])


#: Bytes of text for an owner: bounds what a task gathers, whatever the table's size.
OWNER_BYTES = 32 << 20
#: Partitions for an owner: a hash deals owners to partitions, and more of these let fewer owners share one.
SPREAD = 4


def train(docs: DataFrame) -> tuple[str, dict]:
    """The folder and head of a model of all rows of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    path = new_path(spark, "lm-trie")
    texts = docs.select("text")
    owners = max(4, -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // OWNER_BYTES))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches, 0):
            yield from _messages(owner_of(c.high, owners), c.high, c.low, np.bincount(c.at, minlength=len(c.high)))

    def put_words(owner: int, columns: list[np.ndarray]) -> list[int]:
        high, low, counts = columns
        save(f"{path}/words-{owner}", {"low": low} | EliasFano.build(high).arrays("high") | EliasFano.build(np.concatenate([[0], np.cumsum(counts.astype(np.int64))])).arrays("sums"))
        return [owner, len(high), int(counts.sum())]

    sent = texts.mapInArrow(count_words, "owner long, keys binary")
    # one small row an owner
    rows = _owned(sent, SPREAD * owners, put_words, "owner long, n long, total long").collect()
    sizes, totals = [0] * owners, [0] * owners
    for r in rows:
        sizes[r["owner"]], totals[r["owner"]] = r["n"], r["total"]
    n = sum(totals)
    if sum(sizes) >= 1 << 32:
        raise OverflowError("a bigram's key holds two word numbers of 32 bits")
    head = {"words": sizes, "subs": [max(1, -(-t * owners // max(1, 2 * n))) for t in totals], "n": n}
    most = max(head["subs"]) + 1

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = trie_of(path, head)
        for c in chunks(batches, 0):
            number, _ = trie.numbers(c.high, c.low)
            word = number[c.at]
            context = np.concatenate([[number[c.end]], word[:-1]])
            keys, counts = np.unique(context.astype(np.uint64) << np.uint64(32) | word.astype(np.uint64), return_counts=True)
            owner, sub = trie.shard((keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64))
            yield from _messages(owner * most + sub, keys, counts)

    def put_pairs(shard: int, columns: list[np.ndarray]) -> list[int]:
        owner, sub = divmod(shard, most)
        trie = trie_of(path, head)
        keys, counts = columns
        local = (keys >> np.uint64(32)).astype(np.int64) - trie.first[owner]
        word = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        sums = EliasFano.of(trie._file(f"words-{owner}"), "sums")
        of_context = (sums.access(local + 1) - sums.access(local)).astype(np.int64)
        p = (counts.astype(np.int64) + PRIOR * (counts_of(trie, word) + 1) / trie.total) / (of_context + PRIOR)
        first, size = trie.span(owner, sub)
        pointers = np.concatenate([[0], np.cumsum(np.bincount(local, minlength=int(trie.words[owner])))])
        codes = np.clip(np.rint(np.log10(p) * (CODES / LEAST)), 0, CODES).astype(np.uint16)
        save(f"{path}/pairs-{owner}-{sub}", {"codes": codes} | EliasFano.build(pointers).arrays("pointers") | EliasFano.build(local * size + word - first).arrays("successors"))
        return [owner, sub]

    sent = texts.mapInArrow(count_pairs, "owner long, keys binary")
    found = {(r["owner"], r["sub"]) for r in _owned(sent, SPREAD * sum(head["subs"]), put_pairs, "owner long, sub long").collect()}
    for owner in range(owners):  # a shard without bigrams is an empty file
        for sub in range(head["subs"][owner]):
            if head["words"][owner] and (owner, sub) not in found:
                save(f"{path}/pairs-{owner}-{sub}", {"codes": np.zeros(0, np.uint16)} | EliasFano.build(np.zeros(head["words"][owner] + 1)).arrays("pointers") | EliasFano.build(np.zeros(0)).arrays("successors"))
    return path, head


def counts_of(trie: Trie, number: np.ndarray) -> np.ndarray:
    """Counts of words by number."""
    distinct, at = np.unique(number, return_inverse=True)
    owner = np.searchsorted(trie.first, distinct, "right") - 1
    out = np.zeros(len(distinct), np.int64)
    cuts = np.searchsorted(owner, np.arange(len(trie.words) + 1))
    for o in np.unique(owner):
        own = slice(cuts[o], cuts[o + 1])
        sums, local = EliasFano.of(trie._file(f"words-{o}"), "sums"), distinct[own] - trie.first[o]
        out[own] = (sums.access(local + 1) - sums.access(local)).astype(np.int64)
    return out[at]


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums per row; every row has a token at least."""
    return np.add.reduceat(values, np.concatenate([[0], np.cumsum(sizes)[:-1]])) if len(sizes) else np.zeros(0, values.dtype)


def scored(docs: DataFrame, model: tuple[str, dict]) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row."""
    small_batches(docs.sparkSession)
    path, head = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = trie_of(path, head)
        for c in chunks(batches, 1, 0):
            number, count = trie.numbers(c.high, c.low)
            at, sizes, ids = c.at, c.sizes, c.kept
            base = np.log10((count + 1) / trie.total)
            word, known = number[at], count[at]
            context = np.concatenate([[number[c.end]], word[:-1]])
            of_context = np.concatenate([[count[c.end]], known[:-1]])
            score = base[at] + np.log10(PRIOR / (of_context + PRIOR))
            both = np.flatnonzero((word >= 0) & (context >= 0))
            if len(both):
                keys, back = np.unique(context[both].astype(np.uint64) << np.uint64(32) | word[both].astype(np.uint64), return_inverse=True)
                code = trie.codes((keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64))[back]
                hit = code >= 0
                score[both[hit]] = code[hit] * (LEAST / CODES)
            yield pa.record_batch(
                [ids, pa.array(sizes, pa.int64()), pa.array(_sums((known > 0).astype(np.int64), sizes)), pa.array(np.full(len(sizes), trie.n)), pa.array(_sums(base[at], sizes)), pa.array(_sums(score, sizes))],
                names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, train(docs.where(~held_out(F.col("doc_id")))))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
