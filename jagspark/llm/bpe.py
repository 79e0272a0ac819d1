"""BPE encoding and decoding of whole texts.

A word becomes a doubly linked list of symbols; a heap holds the ranks of the merges that its neighbours allow; popped entries that
no longer fit the list (stale ones) are skipped. Decoding joins the vocabulary strings of the ids. The vocabulary is a tokenizers
JSON file with a BPE model (parameter `path`); nothing is trained.

Defined results: a null or empty text has no tokens and decodes to the empty text, an empty table gives an empty result; of merges with equal
rank (the same pair at several places) the leftmost is first; a very long text is one list of its ids, a very long pre-token costs n log n; symbols outside the vocabulary are left out, as
the library does without an unknown token; the added special tokens are found in the raw text; repeated rows give repeated
results; other columns pass through `encoded`.

At scale: a map over the rows with no shuffle; the vocabulary file (a few MB, read by the driver) is broadcast; each Python worker keeps
the encodings of short words in a cache of at most CACHE_WORDS entries and starts it anew when full, so memory is bounded.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

CACHE_WORDS = 250_000
CACHE_LENGTH = 64
#: Unicode white space, as the tokenizer's \s takes it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


@functools.cache
def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 bytes stand for themselves, the rest follow from 256 on."""
    plain = {b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


#: The letters and digits that Unicode 16, the version of the tokenizer's \p{L} and \p{N}, has and Unicode 15.1 has not.
ADDED = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x116D0, 0x116E3), (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16130, 0x16139), (0x16D40, 0x16D6C),
    (0x16D70, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5FA),
]
#: Fixed values: (first and last capital, distance to the small letter) of the pairs that the tokenizer lower-cases and Unicode 15.1 has not.
CAPITALS = [
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1),
    (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
]
#: Marks whose combining class is younger than the tokenizer's NFC (Unicode 9), to which they are letters like any other, and the
#: second half of the one younger composition.
MARKS = [
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715),
    (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50),
    (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x1193D, 0x1193E), (0x11943, 0x11943),
    (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97),
    (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
]
_LOWER = {c: c + by for a, b, by in CAPITALS for c in range(a, b + 1)}
_HAS_CAPITAL = re.compile("[" + "".join(map(chr, _LOWER)) + "]").search
_AT_MARKS = re.compile("([" + "".join(chr(c) for a, b in MARKS for c in range(a, b + 1)) + "]+)")


@functools.cache
def newer_letters() -> frozenset[str]:
    """Code points that the regex module's Unicode version calls letters or digits and the tokenizer's older one leaves unassigned."""
    known = {c for a, b in ADDED for c in range(a, b + 1)}
    none = "".join(chr(c) for c in range(0x110000) if c not in known and unicodedata.category(chr(c)) == "Cn")
    return frozenset(regex.findall(r"[\p{L}\p{N}]", none))


class _Newer(Exception):
    """A pre-token holds such a code point: the text has to be split anew."""


class _Encodings(dict):
    """Word -> ids, encoded when first asked for."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, word: str) -> tuple[int, ...]:
        if not newer_letters().isdisjoint(word):
            raise _Newer
        ids = tuple(self.codec.encode_word(word))
        if len(word) <= CACHE_LENGTH:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids


class Codec:
    """Encoder and decoder of one vocabulary file (its content as bytes)."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("byte_fallback"):
            raise ValueError("a BPE vocabulary without unknown token, word prefix and byte fallback is needed")
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or spec.get("decoder") is not None or spec.get("post_processor") is not None:
            raise ValueError("this normaliser or decoder is not supported")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        #: left id << 32 | right id -> rank, and rank -> new id
        self.merges = {self.vocab[a] << 32 | self.vocab[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.made = [self.vocab[a + b] for a, b in pairs]
        self.strings = {i: s for s, i in self.vocab.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.numbers = {i: str(i) for i in self.strings}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(split.replace("[^\\s", f"[^{SPACE}"))
        self.symbols = byte_symbols()
        self.encodings = _Encodings(self)

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-token, given as text."""
        chars = [self.symbols[b] for b in word.encode()]
        chars[-1] += self.suffix
        ids = [i for i in map(self.vocab.get, chars) if i is not None]
        rank_of, made, n = self.merges.get, self.made, len(ids)
        # a heap entry is rank << 32 | place: the lowest rank first, of equal ones the leftmost
        heap = [rank << 32 | at for at in range(n - 1) if (rank := rank_of(ids[at] << 32 | ids[at + 1])) is not None]
        heapq.heapify(heap)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while heap:
            entry = heapq.heappop(heap)
            at, rank = entry & 0xFFFFFFFF, entry >> 32
            right = after[at]
            if ids[at] < 0 or right >= n or rank_of(ids[at] << 32 | ids[right]) != rank:
                continue  # stale: one of the two has been merged since
            ids[at] = new = made[rank]
            ids[right] = -1
            after[at] = following = after[right]
            if following < n:
                before[following] = at
                if (rank := rank_of(new << 32 | ids[following])) is not None:
                    heapq.heappush(heap, rank << 32 | at)
            if (left := before[at]) >= 0 and (rank := rank_of(ids[left] << 32 | new)) is not None:
                heapq.heappush(heap, rank << 32 | left)
        return [i for i in ids if i >= 0]

    def normal(self, text: str) -> str:
        """The text as the vocabulary's normaliser leaves it, white space aside."""
        if not text.isascii():
            if _AT_MARKS.search(text):
                parts = _AT_MARKS.split(text)
                parts[::2] = [unicodedata.normalize("NFC", x) for x in parts[::2]]
                text = "".join(parts)
            else:
                text = unicodedata.normalize("NFC", text)
            if _HAS_CAPITAL(text):
                text = text.translate(_LOWER)
        # letter by letter: a capital sigma becomes the same small letter everywhere
        return text.lower() if "Σ" not in text else "".join(map(str.lower, text))

    def words(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens."""
        return self.split.findall(self.normal(text))

    def _plain(self, text: str) -> list[int]:
        """Ids of a text without special tokens."""
        try:
            return list(chain.from_iterable(map(self.encodings.__getitem__, self.words(text))))
        except _Newer:  # rare: such letters stand in as private-use marks while the text is split
            text = self.normal(text)
            odd = sorted(newer_letters().intersection(text))
            spare = (c for c in range(0xF0000, 0x110000) if c & 0xFFFE != 0xFFFE and chr(c) not in text)
            marks = dict(zip(map(ord, odd), spare, strict=False))
            back = {mark: c for c, mark in marks.items()}
            return [i for w in self.split.findall(text.translate(marks)) for i in self.encode_word(w.translate(back))]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.split_special is None or "<|" not in text and not self.split_special.search(text):
            return self._plain(text)
        ids: list[int] = []
        for piece in self.split_special.split(text):
            ids += [self.special[piece]] if piece in self.special else self._plain(piece)
        return ids

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings, joined by a space, as the library does where a file names no decoder."""
        return " ".join(map(self.strings.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def codec_of(content: bytes) -> Codec:
    return Codec(content)


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def _broadcast(spark: SparkSession, path: str | None):
    with open(path or default_path(), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encoded(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """docs with a column of token ids and, if named, one of the decoded text. A column of such a name is replaced."""
    small_batches(docs.sparkSession)
    content = _broadcast(docs.sparkSession, path)
    docs = docs.drop(ids, *[decoded] * bool(decoded))
    position = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(content.value)
        for batch in batches:
            found = [codec.encode(t) for t in batch.column(position).to_pylist()]
            columns = [*batch.columns, pa.array(found, pa.list_(pa.int32()))]
            if decoded:
                columns.append(pa.array([codec.decode(x) for x in found], pa.string()))
            yield pa.record_batch(columns, names=[*batch.schema.names, ids, *[decoded] * bool(decoded)])

    schema = docs.limit(0).withColumn(ids, F.lit(None).cast("array<int>"))
    return docs.mapInArrow(run, (schema.withColumn(decoded, F.lit(None).cast("string")) if decoded else schema).schema)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text; the id lists themselves stay in the workers."""
    small_batches(docs.sparkSession)
    content = _broadcast(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(content.value)
        for batch in batches:
            counts, ids_sha, decoded_sha = [], [], []
            for text in batch.column(1).to_pylist():
                ids = codec.encode(text)
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(codec.numbers.__getitem__, ids)).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
