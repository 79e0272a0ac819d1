"""SimHash near-dedup with pivot distance tables.

A text's fingerprint has 64 bits; a bit is 1 if set in over half the XXH64 hashes (seed 42) of its word shingles. Fingerprints link at
MOST or fewer differing bits, and components follow.

Links: distinct fingerprints, one row each, are dealt to cells that hold every linking pair: of MOST + AGREE bit blocks, a pair with at
most MOST differences agrees in AGREE blocks at least, so each choice of AGREE blocks makes a cell of the fingerprints that agree in
them. More agreement makes more and smaller cells, never other links. In a cell, a table of the Hamming distances to PIVOTS reference
fingerprints discards every pair with a coordinate that differs by more than MOST (the triangle inequality); the survivors are verified bit by bit. The first pivot orders the cell, so that only its window is
ever paired. A cell emits a star for each of its components, not its pairs. (Pivot distances alone leave no route that
avoids comparing all pairs of a table that does not fit one task; the cells are that route, and lose no pair.)

Near copies (near_copies): texts whose sets of five-word shingles have a similarity (Jaccard) of 0.8 or more, counted on the whole texts. One
64-bit fingerprint within 3 bits finds few such pairs, so FINGERPRINTS of them, over the distinct words and with hashes of their own, propose
links, each by the same cells; every proposed link between texts that are not joined yet is then measured.

Defined results: a null or empty text, and one of white space, has fingerprint zero and links like any other; with fewer words than
a shingle the whole sequence is the one shingle; repeated rows and equal texts share a fingerprint; a null doc_id is ignored in
component_id unless its whole component has none; very long texts are read whole, in chunks; an empty table gives an empty result; other
columns are ignored by `components_of` and `near_copies`, kept by `deduplicate` and `keep_one_of_each`, whatever their names. Of a component
the row of the smallest doc_id stays, of rows that share this id and differ in text that of the least SHA-256, of rows that share both that
whose columns come first as JSON: the same on every run.

At scale: texts are read once and never shuffled for op1; copies of any number are one row before the cells are made; cells above CELL_ROWS
split further by blocks of their free bits (exactly, by the same argument); components come from pointers to least neighbours, followed by
doubling, each round stored, with minima combined before the shuffle. near_copies shuffles the texts that have a link. A family of linked texts of any size is first
checked in blocks of BLOCK_ROWS, each row once; a few rows of every class so found then meet across blocks; what is left, pairs of blocks that do
not belong to one class, is checked whole, so that a large group of copies costs rows in proportion to its size and no link is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, one_of_each, small_batches, stored, table, text_key

WIDTH = 3
MOST = 3
AGREE = 3
SEED = 42
PIVOTS = 32
CELL_ROWS = 20_000
#: Rows that a worker gathers before it looks at their cells.
CHUNK_ROWS = 200_000

_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """The fingerprint of a text in UTF-8. bytes.lower and bytes.split know just A-Z and [\\x20\\x09-\\x0D]."""
    words = text.lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = [digest(joined, SEED)]
    else:
        ends = list(accumulate(map((1).__add__, map(len, words))))
        starts = [0, *ends]
        hashes = [digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :], strict=False)]
    n, counts = len(hashes), np.zeros(64, np.int64)
    found = np.array(hashes, np.uint64).astype("<u8").view(np.uint8).reshape(n, 8)
    for at in range(0, n, 1 << 16):
        counts += np.unpackbits(found[at : at + (1 << 16)], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(_BITS[counts * 2 > n].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, sha (SHA-256 of the text) and print (the fingerprint as a signed long) of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            prints = np.array([fingerprint(t, width) for t in raw], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array([hashlib.sha256(t).hexdigest() for t in raw], pa.string()), pa.array(prints)], names=["doc_id", "sha", "print"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, sha string, print long")


# ---------------------------------------------------------------- links


def pivots(count: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: rows of a Hadamard matrix, as far from each other as 64 bits allow, moved by one random word."""
    bit = np.arange(64)
    rows = np.array([int(_BITS[(np.bitwise_count(bit & i) & 1).astype(bool)].sum(dtype=np.uint64)) for i in range(1, count + 1)], np.uint64)
    return rows ^ np.uint64(0x8F1BBCDC_CA62C1D6)


def masks(most: int = MOST, agree: int = AGREE) -> list[int]:
    """The bit masks of the cells: every choice of `agree` of most + agree blocks."""
    n = most + agree
    cuts = [round(64 * i / n) for i in range(n + 1)]
    block = [((1 << b) - 1) & ~((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(block[i] for i in c) for c in combinations(range(n), agree)]


def cell_pairs(cell: np.ndarray, prints: np.ndarray, most: int, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of equal cell that link. Tables of distances discard, bits decide."""
    distance = np.bitwise_count(prints[:, None] ^ references[None, :]).astype(np.int8)
    order = np.lexsort((distance[:, 0], cell))
    cell, first = cell[order], distance[order, 0]
    found, at, step = [], np.arange(len(order) - 1), 1
    while len(at):
        near = (cell[at] == cell[at + step]) & (first[at + step] - first[at] <= most)
        at = at[near]  # sorted: a row whose window has ended stays out
        left, right = order[at], order[at + step]
        for column in range(1, distance.shape[1], 8):
            part = slice(column, column + 8)
            stay = (np.abs(distance[left, part] - distance[right, part]) <= most).all(1)
            left, right = left[stay], right[stay]
        stay = np.bitwise_count(prints[left] ^ prints[right]) <= most
        found.append((left[stay], right[stay]))
        step += 1
        at = at[at + step < len(order)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _labels(n: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are not their component's least row, each row's least row)."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, least)
        np.minimum.at(new, right, least)
        new = new[new]
        if (new == label).all():
            return np.flatnonzero(label != np.arange(n)), label
        label = new


def stars(prints: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, its component's least row's fingerprint) of the linked rows: a tree's worth of links for any number of pairs."""
    at, label = _labels(len(prints), left, right)
    return prints[at], prints[label[at]]


def _split(prints: np.ndarray, nodes: np.ndarray, free: int, most: int, references: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of one large cell: it splits by most + 1 blocks of its free bits, one of which a linking pair shares."""
    bits = [b for b in range(64) if free >> b & 1]
    if len(prints) <= CELL_ROWS or len(bits) <= most:
        return [stars(nodes, *cell_pairs(np.zeros(len(prints), np.int8), prints, most, references))]
    out = []
    for i in range(most + 1):
        block = sum(1 << b for b in bits[i :: most + 1])
        key = prints & np.uint64(block)
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        for part in np.split(order, cuts):
            if len(part) > 1:
                out += _split(prints[part], nodes[part], free & ~block, most, references)
    return out


def links(prints: DataFrame, most: int = MOST, agree: int = AGREE) -> DataFrame:
    """(a, b): pairs of nodes that make the same components as all linking pairs. `prints` holds (turn, print, node), a turn's prints distinct;
    prints of different turns are never compared."""
    every = masks(most, agree)
    signed = [m - (1 << 64) if m >> 63 else m for m in every]
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("print").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(signed)]))
    dealt = prints.select("turn", "print", "node", cells.alias("cell"))
    dealt = dealt.select((F.col("turn") * len(every) + F.col("cell.mask")).cast("int").alias("choice"), "cell.bits", "print", "node")
    dealt = dealt.repartition("choice", "bits").sortWithinPartitions("choice", "bits")
    references = pivots()

    def look(choice: np.ndarray, bits: np.ndarray, prints: np.ndarray, nodes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        starts = np.concatenate([[True], (choice[1:] != choice[:-1]) | (bits[1:] != bits[:-1])])
        cell = np.cumsum(starts)
        size = np.bincount(cell)[cell]
        small = (size > 1) & (size <= CELL_ROWS)
        out = [stars(nodes[small], *cell_pairs(cell[small], prints[small], most, references))] if small.any() else []
        for c in np.unique(cell[size > CELL_ROWS]):
            rows = cell == c
            out += _split(prints[rows], nodes[rows], ~every[int(choice[rows][0]) % len(every)] & ((1 << 64) - 1), most, references)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def emit(found):
            for a, b in found:
                if len(a):
                    yield pa.record_batch([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

        def ready(columns):
            choice, bits, prints, nodes = columns
            return choice, bits, prints.view(np.uint64), nodes

        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            rows += len(batch)
            if rows >= CHUNK_ROWS:
                columns = [np.concatenate(x) for x in zip(*held, strict=True)]
                choice, bits = columns[:2]
                ends = np.flatnonzero((choice[1:] != choice[:-1]) | (bits[1:] != bits[:-1]))
                cut = int(ends[-1]) + 1 if len(ends) else 0  # the last cell may go on
                if cut:
                    yield from emit(look(*ready([c[:cut] for c in columns])))
                held, rows = [[c[cut:] for c in columns]], len(choice) - cut
        if rows:
            yield from emit(look(*ready([np.concatenate(x) for x in zip(*held, strict=True)])))

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _contracted(forest: DataFrame) -> DataFrame:
    """(a, b): each node a that points to a smaller one, and the node b at the end of its pointers. Each round doubles the length of a step, and
    is one join whose right side has one row a node, so that a node that many point to can be split among tasks."""
    at = stored(forest.select("a", "b"), "simhash-trees")
    while True:
        up = at.select(F.col("a").alias("b"), F.col("b").alias("up"))
        moved = at.select("a", "b").join(up, "b", "left").select("a", F.coalesce("up", "b").alias("b"), F.col("up").isNotNull().alias("moved"))
        at = stored(moved, "simhash-trees")
        if at.where("moved").isEmpty():
            return at.select("a", "b")


def _between(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The edges that join two components of labels, as edges of their least nodes."""
    to = lambda c: labels.select(F.col("a").alias(c), F.col("b").alias(f"{c}_root"))
    named = edges.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("a_root", "a").alias("x"), F.coalesce("b_root", "b").alias("y"))
    return stored(named.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "simhash-links")


def _relabelled(labels: DataFrame, roots: DataFrame) -> DataFrame:
    """labels after their least nodes, and nodes without a label, have been joined as `roots` says."""
    moved = labels.join(roots.select(F.col("a").alias("b"), F.col("b").alias("root")), "b", "left").select("a", F.coalesce("root", "b").alias("b"))
    return stored(moved.unionAll(roots.join(labels.select("a"), "a", "left_anti").select("a", "b")), "simhash-stars")


def stars_of(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(a, b): each linked node a and the least node b of its component, of the edges and what `labels` has joined before.

    Each round keeps one edge a node, that to its least neighbour if it is smaller, follows these pointers to their ends, and goes on with the
    edges between the trees so made: rows are as many as nodes, however many edges a dense component has. A component's least node never points
    anywhere, so it is where all its nodes end.
    """
    edges = stored(edges, "simhash-links") if labels is None else _between(edges, labels)
    while labels is None or not edges.isEmpty():
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        roots = _contracted(both.groupBy("a").agg(F.min("b").alias("b")).where("b < a"))
        labels = roots if labels is None else _relabelled(labels, roots)
        edges = _between(edges, roots)
    return labels


def _classes(docs: DataFrame, width: int, most: int, agree: int) -> tuple[DataFrame, DataFrame]:
    """The rows with their prints, and (print, root, component_id) of every print."""
    prints = stored(fingerprints(docs, width), "simhash-prints")
    classes = prints.groupBy("print").agg(F.min("doc_id").alias("least"))
    roots = stars_of(links(classes.select(F.lit(0).alias("turn"), "print", F.col("print").alias("node")), most, agree))
    named = classes.join(roots.withColumnRenamed("a", "print"), "print", "left").select("print", "least", F.coalesce("b", "print").alias("root"))
    named = stored(named, "simhash-classes")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints, named.join(ids, "root").select("print", "root", "component_id")


def components_of(docs: DataFrame, width: int = WIDTH, most: int = MOST, agree: int = AGREE) -> DataFrame:
    """doc_id, print, component_id of every row."""
    prints, classes = _classes(docs, width, most, agree)
    return prints.join(classes, "print").select("doc_id", "print", "component_id")


def deduplicate(docs: DataFrame, width: int = WIDTH, most: int = MOST, agree: int = AGREE) -> DataFrame:
    """One row of each component, with docs' columns."""
    prints, classes = _classes(docs, width, most, agree)
    return keep_one_of_each(docs, prints.join(classes, "print").select("doc_id", "sha", "root"))


def keep_one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row of each component of `found` (doc_id, sha of the text, root), with docs' columns."""
    found = stored(found.groupBy("doc_id", "sha", "root").agg(F.count("*").alias("n")), "simhash-found")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sha")).alias("first"))
    kept = first.select(text_key(F.col("first.doc_id"), F.col("first.sha")).alias("key"))
    named = found.withColumn("key", text_key(F.col("doc_id"), F.col("sha")))
    return one_of_each(docs, named.join(kept, "key", "left_anti").select("key"), named.where("n > 1").join(kept, "key", "left_semi").select("key"))


# ---------------------------------------------------------------- near copies, measured

#: Fingerprints of a text that propose its links. With 3 bits each, eight propose 98.6 % of the pairs of similarity 0.8 on the check's tables.
FINGERPRINTS = 8
#: A larger family is checked block by block.
BLOCK_ROWS = 1000
BLOCK_BYTES = 8 << 20
#: Rows of a class that meet those of other classes before whole blocks do.
CLASS_ROWS = 16

_OWN = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)


def word_fingerprints(text: bytes, count: int = FINGERPRINTS) -> np.ndarray:
    """`count` fingerprints of the set of the text's words, each over hashes of its own."""
    words = set(text.lower().split())
    if not words:
        return np.zeros(count, np.uint64)
    word = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    places, totals = np.arange(8 * count) * 256, np.zeros(2048 * count, np.int64)
    for at in range(0, len(word), 1 << 14):
        own = mix(word[at : at + (1 << 14), None] ^ _OWN[None, :count]).astype("<u8")
        totals += np.bincount((own.view(np.uint8) + places).ravel(), minlength=2048 * count)
    return np.packbits(totals.reshape(-1, 256) @ _BYTE_BITS * 2 > len(word), axis=1, bitorder="little").ravel().view("<u8")


def shingles(text: bytes, width: int = 5) -> np.ndarray:
    """A hash of each of the text's word shingles; a shorter text is one."""
    words, digest = text.lower().split(), xxhash.xxh64_intdigest
    if not words:
        return np.zeros(0, np.uint64)
    word = np.array([digest(w) for w in words], np.uint64)
    n = max(1, len(word) - width + 1)
    shingle = np.zeros(n, np.uint64)
    for i in range(min(width, len(word))):
        shingle = mix(shingle * np.uint64(0x9E3779B97F4A7C15) + word[i : i + n])
    return shingle


def _digest(text: bytes) -> bytes:
    """128 bits of the text's words: texts of equal words are one node."""
    return hashlib.blake2b(b" ".join(text.lower().split()), digest_size=16).digest()


class Measure:
    """Similarity (of the sets of word shingles, by 64-bit hashes) of one of the texts with others; two empty texts are alike."""

    def __init__(self, texts: list[bytes], width: int):
        sets = [np.unique(shingles(t, width)) for t in texts]
        self.size = np.array([len(x) for x in sets], np.int64)
        self.ends = np.cumsum(self.size)
        values, ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.ids, self.marked = ids, np.zeros(len(values), bool)

    def __call__(self, row: int, others: np.ndarray) -> np.ndarray:
        own = self.ids[self.ends[row] - self.size[row] : self.ends[row]]
        self.marked[own] = True
        both = np.array([np.count_nonzero(self.marked[self.ids[self.ends[x] - self.size[x] : self.ends[x]]]) for x in others.tolist()])
        self.marked[own] = False
        either = self.size[row] + self.size[others] - both
        return np.where(either > 0, both / np.maximum(1, either), 1.0)


def joined(prints: np.ndarray, texts: list[bytes], block: np.ndarray, label: np.ndarray, most: int, shingle: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs that make the same components as all pairs that link in one of the columns of prints and whose similarity is `least` or more:
    of two blocks, the pairs across them; of one, all. Rows that share a label, or are joined already, are not compared."""
    label, out = np.unique(label, return_inverse=True)[1], []
    measure, two = None, block.min() != block.max()
    for row in range(len(prints) - 1):
        other = label[row + 1 :] != label[row]
        if two:
            other &= block[row + 1 :] != block[row]
        after = np.flatnonzero(other) + row + 1
        near = after[(np.bitwise_count(prints[row] ^ prints[after]) <= most).any(1)]
        if len(near):
            measure = measure or Measure(texts, shingle)
            for at in near[measure(row, near) >= least]:
                if label[at] != label[row]:
                    out.append((row, at))
                    label[label == label[at]] = label[row]
    a, b = np.array(out, np.int64).reshape(-1, 2).T
    return a, b


def _met(dealt: DataFrame, most: int, shingle: int, least: float) -> DataFrame:
    """(a, b): joined nodes of rows (family, i, j, block, label, node, prints, text) that meet by family, i and j."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = {}, None

        def found() -> pa.RecordBatch:
            nodes, (block, label, prints, texts) = np.array(list(held), np.int64), zip(*held.values(), strict=True)
            own = np.array([x == block[0] for x in block])
            a, b = (nodes[x] for x in joined(np.array(prints, np.int64).view(np.uint64), texts, own, np.array(label), most, shingle, least))
            return pa.record_batch([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

        for batch in batches:
            for family, i, j, block, label, node, prints, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (family, i, j):
                    if len(held) > 1:
                        yield found()
                    held, at = {}, (family, i, j)
                held[node] = (block, label, prints, text)
        if len(held) > 1:
            yield found()

    rows = dealt.select("family", "i", "j", "block", "label", "node", "prints", "text").repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")
    return rows.mapInArrow(check, "a long, b long")


def _blocks(n: str = "n", size: str = "bytes"):
    return F.greatest(F.ceil(F.col(n) / BLOCK_ROWS), F.ceil(F.col(size) / BLOCK_BYTES)).cast("int")


def _same(members: DataFrame, most: int, shingle: int, least: float) -> DataFrame:
    """(a, b): stars of the classes of members (family, node, size, prints, text): every link inside a family is measured or lies in a class."""
    sizes = members.groupBy("family").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).select("family", _blocks().alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("string")
    alone = members.join(sizes, "family").select("*", block.alias("block"), F.col("node").alias("label"))
    first = stars_of(_met(alone.withColumns({"i": F.col("block"), "j": F.col("block")}), most, shingle, least))
    large = sizes.where("blocks > 1").select("family")
    if large.isEmpty():
        return first
    named = lambda stars: members.join(large, "family").join(stars.withColumnRenamed("a", "node"), "node", "left").withColumn("label", F.coalesce("b", "node")).drop("b")
    # a few rows of each class meet: large classes that their blocks kept apart become one
    some = named(first).groupBy("family", "label", F.pmod(F.xxhash64("node"), F.lit(CLASS_ROWS))).agg(F.min("node").alias("node")).select("node")
    some = named(first).join(some, "node", "left_semi")
    sizes = some.groupBy("family").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).select("family", _blocks().alias("blocks"))
    some = some.join(sizes, "family").withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("string"))
    second = stars_of(_met(some.withColumns({"i": F.col("block"), "j": F.col("block")}), most, shingle, least), first)
    # all others: blocks of one class do not meet, blocks of a class and mixed blocks of the small classes do
    rows = stored(named(second), "near-large")
    classes = rows.groupBy("family", "label").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).withColumn("pure", (F.col("n") >= BLOCK_ROWS) | (F.col("bytes") >= BLOCK_BYTES))
    classes = classes.withColumn("blocks", F.when(F.col("pure"), _blocks()))
    mixed = F.when(F.col("pure"), F.lit(0))
    plan = classes.groupBy("family").agg(
        F.sum(mixed.otherwise(F.col("n"))).alias("n"), F.sum(mixed.otherwise(F.col("bytes"))).alias("bytes"),
        F.collect_list(F.when(F.col("pure"), F.struct("label", "blocks"))).alias("pures"), F.count("*").alias("classes"),
    ).where("classes > 1").select("family", _blocks().alias("mixed"), "pures")
    names = lambda label, n: F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(label.cast("string"), F.lit(":"), i.cast("string")))
    mixes = F.when(F.col("mixed") > 0, names(F.lit("mixed"), F.col("mixed"))).otherwise(F.array().cast("array<string>"))
    others = F.flatten(F.transform(F.filter("pures", lambda x: x["label"] != F.col("label")), lambda x: names(x["label"], x["blocks"])))
    pure = F.element_at(F.filter("pures", lambda x: x["label"] == F.col("label")), 1)["blocks"]
    pure = F.when(F.exists("pures", lambda x: x["label"] == F.col("label")), pure)
    at = lambda n: F.pmod(F.xxhash64("node", F.lit(2)), n) + 1
    own = F.when(pure.isNull(), F.concat(F.lit("mixed:"), at(F.col("mixed")).cast("string"))).otherwise(F.concat(F.col("label").cast("string"), F.lit(":"), at(pure).cast("string")))
    dealt = rows.join(plan, "family").withColumn("block", own).withColumn("other", F.explode(F.concat(mixes, others)))
    dealt = dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    return stars_of(_met(dealt, most, shingle, least), second)


def near_copies(docs: DataFrame, most: int = MOST, agree: int = 2, shingle: int = 5, least: float = 0.8, count: int = FINGERPRINTS) -> DataFrame:
    """doc_id, sha (of the text), root, component_id of every row: texts linked by one of `count` fingerprints within `most` bits whose sets of
    `shingle`-word shingles have a similarity (Jaccard) of `least` or more, counted on the whole texts."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    names = [f"p{i}" for i in range(count)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            prints = np.array([word_fingerprints(t, count) for t in raw], np.uint64).reshape(-1, count).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array([hashlib.sha256(t).digest() for t in raw], pa.binary()), pa.array(map(_digest, raw), pa.binary()), pa.array([len(t) for t in raw], pa.int64()), *(pa.array(prints[:, i].copy()) for i in range(count))], names=["doc_id", "sha", "digest", "size", *names])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()]
            own = np.array([_digest(t) == d for t, d in zip(raw, batch.column(1).to_pylist(), strict=True)], bool)
            yield pa.record_batch([batch.column(2), pa.array(raw, pa.binary())], names=["node", "text"]).filter(pa.array(own))

    rows = stored(texts.mapInArrow(run, "doc_id long, sha binary, digest binary, size long, " + ", ".join(f"{p} long" for p in names)), "near-prints")
    nodes = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("size").alias("size"), *[F.min(p).alias(p) for p in names])
    nodes = stored(nodes.select(F.monotonically_increasing_id().alias("node"), "digest", "least", "size", F.array(*names).alias("prints")), "near-nodes")
    each = nodes.select("node", F.posexplode("prints").alias("turn", "print"))
    classes = each.groupBy("turn", "print").agg(F.min("node").alias("first"), F.count("*").alias("n"))
    equal = each.join(classes.where("n > 1"), ["turn", "print"]).where("node > first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    families = stars_of(links(classes.select("turn", "print", F.col("first").alias("node")), most, agree).unionAll(equal).distinct())
    families = families.unionAll(families.select(F.col("b").alias("a"), "b").distinct()).select(F.col("a").alias("node"), F.col("b").alias("family"))
    members = stored(nodes.join(families, "node"), "near-members")
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    found = texts.select(key("doc_id").alias("key"), "text").join(members.select(key("least").alias("key"), "digest", "node"), "key").select("text", "digest", "node")
    found = found.mapInArrow(again, "node long, text binary").groupBy("node").agg(F.min("text").alias("text"))
    members = stored(members.select("node", "family", "size", "prints").join(found, "node"), "near-texts")
    same = _same(members, most, shingle, least)
    named = stored(nodes.select("node", "digest", "least").join(same.withColumnRenamed("a", "node"), "node", "left").select("digest", "least", F.coalesce("b", "node").alias("root")), "near-classes")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.select("doc_id", "sha", "digest").join(named.join(ids, "root").select("digest", "root", "component_id"), "digest").select("doc_id", F.lower(F.hex("sha")).alias("sha"), "root", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components_of(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
