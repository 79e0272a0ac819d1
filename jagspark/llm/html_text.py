"""Main text of raw web pages, with a suffix array per host.

A page is cut into blocks, each in a zone: inside an article (or main) element, elsewhere, or inside an element that is no main text
by its name, role or class (menus, headers, footers, sidebars, notices, adverts, forms, comments). The token streams of a host's pages, all
zones, are concatenated and a suffix array is built; it gives the substrings of MIN_RUN tokens and more that repeat across distinct pages and
on how many. Tags are evidence for what may be main text, the array decides what of it is the site's:
- inside an article (else main) element, a run that stands on more than COMMON of a host's distinct pages, with COMMON_PAGES pages at least, is
  boilerplate, whatever its tags; what fewer pages share (quoted passages, copies) is main text and stays;
- on a page with neither, where no tag vouches for a block, every run that another page repeats is boilerplate: the unique runs stay.
(Substring repeats alone cannot do it: adverts and footers may be unique to a page, and article passages repeat.)

Defined results: a null or empty html gives the empty text; a cut-off tag or comment at the end is markup; character references are decoded as
HTML5 does; white space inside a block becomes one space; a null or odd url has the host ''; pages that repeat a page_id are pages of
their own; pages of a host with equal text count as one distinct page; very long pages are read whole; an empty table gives an empty result;
extra columns are ignored, whatever their names.

At scale: a first look counts each host's words without parsing. A host of at most HOST_TOKENS words has one array: its packed pages are shuffled
once and come out as texts. A larger host's pages are dealt to several arrays by a digest of their text, so no task holds more than a bounded part
of a host; they are shuffled once too, and all else is a map over the table, which knows a page by its digest. Arrays tell of the windows on more
than TOLD of their pages; where these sums allow a window on more than COMMON of all, the host's pages are counted. Only pages without an article
have their windows met with those of other arrays; on hosts that have such pages this exchange moves a hash for each window that such a page has
open, wherever it stands, and may take more disk than the pages.
"""

from __future__ import annotations

import hashlib
import html as htmllib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, small_batches, stored, table

MIN_RUN = 8
HOST_TOKENS = 2_000_000
COMMON, COMMON_PAGES = 0.8, 20
SALTS = 32

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes".split())
#: Elements that never hold main text.
OUT = frozenset("script style noscript template svg math canvas iframe object audio video head title nav footer aside form button select textarea dialog menu xmp noframes".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
#: Words of a class or id that mark what is no main text.
OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted related share sharing sidebar social sponsor sponsored subscribe widget".split()
)
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_MARKS = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_ABOUT = ("no-", "has-", "with-")


def _marked(attributes: str, inside: bool) -> tuple[bool, bool]:
    """(no main text, role main) by class, id and role. Inside an article a header holds its title."""
    words = OUT_WORDS - {"header"} if inside else OUT_WORDS
    out = main = False
    for name, *values in _MARKS.findall(attributes):
        value = "".join(values).lower()
        if name.lower() == "role":
            main |= "main" in value.split()
            out |= not OUT_ROLES.isdisjoint(value.split())
        else:
            # has-sidebar or no-comments tells of the page or a neighbour, not of the element
            out |= any(not words.isdisjoint(_WORD.findall(x)) for x in value.split() if not x.startswith(_ABOUT))
    return out, main


#: Zones of a block.
SKIPPED, OTHER, MAIN, ARTICLE = range(4)


def parse(html: str | None) -> list[tuple[int, str]]:
    """(zone, text) of the page's blocks in order; texts with single spaces, none empty."""
    blocks: list[tuple[int, str]] = []
    if not html:
        return blocks
    parts: list[str] = []
    skip, skip_depth, article, main, at = "", 0, 0, 0, 0
    main_name = ""

    def flush() -> None:
        if parts:
            text = " ".join(htmllib.unescape("".join(parts)).split())
            parts.clear()
            if text:
                blocks.append((SKIPPED if skip else ARTICLE if article else MAIN if main else OTHER, text))

    for m in iter(lambda: _TAG.search(html, at), None):
        if m.start() > at:
            parts.append(html[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name, end, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if name == "br":
            parts.append(" ")
            continue
        if name not in INLINE:
            flush()
        if end:
            if skip and name == skip:
                flush()
                skip_depth -= 1
                if not skip_depth:
                    skip = ""
            elif not skip:
                article -= name == "article" and article > 0
                if main and name == main_name:
                    main -= 1
            continue
        if skip == "p" and name not in INLINE:
            skip, skip_depth = "", 0  # an open paragraph ends where a block begins
        if name in RAW:
            # the content is text up to its own end tag
            found = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            at = found.end() if found else len(html)
            continue
        if name in VOID or attributes.endswith("/") and name in OUT:
            continue
        if skip:
            skip_depth += name == skip
            continue
        out, is_main = _marked(attributes, article > 0) if attributes else (False, False)
        if name in ("article", "main", "body", "html"):
            out = out and name == "article"
        if name in OUT or out or name == "header" and not article:
            flush()
            skip, skip_depth = name, 1
        elif name == "article":
            article += 1
        elif name == "main" or is_main:
            if not main:
                main_name = name
            main += 1
        elif main and name == main_name:
            main += 1
    rest = html[at:]
    if rest:
        parts.append(rest)
    flush()
    return blocks


def host_of(url: str | None) -> str:
    found = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", url or "")
    return found[1].lower() if found else ""


# ---------------------------------------------------------------- suffix arrays


def suffix_ranks(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of all suffixes by their first `depth` tokens (equal prefixes, equal ranks), by doubling of sorted prefixes."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    have, n = 1, len(tokens)
    while have < depth:
        step = min(have, depth - have)
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:]
        rank = np.unique(rank * (n + 2) + after + 1, return_inverse=True)[1].astype(np.int64)
        have += step
    return rank


def repeated(tokens: np.ndarray, pages: np.ndarray, least: int = MIN_RUN) -> tuple[np.ndarray, np.ndarray]:
    """(which tokens lie in a substring of `least` tokens or more that occurs on two pages, on how many pages the one that begins at a token
    occurs). Tokens of each page are consecutive."""
    n = len(tokens)
    on = np.zeros(n, np.int64)
    if n < least:
        return np.zeros(n, bool), on
    inside = np.zeros(n, bool)
    inside[: n - least + 1] = pages[: n - least + 1] == pages[least - 1 :]
    rank = suffix_ranks(tokens, least)
    order = np.lexsort((pages, rank))
    order = order[inside[order]]
    if not len(order):
        return np.zeros(n, bool), on
    r, p = rank[order], pages[order]
    # suffixes of one rank are neighbours in the array, those of one page among them too
    new = np.concatenate([[True], r[1:] != r[:-1]])
    group = np.cumsum(new) - 1
    distinct = np.bincount(group, new | np.concatenate([[True], p[1:] != p[:-1]])).astype(np.int64)
    on[order] = distinct[group]
    edge = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(on > 1)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + least, -1)
    return np.cumsum(edge[:n]) > 0, on


def _token_ids(blocks: list[str]) -> np.ndarray:
    # hash() differs between processes; these are compared across tasks
    import xxhash

    return np.array([xxhash.xxh64_intdigest(w) for b in blocks for w in b.split(" ")], np.uint64)


def windows(ids: np.ndarray, least: int = MIN_RUN) -> np.ndarray:
    """A hash for each window of `least` tokens."""
    n = len(ids) - least + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(least):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + n] + np.uint64(i + 1))
    return h


def _bits(zone: int, own: np.ndarray, places: np.ndarray, covered: np.ndarray) -> np.ndarray:
    """The tokens of a page that are no main text: in its zone's `own` tokens the common windows (at `places`), else what is covered."""
    if zone == OTHER:
        return covered
    bits = np.zeros(len(own), bool)
    for x in places.tolist():
        if own[x : x + MIN_RUN].all():
            bits[x : x + MIN_RUN] = True
    return bits


def _sizes(blocks: list[tuple[int, str]]) -> list[int]:
    return [t.count(" ") + 1 for _, t in blocks]


def _text(blocks: list[tuple[int, str]], zone: int, bits: np.ndarray | None) -> tuple[str, int]:
    """(text of the zone's blocks without the tokens in `bits`, how many those are)."""
    if bits is None or not bits.any():
        return " ".join(t for z, t in blocks if z == zone), 0
    kept, at, gone = [], 0, 0
    for (z, block), size in zip(blocks, _sizes(blocks), strict=True):
        own = bits[at : at + size]
        at += size
        if z == zone:
            if own.any():
                gone += int(own.sum())
                block = " ".join(w for w, out in zip(block.split(" "), own, strict=True) if not out)
            if block:
                kept.append(block)
    return " ".join(kept), gone


def _zone(blocks: list[tuple[int, str]]) -> int:
    return max([OTHER, *(z for z, _ in blocks)])


def _own(blocks: list[tuple[int, str]], zone: int) -> np.ndarray:
    return np.repeat([z == zone for z, _ in blocks], _sizes(blocks))


# ---------------------------------------------------------------- pages on their way to an array

#: Compression of a page's blocks.
LEVEL = 3


def pack(blocks: list[tuple[int, str]]) -> bytes:
    """No block holds a line's end."""
    return zstandard.ZstdCompressor(level=LEVEL).compress("\n".join(f"{z}{t}" for z, t in blocks).encode())


def unpack(packed: bytes) -> list[tuple[int, str]]:
    text = zstandard.ZstdDecompressor().decompress(packed).decode()
    return [(int(b[0]), b[1:]) for b in text.split("\n")] if text else []


def _digest(blocks: list[tuple[int, str]]) -> bytes:
    return hashlib.blake2b("\n".join(t for _, t in blocks).encode(), digest_size=16).digest()


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """(key, rows) of the neighbours that share their first `keys` columns, across batches."""
    at, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != at:
                if held:
                    yield at, held
                at, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield at, held


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.record_batch([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


#: Rows of a batch of results.
OUT_ROWS = 500


def _batches(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    rows = iter(rows)
    while held := list(itertools.islice(rows, OUT_ROWS)):
        yield _batch(held, schema)


# ---------------------------------------------------------------- hosts of one array

_DONE = "page_id long, url string, text string, n_chars long, n_boilerplate long"
_SENT = "host string, page_id long, url string, packed binary"


def _send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from _batches(((host, i, url, pack(parse(source))) for host, i, url, source in zip(*(c.to_pylist() for c in batch.columns), strict=True)), _SENT)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of hosts that have one array."""

    def rows():
        for _, group in _groups(batches, 1):
            pages = [(i, url, unpack(packed)) for i, url, packed in group]
            number: dict[bytes, int] = {}
            which = [number.setdefault(_digest(b), len(number)) if b else -1 for *_, b in pages]
            marks = {}
            # nothing can go on a host with few pages that all have an article
            if len(number) >= COMMON_PAGES or len(number) > 1 and any(_zone(b) == OTHER for *_, b in pages):
                one = dict(zip(reversed(which), (b for *_, b in reversed(pages)), strict=True))
                ids = [_token_ids([t for _, t in one[k]]) for k in range(len(number))]
                covered, on = repeated(np.concatenate(ids), np.repeat(np.arange(len(ids)), [len(x) for x in ids]))
                often = on > COMMON * len(ids) if len(ids) >= COMMON_PAGES else np.zeros(len(on), bool)
                cuts = np.cumsum([len(x) for x in ids])[:-1]
                marks = dict(enumerate(zip(np.split(covered, cuts), np.split(often, cuts), strict=True)))
            for (i, url, blocks), k in zip(pages, which, strict=True):
                zone, bits = _zone(blocks), None
                if k in marks:
                    covered, often = marks[k]
                    if covered.any() or often.any():
                        bits = _bits(zone, _own(blocks, zone), np.flatnonzero(often), covered)
                text, gone = _text(blocks, zone, bits)
                yield i, url, text, len(text), gone

    yield from _batches(rows(), _DONE)


# ---------------------------------------------------------------- hosts of several arrays

_DEALT = "host string, array int, digest binary, packed binary"
_FOUND = "host string, pages long, listed array<long>, on array<int>, digest binary, covered binary, open array<long>, places array<int>"


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages to the arrays of their host, by a digest of their text."""

    def rows(batch):
        for host, arrays, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if blocks := parse(source):
                digest = _digest(blocks)
                yield host, int.from_bytes(digest[:8], "big") % arrays, digest, pack(blocks)

    for batch in batches:
        yield from _batches(rows(batch), _DEALT)


#: Windows on no more than this share of an array's pages are not told; what is told of the others bounds them all.
TOLD = 0.5


def _array(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One of several arrays of a host: the number of its distinct pages and its windows on more than TOLD of them (`listed`, `on`), and for
    each distinct page without an article or main element the tokens that are covered in this array and the windows that are still open."""

    def rows():
        for (host, _), group in _groups(batches, 2):
            one, other = {}, set()
            for digest, packed in group:
                blocks = unpack(packed)
                one.setdefault(digest, [t for _, t in blocks])
                if _zone(blocks) == OTHER:
                    other.add(digest)
            ids = [_token_ids(b) for b in one.values()]
            covered, on = repeated(np.concatenate(ids), np.repeat(np.arange(len(ids)), [len(x) for x in ids]))
            told, at = {}, 0
            often = on > TOLD * len(ids)
            for digest, x in zip(one, ids, strict=True):
                mark, own, count = often[at : at + len(x)], covered[at : at + len(x)], on[at : at + len(x)]
                at += len(x)
                if not mark.any() and digest not in other:
                    continue
                hashes = windows(x).view(np.int64)
                where = np.flatnonzero(mark)
                told.update(zip(hashes[where].tolist(), count[where].tolist(), strict=True))
                if digest in other:
                    # a window all of whose tokens are covered adds nothing
                    places = np.flatnonzero(np.convolve(~own, np.ones(MIN_RUN, np.int64), "valid")) if len(x) >= MIN_RUN else np.zeros(0, np.int64)
                    yield host, None, None, None, digest, np.packbits(own).tobytes(), hashes[places].tolist(), places.tolist()
            yield host, len(ids), list(told), list(told.values()), None, None, None, None

    yield from _batches(rows(), _FOUND)


def _hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The listed windows that each page holds; all its windows where none are listed."""

    def rows(batch):
        for host, source, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            blocks = parse(source)
            own = np.unique(windows(_token_ids([t for _, t in blocks])).view(np.int64))
            own = own if wanted is None else np.intersect1d(own, np.array(wanted, np.int64))
            if len(own):
                yield host, _digest(blocks), own.tolist()

    for batch in batches:
        yield from _batches(rows(batch), "host string, digest binary, window array<long>")


def _finish(others: bool, covers: bool):
    """The texts of pages with an article or main element; with `others` of all pages. With `covers` the input is packed pages and their covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(batch):
            if covers:
                for i, url, packed, covered, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    blocks = unpack(packed)
                    bits = np.zeros(sum(_sizes(blocks)), bool)
                    if covered is not None:
                        bits = np.unpackbits(np.frombuffer(covered, np.uint8), count=len(bits)).astype(bool)
                    for place in more or []:
                        bits[place : place + MIN_RUN] = True
                    text, gone = _text(blocks, OTHER, bits)
                    yield i, url, text, len(text), gone
                return
            for i, url, source, common in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                blocks = parse(source)
                zone, bits = _zone(blocks), None
                if zone == OTHER and not others:
                    continue
                if zone > OTHER and common:
                    found = np.isin(windows(_token_ids([t for _, t in blocks])).view(np.int64), np.array(common, np.int64))
                    if found.any():
                        bits = _bits(zone, _own(blocks, zone), np.flatnonzero(found), found)
                text, gone = _text(blocks, zone, bits)
                yield i, url, text, len(text), gone

        for batch in batches:
            yield from _batches(rows(batch), _DONE)

    return run


_OTHERS = "page_id long, url string, host string, digest binary, packed binary"


def _others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pages without an article or main element."""

    def rows(batch):
        for i, url, host, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            blocks = parse(source)
            if _zone(blocks) == OTHER:
                yield i, url, host, _digest(blocks), pack(blocks)

    for batch in batches:
        yield from _batches(rows(batch), _OTHERS)


#: Up to so many windows, the lists of all hosts are broadcast.
LISTED = 500_000


def _with_lists(rows: DataFrame, lists: DataFrame, name: str, how: str) -> DataFrame:
    """rows with the list `name` of their host. Many lists meet the rows by (host, salt): a host with a third of all pages meets its own in many tasks."""
    if (lists.agg(F.sum(F.size(name))).first()[0] or 0) <= LISTED:
        return rows.join(F.broadcast(lists), "host", how)
    lists = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(SALTS)).cast("int")).join(lists, ["host", "salt"], how).drop("salt")


def _several(rows: DataFrame) -> DataFrame:
    """The texts of hosts that have several arrays. Pages go to an array once; all else is a map over the table, which knows a page by its digest."""
    dealt = rows.select("host", "arrays", "html").mapInArrow(_deal, _DEALT)
    found = stored(dealt.repartition("host", "array").sortWithinPartitions("host", "array").mapInArrow(_array, _FOUND), "html-found")
    arrays = found.where("pages is not null")
    pages = arrays.groupBy("host").agg(F.sum("pages").alias("pages"))
    # a window is on no more than TOLD of the pages of an array that does not tell of it
    told = arrays.select("host", F.col("pages").alias("of"), F.explode(F.arrays_zip("listed", "on")).alias("w")).groupBy("host", F.col("w.listed").alias("window")).agg(F.sum("w.on").alias("n"), F.sum("of").alias("of"))
    perhaps = told.join(pages, "host").where((F.col("pages") >= COMMON_PAGES) & (F.col("n") + TOLD * (F.col("pages") - F.col("of")) > COMMON * F.col("pages")))
    perhaps = stored(perhaps.groupBy("host").agg(F.collect_list("window").alias("wanted")), "html-perhaps")
    if perhaps.isEmpty():
        common = perhaps.select("host", F.col("wanted").alias("common"))
    else:
        hits = _with_lists(rows, perhaps, "wanted", "inner").select("host", "html", "wanted").mapInArrow(_hits, "host string, digest binary, window array<long>")
        counted = hits.dropDuplicates(["host", "digest"]).select("host", F.explode("window").alias("window")).groupBy("host", "window").agg(F.count("*").alias("n"))
        counted = counted.join(pages, "host").where(F.col("n") > COMMON * F.col("pages"))
        common = stored(counted.groupBy("host").agg(F.collect_list("window").alias("common")), "html-common")
    covers = found.where("digest is not null").select("host", "digest", "covered", "open", "places")
    none = covers.isEmpty()
    done = _with_lists(rows, common, "common", "left").select("page_id", "url", "html", "common").mapInArrow(_finish(none, False), _DONE)
    if none:
        return done
    # what a page without an article shares with pages of other arrays
    open_ = covers.where(F.size("open") > 0).select("host", "digest", F.explode(F.arrays_zip("open", "places")).alias("w")).select("host", "digest", F.col("w.open").alias("window"), F.col("w.places").alias("place"))
    held = rows.join(F.broadcast(covers.select("host").distinct()), "host", "left_semi").select("host", "html", F.lit(None).cast("array<long>").alias("wanted")).mapInArrow(_hits, "host string, digest binary, window array<long>")
    held = held.select("host", "digest", F.explode("window").alias("window")).join(open_.select("host", "window").distinct(), ["host", "window"], "left_semi")
    twice = held.groupBy("host", "window").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").select("host", "window")
    more = open_.join(twice, ["host", "window"], "left_semi").groupBy("host", "digest").agg(F.collect_list("place").alias("more"))
    marks = stored(covers.select("host", "digest", "covered").join(more, ["host", "digest"], "left"), "html-marks")
    others = rows.select("page_id", "url", "host", "html").mapInArrow(_others, _OTHERS).join(marks, ["host", "digest"], "left")
    return done.unionAll(others.select("page_id", "url", "packed", "covered", "more").mapInArrow(_finish(True, True), _DONE))


#: No two words of a page without one of these between them, but for rare white space.
_BETWEEN = (" ", "\n", "\t", "\r", "\f", "\u00a0", "\u3000", "<", "&")


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An upper bound of the tokens of each host's pages, without parsing."""
    for batch in batches:
        n = np.ones(len(batch), np.int64)
        for x in _BETWEEN:
            n += pc.fill_null(pc.count_substring(batch.column(1), x), 0).to_numpy(zero_copy_only=False)
        total: dict[str, int] = {}
        for host, k in zip(batch.column(0).to_pylist(), n.tolist(), strict=True):
            total[host] = total.get(host, 0) + k
        yield _batch(list(total.items()), "host string, n long")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_boilerplate (tokens that the suffix array took from the text) of every row."""
    small_batches(pages.sparkSession)
    host = F.pandas_udf(lambda urls: urls.map(host_of), "string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host("url").alias("host"))
    counted = rows.select("host", "html").mapInArrow(_words, "host string, n long").groupBy("host").agg(F.ceil(F.sum("n") / HOST_TOKENS).cast("int").alias("arrays"))
    # one small row for HOST_TOKENS tokens of the table at most
    several = stored(counted.where("arrays > 1"), "html-hosts")
    if several.isEmpty():
        return _alone(rows)
    return _alone(rows.join(F.broadcast(several), "host", "left_anti")).unionAll(_several(rows.join(F.broadcast(several), "host")))


def _alone(rows: DataFrame) -> DataFrame:
    sent = rows.select("host", "page_id", "url", "html").mapInArrow(_send, _SENT)
    return sent.repartition("host").sortWithinPartitions("host").mapInArrow(_whole, _DONE)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
