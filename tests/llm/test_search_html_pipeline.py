"""Top-k search, HTML extraction and the pipeline against brute force."""

import math
import random
from pathlib import Path

import numpy as np
import pytest

from jagspark.llm import html_text as H
from jagspark.llm import topk as T
from jagspark.llm.common import shared_dir


@pytest.mark.parametrize("kind", ["dense", "ties", "negative", "odd"])
def test_topk_matches_brute_force(spark, kind):
    rng = random.Random(kind)
    rows = []
    for i in range(420):
        if kind == "ties":
            v = [rng.choice([-1.0, 0.0, 1.0]) for _ in range(4)]
        elif kind == "negative":
            v = [-rng.random() if i % 100 == 0 else rng.random() for _ in range(5)]
        else:
            v = [rng.gauss(0, 0.2) for _ in range(8)]
        rows.append((i, v))
    if kind == "odd":
        rows += [(600, None), (700, []), (800, [1.0, None]), (900, [math.nan]), (901, [math.inf]), (None, [1.0] * 8), (1000, [0.5]), (33, rows[33][1]), (1100, [1e3] * 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as score", "2 as shard")
    old, T.SHARD_ROWS = T.SHARD_ROWS, 100
    try:
        got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in T.search(df).collect())
    finally:
        T.SHARD_ROWS = old
    whole = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, x in whole:
        if q % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in whole if i != q)[:10]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    assert got == sorted(want)
    assert T.search(df.limit(0)).count() == 0


def test_scores_beyond_doubles_are_exact():
    rows = np.array([[2**40, 1], [2**40, 2], [2**40, 0]], np.int64)
    at, scores = T.Postings(np.array([1, 2, 3]), rows).search(99, np.array([2**40, 3], np.int64))
    assert at.tolist() == [1, 0, 2] and [int(s) for s in scores] == [2**80 + 6, 2**80 + 3, 2**80]


PAGES = [
    ("<html><head><title>t</title></head><body><nav><a>m</a></nav><article><h1>T &amp; U</h1><p>one <b>b</b>old<br>two&nbsp; x<p>three<aside>s</aside><div class='comments'>c</div></article><footer>f</footer>", "T & U one bold two x three"),
    ("<article>a<script>var x='</p><article>'</script><style>p{}</style><form>f<input></form>b<!-- c --></article>", "a b"),
    ("<main><p>m</p><div id=cookie-notice>n</div></main><p>out</p>", "m"),
    ("<p>plain</p><div class=ad>x<div>y</div></div><p>text</p>", "plain text"),
    ("<article>cut <p>here <b", "cut here"),
    ("no tags &lt;at&gt; all", "no tags <at> all"),
    ("<div role='navigation'>x</div><header>h</header><p>b</p>", "b"),
    ("<article><p class=ad>buy<p>stay</article>", "stay"),
    ("<div class='page-header'>h</div><article><div class='entry-header'><h1>Title</h1></div><section id='comments'>c</section><p>x</article>", "Title x"),
    (None, ""),
    ("", ""),
    ("<article></article>", ""),
]


def test_pages(spark):
    df = spark.createDataFrame([(i, f"http://h{i}.example/x", h) for i, (h, _) in enumerate(PAGES)] + [(99, None, "<p>no host</p>")], "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as text")
    got = {r.page_id: r for r in H.extract(df).collect()}
    for i, (_, want) in enumerate(PAGES):
        assert (got[i].text, got[i].n_chars) == (want, len(want)), PAGES[i]
    assert got[99].text == "no host"
    assert H.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("tokens_per_array", [2_000_000, 40])
def test_host_boilerplate_goes_and_unique_runs_stay(spark, tokens_per_array):
    footer = "all rights of this invented site are reserved by its owners forever"
    rows = [(i, f"http://a.example/{i}", f"<div>own{i} words{i} stand{i} here{i}</div><div>{footer}</div>") for i in range(9)]
    rows += [(50, "http://b.example/", f"<div>alone</div><div>{footer}</div>"), (51, "http://a.example/q", f"<article>quoted {footer}</article>")]
    old, H.HOST_TOKENS = H.HOST_TOKENS, tokens_per_array
    try:
        got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    finally:
        H.HOST_TOKENS = old
    assert all(got[i] == f"own{i} words{i} stand{i} here{i}" for i in range(9))
    assert got[50] == f"alone {footer}" and got[51] == f"quoted {footer}"


@pytest.mark.parametrize("tokens_per_array", [2_000_000, 300])
def test_boilerplate_inside_articles_goes_by_the_array_alone(spark, tokens_per_array):
    """No tag, class or id tells the notice from the text; nearly every page of the host has it. Half of them quote a passage, which stays."""
    notice = "read more of our stories every morning with a plan that suits you best"
    passage = "this long passage has been quoted word by word on a great many pages here"
    own = lambda i: " ".join(f"p{i}w{k}" for k in range(20))
    rows, want = [], {}
    for i in range(40):
        quote = f"<p>{passage}</p>" if i % 2 else ""
        rows.append((i, "http://a.example/x", f"<main><article><h1>Title {i}</h1><p>{own(i)}</p><p>{notice if i % 10 else 'none'}</p>{quote}<p>the end {i}</p></article></main>"))
        want[i] = f"Title {i} {own(i)}" + (" none" if i % 10 == 0 else "") + (f" {passage}" if i % 2 else "") + f" the end {i}"
    # equal pages are one page; a small host's repeats stay
    rows += [(100 + i, "http://b.example/x", f"<article>same page for everyone {notice}</article>") for i in range(60)]
    rows += [(200 + i, "http://c.example/x", f"<article>{own(i)} {notice}</article>") for i in range(5)]
    want |= {100 + i: f"same page for everyone {notice}" for i in range(60)} | {200 + i: f"{own(i)} {notice}" for i in range(5)}
    old, H.HOST_TOKENS = H.HOST_TOKENS, tokens_per_array
    try:
        df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as salt", "3 as common").repartition(3)
        got = {r.page_id: r for r in H.extract(df).collect()}
    finally:
        H.HOST_TOKENS = old
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values()) and got[1].n_boilerplate == 14 and got[0].n_boilerplate == 0


@pytest.mark.parametrize("listed", [500_000, 0])
def test_a_host_of_many_arrays_equals_brute_force_and_stores_no_windows_of_articles(spark, listed):
    rng = np.random.default_rng(7)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    passages, notice = [word(12) for _ in range(6)], word(10)
    rows, plain = [], {}
    for i in range(90):
        blocks = [word(40), passages[i % 6], word(30)] if i % 3 else [word(70)]
        # of the plain pages one in two ends with what every page has
        if i % 9 == 0:
            plain[i] = [*blocks, notice] if i % 2 else blocks
            rows.append((i, "http://a.example/x", "".join(f"<div>{' '.join(b)}</div>" for b in plain[i])))
        else:
            rows.append((i, "http://a.example/x", "<article>" + "".join(f"<p>{' '.join(b)}</p>" for b in [*blocks, notice]) + "</article>"))
    rows += [(1000 + i, "http://a.example/x", rows[-1][2]) for i in range(3)]  # copies are one page
    rows.append((2000, "http://b.example/x", rows[0][2]))
    streams = {(i, u): tuple(w for _, b in H.parse(h) for w in b.split(" ")) for i, u, h in rows}
    held = {}
    for stream in {s for (_, u), s in streams.items() if "a.example" in u}:
        for k in range(len(stream) - 7):
            held.setdefault(stream[k : k + 8], set()).add(stream)
    distinct = len({s for (_, u), s in streams.items() if "a.example" in u})
    want = {}
    for (i, u), stream in streams.items():
        out = [False] * len(stream)
        for k in range(len(stream) - 7):
            n = len(held.get(stream[k : k + 8], ())) if "a.example" in u else 0
            if n > 1 if i in plain else n > 0.8 * distinct:
                out[k : k + 8] = [True] * 8
        want[i] = " ".join(w for w, x in zip(stream, out, strict=True) if not x)
    assert want[1] == " ".join(streams[1, rows[1][1]][:-10]) and len(want[9].split()) == 70
    old = H.HOST_TOKENS, getattr(H, "LISTED", 0)
    stored = lambda: sum(p.stat().st_size for p in Path(shared_dir(spark).removeprefix("file:")).rglob("*.parquet"))
    H.HOST_TOKENS, H.LISTED = 1000, listed
    try:
        df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
        got = {r.page_id: r.text for r in H.extract(df).collect()}
        # pages with an article only, with nothing in common: what is stored is in proportion to the hosts, not to the pages
        rows = [(i, "http://c.example/x", f"<article>{' '.join(word(200))}</article>") for i in range(60)]
        kept = stored()
        texts = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}
        kept = stored() - kept
    finally:
        H.HOST_TOKENS, H.LISTED = old
    assert got == want
    assert texts == {i: h[9:-10] for i, _, h in rows}
    assert kept < sum(len(h) for *_, h in rows) / 2


def test_a_very_long_page(spark):
    text = " ".join(f"w{i % 5000}" for i in range(300_000))
    df = spark.createDataFrame([(1, "http://a.example/", f"<article><p>{text}</p></article>"), (1, "http://a.example/", "<article>x</article>")], "page_id long, url string, html string")
    assert sorted(r.text for r in H.extract(df).collect()) == sorted([text, "x"])


def test_suffix_array_cover_matches_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(150):
        n, least = int(rng.integers(1, 60)), 4
        pages, tokens = np.sort(rng.integers(0, 4, n)), rng.integers(0, 3, n).astype(np.uint64)
        at = {}
        for i in range(n - least + 1):
            if pages[i] == pages[i + least - 1]:
                at.setdefault(tuple(tokens[i : i + least]), []).append(i)
        want = np.zeros(n, bool)
        for places in at.values():
            if len({pages[i] for i in places}) > 1:
                for i in places:
                    want[i : i + least] = True
        covered, on = H.repeated(tokens, pages, least)
        assert (covered == want).all()
        for places in at.values():
            assert {int(on[i]) for i in places} == {len({pages[i] for i in places})}


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as C

    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 60
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(20, 80))) for _ in range(120)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    rows += [(200 + i, t + " ", "en", "s0", 0) for i, t in enumerate(texts[:20])] + [(300 + i, "&&& | *** %%% " * 20 + str(i), "en", "s1", 0) for i in range(40)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 300), 0) for i, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in C.STAGES:
        before, docs = docs, C.stored(stage(spark, docs, str(tmp_path)), "test")
        seen.append((name, sorted(r.doc_id for r in docs.select("doc_id").collect())))
        if name != "bpe":
            assert docs.columns == before.columns
    stages = dict(seen)
    assert stages["quality"] == [*range(120), *range(200, 220)]
    assert stages["exact_dedup"] == stages["near_dedup"] == [*range(20, 120), *range(200, 220)]  # the longer original stays
    assert set(stages["mixing"]) <= set(stages["near_dedup"]) and 120 < len(stages["mixing"]) < 250
    assert stages["bpe"] == stages["mixing"]
    assert all(r.decoded.replace("</w> ", " ").replace(" ", "").replace("</w>", "") == r.text.replace(" ", "") for r in docs.limit(5).collect())
    assert C.run(spark, str(tmp_path)).count() == len(stages["bpe"])


@pytest.mark.parametrize("name", ["content has-sidebar", "no-comments", "post with-share"])
def test_class_names_that_tell_of_something_else_skip_nothing(name):
    assert H.parse(f"<div class='{name}'><article>kept</article></div>") == [(H.ARTICLE, "kept")]
    assert H.parse(f"<div class='{name} sidebar'>gone</div>") == [(H.SKIPPED, "gone")]


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Null and empty texts, repeated ids with equal and different texts, null ids, extra columns and an empty table, through every stage."""
    import corpus_pipeline as C

    long = lambda c, n=60: " ".join(f"{c}{i}" for i in range(n))
    rows = [(1, None), (2, ""), (3, " "), (4, long("a")), (4, long("b")), (4, long("b")), (None, long("c")), (5, long("d", 40_000)), (6, long("a"))]
    docs = spark.createDataFrame([(i, t, "en", None if i == 6 else "s", 0, "u", 7) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, `key` string, copies int")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in C.STAGES[1:]:
        out = C.stored(stage(spark, docs, str(tmp_path)), "odd")
        nothing = stage(spark, docs.limit(0), str(tmp_path))
        assert nothing.count() == 0 and out.columns[: len(docs.columns)] == docs.columns
        if name == "exact_dedup":
            # of the blank ones the longest; of equal texts the smallest id; different texts of one id stay
            assert sorted((r.doc_id or 0, (r.text or "")[:2]) for r in out.collect()) == [(0, "c0"), (3, " "), (4, "a0"), (4, "b0"), (5, "d0")]
            docs = out
        elif name == "near_dedup":
            assert out.count() == 5
            docs = out
    kept = C.STAGES[0][1](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and kept.count() == 0  # without labels every score is 0.5
