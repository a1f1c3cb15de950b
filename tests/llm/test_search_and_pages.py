"""Block search, HTML extraction and the pipeline."""

from __future__ import annotations

import html
import re
import time

import numpy as np
import pytest
from compare import connect, difference
from llm.conftest import ordered, pairs

import corpus_pipeline
from tierglass.llm import block_search, html_text, simhash, substring_dedup
from tierglass.llm.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    assert difference(spark, connect(SF), SF, QUERIES[name], SQL[name]) is None


@pytest.mark.parametrize("blocks", [(1024, 8192), (7, 30)])
def test_search_takes_odd_vectors(spark, monkeypatch, blocks):
    monkeypatch.setattr(block_search, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(block_search, "CANDIDATE_BLOCK", blocks[1])
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.integers(-3, 4, 4)]) for i in range(1, 120)]  # many ties
    rows += [(200, None), (220, [0.0] * 4), (240, [1.0, None, 0.0, 0.0]), (260, [float("nan"), 1.0, 1.0, 1.0])]
    rows += [(280, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (300, [1.0, 2.0]), (301, [2.0, 2.0]), (20, [9.0] * 4), (320, [])]
    rows += [(340, [1e-30, 1e30, 0.0, 0.0])]
    vectors = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "vec_id long, embedding array<float>, block int, dim string")
    got = block_search.nearest(vectors.where("vec_id % 20 = 0"), vectors, 5).collect()
    usable = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            v = tuple(np.array(v, np.float32).astype(float).tolist())
            usable[i] = min(usable.get(i, v), v)
    want = []
    for q in (i for i in usable if i % 20 == 0):
        scored = sorted((-float(np.dot(usable[q], v)), i) for i, v in usable.items() if i != q and len(v) == len(usable[q]))
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:5])]
    assert [tuple(r)[:3] for r in sorted(got)] == [w[:3] for w in sorted(want)]
    assert np.allclose([r["score"] for r in sorted(got)], [w[3] for w in sorted(want)])


def test_search_of_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert block_search.nearest(none, none).count() == 0


def article_text(page):
    parts = re.split(r"</?(?:h1|p)>", re.search(r"<article>(.*?)</article>", page, re.S)[1])
    made = (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", p)).split()) for p in parts)
    return "\n".join(p for p in made if p)


def nearest_by_hand(rows, k, every):
    out = []
    for q, x in rows:
        if q % every == 0:
            scored = sorted((-float(np.dot(np.array(x, np.float64), np.array(y, np.float64))), v) for v, y in rows if v != q)
            out += [(q, r + 1, v, -s) for r, (s, v) in enumerate(scored[:k])]
    return out


def test_double_vectors_are_not_rounded(spark):
    rows = [(i, [1.0 + i * 1e-12, 1.0 - (i % 7) * 1e-13, 0.5]) for i in range(60)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = block_search.nearest(vectors.where("vec_id % 20 = 0"), vectors, 5).collect()
    assert [tuple(r)[:3] for r in sorted(got)] == [r[:3] for r in sorted(nearest_by_hand(rows, 5, 20))]


def test_long_vectors_lose_no_neighbour(spark):
    """Over 1,040 dimensions the products of int8 rows no longer fit a float32 mantissa."""
    rng = np.random.default_rng(5)
    base = np.full(3000, 1.0)
    rows = [(i, (base + rng.choice([0, 1e-7], 3000)).tolist()) for i in range(45)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = block_search.nearest(vectors.where("vec_id % 20 = 0"), vectors, 5).collect()
    assert [tuple(r)[:3] for r in sorted(got)] == [r[:3] for r in sorted(nearest_by_hand(rows, 5, 20))]


def test_page_query_gives_the_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r["page_id"]: r for r in QUERIES["op2_html_extraction"](spark, SF).collect()}
    assert {r["page_id"]: got[r["page_id"]]["text"] for r in pages} == {r["page_id"]: article_text(r["html"]) for r in pages}
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_blocks_and_kinds():
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><script>'<p>no</p>'</script>"
        "<div class='site-header'>logo</div><nav><p>menu</nav><main><h1>Ti&amp;tle</h1><p>one <b>two</b>\n three"
        "<p>four<br>five<ul><li>a<li>b</ul><!-- <p>no</p> --><form><input value=x>go</form>"
        "<section id=comments><p>reader</p></section><div>six &lt;b&gt;</div></main><p>out</body>"
    )
    found = html_text.blocks(page)
    assert [t for k, _, t in found if k == "main"] == ["Ti&tle", "one two three", "four five", "a", "b", "six <b>"]
    assert [t for k, _, t in found if k == "drop"] == ["logo", "menu", "go", "reader"]
    assert [t for k, _, t in found if k == "open"] == ["out"]


@pytest.mark.parametrize(
    "page, want",
    [
        ("<div class='layout has-sidebar'><article><p>One</p></article></div>", ["One"]),
        ("<div class='post no-comments'><article>One<p>Two</article></div>", ["One", "Two"]),
        ("<article><p class='social-science'>One</p><section class='search-algorithms'>Two</section></article>", ["One", "Two"]),
        ("<article><p>One</p><iframe src=x /><p>Two</p><svg/><p>Three</article>", ["One", "Two", "Three"]),
        ('<article><p class="x"">First</p><p title=it\'s>Second</p></article>', ["First", "Second"]),
        ("<article><p>One<script>never closed<p>Two</article>", ["Onenever closed", "Two"]),
        ("<form><article>One<form>Send</form></article></form>", ["One"]),
        ("<aside><article>Teaser</article></aside><main>One</main>", ["One"]),
        ("<article>One<section class='comments'><article>Reader</article></section></article>", ["One"]),
        ("<article><a href='x\">One</a> &lt;2 < 3 </article><p title=\"open>rest", ["One <2 < 3"]),
        ("<article><p>One<textarea>x</textarea\n>two</p><STYLE>p</Style>three</article>", ["Onetwo", "three"]),
        ("<article>One <b data-x='a>b' data-y=c/d>two</b></article>", ["One two"]),
    ],
)
def test_malformed_pages_keep_their_article(page, want):
    assert [t for k, _, t in html_text.blocks(page) if k == "main"] == want


@pytest.mark.parametrize("part", ['<a "', "<a x='", "<script>", "<!-", "<p class=\"", "</", "<svg><", "<b x=", "<![CDATA[", "&#"])
def test_hostile_pages_take_linear_time(part):
    page = part * (2_000_000 // len(part))
    started = time.process_time()
    html_text.blocks(page)
    assert time.process_time() - started < 6


def test_repeated_runs_match_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(20):
        tokens = rng.integers(0, 4, 200)
        page = np.sort(rng.integers(0, 6, 200))
        seen = {}
        for i in range(200 - 4):
            if page[i] == page[i + 4]:
                seen.setdefault(tuple(tokens[i : i + 5]), []).append(i)
        want = np.zeros(200, bool)
        for places in seen.values():
            if len({page[i] for i in places}) > 1:
                for i in places:
                    want[i : i + 5] = True
        assert (html_text.repeated_runs(tokens, page, 5) == want).all()


def test_boilerplate_without_elements_is_what_a_host_repeats(spark):
    legal = "All rights reserved by the owner of this site and nobody else at all."
    rows = [(i, f"http://a.example/{i}", f"<div>{legal}</div><div>Story number {i} tells of day {i}.</div><p>{legal}") for i in range(9)]
    rows += [(9, "http://b.example/", f"<p>{legal}"), (10, None, None), (11, "http://c.example", ""), (12, "x", "plain &lt; text")]
    rows += [(None, "http://a.example/n", f"<p>{legal}<p>Null id."), (None, None, None), (12, "x", "plain &lt; text")]
    pages = spark.createDataFrame([(*r, "c", 5) for r in rows], "page_id long, url string, html string, host string, count int")
    got = html_text.extract(pages).collect()
    want = [(i, u, f"Story number {i} tells of day {i}.") for i, u, _ in rows[:9]]
    want += [(9, "http://b.example/", legal), (10, None, ""), (11, "http://c.example", ""), (12, "x", "plain < text")]
    want += [(None, "http://a.example/n", "Null id."), (None, None, ""), (12, "x", "plain < text")]
    assert ordered(got) == ordered(want)


@pytest.mark.parametrize("tasks", [1, 7])
def test_a_run_on_two_pages_of_a_large_host_is_boilerplate(spark, tasks):
    legal = "This passage stands on only two of all the pages of its host and on no other."
    rows = [(i, f"//h.example/{i}", f"<div>Page {i} tells of day {i}.</div>") for i in range(2000)]
    for i in (3, 1990):
        rows[i] = (i, rows[i][1], rows[i][2] + f"<p>{legal}</p><article></article>")
    rows.append((2000, "//other.example/", f"<p>{legal}</p>"))
    rng = np.random.default_rng(5)
    for i in range(2001, 2060):
        words = [" ".join(f"w{w}" for w in rng.integers(0, 3, rng.integers(1, 25))) for _ in range(3)]
        rows.append((i, "//words.example/", "".join(f"<p>{w}</p>" for w in words) + "<nav>menu</nav>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(tasks)
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    for part in (rows[:2000], rows[2000:2001], rows[2001:]):
        want = html_text.main_texts([html_text.blocks(h) for *_, h in part], np.arange(len(part)))
        assert [got[i] for i, *_ in part] == want
    assert got[3] == "Page 3 tells of day 3." and got[2000] == legal


@pytest.mark.parametrize("tasks", [1, 7])
def test_runs_decide_inside_articles_too(spark, tasks):
    rng = np.random.default_rng(6)
    notice = "Like this story? Tell your friends about it and read more every morning."
    quoted = "Permission is granted to copy and share this text with anyone at no charge."

    def story():
        return " ".join(f"w{w}" for w in rng.integers(0, 10**6, 30))

    copied, twice = story(), story()
    own, rows = [story() for _ in range(12)], []
    for i, text in enumerate(own):  # a notice in 9 of 12 articles, a quotation in 5, all different otherwise
        rows.append(("//a/", text, [notice] * (i < 9), [quoted] * (i > 6)))
    rows += [("//b/", copied, [notice], [])] * 5 + [("//b/", own[0], [], [])]  # one text on most pages of its host
    rows += [("//c/", story(), [notice], []) for _ in range(3)]  # too few pages
    rows += [("//d/", twice, [], []), ("//d/", twice, [], []), ("//d/", own[1], [], [])]
    made = [
        (i, f"{u}{i}", f"<nav>x</nav><article><p>{text}</p>" + "".join(f"<p>{x}</p>" for x in (*a, *b)) + "</article>")
        for i, (u, text, a, b) in enumerate(rows)
    ]
    want = {i: "\n".join([text, *(a if u != "//a/" else []), *b]) for i, (u, text, a, b) in enumerate(rows)}
    # Four rows of one page are one page: nothing is on several.
    made += [(len(rows), "//e/", f"<article><p>{own[2]}</p><p>{notice}</p></article>")] * 4
    want[len(rows)] = f"{own[2]}\n{notice}"
    pages = spark.createDataFrame(made, "page_id long, url string, html string").repartition(tasks)
    got = html_text.extract(pages).collect()
    assert len(got) == len(made)
    assert {r["page_id"]: r["text"] for r in got} == want
    for host in "abcde":
        part = [(i, h) for i, u, h in made if u.startswith(f"//{host}/")]
        found = html_text.main_texts([html_text.blocks(h) for _, h in part], np.array([i for i, _ in part]))
        assert found == [want[i] for i, _ in part]


def test_suffixes_of_one_run_have_one_anchor():
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{w}" for w in rng.integers(0, 3, 200)) for _ in range(4)]
    streams, hosts = html_text.pa.array(texts), html_text.pa.array([1, 1, 2, 2], html_text.pa.int64())
    place, own, values, anchors, offsets = html_text._suffixes(streams, hosts, 8)
    assert len(place) == 4 * 193 and offsets.tolist() == [0, 200, 400, 600, 800]
    seen = {}
    for p, o, v, a in zip(place - offsets[own], own, values, anchors):
        run = (int(o) // 2, *texts[o].split()[p : p + 8])
        assert seen.setdefault(run, (v, a)) == (v, a)
    assert len({v for v, _ in seen.values()}) == len(seen)


def test_pages_of_an_empty_table(spark):
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline_stages_follow_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, after = pairs(docs), stage(spark, docs, SF).cache()
        assert after.columns == docs.columns
        left = dict(pairs(after))
        if name == "simhash_near_dedup":
            assert set(left) == {d for d, _, c in simhash.brute_force(before) if d == c}
        elif name == "substring_dedup":
            want = {d: (n, gone) for d, n, gone, _ in substring_dedup.brute_force(before)}
            assert set(left) == set(want)
            for d, text in before:
                n, gone = want[d]
                assert left[d] == text if not gone else len(left[d].split()) == n - gone
        else:
            assert set(left) <= {d for d, _ in before} and len(left) > 0.6 * len(before)
        docs = after
    placed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in placed.collect()} == {d for d, _ in pairs(docs)}


def test_pipeline_runs_from_the_entry(spark):
    from __spark_entry__ import queries

    assert set(queries()["pipeline"](spark, SF).columns) >= {"doc_id", "sequence_id", "offset"}


def test_pipeline_stages_take_odd_rows(spark, odd_docs, no_docs, tmp_path):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd_docs, SF).count() >= (0 if name == "quality_rules" else 1)
        assert stage(spark, no_docs, SF).count() == 0
