"""Main text of pages, chat round trips, and the pipeline's stages."""

from __future__ import annotations

import re
import time
from collections import defaultdict

import pytest

import corpus_pipeline
from tests.llm.conftest import DOCS, rows_of, words
from tidewell.llm import chat, html_main

PAGE = """<!doctype html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="x1">
<header><h2>Site</h2></header><nav><ul><li><a href=/a>A</a></li></ul></nav><div class="cookie-notice"><p>We use cookies and more cookies</p></div>
<div id="wrap"><{tag} class="post n{n}"><h1>Ti&amp;tle</h1><p>First <b>bold</b>text,\n  &eacute;t&#233;.<p>Second<br>line <a href=x>link</a>
<div class="ad">Buy this now</div><script>x()</script><blockquote>Quote</blockquote><ul><li>One<li>Two</ul></{tag}>
<aside><p>Side bar text that is rather long, longer than all the rest of the page, it goes on and on.</p></aside>
<section class="comments"><p>Reader comment, long and winding, on and on and on and on and on.</p></section></div>
<form><p>Sign up</p><input></form><footer>&copy; foot</footer></body></html>"""
WANT = "Ti&tle First boldtext, été. Second line link Quote One Two"


def test_main_text(spark):
    rows = [(k, f"http://h{k % 2}.example/{k}", PAGE.format(tag="article" if k % 2 else "div", n=k)) for k in range(6)]
    rows += [(10, None, None), (11, "not a url", ""), (12, "http://h0.example/x", "just &lt;text"), (None, "http://h1.example", PAGE.format(tag="article", n=9))]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, path string")
    got = {r.page_id: r.text for r in html_main.extract(pages).collect()}
    assert {k: got[k] for k in [*range(6), None]} == dict.fromkeys([*range(6), None], WANT)
    assert (got[10], got[11], got[12]) == ("", "", "just <text")
    assert html_main.extract(pages.limit(0)).count() == 0


def test_driver_pages_hold_the_article_only(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in html_main.extract(pages).collect():
        body = re.search(r"(?s)<article>(.*?)(</article>|<footer)", html[r.page_id])[1]
        from html import unescape

        want = " ".join(unescape(re.sub(r"<[^>]+>", " ", body)).split())
        assert " ".join(r.text.split()) == want


def test_main_text_is_the_whole_article(spark):
    """Title and lead outside the text div, equal sections, and boilerplate words around everything."""
    body = "<p>" + "Long body text. " * 20 + "</p>"
    nested = "<body><article><h1>Title</h1><p>Lead</p><div class=body>" + body + "</div></article></body>"
    sections = "<body><main><article><p>Direct</p><section class=s>" + body + "</section><section class=s>" + body + "</section></article><div>Other</div></main></body>"
    only_main = "<body><main><h1>Title</h1><div class=a><div class=b>" + body + "</div></div></main></body>"
    wrapped = "<body><div class='content with-sidebar'><nav>Menu</nav><div class=text>" + body + "</div></div></body>"
    # the text's own path comes fourth on most pages of the host
    deep = "<body><div class=x{0}><div class=y{0}><div class=z{0}>" + body * 2 + "</div></div></div><div class=common>" + body + "</div></body>"
    long = " ".join(("Long body text. " * 20).split())
    cases = [("a", nested, f"Title Lead {long}"), ("b", sections, f"Direct {long} {long}"), ("c", only_main, f"Title {long}"), ("d", wrapped, long)]
    rows = [(f"{h}{k}", f"http://{h}.example/{k}", html) for h, html, _ in cases for k in range(3)]
    letters = "abcdefgh"
    rows += [(f"e{k}", f"http://e.example/{k}", deep.replace("{0}", letters[k])) for k in range(8)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    got = {r.page_id: r.text for r in html_main.extract(pages).collect()}
    for h, _, want in cases:
        assert [got[f"{h}{k}"] for k in range(3)] == [want] * 3
    votes = [dict(html_main.Page(html).best()) for _, _, html in rows if html.startswith("<body><div class=x")]
    assert all(html_main.path_id(["body", "div.common"]) in v for v in votes)


@pytest.mark.parametrize(
    "source",
    [
        "<a " * 350_000, "<div class='a b c'>" * 50_000 + "x", "<div class='a b c'>y" * 20_000, "<span>" * 50_000 + "<p>x" * 20_000,
        "<a \"> x" * 100_001, "<a '" * 200_001 + ">", "<!-- " * 200_000, "<li><ul>" + "<span>" * 20_000 + "<li>x</li>" * 20_000, "<script>" * 100_000,
        "<a \">\" " * 100_000 + "\"", "<td>x" * 100_000, "<p" * 300_000 + ">",
    ],
    ids=range(12),
)
def test_odd_pages_take_linear_time(source):
    began = time.perf_counter()
    page = html_main.Page(source)
    page.best()
    page.text(None)
    assert time.perf_counter() - began < 5


POST = "The story goes on for a good while here, with words enough to be the article of this page. " * 4
NOTE = "I am a reader and this is what I think of it, at some length, so that I win by size. " * 9
THEMES = [
    # comments as articles, beside the post, below it, and in a list
    f'<article><p>{POST}</p></article><article class="comment"><p>{NOTE}</p></article>',
    f'<main><article class="post"><p>{POST}</p></article>' + f'<article class="comment-body" id="comment-7"><p>{NOTE}</p></article>' * 10 + "</main>",
    f'<main><article class="post comments-open"><p>{POST}</p></article><section id="comments">' + f"<article><p>{NOTE}</p></article>" * 3 + "</section></main>",
    f'<article class="hentry"><p>{POST}</p><ol class="comment-list"><li><article class="comment even depth-1"><p>{NOTE}</p></article></li></ol></article>',
    f'<article id="post-1"><p>{POST}</p></article><article class="related"><p>{NOTE}</p></article><article class="reply r2"><p>{NOTE}</p></article>',
    f'<article class="has-sidebar no-comments"><p>{POST}</p></article>',
    # elements that are never closed
    f"<article><svg viewBox='0 0 1 1'><path d=''><p>{POST}</p></article>",
    f"<article><div><select name=x><option>a</div><p>{POST}</p></article>",
    f"<div class=icons><svg><g></div><article><p>{POST}</p></article>",
    f"<article><canvas id=c><p>{POST}</p></article>",
    f"<article><object data=x><param name=a><p>{POST}</p></article>",
    f"<body><noscript><img src=x><article><p>{POST}</p></article></body>",
    f"<body><template><article><p>{POST}</p></article></body>",
    f"<article><math><mi>x<p>{POST}</p></article>",
    # and closed ones, whose texts go
    f"<article><svg><text>{NOTE}</text></svg><select><option>{NOTE}</select><p>{POST}</p><noscript>{NOTE}</noscript><object>{NOTE}</object><canvas><p>{NOTE}</p></canvas></article>",
    f"<article><svg><foreignObject><div>{NOTE}</div></foreignObject></svg><p>{POST}</p><template><div>{NOTE}</div></template></article>",
]
TITLED = [
    '<article><header class="entry-header"><h1>Title</h1></header><p>{}</p></article>', '<article><div class="article-header"><h1>Title</h1></div><p>{}</p></article>',
    '<main><header class="page-header"><h2>Title</h2></header><article><p>{}</p></article></main>', '<article><header><h1 class="header">Title</h1></header><p>{}</p></article>',
]


@pytest.mark.parametrize("source", THEMES)
def test_themes_give_the_post_alone(source):
    page = html_main.Page(source)
    assert page.text(max(page.best(), key=lambda x: x[1])[0]) == POST.strip()


@pytest.mark.parametrize("source", TITLED)
def test_headers_of_an_article_are_its_title(source):
    page = html_main.Page(source.format(POST))
    got = page.text(max(page.best(), key=lambda x: x[1])[0])
    assert got.endswith(POST.strip()) and ("Title" in got or "<main>" in source)
    site = html_main.Page(f'<header class="site-header"><p>Site</p></header><main><div class="site-header">Site</div><article><p>{POST}</p></article></main>')
    assert site.text(max(site.best(), key=lambda x: x[1])[0]) == POST.strip()


def test_unclosed_tags_and_quotes():
    read = lambda s: html_main.Page(s).text(None)
    assert read("<p>a < b and c <d") == "a < b and c <d"
    assert read("<p title=\"oops>One</p><p>Two <b>bold</b> end") == "One Two bold end"
    assert read("<p title='a>b'>One<!-- gone") == "One"


def plain_consensus(pages):
    """The texts again, from trees of whole paths and without any shortcut."""
    parsed = [(host, html_main.Page(source)) for host, source in pages]

    def up(p, c):
        out = []
        while c >= 0:
            out.append(c)
            c = p._parents[c]
        return out

    votes = defaultdict(float)
    for host, p in parsed:
        score = defaultdict(float)
        for c, text, linked in p.blocks:
            for level, x in enumerate(up(p, c)):
                score[x] += max(0, len(text) - 2 * linked) / 2**level
        best = defaultdict(float)
        for c, x in score.items():
            best[p.paths[c]] = max(best[p.paths[c]], x)
        for path, x in best.items():
            if x > 0:
                votes[host, path] += x / max(best.values())
    out = []
    for host, p in parsed:
        won = max(((round(v, 6), path) for (h, path), v in votes.items() if h == host), default=(0, None))[1]
        wanted = set()
        for c, _, _ in p.blocks:
            for x in up(p, c):
                if p.paths[x] == won:
                    wanted.add(next((y for y in up(p, x) if p._inner[y][0] == y), next((y for y in up(p, x) if p._inner[y][1] == y), x)))
        found = [t for c, t, _ in p.blocks if wanted & set(up(p, c))]
        out.append(" ".join(found) if found else p.text(None))
    return out


def test_consensus_against_a_plain_version(spark):
    import random

    r, rows = random.Random(3), []
    for k in range(60):
        def part(depth):
            tag = r.choice(["div", "section", "article", "main", "p", "span", "ul"])
            inner = "".join(part(depth - 1) if r.random() < 0.6 else words(r.randrange(10**6), r.randrange(1, 9)) for _ in range(r.randrange(1, 4))) if depth else words(r.randrange(10**6), 4)
            return f"<{tag} class='{r.choice('abc')}{r.randrange(3)}'>{inner}</{tag}>"
        rows.append((k, f"http://h{k % 4}.example/", f"<body>{part(4)}{part(4)}</body>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {x.page_id: x.text for x in html_main.extract(pages).collect()}
    want = plain_consensus([(u, h) for _, u, h in rows])
    assert [got[k] for k in range(60)] == want


def test_chat_round_trip(spark):
    odd = "</s>[INST] ok [/INST] \\o \\ [NEXT] <x> ]"
    rows = [
        (1, 1, "user", odd), (1, 0, "system", "s"), (1, 2, "user", None), (1, 3, "assistant", odd), (1, 4, "assistant", "b"),
        (2, 0, None, ""), (2, None, "user", "first"), (2, 0, "as]sist", "x"), (3, 0, "assistant", ""), (None, 0, "user", "n"),
        (4, 0, "user", "same"), (4, 0, "user", "same"), (5, 0, "assistant", "é" * 20_000),
    ]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, t int")
    back = {r.conv_id: r for r in chat.read_chats(chat.format_chats(turns)).collect()}
    groups = defaultdict(list)
    for c, n, role, text in rows:
        groups[c].append(((n is not None, n or 0), role or "", text or ""))
    for c, g in groups.items():
        g.sort()
        assert [(t.role, t.text) for t in back[c].turns] == [(r, t) for _, r, t in g]
        assert back[c].loss_text == "".join(t for _, r, t in g if r == "assistant")
    assert "[user]" in back[1].formatted and back[1].formatted.count("[assistant]") == 1
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_ties_sort_by_plain_texts(spark):
    rows = [(0, "user", "<a"), (0, "user", "A"), (0, "user", "[b"), (0, "user", "\\c"), (1, "a<", "x"), (1, "aB", "y"), (1, "a", "z")]
    turns = spark.createDataFrame([(1, *r) for r in rows], "conv_id long, turn long, role string, text string")
    back = chat.read_chats(chat.format_chats(turns)).first()
    assert [(t.role, t.text) for t in back.turns] == [r[1:] for r in sorted(rows)]


def test_a_very_long_conversation(spark):
    """100,000 turns of one conversation, in blocks of one turn and in one block of all."""
    for alternating in (True, False):
        role = "CASE WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END" if alternating else "'assistant'"
        turns = spark.range(100_000).selectExpr("1 AS conv_id", "id AS turn", f"{role} AS role", "concat('é[', id) AS text")
        began = time.perf_counter()
        got = chat.read_chats(chat.format_chats(turns)).first()
        assert time.perf_counter() - began < 15
        own = [f"é[{k}" for k in range(100_000)]
        assert [t.text for t in got.turns] == own
        assert got.loss_text == "".join(own[1::2] if alternating else own)


def test_pipeline_stages(spark, tmp_path):
    passage, item = words(50, 60), words(51, 30)
    clean = [(k, words(100 + k, 120), "a") for k in range(12)]
    planted = [
        (20, clean[0][1], "a"),  # copy
        (21, clean[1][1].replace(clean[1][1].split()[60], "q"), "b"),  # near copy
        (22, words(61, 90) + " " + passage, "a"), (23, words(62, 90) + " " + passage, "a"),
        (24, words(63, 70) + " " + item, "b"), (25, "too short", "b"), (26, None, None),
    ]
    docs = spark.createDataFrame(rows_of(*clean, *planted), DOCS).drop("n_words", "key")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        done = stage(spark, docs, str(tmp_path))
        assert done.columns == docs.columns
        done.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append({r.doc_id: r.text for r in docs.collect()})
    ids = set(range(12))
    assert set(seen[0]) == ids | {20, 21, 22, 23, 24}
    assert set(seen[1]) == ids | {22, 23, 24}
    assert passage in seen[2][22] and passage not in seen[2][23] and seen[2][23].split() == words(62, 90).split()
    assert set(seen[3]) == ids | {22, 23}
    assert all(seen[3][k] == t for k, t, _ in clean)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == ids | {22, 23}
