"""Stems, query language, matching, ranking and cover density against plain versions."""

from __future__ import annotations

import math
import random

import pytest

from tidewell.functions.stem import stem, terms
from tidewell.operators import fulltext
from tidewell.operators.fulltext import AND, FIELDS, NOT, OR, parse

ARTICLES = "id long, feed_id long, title string, summary string, content string, linked_content string, score double, size int"


def articles_of(spark, rows):
    """(id, feed, title, summary, content, linked) with clashing columns beside them."""
    return spark.createDataFrame([(*r, 0.5, 3) for r in rows], ARTICLES)


def queries_of(spark, *texts, user=None):
    return spark.createDataFrame([(k, user, t) for k, t in enumerate(texts)], "query_id long, user_id long, query string")


def feeds_of(spark, *pairs):
    return spark.createDataFrame(list(pairs), "user_id long, feed_id long")


# --- stems ------------------------------------------------------------------------

#: Examples of the published description of the algorithm.
STEMS = (
    "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat "
    "troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky "
    "relational relat conditional condit rational ration digitizer digit operator oper feudalism feudal decisiveness decis hopefulness hope "
    "formality formal sensitivity sensit triplicate triplic formative form formalize formal electrical electr goodness good revival reviv "
    "allowance allow airliner airlin adjustable adjust irritant irrit replacement replac adoption adopt activate activ effective effect "
    "probate probat rate rate cease ceas controlling control roll roll yes ye by by generalizations gener"
).split()


@pytest.mark.parametrize("word,want", list(zip(STEMS[::2], STEMS[1::2], strict=True)))
def test_stems(word, want):
    assert stem(word) == want


def test_terms_are_folded():
    assert terms("Élan's RUNNING, naïve_words 東京 1990s!") == ["elan", "s", "run", "naiv", "word", "東京", "1990"]
    assert terms(None) == terms("") == terms("!?") == []
    assert stem("x" * 65 + "ing") == "x" * 65 + "ing"


# --- query language -----------------------------------------------------------------


def words_of(query):
    leaves, program = parse(query)
    return [" ".join(t) + "*" * p for t, p, _, _ in leaves], program


def test_precedence():
    assert words_of("a b OR c AND d NOT e") == (["a", "b", "c", "d", "e"], [0, 1, AND, 2, 3, 4, NOT, AND, OR])
    assert words_of("(a OR b) AND c") == (["a", "b", "c"], [0, 1, OR, 2, AND])
    assert words_of("a NOT b c") == (["a", "b", "c"], [0, 1, 2, AND, NOT])
    assert words_of("a NOT b NOT c")[1] == [0, 1, NOT, 2, NOT]
    assert words_of("running runs RUN") == (["run"], [0, 0, AND, 0, AND])
    assert words_of("and or not") == (["and", "or", "not"], [0, 1, AND, 2, AND])


def test_phrases_prefixes_and_columns():
    assert words_of('"one ""two"" three" four* "five si" *') == (["on two three", "four*", "five si*"], [0, 1, AND, 2, AND])
    assert words_of("one + two + three*")[0] == ["on two three*"]
    assert parse("^one")[0] == [(("on",), False, True, tuple(FIELDS))]
    assert [x[3] for x in parse("title : a {summary content}: b -title: c d")[0]] == [("title",), ("summary", "content"), tuple(FIELDS[1:]), tuple(FIELDS)]
    assert [x[3] for x in parse("title : (a OR content : b)")[0]] == [("title",), ()]
    assert words_of("foo_bar baz")[0] == ["foo bar", "baz"]


def test_words_that_are_no_words_are_left_out():
    assert parse('"!!" OR a') == ([(("a",), False, False, tuple(FIELDS))], [0])
    assert parse('a NOT "!!"')[1] == [0] and parse('"!!" NOT a')[1] == [] and parse("") == parse(None) == parse("  ") == ([], [])


@pytest.mark.parametrize("query", ["C++ code", "a AND", "AND b", "(a", "a)", "what?", 'say "hi', "a OR OR b", "nope : x", "(a) b", "-x", "it's", "NOT a", "^", "(" * 3000 + "a"])
def test_broken_syntax_is_one_phrase(query):
    leaves, program = parse(query)
    assert program == [0] and leaves == [(tuple(terms(query)), False, False, tuple(FIELDS))] or not terms(query) and program == []


# --- matching ----------------------------------------------------------------------------


def plain_search(rows, query):
    """(article, score) by reading every article."""
    leaves, program = parse(query)
    texts = {r[0]: {f: terms(t) for f, t in zip(FIELDS, (r[2], r[3], r[4], r[5]), strict=True)} for r in rows}
    size = {d: sum(map(len, t.values())) for d, t in texts.items()}
    times = {}
    for d, by_field in texts.items():
        for k, (words, prefix, first, fields) in enumerate(leaves):
            n = 0
            for f in fields:
                t = by_field[f]
                for at in range(len(t) - len(words) + 1):
                    same = list(t[at : at + len(words) - prefix]) == list(words[: len(words) - prefix])
                    n += same and (not prefix or t[at + len(words) - 1].startswith(words[-1])) and (not first or at == 0)
            if n:
                times[d, k] = n
    df = [sum((d, k) in times for d in texts) for k in range(len(leaves))]
    average, out = sum(size.values()) / max(1, len(size)), {}
    for d in texts:
        stack = []
        for op in program:
            if op >= 0:
                stack.append((d, op) in times)
            else:
                b, a = stack.pop(), stack.pop()
                stack.append(a and b if op == AND else a or b if op == OR else a and not b)
        if stack and stack[0]:
            out[d] = sum(
                max(math.log((len(texts) - df[k] + 0.5) / (df[k] + 0.5)), 1e-6) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * size[d] / average))
                for k in range(len(leaves)) if (n := times.get((d, k)))
            )
    return {d: round(v, 8) for d, v in out.items()}


def made_articles(seed, n):
    r = random.Random(seed)
    text = lambda k: " ".join(r.choice("a b c d running runs ran Élan elan the the the x1 x2".split()) for _ in range(r.randint(0, k)))
    return [(k, k % 3, text(4), text(6) if k % 4 else None, text(30), text(5) if k % 2 else None) for k in range(n)]


QUERIES = [
    "a", "run", "a b", "a AND b NOT c", "a OR d", '"a b"', '"the the"', '"the the the"', "x*", "el*", "a NOT x*", '"a the" OR "b the"', "^the", "title : a",
    "{title summary} : the", "-content : the", '"a x" *', "(a OR b) AND (c OR d) NOT run", "nothing", "", None, "a )", 'title : "a b" OR content : ^c', "a b c d run elan x1",
]


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, {})[r.article_id] = round(r.score, 8)
    return out


def test_search_against_reading_everything(spark):
    rows = [*made_articles(1, 60), (100, 0, None, None, None, None), (101, 0, "", "", "", "")]
    articles = articles_of(spark, rows)
    index = fulltext.build(articles, buckets=3)
    got = found(fulltext.search(queries_of(spark, *QUERIES), index, articles, feeds_of(spark, (1, 1)), limit=None))
    want = {k: w for k, q in enumerate(QUERIES) if (w := plain_search(rows, q))}
    assert len(want) > 15 and got == want


def test_subscriptions_limits_and_order(spark):
    rows = made_articles(2, 60)
    articles = articles_of(spark, rows)
    index, feeds = fulltext.build(articles), feeds_of(spark, (7, 1), (7, 1), (8, 0), (8, 2))
    every = plain_search(rows, "x1 OR x2")
    for user, fits in ((7, {1}), (8, {0, 2}), (9, set())):
        ranked = fulltext.search(queries_of(spark, "x1 OR x2", user=user), index, articles, feeds, limit=5, offset=2).collect()
        own = sorted(((-s, d) for d, s in every.items() if d % 3 in fits))[2:7]
        assert [(r.article_id, r.rank) for r in sorted(ranked, key=lambda r: r.rank)] == [(d, k) for k, (_, d) in enumerate(own, 3)]


def test_search_finds_subscribed_articles_only(spark):
    rows = [
        (1, 1, "Go programming language", None, "Go is a statically typed language designed at Google.", None), (2, 1, "Rust memory safety", None, "Rust prevents memory errors at compile time.", None),
        (3, 1, "Python data science", None, "Python is popular for data analysis and machine learning.", None), (4, 2, "Go in other feed", None, "Go content in unsubscribed feed.", None),
    ]
    articles = articles_of(spark, rows)
    got = found(fulltext.search(queries_of(spark, "Go", "memory", "kubernetes", "Go programming", "error", user=1), fulltext.build(articles), articles, feeds_of(spark, (1, 1))))
    assert {k: set(v) for k, v in got.items()} == {0: {1}, 1: {2}, 3: {1}, 4: {2}}


def test_empty_tables(spark):
    articles = articles_of(spark, [])
    index = fulltext.build(articles)
    assert fulltext.search(queries_of(spark, "a", "b*"), index, articles, feeds_of(spark, (1, 1))).count() == 0
    some = articles_of(spark, made_articles(3, 5))
    assert fulltext.search(queries_of(spark).limit(0), fulltext.build(some), some, feeds_of(spark, (1, 1))).count() == 0
    assert fulltext.cover_density(queries_of(spark, "a"), index, articles, feeds_of(spark, (1, 1))).count() == 0


# --- cover density -------------------------------------------------------------------------


def all_covers(events, n_leaves):
    """Intervals between any two occurrences that hold every leaf and hold no smaller such interval."""

    def inside(s, e):
        return [x for x in events if x[1] >= s and x[0] <= e]

    spans = {(b, e) for _, b, _, _ in events for e, _, _, _ in events if b <= e and len({x[2] for x in inside(b, e)}) == n_leaves}
    least = [(b, e) for b, e in spans if not any((c, d) != (b, e) and b <= c and d <= e for c, d in spans)]
    return sorted((b, e, len(inside(b, e)), sum(x[3] for x in inside(b, e))) for b, e in least)


def test_covers_against_all_intervals():
    r = random.Random(5)
    for k in range(3000):
        leaves = r.randint(1, 4)
        at = r.sample(range(40), r.randint(0, 14))
        events = sorted((p, p, r.randrange(leaves), r.choice([1.0, 2.5, 5.0])) for p in at)
        if k % 3 == 0 and events:  # two leaves at one place, as a word and its prefix
            events = sorted(events + [(events[0][0], events[0][1], (events[0][2] + 1) % leaves, 1.0)]) if leaves > 1 else events
        got = fulltext.covers(events, leaves)
        assert [g[:2] for g in got] == [w[:2] for w in all_covers(events, leaves)], events
        if len({e[0] for e in events}) == len(events):
            assert [(g[2], round(g[3], 9)) for g in got] == [(w[2], round(w[3], 9)) for w in all_covers(events, leaves)]


def test_closer_words_score_higher(spark):
    rows = [(1, 1, None, None, "alpha beta", None), (2, 1, None, None, "alpha x x x beta", None), (3, 1, "alpha beta", None, None, None), (4, 1, None, None, "alpha beta alpha", None), (5, 1, None, None, "alpha", None)]
    articles = articles_of(spark, rows)
    got = fulltext.cover_density(queries_of(spark, "alpha beta", user=1), fulltext.build(articles), articles, feeds_of(spark, (1, 1)))
    assert {r.article_id: (r.n_covers, round(r.score, 6)) for r in got.collect()} == {1: (1, 0.2), 2: (1, 0.05), 3: (1, 1.0), 4: (2, 0.4)}


def test_folding_leaves_marks_out_one_by_one():
    """The same as a look at each character, marks outside the first plane included."""
    import unicodedata

    from tidewell.functions.stem import fold

    text = "Élan à l'œuvre Straße İÇ á̂b \U0001e8d0x़y [-^]\\ ְ"
    assert fold(text) == "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")


def test_leaves_of_one_term_need_no_shuffle(spark):
    """Their places are the postings' own; phrases and prefixes are still put together."""
    articles = spark.createDataFrame([(1, "ab cd ab", "cd"), (2, "abc", None)], "id long, title string, content string")
    index = fulltext.build(articles)

    def plan(query: str) -> tuple[str, list]:
        read = fulltext.parsed(spark.createDataFrame([(1, None, query)], "query_id long, user_id long, query string"))
        hits = fulltext.leaf_hits(read, index)
        return hits._jdf.queryExecution().optimizedPlan().toString(), sorted((r.article_id, r.field, r.at) for r in hits.collect())

    text, rows = plan("ab OR cd")
    assert "Aggregate" not in text and rows == [(1, "content", [0]), (1, "title", [0, 2]), (1, "title", [1])]
    assert plan("ab*")[1] == [(1, "title", [0, 2]), (2, "title", [0])] and plan('"cd ab"')[1] == [(1, "title", [1])]
