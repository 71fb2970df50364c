"""Full-text search: a positional inverted index, a query language over it, and ranking.

*Index.*  One row per (term, article, field) with the positions of the term in the field,
and one per article with its size.
Terms are stems; they are made in Arrow batches, article by article, so that building
needs no shuffle but the one that deals rows to buckets of terms.  A bucket is a folder
of the index: a search reads the buckets and row groups of its terms only.

*Queries* come as a table (query_id, user_id, query), any number at once.  Words, "phrases",
prefix*, ^first, column filters (``title: x``, ``{title summary}: x``, ``-title: x``), AND, OR,
NOT and parentheses are turned into leaves, phrases of one or more terms, and a program
that combines them.  Leaves become joins with the postings, phrases an intersection of
shifted positions, and the program is evaluated per article that some leaf has found.
A query that breaks the syntax is read again as one phrase.

*Ranking* is BM25 over leaves (each weighs by the articles it is found in), or cover
density: the intervals that hold every leaf and no smaller one that does.

Defined cases: null fields are empty; a null or empty query finds nothing, and a phrase
without words is left out; articles with a null id are not indexed; repeated article ids
are an error of the caller's (``segments`` replaces articles by id).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewell.functions.stem import terms
from tidewell.plans.scratch import broadcast_if_small, materialize

#: Indexed fields in order, and the weights of cover density; fixed values.
FIELDS = ["title", "summary", "content", "linked_content"]
WEIGHTS = {"title": 1.0, "summary": 0.4, "content": 0.2, "linked_content": 0.1}
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Folders of an index; a bucket is read whole only where most of its terms are asked for.
BUCKETS = 16
#: The bucket of the rows that hold articles' sizes.
SIZES = -1
AND, OR, NOT = -1, -2, -3
_POSTINGS = "term string, article_id long, field string, start int, size int, positions array<int>"
_LEAVES = "query_id long, user_id long, program array<int>, leaves array<struct<terms: array<string>, prefix: boolean, first: boolean, fields: array<string>>>"


# --- index ---------------------------------------------------------------------


def _invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(article_id, fields...) to postings, and a row of a null term with each article's size."""
    names = [c.split()[0] for c in _POSTINGS.split(", ")]
    fields = pa.array([*FIELDS, None], pa.string())
    for batch in batches:
        # columns are filled by whole fields, and what all rows of a field share is spread by their number
        found: list[str | None] = []
        places: list[int] = []
        sizes: list[int] = []
        runs: list[tuple[int, int, int, int, int]] = []  # rows, article, field, start, size
        for article, *texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            split = [terms(t) for t in texts]
            size, start = sum(map(len, split)), 0
            found.append(None)
            sizes.append(0)
            runs.append((1, article, len(FIELDS), 0, size))
            for field, words in enumerate(split):
                at: dict[str, list[int]] = {}
                for k, w in enumerate(words):
                    at.setdefault(w, []).append(k)
                found += at
                sizes += map(len, at.values())
                places += chain.from_iterable(at.values())
                runs.append((len(at), article, field, start, size))
                start += len(words)
        n, *shared = np.array(runs, np.int64).reshape(-1, 5).T
        article, field, start, size = (np.repeat(c, n) for c in shared)
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))]).astype(np.int32))
        positions = pa.ListArray.from_arrays(offsets, pa.array(np.array(places, np.int32)))
        columns = [pa.array(found, pa.string()), pa.array(article), fields.take(pa.array(field)), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), positions]
        yield pa.RecordBatch.from_arrays(columns, names)


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def postings_of(articles: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Postings of ``articles`` (id and the indexed fields), with their bucket."""
    texts = [(F.col(f) if f in articles.columns else F.lit(None)).cast("string").alias(f) for f in FIELDS]
    made = articles.where("id IS NOT NULL").select("id", *texts).mapInArrow(_invert, _POSTINGS)
    return made.withColumn("bucket", F.when(F.col("term").isNull(), SIZES).otherwise(bucket_of(F.col("term"), buckets)))


def dealt(postings: DataFrame) -> DataFrame:
    """Rows of a bucket together, terms in order; a bucket that outgrows the others is cut up."""
    return postings.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term")


class Index:
    """Postings that may be searched: one written table, or the live part of many segments."""

    def __init__(self, postings: DataFrame, buckets: int = BUCKETS) -> None:
        self.postings, self.buckets = postings, buckets

    def sizes(self) -> DataFrame:
        """(n, average): articles, and their mean number of words."""
        return self.postings.where(F.col("bucket") == SIZES).agg(F.count(F.lit(1)).cast("double").alias("n"), F.coalesce(F.avg("size"), F.lit(0.0)).alias("average"))

    def vocabulary(self) -> DataFrame:
        return self.postings.where(F.col("bucket") != SIZES).select("term").distinct()


def build(articles: DataFrame, buckets: int = BUCKETS, label: str = "index") -> Index:
    """The index of a table of articles, as a scratch table."""
    return Index(materialize(dealt(postings_of(articles, buckets)), label), buckets)


# --- query language -----------------------------------------------------------------

_TOKEN = re.compile(r'\s*(?:"((?:[^"]|"")*)"|(AND|OR|NOT)(?![0-9A-Za-z_\x80-\U0010FFFF])|([0-9A-Za-z_\x1a\x80-\U0010FFFF]+)|([(){}:*+^-]))')
Leaf = tuple[tuple[str, ...], bool, bool, tuple[str, ...]]


class _Reader:
    """Leaves and postfix program of one query, by recursive descent."""

    def __init__(self, query: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        at, query = 0, query.rstrip()
        while at < len(query):
            m = _TOKEN.match(query, at)
            if not m:
                raise SyntaxError(f"unexpected character at {at}")
            kind = ("quoted", "operator", "word", "mark")[next(k for k in range(4) if m[k + 1] is not None)]
            self.tokens.append((kind, m[m.lastindex].replace('""', '"') if kind == "quoted" else m[m.lastindex]))
            at = m.end()
        self.at, self.leaves = 0, []

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "")

    def take(self, *wanted: tuple[str, str]) -> bool:
        if self.peek() in wanted:
            self.at += 1
            return True
        return False

    def need(self, mark: str) -> None:
        if not self.take(("mark", mark)):
            raise SyntaxError(f"{mark} expected")

    def whole(self) -> list[int]:
        program = self.operators(0, FIELDS)
        if self.at < len(self.tokens):
            raise SyntaxError("an operator is missing")
        return program

    def operators(self, level: int, fields: list[str]) -> list[int]:
        """OR binds loosest, then AND, then NOT; words side by side bind closest."""
        if level == 3:
            return self.side_by_side(fields)
        word, code = (("OR", OR), ("AND", AND), ("NOT", NOT))[level]
        left = self.operators(level + 1, fields)
        while self.take(("operator", word)):
            left = self.joined(left, self.operators(level + 1, fields), code)
        return left

    @staticmethod
    def joined(left: list[int], right: list[int], code: int) -> list[int]:
        """A side without words is left out; nothing remains of NOT if its left side has none."""
        if not left or not right:
            return left if code == NOT else left or right
        return [*left, *right, code]

    def side_by_side(self, fields: list[str]) -> list[int]:
        if self.take(("mark", "(")):
            inner = self.operators(0, fields)
            self.need(")")
            return inner
        found, n = [], 0
        while self.peek()[0] in ("word", "quoted") or self.peek() in (("mark", "^"), ("mark", "{"), ("mark", "-")):
            own = self.columns(fields)
            if own is not None and self.peek() == ("mark", "("):
                if n:
                    raise SyntaxError("an operator is missing")
                return self.side_by_side(own)
            found = self.joined(found, self.phrase(fields if own is None else own), AND)
            n += 1
        if not n:
            raise SyntaxError("a word is missing")
        return found

    def columns(self, fields: list[str]) -> list[str] | None:
        """A column filter, if one stands here."""
        but, names = self.peek() == ("mark", "-"), []
        first = self.peek(but)
        if first == ("mark", "{"):
            self.at += 1 + but
            while self.peek()[0] in ("word", "quoted"):
                names.append(self.peek()[1])
                self.at += 1
            self.need("}")
        elif first[0] in ("word", "quoted") and self.peek(1 + but) == ("mark", ":"):
            names = [first[1]]
            self.at += 1 + but
        elif but:
            raise SyntaxError("a column is missing")
        else:
            return None
        self.need(":")
        names = [x.lower() for x in names]
        if set(names) - set(FIELDS):
            raise SyntaxError(f"no such column: {names}")
        return [f for f in fields if (f in names) != but]

    def phrase(self, fields: list[str]) -> list[int]:
        first, words, prefix = self.take(("mark", "^")), [], False
        while True:
            kind, text = self.peek()
            if kind not in ("word", "quoted"):
                raise SyntaxError("a word is missing")
            self.at += 1
            words += terms(text)
            prefix = self.take(("mark", "*"))
            if not self.take(("mark", "+")):
                break
        if not words:
            return []
        leaf = (tuple(words), prefix, first, tuple(fields))
        if leaf not in self.leaves:
            self.leaves.append(leaf)
        return [self.leaves.index(leaf)]


def parse(query: str | None) -> tuple[list[Leaf], list[int]]:
    """Leaves and program of a query; one that breaks the syntax is one phrase."""
    if not (query or "").strip():
        return [], []
    try:
        reader = _Reader(query)
        program = reader.whole()
    except (SyntaxError, RecursionError):
        reader = _Reader('"' + query.replace('"', '""') + '"')
        program = reader.whole()
    return reader.leaves, program


def parsed(queries: DataFrame) -> DataFrame:
    """(query_id, user_id, program, leaves) of (query_id, user_id, query)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves, programs = zip(*map(parse, batch.column(2).to_pylist()), strict=True) if len(batch) else ((), ())
            shape = pa.struct([("terms", pa.list_(pa.string())), ("prefix", pa.bool_()), ("first", pa.bool_()), ("fields", pa.list_(pa.string()))])
            rows = [[dict(zip(("terms", "prefix", "first", "fields"), x, strict=True)) for x in found] for found in leaves]
            columns = [batch.column(0), batch.column(1), pa.array(programs, pa.list_(pa.int32())), pa.array(rows, pa.list_(shape))]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "user_id", "program", "leaves"])

    typed = [F.col(c).cast("long").alias(c) for c in ("query_id", "user_id")]
    return queries.select(*typed, F.col("query").cast("string").alias("query")).mapInArrow(run, _LEAVES)


# --- matching ---------------------------------------------------------------------------


def _wanted(read: DataFrame, index: Index) -> DataFrame:
    """(query_id, leaf, k, term, n_terms, first, fields, kind, bucket): the terms of every leaf, prefixes spelled out.

    ``kind`` is 0 for a leaf of one term, 1 for one prefix, which may stand for several, 2 for a phrase.
    """
    leaves = read.select("query_id", F.posexplode("leaves").alias("leaf", "x"))
    each = leaves.select("query_id", "leaf", F.size("x.terms").alias("n_terms"), "x.first", "x.fields", "x.prefix", F.posexplode("x.terms").alias("k", "term"))
    is_prefix = F.col("prefix") & (F.col("k") == F.col("n_terms") - 1)
    exact, prefixes = each.where(~is_prefix), each.where(is_prefix).withColumnsRenamed({"term": "begin"})
    lengths = prefixes.agg(F.sort_array(F.collect_set(F.length("begin"))).alias("lengths"))
    begun = index.vocabulary().join(F.broadcast(lengths)).select("term", F.explode("lengths").alias("n"))  # as many as there are lengths
    begun = begun.where(F.length("term") >= F.col("n")).select("term", F.expr("left(term, n)").alias("begin"))
    spelled = begun.join(broadcast_if_small(prefixes), "begin")
    columns = ["query_id", "leaf", "k", "term", "n_terms", "first", "fields"]
    kind = F.when(F.col("n_terms") > 1, 2)
    return exact.select(*columns, kind.otherwise(0).alias("kind")).union(spelled.select(*columns, kind.otherwise(1).alias("kind"))).withColumn("bucket", bucket_of(F.col("term"), index.buckets))


def leaf_hits(read: DataFrame, index: Index) -> DataFrame:
    """(query_id, leaf, article_id, field, start, size, n_terms, at): where each leaf's phrase begins in each field."""
    wanted = materialize(_wanted(read, index), "wanted")
    kinds = {r.kind for r in wanted.select("kind").distinct().collect()}  # three at most
    wanted = broadcast_if_small(wanted)
    found = index.postings.join(wanted, ["bucket", "term"]).where(F.array_contains("fields", F.col("field")))
    began = F.transform("positions", lambda p: p - F.col("k"))
    found = found.select("query_id", "leaf", "article_id", "field", "start", "size", "n_terms", "first", "kind", "k", began.alias("at"))
    keys = ["query_id", "leaf", "article_id", "field"]
    whole = [F.max(c).alias(c) for c in ("start", "size", "n_terms", "first")]
    # A term has one row in a field: its places are the leaf's.
    alone = found.where("kind = 0").select(*keys, "start", "size", "n_terms", "first", "at")
    # One shuffle serves both steps: places of a term (several terms if a prefix was spelled out), then of the phrase.
    single = found.where("kind = 1").groupBy(keys).agg(*whole, F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("at"))
    dealt = found.where("kind = 2").repartition(*keys)
    places = dealt.groupBy(*keys, "k").agg(*whole, F.flatten(F.collect_list("at")).alias("at"))
    lists = places.groupBy(keys).agg(*whole, F.collect_list("at").alias("lists")).where(F.size("lists") == F.col("n_terms"))
    common = F.reduce(F.slice("lists", 2, F.size("lists")), F.get("lists", F.lit(0)), lambda a, x: F.array_intersect(a, x))
    steps = {0: alone, 1: single, 2: lists.withColumn("at", F.array_sort(common)).drop("lists")}
    hits = reduce(DataFrame.unionByName, [steps[k] for k in sorted(kinds)] or [alone])
    hits = hits.withColumn("at", F.when(F.col("first"), F.filter("at", lambda p: p == 0)).otherwise(F.col("at")))
    return hits.where(F.size("at") > 0).drop("first")


def holds(program: Column, leaves: Column) -> Column:
    """Whether a program is true of the leaves found in an article."""

    def step(stack: Column, op: Column) -> Column:
        left, right = F.element_at(stack, -2), F.element_at(stack, -1)
        value = F.when(op == AND, left & right).when(op == OR, left | right).otherwise(left & ~right)
        return F.when(op >= 0, F.concat(stack, F.array(F.array_contains(leaves, op)))).otherwise(F.concat(F.slice(stack, 1, F.size(stack) - 2), F.array(value)))

    values = F.aggregate(program, F.array().cast("array<boolean>"), step)
    return (F.size(program) > 0) & F.get(values, F.lit(0))


def matches(read: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, user_id, article_id, score parts): articles for which a query's program holds.

    ``hits`` is written once; it is read for the leaves' articles and for the articles' leaves.
    """
    each = hits.groupBy("query_id", "article_id", "leaf").agg(F.sum(F.size("at")).alias("times"), F.max("size").alias("size"))
    each = materialize(each, "leaf-articles")
    df = each.groupBy("query_id", "leaf").agg(F.count(F.lit(1)).alias("df"))
    by_leaf = each.join(broadcast_if_small(df), ["query_id", "leaf"])
    found = by_leaf.groupBy("query_id", "article_id").agg(F.max("size").alias("size"), F.collect_list(F.struct("leaf", "times", "df")).alias("found"))
    programs = broadcast_if_small(read.select("query_id", "user_id", "program"))
    return found.join(programs, "query_id").where(holds(F.col("program"), F.col("found.leaf"))).drop("program")


def scoped(found: DataFrame, articles: DataFrame, user_feeds: DataFrame) -> DataFrame:
    """Only articles of feeds that the query's user is subscribed to; a null user sees all."""
    feed = articles.select(F.col("id").alias("article_id"), "feed_id")
    placed = found.join(feed, "article_id")
    mine = user_feeds.select(F.col("user_id").alias("u"), F.col("feed_id").alias("f")).distinct()
    own = placed.join(mine, (F.col("user_id") == F.col("u")) & (F.col("feed_id") == F.col("f")), "left_semi")
    return own.unionByName(placed.where("user_id IS NULL")).drop("feed_id")


def bm25_of(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """``found`` with its BM25 ``score``: leaves are the terms, frequent leaves keep a least weight."""

    def weight(x: Column) -> Column:
        idf = F.greatest(F.log((F.col("n") - x["df"] + 0.5) / (x["df"] + 0.5)), F.lit(LEAST_IDF))
        norm = K1 * (1 - B + B * F.col("size") / F.greatest("average", F.lit(1e-9)))
        return idf * x["times"] * (K1 + 1) / (x["times"] + norm)

    total = F.aggregate(F.array_sort("found"), F.lit(0.0), lambda a, x: a + weight(x))
    return found.join(F.broadcast(sizes)).withColumn("score", total).drop("n", "average")


def top(found: DataFrame, limit: int | None, offset: int = 0) -> DataFrame:
    """(query_id, article_id, score, rank): best first, ties by id; ranks count from 1."""
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "article_id")
    ranked = found.select("query_id", "article_id", "score", F.row_number().over(best).alias("rank"))
    return ranked.where((F.col("rank") > offset) & (F.lit(True) if limit is None else F.col("rank") <= offset + limit))


def search(queries: DataFrame, index: Index, articles: DataFrame, user_feeds: DataFrame, limit: int | None = 20, offset: int = 0) -> DataFrame:
    """(query_id, article_id, score, rank) of (query_id, user_id, query): BM25, within the user's subscriptions."""
    read = materialize(parsed(queries), "queries")
    found = scoped(matches(read, leaf_hits(read, index)), articles, user_feeds)
    return top(bm25_of(found, index.sizes()), limit, offset)


# --- cover density ------------------------------------------------------------------------


def covers(events: list[tuple[int, int, int, float]], n_leaves: int) -> list[tuple[int, int, int, float]]:
    """Minimal intervals that hold every leaf: (begin, end, occurrences inside, sum of 1 / weight).

    ``events``: (end, begin, leaf, 1 / weight) of each occurrence, in order.  One pass: the
    last occurrence of each leaf is kept with the sums before it, and an interval is given
    up as soon as a later end moves its begin.
    """
    last: dict[int, tuple[int, int, float]] = {}
    out, held, reached, n, inverse = [], None, -1, 0, 0.0
    for end, begin, leaf, w in events:
        last[leaf] = (begin, n, inverse)
        n, inverse = n + 1, inverse + w
        if len(last) < n_leaves:
            continue
        first = min(last.values())
        if first[0] > reached:
            if held and held[1] < end:
                out.append(held)
            reached, held = first[0], (first[0], end, n - first[1], inverse - first[2])
        elif held and held[1] == end and held[0] == first[0]:
            held = (first[0], end, n - first[1], inverse - first[2])
    return [*out, held] if held else out


def _density(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query_id, user_id, article_id, n_leaves, events) to (query_id, user_id, article_id, n_covers, score)."""
    for batch in batches:
        counts, scores = [], []
        for n_leaves, events in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            found = covers([(e["end"], e["begin"], e["leaf"], e["inverse"]) for e in events], n_leaves)
            counts.append(len(found))
            # Words between the occurrences are noise.
            scores.append(sum(n / inverse / (1 + max(0, end - begin - (n - 1))) for begin, end, n, inverse in found))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(counts, pa.int64()), pa.array(scores, pa.float64())], ["query_id", "user_id", "article_id", "n_covers", "score"])


def cover_density(queries: DataFrame, index: Index, articles: DataFrame, user_feeds: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(query_id, user_id, article_id, n_covers, score) of articles that hold every leaf of a query.

    Fields follow each other in one line of positions.  A cover weighs the harmonic mean of
    its occurrences' field weights, divided by one more than the words between them; an
    article's score is the sum over its covers.
    """
    read = materialize(parsed(queries), "queries")
    inverse = F.create_map(*[F.lit(v) for f, w in weights.items() for v in (f, 1.0 / w)])[F.col("field")]
    hits = leaf_hits(read, index).select("query_id", "article_id", "leaf", "n_terms", (inverse).alias("inverse"), F.transform("at", lambda p: p + F.col("start")).alias("at"))
    occurrence = F.transform("at", lambda p: F.struct((p + F.col("n_terms") - 1).alias("end"), p.alias("begin"), F.col("leaf").alias("leaf"), F.col("inverse").alias("inverse")))
    events = F.array_sort(F.flatten(F.collect_list(occurrence)))
    found = hits.groupBy("query_id", "article_id").agg(events.alias("events"), F.count_distinct("leaf").alias("n"))
    wanted = broadcast_if_small(read.select("query_id", "user_id", F.size("leaves").alias("n_leaves")))
    whole = found.join(wanted, "query_id").where("n = n_leaves")
    scored = whole.select("query_id", "user_id", "article_id", "n_leaves", "events").mapInArrow(_density, "query_id long, user_id long, article_id long, n_covers long, score double")
    return scoped(scored, articles, user_feeds)
