"""Catalogue queries of full-text search; their twins stem, count and rank in SQL.

Queries are made from the words of every benchmark item and belong to user ``item_id % 50``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewell.catalogue_star import BASE
from tidewell.functions.stem import stem_sql
from tidewell.operators import fulltext, segments
from tidewell.plans.scratch import shared_dir
from tidewell.sources.driver import driver_star
from tidewell.sources.star import Star

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_WORDS = r"[\p{L}\p{N}]+"

#: Postings, and the stems of every item's words; ``extra`` are more words to stem.
_INDEX = BASE + f""",
fields AS (
  SELECT id, unnest(['title', 'summary', 'content', 'linked_content']) AS f, unnest([0, 1, 2, 3]) AS nr,
         unnest([coalesce(title, ''), coalesce(summary, ''), coalesce(content, ''), coalesce(linked_content, '')]) AS body FROM articles),
split AS (SELECT id, f, nr, regexp_extract_all(strip_accents(lower(body)), '{_WORDS}') AS ws FROM fields),
toks AS (SELECT id, f, nr, unnest(ws) AS w, unnest(range(0, len(ws))) AS pos FROM split),
items AS (SELECT item_id AS query_id, item_id % 50 AS user_id, regexp_extract_all(text, '{_WORDS}') AS ws FROM benchmark),
qtoks AS (SELECT query_id, user_id, strip_accents(lower(w)) AS w, k FROM (SELECT query_id, user_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS k FROM items)),
begins AS (SELECT query_id, user_id, strip_accents(lower(substr(ws[1], 1, 4))) AS w FROM items),
every AS (SELECT w FROM toks UNION ALL SELECT w FROM qtoks UNION ALL SELECT w FROM begins),
{stem_sql("every")},
starts AS (SELECT id, f, coalesce(sum(len(ws)) OVER (PARTITION BY id ORDER BY nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM split),
post AS (SELECT id, f, stem, pos FROM toks JOIN stems USING (w)),
qs AS (SELECT query_id, user_id, k, stem FROM qtoks JOIN stems USING (w)),
sizes AS (SELECT id, sum(len(ws)) AS size FROM split GROUP BY 1),
totals AS (SELECT count(*)::DOUBLE AS n, avg(size) AS average FROM sizes)"""

#: ``hits(query_id, leaf, id, times)`` scored, for the (query_id, id) of ``good``.
_RANKED = """,
dfs AS (SELECT query_id, leaf, count(*) AS df FROM hits GROUP BY 1, 2),
weights AS (
  SELECT query_id, id, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * times * 2.2 / (times + 1.2 * (0.25 + 0.75 * size / average)) AS w
  FROM hits JOIN dfs USING (query_id, leaf) JOIN sizes USING (id), totals),
scores AS (SELECT query_id, id, sum(w) AS score FROM weights GROUP BY 1, 2),
seen AS (
  SELECT g.query_id, g.id, score FROM good g JOIN scores USING (query_id, id) JOIN articles a USING (id)
  WHERE EXISTS (SELECT 1 FROM user_feeds u WHERE u.feed_id = a.feed_id AND u.user_id = g.query_id % 50))
SELECT query_id, id AS article_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM seen
"""


def query(name: str, sql: str):
    def add(f: Callable[[Star, DataFrame], DataFrame]) -> Callable[[Star, DataFrame], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
            words = F.regexp_extract_all("text", F.lit(_WORDS), 0)
            return f(driver_star(spark, sf_dir), items.select("item_id", words.alias("ws")))

        QUERIES[name], ORACLES[name] = run, _INDEX + sql
        return f

    return add


def _w(k: int) -> Column:
    return F.coalesce(F.get("ws", F.lit(k - 1)), F.lit(""))


def _asked(items: DataFrame, *parts: str | Column) -> DataFrame:
    text = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return items.select(F.col("item_id").alias("query_id"), (F.col("item_id") % 50).alias("user_id"), text.alias("query"))


def _searched(s: Star, queries: DataFrame) -> DataFrame:
    found = fulltext.search(queries, fulltext.build(s["articles"]), s["articles"], s["user_feeds"], limit=None)
    return found.select("query_id", "article_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    "fts_boolean",
    """,
leaves AS (SELECT DISTINCT query_id, stem AS leaf FROM qs WHERE k <= 5),
hits AS (SELECT query_id, leaf, id, count(*) AS times FROM leaves JOIN post ON stem = leaf GROUP BY 1, 2, 3),
ks AS (SELECT query_id, id, list(DISTINCT k) AS ks FROM hits JOIN qs USING (query_id) WHERE k <= 5 AND stem = leaf GROUP BY 1, 2),
good AS (SELECT query_id, id FROM ks WHERE list_has_all(ks, [1, 2, 3]) OR list_contains(ks, 4) AND NOT list_contains(ks, 5))""" + _RANKED,
)
def fts_boolean(s: Star, items: DataFrame) -> DataFrame:
    """Words side by side, AND, OR and NOT."""
    return _searched(s, _asked(items, _w(1), " ", _w(2), " AND ", _w(3), " OR ", _w(4), " NOT ", _w(5)))


@query(
    "fts_phrases",
    """,
p3 AS (
  SELECT a.query_id, a.id, count(*) AS times
  FROM (SELECT query_id, id, f, pos FROM qs JOIN post USING (stem) WHERE k = 1) a
  JOIN (SELECT query_id, id, f, pos FROM qs JOIN post USING (stem) WHERE k = 2) b ON b.query_id = a.query_id AND b.id = a.id AND b.f = a.f AND b.pos = a.pos + 1
  JOIN (SELECT query_id, id, f, pos FROM qs JOIN post USING (stem) WHERE k = 3) c ON c.query_id = a.query_id AND c.id = a.id AND c.f = a.f AND c.pos = a.pos + 2
  GROUP BY 1, 2),
p2 AS (
  SELECT a.query_id, a.id, count(*) AS times
  FROM (SELECT query_id, id, pos FROM qs JOIN post USING (stem) WHERE k = 4 AND f = 'title') a
  JOIN (SELECT query_id, id, pos FROM qs JOIN post USING (stem) WHERE k = 5 AND f = 'title') b ON b.query_id = a.query_id AND b.id = a.id AND b.pos = a.pos + 1
  GROUP BY 1, 2),
hits AS (SELECT query_id, 0 AS leaf, id, times FROM p3 UNION ALL SELECT query_id, 1, id, times FROM p2),
good AS (SELECT DISTINCT query_id, id FROM hits)""" + _RANKED,
)
def fts_phrases(s: Star, items: DataFrame) -> DataFrame:
    """A phrase anywhere, or one in the title."""
    return _searched(s, _asked(items, '"', _w(1), " ", _w(2), " ", _w(3), '" OR title : "', _w(4), " ", _w(5), '"'))


@query(
    "fts_prefix",
    """,
b AS (SELECT query_id, stem AS begin FROM begins JOIN stems USING (w)),
hits AS (
  SELECT query_id, 0 AS leaf, id, count(*) AS times FROM b JOIN post ON starts_with(stem, begin) GROUP BY 1, 2, 3
  UNION ALL SELECT query_id, 1, id, count(*) FROM qs JOIN post USING (stem) WHERE k = 2 GROUP BY 1, 2, 3),
good AS (SELECT query_id, id FROM hits GROUP BY 1, 2 HAVING count(*) = 2)""" + _RANKED,
)
def fts_prefix(s: Star, items: DataFrame) -> DataFrame:
    """Words that begin alike, and another word."""
    return _searched(s, _asked(items, F.substring(_w(1), 1, 4), "* AND ", _w(2)))


def _changed(sql: str) -> str:
    """The twin's articles after the changes of ``fts_after_changes``."""
    fresh = "id + 1000000, feed_id, guid, summary, url, title, content, author, published_date, fetched_date, linked_url, linked_content, full_text_fetched, images_cached"
    after = f"""articles AS (
  SELECT * REPLACE (CASE WHEN id % 10 = 5 THEN 'new ' || title ELSE title END AS title, CASE WHEN id % 10 = 5 THEN '' ELSE content END AS content) FROM was WHERE id % 10 <> 3
  UNION ALL SELECT {fresh} FROM was WHERE id % 20 = 0)"""
    return sql.replace("articles AS (", "was AS (", 1).replace("user_feeds AS (", f"{after},\nuser_feeds AS (", 1)


@query(
    "fts_after_changes",
    """,
hits AS (SELECT query_id, 0 AS leaf, id, count(*) AS times FROM qs JOIN post USING (stem) WHERE k = 1 GROUP BY 1, 2, 3),
good AS (SELECT query_id, id FROM hits)""" + _RANKED,
)
def fts_after_changes(s: Star, items: DataFrame) -> DataFrame:
    """The index of all articles takes deletions, changes and new articles, and is searched then."""
    was = s["articles"]
    changed = was.where("id % 10 = 5").withColumns({"title": F.concat(F.lit("new "), "title"), "content": F.lit("")})
    fresh = was.where("id % 20 = 0").select((F.col("id") + 1_000_000).alias("id"), F.col("summary").alias("title"), F.col("title").alias("summary"), "content", "linked_content", "feed_id")
    index = segments.SegmentedIndex(s.spark, f"{shared_dir(s.spark)}/fts-{uuid.uuid4().hex}")
    index.apply(was)
    index.apply(was.where("id % 10 = 3").select("id", F.lit(True).alias("deleted")))
    index.apply(changed)
    index.apply(fresh)
    now = was.where("id % 10 <> 3").select("id", "feed_id").union(fresh.select("id", "feed_id"))
    found = fulltext.search(_asked(items, _w(1)), index.index(), now, s["user_feeds"], limit=None)
    return found.select("query_id", "article_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


ORACLES["fts_after_changes"] = _changed(ORACLES["fts_after_changes"])


@query(
    "fts_cover_density",
    """,
leaves AS (SELECT query_id, stem, row_number() OVER (PARTITION BY query_id ORDER BY min(k)) AS leaf FROM qs WHERE k <= 3 GROUP BY 1, 2),
wanted AS (SELECT query_id, count(*) AS n FROM leaves GROUP BY 1),
ev AS (
  SELECT query_id, id, leaf, pos + start AS p, 1 / CASE f WHEN 'title' THEN 1.0 WHEN 'summary' THEN 0.4 WHEN 'content' THEN 0.2 ELSE 0.1 END::DOUBLE AS inv
  FROM leaves JOIN post USING (stem) JOIN starts USING (id, f)),
passed AS (
  SELECT *, row_number() OVER w AS nr, sum(inv) OVER w AS total,
         max(CASE WHEN leaf = 1 THEN p END) OVER w AS l1, max(CASE WHEN leaf = 2 THEN p END) OVER w AS l2, max(CASE WHEN leaf = 3 THEN p END) OVER w AS l3
  FROM ev WINDOW w AS (PARTITION BY query_id, id ORDER BY p ROWS UNBOUNDED PRECEDING)),
ended AS (
  SELECT x.*, CASE n WHEN 1 THEN l1 WHEN 2 THEN CASE WHEN l1 IS NOT NULL AND l2 IS NOT NULL THEN least(l1, l2) END
                     ELSE CASE WHEN l1 IS NOT NULL AND l2 IS NOT NULL AND l3 IS NOT NULL THEN least(l1, l2, l3) END END AS s
  FROM passed x JOIN wanted USING (query_id)),
minimal AS (SELECT * FROM (SELECT *, lag(s) OVER (PARTITION BY query_id, id ORDER BY p) AS before FROM ended) WHERE s IS NOT NULL AND (before IS NULL OR s > before)),
closest AS (
  SELECT m.query_id, m.id, (m.nr - b.nr + 1) AS n, m.total - b.total + b.inv AS inverse, m.p - m.s AS width
  FROM minimal m JOIN passed b ON b.query_id = m.query_id AND b.id = m.id AND b.p = m.s),
dense AS (SELECT query_id, id, count(*) AS n_covers, sum(n / inverse / (1 + greatest(0, width - (n - 1)))) AS score FROM closest GROUP BY 1, 2)
SELECT query_id, d.id AS article_id, n_covers, round(score, 6) AS score FROM dense d JOIN articles a ON a.id = d.id
WHERE EXISTS (SELECT 1 FROM user_feeds u WHERE u.feed_id = a.feed_id AND u.user_id = query_id % 50)
""",
)
def fts_cover_density(s: Star, items: DataFrame) -> DataFrame:
    """Articles by how closely three words stand together."""
    queries = _asked(items, _w(1), " ", _w(2), " ", _w(3))
    found = fulltext.cover_density(queries, fulltext.build(s["articles"]), s["articles"], s["user_feeds"])
    return found.select("query_id", "article_id", "n_covers", F.round("score", 6).alias("score"))
