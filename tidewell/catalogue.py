"""Query catalogue: name -> (spark, sf_dir) -> DataFrame, and its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell import catalogue_feeds, catalogue_search, catalogue_star
from tidewell.functions import text, vectors
from tidewell.operators import reading, render, search, state, stats
from tidewell.sources.tables import NOW, RULES, Tables
from tidewell.streaming import grouping, ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_RULES = ", ".join(f"({a}, {b}, {'NULL' if c is None else c}, '{d}', '{e}', {f})" for a, b, c, d, e, f in RULES)
BASE = f"""
WITH feeds AS (SELECT DISTINCT substr(source, 4)::BIGINT AS feed_id, source AS title FROM documents),
articles AS (
  SELECT doc_id AS article_id, substr(source, 4)::BIGINT AS feed_id, substr(text, 1, 60) AS title, text AS content, lang,
         TIMESTAMP '2024-01-01' + to_minutes((doc_id * 7919) % 43200) AS published FROM documents),
users AS (SELECT DISTINCT user_id FROM events),
subs AS (SELECT user_id, feed_id FROM users, feeds WHERE (user_id * 7 + feed_id) % 3 = 0),
folded AS (
  SELECT user_id, event_id % 200 AS article_id, bool_or(event_type IN ('view', 'click')) AS read,
         bool_or(event_type = 'purchase') AS starred, least(10.0, max(value) / 10) AS interest,
         count(*) FILTER (event_type = 'error') AS retries FROM events GROUP BY 1, 2),
state AS (
  SELECT folded.*, CASE WHEN toxic = 1 THEN 2.0 WHEN quality = 1 THEN 9.0 ELSE 5.0 END::DOUBLE AS security
  FROM folded LEFT JOIN labels ON doc_id = article_id),
rules(rule_id, user_id, feed_id, axis, value, score) AS (VALUES {_RULES}),
members AS (SELECT label::BIGINT AS group_id, vec_id AS article_id FROM embeddings),
groups AS (SELECT DISTINCT group_id, group_id AS user_id, 'Topic ' || group_id AS topic, group_id % 5 = 4 AS muted FROM members),
grouped AS (SELECT DISTINCT user_id, article_id FROM members JOIN groups USING (group_id)),
subscribed AS (SELECT user_id, article_id, feed_id, published FROM articles JOIN subs USING (feed_id)),
unread AS (
  SELECT s.* FROM subscribed s LEFT JOIN state r USING (user_id, article_id)
  WHERE NOT coalesce(r.read, false) AND NOT EXISTS (SELECT 1 FROM grouped g WHERE g.user_id = s.user_id AND g.article_id = s.article_id)),
meta AS (
  SELECT article_id, 'author' AS kind, lower('Author ' || (article_id % 13)) AS value FROM articles
  UNION ALL SELECT article_id, 'category', lower(lang) FROM articles),
hits AS (
  SELECT DISTINCT s.user_id, s.article_id, r.rule_id, r.score FROM subscribed s JOIN meta m USING (article_id)
  JOIN rules r ON r.user_id = s.user_id AND lower(r.value) = m.value AND (r.feed_id IS NULL OR r.feed_id = s.feed_id)
    AND m.kind = CASE WHEN r.axis = 'author' THEN 'author' ELSE 'category' END),
sums AS (SELECT user_id, article_id, sum(score)::BIGINT AS rule_score FROM hits GROUP BY 1, 2)
"""


def query(name: str, sql: str | None = None, base: bool = True):
    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = (BASE if base else "") + sql
        return f

    return add


LISTING = ["article_id", "feed_id", "published"]


@query("unread_for_user", "SELECT article_id, feed_id, published FROM unread WHERE user_id = 1 ORDER BY published DESC, article_id DESC LIMIT 50")
def unread_for_user(t: Tables) -> DataFrame:
    return reading.newest(reading.unread(t, 1).select(LISTING), 50)


@query("unread_by_feed", "SELECT article_id, feed_id, published FROM unread WHERE user_id = 1 AND feed_id = 5 ORDER BY published DESC, article_id DESC LIMIT 50 OFFSET 2")
def unread_by_feed(t: Tables) -> DataFrame:
    return reading.newest(reading.unread(t, 1).where("feed_id = 5").select(LISTING), 50, 2)


@query("unread_all_users_count", "SELECT user_id, count(*)::BIGINT AS n_unread FROM unread GROUP BY 1")
def unread_all_users_count(t: Tables) -> DataFrame:
    return reading.unread_counts(t)


@query("starred", "SELECT s.user_id, s.article_id, s.feed_id, published FROM subscribed s JOIN state r USING (user_id, article_id) WHERE starred")
def starred(t: Tables) -> DataFrame:
    return reading.starred(t).select("user_id", *LISTING)


@query(
    "unscored_queue",
    "SELECT s.user_id, count(*)::BIGINT AS n, min(article_id) AS first_article FROM subscribed s LEFT JOIN state r USING (user_id, article_id) "
    "WHERE interest IS NULL AND coalesce(retries, 0) < 3 GROUP BY 1",
)
def unscored_queue(t: Tables) -> DataFrame:
    return reading.unscored_counts(t)


@query(
    "pending_counts",
    "SELECT user_id, count(*)::BIGINT AS subscribed, count(*) FILTER (interest IS NULL AND coalesce(retries, 0) < 3)::BIGINT AS unscored, "
    "count(*) FILTER (coalesce(read, false))::BIGINT AS read FROM subscribed LEFT JOIN state USING (user_id, article_id) GROUP BY 1",
)
def pending_counts(t: Tables) -> DataFrame:
    return stats.pending(t)


@query("rule_score_sum", "SELECT user_id, article_id, rule_score FROM sums")
def rule_score_sum(t: Tables) -> DataFrame:
    return reading.rule_scores(t)


@query(
    "rule_filtered_unread",
    "SELECT u.user_id, u.article_id, u.feed_id FROM unread u LEFT JOIN sums USING (user_id, article_id) "
    "WHERE u.user_id NOT IN (SELECT user_id FROM rules) OR coalesce(rule_score, 0) >= 2",
)
def rule_filtered_unread(t: Tables) -> DataFrame:
    return reading.unread(t, threshold=2).select("user_id", "article_id", "feed_id")


_DECAYED = f"""
, decayed AS (
  SELECT user_id, article_id, feed_id, interest,
         interest / (1.0 + 0.1 * greatest(0.0, date_diff('second', published, TIMESTAMP '{NOW}') / 86400.0)) AS decayed
  FROM state JOIN articles USING (article_id) WHERE interest >= 8.0 AND NOT read),
decayed_sums AS (
  SELECT user_id, article_id, sum(score) AS rule_score FROM (
    SELECT DISTINCT d.user_id, d.article_id, r.rule_id, r.score FROM decayed d JOIN meta m USING (article_id)
    JOIN rules r ON r.user_id = d.user_id AND lower(r.value) = m.value AND (r.feed_id IS NULL OR r.feed_id = d.feed_id)
      AND m.kind = CASE WHEN r.axis = 'author' THEN 'author' ELSE 'category' END) GROUP BY 1, 2)
"""


@query(
    "decayed_topk",
    _DECAYED + "SELECT article_id, feed_id, round(interest, 6) AS interest, round(decayed, 6) AS decayed FROM decayed d "
    "LEFT JOIN decayed_sums USING (user_id, article_id) WHERE user_id = 1 AND coalesce(rule_score, 0) >= -1 ORDER BY d.decayed DESC, article_id DESC LIMIT 50",
)
def decayed_topk(t: Tables) -> DataFrame:
    rows = reading.above_threshold(t, reading.decayed(t, NOW).where("user_id = 1"), -1)
    top = rows.orderBy(F.desc("decayed"), F.desc("article_id")).limit(50)
    return top.select("article_id", "feed_id", F.round("interest", 6).alias("interest"), F.round("decayed", 6).alias("decayed"))


@query("decayed_all_users", _DECAYED + "SELECT user_id, count(*)::BIGINT AS n, round(max(decayed), 6) AS best FROM decayed GROUP BY 1")
def decayed_all_users(t: Tables) -> DataFrame:
    return reading.decayed(t, NOW).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("decayed"), 6).alias("best"))


_NEWS = "SELECT article_id, feed_id, round(interest, 6) AS interest, security FROM subscribed JOIN state USING (user_id, article_id) JOIN (SELECT article_id, lang FROM articles) USING (article_id) WHERE user_id = 1 AND "


def _issue(rows: DataFrame) -> DataFrame:
    return rows.withColumn("interest", F.round("interest", 6))


@query("newsletter_scores", _NEWS + "interest >= 5 AND security >= 5 ORDER BY state.interest DESC, article_id DESC LIMIT 20")
def newsletter_scores(t: Tables) -> DataFrame:
    return _issue(reading.newsletter(t, 1, min_interest=5.0, min_security=5.0))


@query("newsletter_feeds", _NEWS + "feed_id IN (2, 5, 8, 11) AND feed_id NOT IN (5) AND published > TIMESTAMP '2024-01-05' ORDER BY state.interest DESC, article_id DESC LIMIT 20")
def newsletter_feeds(t: Tables) -> DataFrame:
    return _issue(reading.newsletter(t, 1, include_feeds=[2, 5, 8, 11], exclude_feeds=[5], since="2024-01-05 00:00:00"))


@query("newsletter_categories", _NEWS + "lower(lang) IN ('en', 'fr') AND lower(lang) NOT IN ('fr') ORDER BY state.interest DESC, article_id DESC LIMIT 20")
def newsletter_categories(t: Tables) -> DataFrame:
    return _issue(reading.newsletter(t, 1, include_categories=["EN", "fr"], exclude_categories=["FR"]))


_FEED_STATS = """
, totals AS (SELECT feed_id, count(*) AS total, max(published) AS last_published FROM articles GROUP BY 1),
waiting AS (SELECT user_id, feed_id, count(*) AS unread FROM unread GROUP BY 1, 2),
fs AS (SELECT user_id, feed_id, total::BIGINT AS total, last_published, coalesce(unread, 0)::BIGINT AS unread
       FROM subs JOIN totals USING (feed_id) LEFT JOIN waiting USING (user_id, feed_id))
"""


@query("feed_stats", _FEED_STATS + "SELECT * FROM fs")
def feed_stats(t: Tables) -> DataFrame:
    return stats.feed_stats(t)


@query("feed_stats_total", _FEED_STATS + "SELECT user_id, feed_id, sum(total)::BIGINT AS total, sum(unread)::BIGINT AS unread FROM fs GROUP BY GROUPING SETS ((user_id, feed_id), (user_id))")
def feed_stats_total(t: Tables) -> DataFrame:
    return stats.feed_totals(t)


_BUCKETS = """
, buckets AS (
  SELECT user_id, feed_id, count(interest)::BIGINT AS scored, count(*) FILTER (security >= 7)::BIGINT AS sec_high,
         count(*) FILTER (security >= 4 AND security < 7)::BIGINT AS sec_mid, count(*) FILTER (security < 4)::BIGINT AS sec_low,
         count(*) FILTER (security >= 7 AND interest >= 8)::BIGINT AS int_high,
         count(*) FILTER (security >= 7 AND interest >= 5 AND interest < 8)::BIGINT AS int_mid,
         count(*) FILTER (security >= 7 AND interest < 5)::BIGINT AS int_low
  FROM subscribed JOIN state USING (user_id, article_id) GROUP BY 1, 2)
"""


@query("score_buckets", _BUCKETS + "SELECT * FROM buckets")
def score_buckets(t: Tables) -> DataFrame:
    return stats.score_stats(t)


@query(
    "score_bucket_pcts",
    _BUCKETS + "SELECT user_id, coalesce(sum(sec_high) * 100 // nullif(sum(scored), 0), 0)::BIGINT AS pct_secure, "
    "coalesce(sum(int_high) * 100 // nullif(sum(sec_high), 0), 0)::BIGINT AS pct_interesting FROM buckets GROUP BY 1",
)
def score_bucket_pcts(t: Tables) -> DataFrame:
    sums = stats.score_stats(t).groupBy("user_id").agg(*[F.sum(c).alias(c) for c in ("scored", "sec_high", "int_high")])
    return sums.select(
        "user_id", stats.percent(F.col("sec_high"), F.col("scored")).alias("pct_secure"), stats.percent(F.col("int_high"), F.col("sec_high")).alias("pct_interesting")
    )


@query(
    "group_stats_having",
    "SELECT g.user_id, g.group_id, topic, count(*)::BIGINT AS n_members, count(*) FILTER (NOT coalesce(read, false))::BIGINT AS unread "
    "FROM groups g JOIN members m USING (group_id) LEFT JOIN state s ON s.user_id = g.user_id AND s.article_id = m.article_id WHERE NOT muted "
    "GROUP BY 1, 2, 3 HAVING count(*) >= 2 AND count(*) FILTER (NOT coalesce(read, false)) > 0",
)
def group_stats_having(t: Tables) -> DataFrame:
    return stats.group_stats(t)


@query("user_groups_min2", "SELECT group_id, user_id, topic, count(*)::BIGINT AS n_members FROM groups JOIN members USING (group_id) GROUP BY 1, 2, 3 HAVING count(*) >= 2")
def user_groups_min2(t: Tables) -> DataFrame:
    sizes = t.members.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_members")).where("n_members >= 2")
    return t.groups.join(sizes, "group_id").select("group_id", "user_id", "topic", "n_members")


@query(
    "db_stats_distinct",
    ", a AS (SELECT feed_id, count(DISTINCT article_id) AS n FROM articles GROUP BY 1), s AS (SELECT feed_id, count(DISTINCT user_id) AS n FROM subs GROUP BY 1) "
    "SELECT feed_id, title, coalesce(a.n, 0)::BIGINT AS articles, coalesce(s.n, 0)::BIGINT AS subscribers FROM feeds LEFT JOIN a USING (feed_id) LEFT JOIN s USING (feed_id)",
)
def db_stats_distinct(t: Tables) -> DataFrame:
    return stats.db_stats(t)


@query("feed_authors_distinct", "SELECT DISTINCT feed_id, 'Author ' || (article_id % 13) AS name FROM articles")
def feed_authors_distinct(t: Tables) -> DataFrame:
    return t.articles.select("feed_id", "article_id").join(t.authors, "article_id").select("feed_id", "name").distinct()


@query(
    "feed_group_memberships",
    "SELECT group_id, string_agg(feed_id::VARCHAR, ',' ORDER BY feed_id) AS feed_ids FROM (SELECT DISTINCT group_id, feed_id FROM members JOIN articles USING (article_id)) GROUP BY 1",
)
def feed_group_memberships(t: Tables) -> DataFrame:
    return stats.memberships(t)


@query(
    "fever_links",
    ", b AS (SELECT article_id, max(interest) AS interest FROM state GROUP BY 1), r AS (SELECT group_id, min(article_id) AS first_article, count(*) AS n_members, max(interest) AS best "
    "FROM members LEFT JOIN b USING (article_id) GROUP BY 1) SELECT group_id, first_article, n_members::BIGINT AS n_members, "
    "least(CASE WHEN coalesce(best, 0) > 0 THEN floor(best * 10) ELSE n_members * 25 END, 100)::BIGINT AS temperature FROM r WHERE n_members >= 2",
)
def fever_links(t: Tables) -> DataFrame:
    return stats.group_links(t)


@query("fever_items_page", "SELECT article_id, feed_id, published FROM subscribed WHERE user_id = 1 AND article_id > 20 AND article_id <= 900 ORDER BY article_id DESC LIMIT 50")
def fever_items_page(t: Tables) -> DataFrame:
    return reading.sync_page(t, 1, since=20, until=900)


@query("fever_items_with_ids", "SELECT article_id, feed_id, published FROM subscribed WHERE user_id = 1 AND article_id IN (1, 5, 8, 13, 21, 34, 55, 89, 144) ORDER BY article_id DESC LIMIT 50")
def fever_items_with_ids(t: Tables) -> DataFrame:
    return reading.sync_page(t, 1, since=20, ids=[1, 5, 8, 13, 21, 34, 55, 89, 144])


@query(
    "unread_ids",
    "SELECT user_id, string_agg(article_id::VARCHAR, ',' ORDER BY article_id) AS ids FROM subscribed LEFT JOIN state USING (user_id, article_id) WHERE NOT coalesce(read, false) GROUP BY 1",
)
def unread_ids(t: Tables) -> DataFrame:
    return reading.unread_ids(t)


@query("saved_ids", "SELECT user_id, string_agg(article_id::VARCHAR, ',' ORDER BY article_id) AS ids FROM state WHERE starred GROUP BY 1")
def saved_ids(t: Tables) -> DataFrame:
    return t.state.where("starred").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list("article_id")), ",").alias("ids"))


def _log(t: Tables) -> DataFrame:
    """The event table as a change log."""
    kinds = F.expr("CASE event_type WHEN 'view' THEN 'user' WHEN 'click' THEN 'user' WHEN 'purchase' THEN 'star' WHEN 'error' THEN 'retry' ELSE 'ai' END")
    return t.read("events").select(
        "user_id", F.expr("event_id % 200").alias("article_id"), F.col("event_id").alias("seq"), kinds.alias("kind"), (F.col("event_type") == "view").alias("read"),
        F.lit(True).alias("starred"), F.least(F.lit(10.0), F.col("value") / 10).alias("interest"),
    )


_LOG = """
, log AS (
  SELECT user_id, event_id % 200 AS article_id, event_id AS seq,
         CASE event_type WHEN 'view' THEN 'user' WHEN 'click' THEN 'user' WHEN 'purchase' THEN 'star' WHEN 'error' THEN 'retry' ELSE 'ai' END AS kind,
         event_type = 'view' AS read, true AS starred, least(10.0, value / 10) AS interest FROM events)
"""
_FOLD = """
SELECT user_id, article_id, max_by(read, seq) FILTER (kind = 'user') AS read, max_by(starred, seq) FILTER (kind = 'star') AS starred,
       max_by(interest, seq) FILTER (kind = 'ai' AND live) AS interest, count(*) FILTER (kind = 'retry' AND live)::BIGINT AS retries
"""


@query("read_state_fold", _LOG + _FOLD + "FROM (SELECT *, true AS live FROM log) GROUP BY 1, 2")
def read_state_fold(t: Tables) -> DataFrame:
    return state.fold(_log(t))


@query(
    "reset_scores_fold",
    _LOG + ", mid AS (SELECT max(event_id) // 2 AS m FROM events)" + _FOLD.replace("SELECT user_id", "SELECT user_id", 1)
    + "FROM (SELECT log.*, user_id <> 1 OR seq > m AS live FROM log, mid) GROUP BY 1, 2",
)
def reset_scores_fold(t: Tables) -> DataFrame:
    log = _log(t)
    mid = t.read("events").agg(F.expr("max(event_id) div 2").alias("seq"))
    reset = log.where("user_id = 1").select("user_id", "article_id").distinct().join(F.broadcast(mid)).select(
        "user_id", "article_id", "seq", F.lit("reset").alias("kind"), F.lit(None).cast("boolean").alias("read"), F.lit(None).cast("boolean").alias("starred"), F.lit(None).cast("double").alias("interest")
    )
    return state.fold(log.unionByName(reset))


@query(
    "mark_all_read_fold",
    ", marked AS (SELECT 1 AS user_id, article_id FROM subscribed WHERE user_id = 1 AND published <= TIMESTAMP '2024-01-20') "
    + _LOG.lstrip().replace(", log", ", log", 1)
    + "SELECT user_id, article_id, max_by(read, seq) AS read FROM (SELECT user_id, article_id, seq, read FROM log WHERE kind = 'user' UNION ALL SELECT user_id, article_id, 1000000000000, true FROM marked) GROUP BY 1, 2",
)
def mark_all_read_fold(t: Tables) -> DataFrame:
    marked = state.mark_read(reading.subscribed(t, 1), 1, "2024-01-20 00:00:00", 10**12)
    return state.fold(_log(t).where("kind = 'user'").unionByName(marked)).select("user_id", "article_id", "read")


@query("without_embeddings_anti", "SELECT article_id, feed_id FROM articles WHERE article_id NOT IN (SELECT vec_id FROM embeddings)")
def without_embeddings_anti(t: Tables) -> DataFrame:
    return t.articles.select("article_id", "feed_id").join(t.vectors.select("article_id"), "article_id", "left_anti")


@query("orphan_users", "SELECT user_id FROM (SELECT user_id FROM rules UNION SELECT user_id FROM groups UNION SELECT c_custkey FROM customer) EXCEPT SELECT user_id FROM users")
def orphan_users(t: Tables) -> DataFrame:
    return state.orphans(t.users, t.rules, t.groups, t.read("customer").select(F.col("c_custkey").alias("user_id")))


@query("dedup_feed_guid", "SELECT feed_id, md5(content) AS guid, min(article_id) AS article_id FROM articles GROUP BY 1, 2")
def dedup_feed_guid(t: Tables) -> DataFrame:
    rows = t.articles.select("feed_id", F.md5(F.col("content").cast("binary")).alias("guid"), "article_id")
    return state.first_of(rows, ["feed_id", "guid"], "article_id")


@query("dedup_title_day", "SELECT title, published::DATE AS day, min(article_id) AS article_id FROM articles WHERE title <> '' GROUP BY 1, 2 UNION ALL SELECT title, published::DATE, article_id FROM articles WHERE coalesce(title, '') = ''")
def dedup_title_day(t: Tables) -> DataFrame:
    return state.first_of(t.articles.select("title", F.to_date("published").alias("day"), "article_id"), ["title", "day"], "article_id")


@query("latest_per_group", "SELECT group_id, max_by(article_id, (published, article_id)) AS article_id FROM members JOIN articles USING (article_id) GROUP BY 1")
def latest_per_group(t: Tables) -> DataFrame:
    rows = t.members.join(t.articles.select("article_id", "published"), "article_id")
    return rows.groupBy("group_id").agg(F.max_by("article_id", F.struct("published", "article_id")).alias("article_id"))


_GAPS = """
, ranked AS (SELECT feed_id, article_id, published, row_number() OVER (PARTITION BY feed_id ORDER BY published DESC, article_id DESC) AS r FROM articles),
gaps AS (
  SELECT feed_id, published, date_diff('minute', lead(published) OVER (PARTITION BY feed_id ORDER BY r), published) AS gap FROM ranked WHERE r <= 11),
per AS (SELECT feed_id, max(published) AS last_post, list(gap ORDER BY gap) FILTER (gap > 0) AS g FROM gaps GROUP BY 1),
medians AS (SELECT feed_id, last_post, g[len(g) // 2 + 1] AS median_gap FROM per)
"""


@query("publish_gaps_upper_median", _GAPS + "SELECT * FROM medians")
def publish_gaps_upper_median(t: Tables) -> DataFrame:
    return stats.publish_gaps(t)


@query(
    "fetch_interval",
    _GAPS + f", a AS (SELECT *, date_diff('minute', last_post, TIMESTAMP '{NOW}') AS age FROM medians) SELECT feed_id, "
    "CASE WHEN age < 10080 THEN CASE WHEN coalesce(median_gap, 0) < 360 THEN 30 WHEN median_gap < 1440 THEN 60 ELSE 240 END "
    "WHEN age < 43200 THEN 720 WHEN age < 129600 THEN 1440 WHEN age < 259200 THEN 4320 WHEN age < 525600 THEN 10080 ELSE 43200 END::BIGINT AS minutes FROM a",
)
def fetch_interval(t: Tables) -> DataFrame:
    age = F.expr(f"timestampdiff(MINUTE, last_post, TIMESTAMP_NTZ'{NOW}')")
    return stats.publish_gaps(t).select("feed_id", stats.fetch_interval(age, F.col("median_gap")).cast("long").alias("minutes"))


@query("error_backoff", "SELECT user_id, article_id, least(60 * (1 << least(retries, 6)::INT), 43200)::BIGINT AS minutes FROM folded")
def error_backoff(t: Tables) -> DataFrame:
    return t.state.select("user_id", "article_id", stats.error_backoff(F.lit(60), F.col("retries")).cast("long").alias("minutes"))


_STRIP = "replace(regexp_replace(html, '<[^>]*>?', '', 'g'), '>', '')"


@query("strip_tags", f"SELECT page_id, md5({_STRIP}) AS digest FROM pages", base=False)
def strip_tags(t: Tables) -> DataFrame:
    return t.read("pages").select("page_id", F.md5(text.strip_tags(F.col("html")).cast("binary")).alias("digest"))


_LENGTH = f"length(regexp_replace({_STRIP}, '[ \\t\\n\\r]', '', 'g'))"


@query("text_length", f"SELECT page_id, {_LENGTH}::BIGINT AS n FROM pages", base=False)
def text_length(t: Tables) -> DataFrame:
    return t.read("pages").select("page_id", text.text_length(F.col("html")).cast("long").alias("n"))


_DOC_STRIP = _STRIP.replace("html", "text")
_DOC_TEXT = f"lower(rtrim({_DOC_STRIP}, ' ' || chr(9) || chr(10) || chr(13)))"
_MARKED = " OR ".join(f"ends_with({_DOC_TEXT}, '{m}')" for m in text.CUT_MARKERS)


@query(
    "is_truncated",
    f"SELECT doc_id, {_MARKED} OR ({_LENGTH.replace('html', 'text')} < 500 AND NOT regexp_matches({_DOC_TEXT}, '[.!?\"''’”]$')) AS truncated FROM documents",
    base=False,
)
def is_truncated(t: Tables) -> DataFrame:
    return t.read("documents").select("doc_id", text.is_truncated(F.col("text")).alias("truncated"))


@query(
    "contact_page",
    f"SELECT doc_id, len(regexp_extract_all({_DOC_STRIP}, '{text.ADDRESS}')) >= 3 AS contacts FROM documents",
    base=False,
)
def contact_page(t: Tables) -> DataFrame:
    return t.read("documents").select("doc_id", text.looks_like_contacts(F.col("text")).alias("contacts"))


@query(
    "shingle_overlap",
    ", w AS (SELECT conv_id, turn, text, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w, "
    "lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) "
    "SELECT conv_id, turn, len(w) < 3 OR len(list_filter(range(1, len(w) - 1), lambda i: contains(lower(before), w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) > 0 AS overlaps "
    "FROM w WHERE before IS NOT NULL",
)
def shingle_overlap(t: Tables) -> DataFrame:
    turns = t.read("conversations")
    before = turns.withColumn("before", F.expr("lag(text) OVER (PARTITION BY conv_id ORDER BY turn)")).where("before IS NOT NULL")
    return before.select("conv_id", "turn", text.shingle_overlap(F.col("text"), F.col("before")).alias("overlaps"))


@query("clean_title", "SELECT page_id, trim(regexp_replace('Page ' || page_id || ': ' || url, '[:\\s]+(https?://\\S+)\\s*$', '')) AS title FROM pages", base=False)
def clean_title(t: Tables) -> DataFrame:
    return t.read("pages").select("page_id", text.clean_title(F.concat(F.lit("Page "), F.col("page_id"), F.lit(": "), F.col("url"))).alias("title"))


@query(
    "best_date",
    "SELECT article_id, CASE WHEN date_trunc('day', published) = published AND published + INTERVAL 90 MINUTE > published THEN published + INTERVAL 90 MINUTE ELSE published END AS best FROM articles",
)
def best_date(t: Tables) -> DataFrame:
    return t.articles.select("article_id", text.best_date(F.col("published"), F.expr("published + INTERVAL '90' MINUTE")).cast("timestamp_ntz").alias("best"))


@query(
    "relative_date",
    f", s AS (SELECT article_id, published, date_diff('second', published, TIMESTAMP '{NOW}') AS s FROM articles) "
    "SELECT article_id, CASE WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' WHEN s < 604800 THEN (s // 86400) || 'd ago' "
    "ELSE strftime(published, '%b %-d, %Y') END AS shown FROM s",
)
def relative_date(t: Tables) -> DataFrame:
    seconds = F.expr(f"timestampdiff(SECOND, published, TIMESTAMP_NTZ'{NOW}')")
    return t.articles.select("article_id", text.relative_date(seconds, F.col("published")).alias("shown"))


@query(
    "extract_json",
    "SELECT event_id, CASE WHEN said LIKE '%{%}%' THEN regexp_extract(said, '(?s)\\{.*\\}', 0) ELSE said END AS body "
    "FROM (SELECT event_id, 'said: ' || CASE WHEN event_id % 5 = 0 THEN event_type ELSE props END || ' end' AS said FROM events)",
    base=False,
)
def extract_json(t: Tables) -> DataFrame:
    said = F.when(F.col("event_id") % 5 == 0, F.col("event_type")).otherwise(F.col("props"))
    return t.read("events").select("event_id", text.extract_json(F.concat(F.lit("said: "), said, F.lit(" end"))).alias("body"))


@query("garbage_flag", "SELECT conv_id, turn, " + " OR ".join(f"contains(lower(role || ' ' || text), '{g}')" for g in text.GARBAGE) + " AS garbage FROM conversations", base=False)
def garbage_flag(t: Tables) -> DataFrame:
    return t.read("conversations").select("conv_id", "turn", text.is_garbage(F.concat_ws(" ", "role", "text")).alias("garbage"))


@query("md5_key", "SELECT c_custkey, md5(c_name || '@example.org:' || c_nationkey) AS api_key FROM customer", base=False)
def md5_key(t: Tables) -> DataFrame:
    email = F.concat(F.col("c_name"), F.lit("@example.org"))
    return t.read("customer").select("c_custkey", text.api_key(email, F.col("c_nationkey").cast("string")).alias("api_key"))


def _terms(t: Tables) -> DataFrame:
    """Each benchmark item's words as a query."""
    return search.tokens(t.read("benchmark"), "item_id", "text").select(F.col("article_id").alias("query_id"), "term").distinct()


_BM25 = r"""
, words AS (SELECT article_id, unnest(regexp_extract_all(lower(content), '[\p{L}\p{N}]+')) AS term FROM articles),
q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM benchmark),
n AS (SELECT (SELECT count(*) FROM articles)::DOUBLE AS n, (SELECT count(*) FROM words)::DOUBLE / (SELECT count(*) FROM articles) AS avgdl),
sz AS (SELECT article_id, count(*) AS size FROM words GROUP BY 1),
post AS (SELECT article_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
w AS (
  SELECT article_id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / avgdl)) AS w
  FROM post JOIN dfs USING (term) JOIN sz USING (article_id), n),
bm AS (SELECT query_id, article_id, sum(w) AS score FROM q JOIN w USING (term) GROUP BY 1, 2),
topk AS (SELECT query_id, article_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, article_id) AS i FROM bm)
"""


@query("bm25_search", _BM25 + "SELECT query_id, article_id, round(score, 6) AS score FROM bm")
def bm25_search(t: Tables) -> DataFrame:
    return search.bm25(t.articles.select("article_id", "content"), _terms(t)).select("query_id", "article_id", F.round("score", 6).alias("score"))


def _centers(t: Tables) -> DataFrame:
    return search.centroids(t.vectors, t.members)


def _semantic(t: Tables) -> DataFrame:
    """Group centroids as query vectors."""
    return search.semantic(t.vectors, _centers(t).select(F.col("group_id").alias("query_id"), F.col("centroid").alias("embedding")))


_CENTERS = """
, cells AS (SELECT label::BIGINT AS group_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS dim FROM embeddings),
means AS (SELECT group_id, dim, avg(x) AS m FROM cells GROUP BY 1, 2),
centers AS (SELECT group_id, list(m ORDER BY dim) AS centroid FROM means GROUP BY 1),
cosines AS (SELECT group_id, vec_id AS article_id, list_cosine_similarity(embedding::DOUBLE[], centroid) AS cos FROM embeddings, centers)
"""
_NEAREST = """
, near AS (SELECT * FROM (SELECT group_id AS query_id, article_id, cos,
  row_number() OVER (PARTITION BY group_id ORDER BY round(cos, 9) DESC, article_id) AS i FROM cosines WHERE cos > 0.3) WHERE i <= 20)
"""


@query("semantic_topk", _CENTERS + _NEAREST + "SELECT query_id, article_id, round(cos, 6) AS cos FROM near")
def semantic_topk(t: Tables) -> DataFrame:
    return _semantic(t).select("query_id", "article_id", F.round("cos", 6).alias("cos"))


@query(
    "semantic_rows",
    "SELECT query_id, article_id, round(cos, 6) AS cos FROM (SELECT q.vec_id AS query_id, v.vec_id AS article_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS cos, "
    "row_number() OVER (PARTITION BY q.vec_id ORDER BY round(cos, 9) DESC, v.vec_id) AS i FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 WHERE cos > 0.3) WHERE i <= 20",
    base=False,
)
def semantic_rows(t: Tables) -> DataFrame:
    """Every vector whose id is divisible by 20, against all vectors."""
    queries = t.vectors.where("article_id % 20 = 0").select(F.col("article_id").alias("query_id"), "embedding")
    return search.semantic(t.vectors, queries).select("query_id", "article_id", F.round("cos", 6).alias("cos"))


@query(
    "hybrid_search",
    _BM25 + _CENTERS + _NEAREST + """
, lex AS (SELECT query_id, article_id, 1.0::DOUBLE - (i - 1)::DOUBLE / count(*) OVER (PARTITION BY query_id) AS fts FROM topk WHERE i <= 20),
fused AS (
  SELECT query_id, article_id, CASE WHEN fts IS NOT NULL AND cos IS NOT NULL THEN 0.6 * fts + 0.4 * cos ELSE coalesce(fts, cos) END AS score,
         CASE WHEN fts IS NOT NULL AND cos IS NOT NULL THEN 'both' WHEN fts IS NOT NULL THEN 'fts' ELSE 'semantic' END AS match_type
  FROM lex FULL JOIN near USING (query_id, article_id))
SELECT query_id, article_id, round(score, 6) AS score, match_type
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, article_id) AS k FROM fused) WHERE k <= 20
""",
)
def hybrid_search(t: Tables) -> DataFrame:
    lexical = search.rank_score(search.bm25(t.articles.select("article_id", "content"), _terms(t)), 20)
    return search.fuse(lexical, _semantic(t)).select("query_id", "article_id", F.round("score", 6).alias("score"), "match_type")


@query(
    "group_assign",
    _CENTERS + ", best AS (SELECT article_id, max_by(group_id, (round(cos, 9), -group_id)) AS g, max(round(cos, 9)) AS c FROM cosines GROUP BY 1) "
    "SELECT article_id, CASE WHEN c >= 0.75 THEN g END AS group_id, round(c, 6) AS cos FROM best",
)
def group_assign(t: Tables) -> DataFrame:
    return search.assign(t.vectors, _centers(t)).select("article_id", "group_id", F.round("cos", 6).alias("cos"))


@query("group_centroid", _CENTERS + "SELECT group_id, dim::BIGINT AS dim, round(m, 6) AS m FROM means")
def group_centroid(t: Tables) -> DataFrame:
    return _centers(t).select("group_id", F.posexplode("centroid").alias("dim", "m")).select("group_id", F.col("dim").cast("long").alias("dim"), F.round("m", 6).alias("m"))


@query(
    "cosine_pairs",
    "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cos "
    "FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    base=False,
)
def cosine_pairs(t: Tables) -> DataFrame:
    a = t.vectors.select(F.col("article_id").alias("a"), F.col("embedding").alias("va"))
    b = t.vectors.select(F.col("article_id").alias("b"), F.col("embedding").alias("vb"), (F.col("article_id") - 1).alias("a"))
    return a.join(b, "a").select("a", "b", F.round(vectors.cosine(F.col("va"), F.col("vb")), 6).alias("cos"))


@query("briefing_text")
def briefing_text(t: Tables) -> DataFrame:
    return render.briefing(reading.decayed(t, NOW).join(t.articles.select("article_id", "title"), "article_id"))


@query("opml_export")
def opml_export(t: Tables) -> DataFrame:
    url = F.concat(F.lit("https://example.org/"), F.col("title"), F.lit(".xml"))
    return render.opml(t.subscriptions.join(t.feeds, "feed_id").select("user_id", "title", url.alias("url")))


@query("opml_import")
def opml_import(t: Tables) -> DataFrame:
    docs = opml_export(t)
    t.spark.udtf.register("outlines", render.Outlines)
    docs.createOrReplaceTempView("opml_documents")
    return t.spark.sql("SELECT user_id, o.title, o.url FROM opml_documents, LATERAL outlines(opml) AS o")


@query("stream_dedup_count", "SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY 1", base=False)
def stream_dedup_count(t: Tables) -> DataFrame:
    stream = ingest.deduplicated(ingest.event_stream(t.spark, f"{t.path}/events.parquet"))
    return ingest.run_once(stream, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("online_groups")
def online_groups(t: Tables) -> DataFrame:
    """All vectors as a stream, grouped online for fifty users."""
    vectors = ingest.event_stream(t.spark, f"{t.path}/embeddings.parquet")
    arrivals = vectors.select((F.col("vec_id") % 50).alias("user_id"), F.col("vec_id").alias("article_id"), F.col("vec_id").alias("arrival"), "embedding")
    return ingest.run_once(grouping.grouped(arrivals), "groups")


for _more in (catalogue_star, catalogue_feeds, catalogue_search):
    QUERIES.update(_more.QUERIES)
    ORACLES.update(_more.ORACLES)
