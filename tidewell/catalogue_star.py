"""Catalogue queries over the star schema: look-ups, listings and state changes.

A change is shown by the rows that it leaves behind, and its twin computes those rows
from the tables before it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.functions import images
from tidewell.operators import changes, prompts, refresh, render, shelf, statelog
from tidewell.plans.scratch import shared_dir
from tidewell.sources import driver
from tidewell.sources.star import Star

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The clock of these queries.
NOW = "2024-02-01 00:00:00"
_NOW = f"TIMESTAMP '{NOW}'"

BASE = "WITH " + ",\n".join(f"{n} AS ({sql.strip()})" for n, sql in driver.tables(driver.duck_minutes).items()) + """,
subscribed AS (SELECT user_id, id, feed_id, published_date FROM articles JOIN user_feeds USING (feed_id)),
state AS (SELECT *, article_id AS id FROM read_state),
owned AS (SELECT m.group_id, m.article_id AS id, g.user_id, added_at FROM article_group_members m JOIN article_groups g ON g.id = m.group_id),
meta AS (
  SELECT article_id AS id, 'author' AS kind, lower(name) AS value FROM article_authors
  UNION ALL SELECT article_id, 'category', lower(category) FROM article_categories),
sums AS (
  SELECT user_id, id, sum(score) AS rule_score FROM (
    SELECT DISTINCT r.user_id, a.id, r.id AS rule_id, r.score FROM articles a JOIN meta m USING (id)
    JOIN filter_rules r ON lower(r.value) = m.value AND (r.feed_id IS NULL OR r.feed_id = a.feed_id)
     AND m.kind = CASE WHEN r.axis = 'author' THEN 'author' ELSE 'category' END) GROUP BY 1, 2),
unread AS (
  SELECT s.* FROM subscribed s LEFT JOIN state r USING (user_id, id)
  WHERE NOT coalesce(r.read, false) AND NOT EXISTS (SELECT 1 FROM owned o WHERE o.user_id = s.user_id AND o.id = s.id)),
unsummarized AS (SELECT s.* FROM subscribed s WHERE NOT EXISTS (SELECT 1 FROM article_summaries x WHERE x.user_id = s.user_id AND x.article_id = s.id)),
waiting AS (
  SELECT s.* FROM subscribed s LEFT JOIN state r USING (user_id, id) WHERE NOT coalesce(ai_scored, false) AND coalesce(ai_retries, 0) < 3)
"""
_NEWEST = " ORDER BY published_date DESC NULLS LAST, id DESC "


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Star], DataFrame]) -> Callable[[Star], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(driver.driver_star(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = BASE + sql
        return f

    return add


def passing(threshold: int, rows: str) -> str:
    return f"SELECT x.* FROM ({rows}) x LEFT JOIN sums s ON s.user_id = x.user_id AND s.id = x.id WHERE x.user_id NOT IN (SELECT user_id FROM filter_rules) OR coalesce(rule_score, 0) >= {threshold}"


SHORT = ["id", "feed_id", "published_date"]


def values(s: Star, schema: str, *rows: tuple) -> DataFrame:
    return s.spark.createDataFrame(list(rows), schema)


# --- articles ----------------------------------------------------------------

_COLS = ", ".join(c if not c.startswith("linked") else f"coalesce({c}, '') AS {c}" for c in shelf.ARTICLE)


@query("article_by_id", f"SELECT {_COLS} FROM articles WHERE id = 7")
def article_by_id(s: Star) -> DataFrame:
    return shelf.article(s, 7)


@query("article_for_user", f"SELECT {_COLS}, ai_summary FROM articles LEFT JOIN (SELECT article_id AS id, ai_summary FROM article_summaries WHERE user_id = 3) USING (id)")
def article_for_user(s: Star) -> DataFrame:
    return shelf.article_for_user(s, 3)


@query("unread_of_anyone", "SELECT id, feed_id, published_date FROM articles LEFT JOIN state USING (id) WHERE NOT coalesce(read, false)")
def unread_of_anyone(s: Star) -> DataFrame:
    return shelf.unread_anyones(s).select(SHORT)


@query("unread_page", "SELECT id, feed_id, published_date FROM unread WHERE user_id = 2" + _NEWEST + "LIMIT 30 OFFSET 5")
def unread_page(s: Star) -> DataFrame:
    return shelf.newest(shelf.unread(s, 2).select(SHORT), 30, 5)


@query("unread_page_more", "SELECT id, feed_id, published_date, count(*) OVER () > 10 AS more FROM (SELECT * FROM unread WHERE user_id = 2" + _NEWEST + "LIMIT 11)" + _NEWEST + "LIMIT 10")
def unread_page_more(s: Star) -> DataFrame:
    return shelf.has_more(shelf.newest(shelf.unread(s, 2).select(SHORT), 11), 10)


@query("unread_over_threshold", passing(2, "SELECT user_id, id, feed_id FROM unread"))
def unread_over_threshold(s: Star) -> DataFrame:
    return shelf.unread(s, threshold=2).select("user_id", "id", "feed_id")


@query("unread_of_feed", "SELECT user_id, id, published_date FROM unread WHERE feed_id = 3")
def unread_of_feed(s: Star) -> DataFrame:
    return shelf.unread(s, feed=3).select("user_id", "id", "published_date")


@query("starred_over_threshold", passing(1, "SELECT user_id, id, feed_id FROM subscribed JOIN state USING (user_id, id) WHERE starred"))
def starred_over_threshold(s: Star) -> DataFrame:
    return shelf.starred(s, threshold=1).select("user_id", "id", "feed_id")


@query("starred_page", "SELECT id, feed_id, published_date FROM subscribed JOIN state USING (user_id, id) WHERE starred AND user_id = 1" + _NEWEST + "LIMIT 20 OFFSET 1")
def starred_page(s: Star) -> DataFrame:
    return shelf.newest(shelf.starred(s, 1).select(SHORT), 20, 1)


@query(
    "unread_group_members",
    passing(1, "SELECT group_id, user_id, id, feed_id, published_date FROM owned JOIN articles USING (id) LEFT JOIN (SELECT user_id, id, read FROM state) USING (user_id, id) WHERE NOT coalesce(read, false)"),
)
def unread_group_members(s: Star) -> DataFrame:
    return shelf.unread_in_groups(s, threshold=1).select("group_id", "user_id", *SHORT)


@query("group_members", "SELECT m.group_id, m.article_id AS id, g.user_id, coalesce(display_name, topic) AS label, feed_id, published_date FROM article_group_members m JOIN article_groups g ON g.id = m.group_id JOIN articles a ON a.id = m.article_id")
def group_members(s: Star) -> DataFrame:
    return shelf.group_articles(s)


@query("full_text_queue", "SELECT id, feed_id, published_date FROM articles WHERE NOT full_text_fetched" + _NEWEST + "LIMIT 50")
def full_text_queue(s: Star) -> DataFrame:
    return shelf.needing(s, "full_text_fetched", 50)


@query("image_queue", "SELECT id, feed_id, published_date FROM articles WHERE NOT images_cached" + _NEWEST + "LIMIT 50")
def image_queue(s: Star) -> DataFrame:
    return shelf.needing(s, "images_cached", 50)


@query("without_embeddings_of_model", "SELECT id, feed_id, published_date FROM articles WHERE id NOT IN (SELECT article_id FROM article_embeddings WHERE embedding_model = 'm1')")
def without_embeddings_of_model(s: Star) -> DataFrame:
    return shelf.without_embeddings(s, "m1")


@query("scoring_queue", "SELECT user_id, id, feed_id FROM waiting")
def scoring_queue(s: Star) -> DataFrame:
    return shelf.unscored(s).select("user_id", "id", "feed_id")


@query("unsummarized_count", "SELECT user_id, count(*)::BIGINT AS n FROM unsummarized GROUP BY 1")
def unsummarized_count(s: Star) -> DataFrame:
    return shelf.unsummarized_counts(s)


@query(
    "pending_by_user",
    ", q AS (SELECT user_id, count(*) AS n FROM waiting GROUP BY 1), b AS (SELECT user_id, count(*) AS n FROM unsummarized GROUP BY 1) "
    "SELECT user_id, coalesce(q.n, 0)::BIGINT AS unscored, coalesce(b.n, 0)::BIGINT AS unsummarized FROM (SELECT DISTINCT user_id FROM user_feeds) LEFT JOIN q USING (user_id) LEFT JOIN b USING (user_id)",
)
def pending_by_user(s: Star) -> DataFrame:
    return shelf.pending(s)


@query("sync_item_count", "SELECT user_id, count(*)::BIGINT AS n FROM subscribed GROUP BY 1")
def sync_item_count(s: Star) -> DataFrame:
    return shelf.subscribed_counts(s)


# --- feeds -------------------------------------------------------------------

_DUE = f"enabled AND status = 'active' AND (next_fetch_at IS NULL OR next_fetch_at <= {_NOW})"
_FOLLOWED = "id IN (SELECT feed_id FROM user_feeds)"


@query("due_feeds", f"SELECT id, url, title FROM feeds WHERE {_DUE}")
def due_feeds(s: Star) -> DataFrame:
    return shelf.due(s["feeds"], NOW).select("id", "url", "title")


@query("user_feed_titles", "SELECT user_id, id, coalesce(user_title, title) AS title, url FROM user_feeds JOIN feeds ON id = feed_id WHERE enabled")
def user_feed_titles(s: Star) -> DataFrame:
    return shelf.user_feeds(s)


@query("subscribed_due_feeds", f"SELECT id, title FROM feeds WHERE {_DUE} AND {_FOLLOWED}")
def subscribed_due_feeds(s: Star) -> DataFrame:
    return shelf.due(shelf.followed(s), NOW).select("id", "title")


@query("subscribed_active_feeds", f"SELECT id, title FROM feeds WHERE enabled AND {_FOLLOWED}")
def subscribed_active_feeds(s: Star) -> DataFrame:
    return shelf.followed(s).where("enabled").select("id", "title")


@query("feeds_without_favicons", f"SELECT id, url, site_url FROM feeds WHERE {_FOLLOWED} AND id NOT IN (SELECT feed_id FROM feed_favicons)")
def feeds_without_favicons(s: Star) -> DataFrame:
    return shelf.without_favicons(s)


@query("feed_subscribers", "SELECT feed_id, user_id FROM user_feeds WHERE feed_id = 4")
def feed_subscribers(s: Star) -> DataFrame:
    return shelf.only(s["user_feeds"], feed_id=4).select("feed_id", "user_id")


@query("subscribing_users", "SELECT DISTINCT user_id FROM user_feeds")
def subscribing_users(s: Star) -> DataFrame:
    return s["user_feeds"].select("user_id").distinct()


@query("article_authors_of", "SELECT article_id, name, email FROM article_authors WHERE article_id BETWEEN 1 AND 30")
def article_authors_of(s: Star) -> DataFrame:
    return s["article_authors"].where("article_id BETWEEN 1 AND 30")


@query("article_categories_of", "SELECT article_id, string_agg(category, ',' ORDER BY category) AS categories FROM article_categories GROUP BY 1")
def article_categories_of(s: Star) -> DataFrame:
    return s["article_categories"].groupBy("article_id").agg(F.array_join(F.array_sort(F.collect_list("category")), ",").alias("categories"))


@query("feed_categories", "SELECT DISTINCT feed_id, category AS name FROM articles JOIN article_categories ON article_id = id")
def feed_categories(s: Star) -> DataFrame:
    return shelf.feed_names(s, "category")


@query(
    "feed_metadata",
    "SELECT DISTINCT feed_id, name, 'author' AS kind FROM articles JOIN article_authors ON article_id = id UNION ALL SELECT DISTINCT feed_id, category, 'category' FROM articles JOIN article_categories ON article_id = id",
)
def feed_metadata(s: Star) -> DataFrame:
    return shelf.feed_metadata(s)


@query("filter_rules_of_feed", "SELECT id, feed_id, axis, value, score FROM filter_rules WHERE user_id = 1 AND (feed_id IS NULL OR feed_id = 3)")
def filter_rules_of_feed(s: Star) -> DataFrame:
    return shelf.filter_rules(s, 1, 3).select("id", "feed_id", "axis", "value", "score")


@query("has_filter_rules", "SELECT id AS user_id, id IN (SELECT user_id FROM filter_rules) AS has_rules FROM users")
def has_filter_rules(s: Star) -> DataFrame:
    return shelf.has_filter_rules(s)


_STATS = """
, t AS (SELECT feed_id, count(*) AS n, max(published_date) AS last_published FROM articles GROUP BY 1), u AS (SELECT user_id, feed_id, count(*) AS n FROM unread GROUP BY 1, 2),
b AS (SELECT user_id, feed_id, count(*) AS n FROM unsummarized GROUP BY 1, 2),
fs AS (SELECT f.user_id, f.feed_id, coalesce(user_title, title) AS title, last_published, coalesce(t.n, 0)::BIGINT AS total, coalesce(u.n, 0)::BIGINT AS unread, coalesce(b.n, 0)::BIGINT AS unsummarized
  FROM user_feeds f JOIN feeds ON feeds.id = f.feed_id LEFT JOIN t USING (feed_id) LEFT JOIN u ON u.user_id = f.user_id AND u.feed_id = f.feed_id
  LEFT JOIN b ON b.user_id = f.user_id AND b.feed_id = f.feed_id WHERE enabled)
"""


@query("feed_stats_full", _STATS + "SELECT * FROM fs")
def feed_stats_full(s: Star) -> DataFrame:
    return shelf.feed_stats(s)


@query("feed_stats_posted", _STATS + "SELECT * FROM fs WHERE total > 0")
def feed_stats_posted(s: Star) -> DataFrame:
    """Feeds with articles only."""
    return shelf.feed_stats(s, posted=True)


@query("feed_stats_sums", _STATS + "SELECT user_id, sum(total)::BIGINT AS total, sum(unread)::BIGINT AS unread, sum(unsummarized)::BIGINT AS unsummarized FROM fs GROUP BY 1")
def feed_stats_sums(s: Star) -> DataFrame:
    return shelf.feed_stats(s).groupBy("user_id").agg(*[F.sum(c).alias(c) for c in ("total", "unread", "unsummarized")])


@query("favicons", "SELECT feed_id, mime_type FROM feed_favicons")
def favicons(s: Star) -> DataFrame:
    return s["feed_favicons"].select("feed_id", "mime_type")


@query("favicon_of_feed", "SELECT feed_id, mime_type FROM feed_favicons WHERE feed_id = 3")
def favicon_of_feed(s: Star) -> DataFrame:
    return shelf.only(s["feed_favicons"], feed_id=3).select("feed_id", "mime_type")


@query("article_image_map", "SELECT article_id, original_url, id FROM article_images WHERE article_id = 5")
def article_image_map(s: Star) -> DataFrame:
    return shelf.only(s["article_images"], article_id=5).select("article_id", "original_url", "id")


@query("article_image", "SELECT id, article_id, mime_type, width, height FROM article_images WHERE id = 9")
def article_image(s: Star) -> DataFrame:
    return shelf.only(s["article_images"], id=9).select("id", "article_id", "mime_type", "width", "height")


# --- groups ------------------------------------------------------------------


@query("group_by_id", "SELECT id, user_id, topic, display_name, muted FROM article_groups WHERE id = 2")
def group_by_id(s: Star) -> DataFrame:
    return shelf.only(s["article_groups"], id=2).select("id", "user_id", "topic", "display_name", "muted")


@query("group_of_article", "SELECT user_id, id AS article_id, min(group_id) AS group_id FROM owned GROUP BY 1, 2")
def group_of_article(s: Star) -> DataFrame:
    return shelf.find_group(s)


@query("muted_groups", "SELECT id, muted FROM article_groups")
def muted_groups(s: Star) -> DataFrame:
    return s["article_groups"].select("id", "muted")


@query("group_summary", "SELECT * FROM group_summaries WHERE group_id = 4")
def group_summary(s: Star) -> DataFrame:
    return shelf.only(s["group_summaries"], group_id=4)


@query("summary_of_article", "SELECT * FROM article_summaries WHERE user_id = 1 AND article_id = 11")
def summary_of_article(s: Star) -> DataFrame:
    return shelf.only(s["article_summaries"], user_id=1, article_id=11)


@query("vectors_of_subscribed", "SELECT s.user_id, s.id, len(embedding)::INT AS dims FROM subscribed s JOIN article_embeddings e ON e.article_id = s.id WHERE embedding_model = 'm2'")
def vectors_of_subscribed(s: Star) -> DataFrame:
    return shelf.article_vectors(s, None, "m2", F.size("embedding").alias("dims"))


def _with_centroids(s: Star) -> Star:
    """Every group gets the mean of its members as its centroid."""
    cells = s["article_embeddings"].join(s["article_group_members"].select("article_id", "group_id"), "article_id").select("group_id", F.posexplode("embedding").alias("dim", "x"))
    means = cells.groupBy("group_id", "dim").agg(F.avg("x").alias("m")).groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("dim", "m"))).alias("l"))
    rows = means.select(F.col("group_id").alias("id"), F.transform("l", lambda c: c["m"].cast("float")).alias("embedding"), F.lit("m1").alias("embedding_model"))
    return changes.set_centroids(s, rows)


@query(
    "groups_with_centroids",
    "SELECT label::BIGINT AS id, label::BIGINT AS user_id, 'Topic ' || label AS topic, count(*)::BIGINT AS n, round(list_sum(list_transform(list(list_aggregate(embedding::DOUBLE[], 'sum')), lambda x: x)) / count(*), 3) AS total FROM embeddings GROUP BY 1, 2, 3",
)
def groups_with_centroids(s: Star) -> DataFrame:
    rows = shelf.groups_with_embeddings(_with_centroids(s), None, "m1")
    sizes = s["article_group_members"].groupBy(F.col("group_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return rows.join(sizes, "id").select("id", "user_id", "topic", "n", F.round(total, 3).alias("total"))


@query(
    "group_stats_labels",
    "SELECT o.user_id, group_id, coalesce(display_name, topic) AS label, count(*)::BIGINT AS n_members, count(*) FILTER (NOT coalesce(read, false))::BIGINT AS unread FROM owned o JOIN article_groups g ON g.id = group_id "
    "LEFT JOIN state r ON r.user_id = o.user_id AND r.id = o.id WHERE NOT muted GROUP BY 1, 2, 3 HAVING count(*) >= 2 AND count(*) FILTER (NOT coalesce(read, false)) > 0",
)
def group_stats_labels(s: Star) -> DataFrame:
    return shelf.group_stats(s)


@query(
    "group_links_by_owner",
    "SELECT o.user_id, group_id, min_by(o.id, (added_at, o.id)) AS first_article, count(*)::BIGINT AS n_members, "
    "least(CASE WHEN coalesce(max(interest_score), 0) > 0 THEN floor(max(interest_score) * 10) ELSE count(*) * 25 END, 100)::BIGINT AS temperature "
    "FROM owned o LEFT JOIN state r ON r.user_id = o.user_id AND r.id = o.id GROUP BY 1, 2 HAVING count(*) >= 2",
)
def group_links_by_owner(s: Star) -> DataFrame:
    return shelf.group_links(s)


@query(
    "group_first_titles",
    "SELECT group_id, string_agg(title, ' | ' ORDER BY i) AS titles FROM (SELECT group_id, title, row_number() OVER (PARTITION BY group_id ORDER BY added_at, article_id) AS i, article_id FROM article_group_members "
    "LEFT JOIN articles ON id = article_id) WHERE i <= 3 AND title IS NOT NULL GROUP BY 1",
)
def group_first_titles(s: Star) -> DataFrame:
    return shelf.first_titles(s)


# --- users, prompts, newsletters ---------------------------------------------


@query("user_by_name", "SELECT id, name, email FROM users WHERE lower(name) = 'user7'")
def user_by_name(s: Star) -> DataFrame:
    return shelf.user_by_name(s, "USER7").select("id", "name", "email")


@query("user_by_subject", "SELECT id, name FROM users WHERE oidc_sub = 'sub-6'")
def user_by_subject(s: Star) -> DataFrame:
    return shelf.only(s["users"], oidc_sub="sub-6").select("id", "name")


@query("user_list", "SELECT id, name FROM users")
def user_list(s: Star) -> DataFrame:
    return s["users"].select("id", "name")


@query("user_by_api_key", "SELECT id, name FROM users WHERE id IN (SELECT user_id FROM fever_credentials WHERE api_key = md5('user8@mail.example:secret'))")
def user_by_api_key(s: Star) -> DataFrame:
    import hashlib

    return shelf.user_by_api_key(s, hashlib.md5(b"user8@mail.example:secret").hexdigest()).select("id", "name")


@query("api_keys", "SELECT id AS user_id, api_key, api_key IS NOT NULL AS has_key FROM users LEFT JOIN fever_credentials ON user_id = id")
def api_keys(s: Star) -> DataFrame:
    rows = s["users"].select(F.col("id").alias("user_id")).join(s["fever_credentials"], "user_id", "left")
    return rows.withColumn("has_key", F.col("api_key").isNotNull())


@query("preference_maps", "SELECT user_id, string_agg(key || '=' || value, ';' ORDER BY key) AS preferences FROM user_preferences GROUP BY 1")
def preference_maps(s: Star) -> DataFrame:
    joined = F.array_join(F.transform(F.map_entries("preferences"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return shelf.preference_map(s).select("user_id", joined.alias("preferences"))


@query(
    "preferences_typed",
    ", p AS (SELECT user_id, max(value) FILTER (key = 'interest_threshold') AS i, max(value) FILTER (key = 'filter_threshold') AS f, max(value) FILTER (key = 'keywords') AS k FROM user_preferences GROUP BY 1) "
    "SELECT id AS user_id, coalesce(try_cast(i AS DOUBLE), 8.0) AS interest_threshold, 'present' AS notify_when, 7.0::DOUBLE AS notify_min_score, coalesce(try_cast(f AS INT), 0) AS filter_threshold, "
    "coalesce(list_aggregate(from_json(k, '[\"VARCHAR\"]'), 'string_agg', ','), '') AS keywords FROM users LEFT JOIN p ON user_id = id",
)
def preferences_typed(s: Star) -> DataFrame:
    return shelf.preferences(s).withColumn("keywords", F.array_join("keywords", ","))


@query("prompts_of_user", "SELECT prompt_type, prompt_template, coalesce(temperature, 0) AS temperature, coalesce(model, '') AS model FROM user_prompts WHERE user_id = 4")
def prompts_of_user(s: Star) -> DataFrame:
    rows = shelf.only(s["user_prompts"], user_id=4)
    return rows.select("prompt_type", "prompt_template", F.coalesce("temperature", F.lit(0.0)).alias("temperature"), F.coalesce("model", F.lit("")).alias("model"))


@query("newsletters_of_user", "SELECT id, name, schedule, (config_json::JSON ->> 'min_interest_score')::DOUBLE AS least, (config_json::JSON ->> 'max_articles')::INT AS most FROM newsletters WHERE user_id = 3")
def newsletters_of_user(s: Star) -> DataFrame:
    return shelf.newsletters(s, 3).select("id", "name", "schedule", F.col("config.min_interest_score").alias("least"), F.col("config.max_articles").alias("most"))


@query(
    "due_newsletters",
    f"SELECT id, schedule FROM newsletters WHERE enabled AND schedule IN ('hourly', 'daily') AND (last_generated_at IS NULL OR last_generated_at <= {_NOW} - CASE schedule WHEN 'hourly' THEN INTERVAL 1 HOUR ELSE INTERVAL 1 DAY END)",
)
def due_newsletters(s: Star) -> DataFrame:
    return shelf.due_newsletters(s, NOW).select("id", "schedule")


@query("issue_page", "SELECT id, headline, content_text, generated_at, sent_at, article_ids_json AS ids FROM newsletter_issues WHERE newsletter_id = 7 ORDER BY generated_at DESC, id DESC LIMIT 5 OFFSET 1")
def issue_page(s: Star) -> DataFrame:
    ids = F.concat(F.lit("["), F.array_join("article_ids", ", "), F.lit("]"))
    return shelf.issues(s, 7, 5, 1).select("id", "headline", "content_text", "generated_at", "sent_at", ids.alias("ids"))


@query(
    "newsletter_stats",
    ", x AS (SELECT newsletter_id, count(*) AS n, count(sent_at) AS m, max_by(headline, (generated_at, id)) AS latest FROM newsletter_issues GROUP BY 1) "
    "SELECT id AS newsletter_id, name, coalesce(n, 0)::BIGINT AS n_issues, coalesce(m, 0)::BIGINT AS n_sent, latest FROM newsletters LEFT JOIN x ON newsletter_id = id",
)
def newsletter_stats(s: Star) -> DataFrame:
    return shelf.newsletter_stats(s)


@query(
    "issue_articles",
    ", letters AS (SELECT id AS newsletter_id, user_id, (config_json::JSON ->> 'min_interest_score')::DOUBLE AS least, from_json(config_json::JSON -> 'include_feeds', '[\"BIGINT\"]') AS feeds, "
    "(config_json::JSON ->> 'max_articles')::INT AS most, last_generated_at FROM newsletters) "
    "SELECT newsletter_id, rank::INT AS rank, id, round(interest_score, 6) AS interest_score FROM (SELECT newsletter_id, id, interest_score, CASE WHEN most > 0 THEN most ELSE 20 END AS most, "
    "row_number() OVER (PARTITION BY newsletter_id ORDER BY interest_score DESC, id DESC) AS rank FROM subscribed s JOIN state r USING (user_id, id) JOIN letters l USING (user_id) "
    "WHERE interest_score IS NOT NULL AND interest_score >= least AND list_contains(feeds, s.feed_id) AND (last_generated_at IS NULL OR published_date > last_generated_at)) WHERE rank <= most",
)
def issue_articles(s: Star) -> DataFrame:
    return shelf.issue_articles(s, shelf.newsletters(s)).withColumn("interest_score", F.round("interest_score", 6))


# --- changes -----------------------------------------------------------------

_MARKED = f"(SELECT user_id, id FROM subscribed WHERE user_id = 1 AND (published_date IS NULL OR published_date <= TIMESTAMP '2024-01-20'))"
_STATE = "SELECT user_id, article_id, read, read_date, starred, ai_scored, ai_retries FROM "


def _state_after(rows: str, date: str = _NOW) -> str:
    """The reading state after marking (user_id, id) rows read."""
    return (
        f"{_STATE}(SELECT s.user_id, s.article_id, s.read OR m.id IS NOT NULL AS read, CASE WHEN m.id IS NOT NULL THEN {date} ELSE s.read_date END AS read_date, starred, ai_scored, ai_retries "
        f"FROM read_state s LEFT JOIN {rows} m ON m.user_id = s.user_id AND m.id = s.article_id UNION ALL SELECT m.user_id, m.id, true, {date}, false, false, 0 FROM {rows} m "
        "ANTI JOIN read_state s ON m.user_id = s.user_id AND m.id = s.article_id)"
    )


def _shown(s: Star) -> DataFrame:
    return s["read_state"].select("user_id", "article_id", "read", "read_date", "starred", "ai_scored", "ai_retries")


@query("mark_all_read", _state_after(_MARKED))
def mark_all_read(s: Star) -> DataFrame:
    return _shown(changes.mark_all(s, 1, NOW, "2024-01-20 00:00:00"))


@query("mark_feed_read", _state_after("(SELECT 2 AS user_id, id FROM articles WHERE feed_id = 5)"))
def mark_feed_read(s: Star) -> DataFrame:
    return _shown(changes.mark_feed(s, 2, 5, NOW))


@query("mark_group_read", _state_after("(SELECT 3 AS user_id, id FROM owned JOIN articles USING (id) WHERE group_id = 3)"))
def mark_group_read(s: Star) -> DataFrame:
    return _shown(changes.mark_group(s, 3, 3, NOW))


@query(
    "mute_group",
    _state_after("(SELECT user_id, id FROM owned JOIN articles USING (id) WHERE group_id = 2)").replace("SELECT user_id, article_id, read,", "SELECT user_id, article_id, read, (SELECT count(*) FROM article_groups WHERE muted OR id = 2)::BIGINT AS n_muted,", 1),
)
def mute_group(s: Star) -> DataFrame:
    after = changes.mute(s, 2, NOW)
    muted = after["article_groups"].agg(F.count_if("muted").alias("n_muted"))
    return _shown(after).join(F.broadcast(muted))


_LOGGED = """, asked AS (
  SELECT user_id, event_id % 200 AS article_id, event_id AS seq, event_type AS kind, event_id % 7 < 3 AS flag, value, event_id % 3 AS batch FROM events),
lasts AS (
  SELECT user_id, article_id, arg_max(flag, (batch, seq)) FILTER (kind = 'view') AS read, arg_max(flag, (batch, seq)) FILTER (kind = 'click') AS starred,
         arg_max(value, (batch, seq)) FILTER (kind = 'purchase') AS interest, max((batch, seq)) FILTER (kind = 'purchase') AS scored,
         count(*) FILTER (kind = 'error') AS failed, bool_or(kind IN ('view', 'click', 'purchase', 'error')) AS known FROM asked GROUP BY 1, 2),
second AS (SELECT user_id, article_id, arg_max(value, (batch, seq)) FILTER (kind = 'purchase') AS then_score FROM asked WHERE batch < 2 GROUP BY 1, 2),
late AS (
  SELECT user_id, article_id, count(*) FILTER (kind = 'error') AS failed, arg_max(value, seq) FILTER (kind = 'purchase') AS interest FROM asked WHERE batch = 2 GROUP BY 1, 2)
SELECT user_id, article_id, coalesce(read, false) AS read, coalesce(starred, false) AS starred,
       CASE WHEN reset THEN late_interest ELSE interest END AS interest_score, CASE WHEN reset THEN late_interest ELSE interest END IS NOT NULL AS ai_scored,
       (CASE WHEN reset THEN coalesce(late_failed, 0) ELSE failed END)::INT AS ai_retries
FROM (SELECT l.*, coalesce(user_id = 1 AND then_score < 50, false) AS reset, late.interest AS late_interest, late.failed AS late_failed
      FROM lasts l LEFT JOIN second USING (user_id, article_id) LEFT JOIN late USING (user_id, article_id) WHERE known)
"""


@query("state_from_log", _LOGGED)
def state_from_log(s: Star) -> DataFrame:
    """Events as requests in three batches: contradicting marks, stars and scores, failures, a reset before the last batch, and a compaction."""
    events = s.spark.read.parquet(f"{s.path}/events.parquet")
    asked = events.select("user_id", (F.col("event_id") % 200).alias("article_id"), F.col("event_id").alias("seq"), "event_type", (F.col("event_id") % 7 < 3).alias("flag"), "value", (F.col("event_id") % 3).alias("batch"))
    log = statelog.StateLog(s.spark, f"{shared_dir(s.spark)}/state-{uuid.uuid4().hex}", buckets=4)
    for k in range(3):
        part = asked.where(F.col("batch") == k)
        log.mark(part.where("event_type = 'view'").withColumnRenamed("flag", "read"), NOW)
        log.star(part.where("event_type = 'click'").withColumnRenamed("flag", "starred"))
        log.score(part.where("event_type = 'purchase'").withColumns({"interest_score": F.col("value"), "security_score": F.col("value")}))
        log.retry(part.where("event_type = 'error'"))
        if k == 1:
            log.compact()
            log.reset(1, 50.0)
    return log.state().select("user_id", "article_id", "read", "starred", "interest_score", "ai_scored", "ai_retries")


@query("reset_insecure_scores", "SELECT user_id, article_id, CASE WHEN hit THEN NULL ELSE interest_score END AS interest_score, ai_scored AND NOT hit AS ai_scored, CASE WHEN hit THEN 0 ELSE ai_retries END AS ai_retries FROM (SELECT *, coalesce(user_id = 1 AND security_score < 4, false) AS hit FROM read_state)")
def reset_insecure_scores(s: Star) -> DataFrame:
    return changes.reset_scores(s, 1, 4.0)["read_state"].select("user_id", "article_id", "interest_score", "ai_scored", "ai_retries")


@query("count_retries", "SELECT user_id, article_id, ai_retries + CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END AS ai_retries FROM read_state UNION ALL SELECT user_id, 1000000, 1 FROM users, (SELECT id AS user_id FROM users) u WHERE users.id = u.user_id AND user_id % 2 = 0")
def count_retries(s: Star) -> DataFrame:
    even = s["read_state"].where("user_id % 2 = 0").select("user_id", "article_id")
    new = s["users"].where("id % 2 = 0").select(F.col("id").alias("user_id"), F.lit(1_000_000).cast("long").alias("article_id"))
    return changes.retry(s, even.union(new))["read_state"].select("user_id", "article_id", "ai_retries")


@query("disband_group", "SELECT g.id, count(article_id)::BIGINT AS n FROM article_groups g LEFT JOIN article_group_members ON group_id = g.id WHERE g.id <> 3 GROUP BY 1")
def disband_group(s: Star) -> DataFrame:
    after = changes.disband(s, 3, values(s, "id long", (3,), (4,)))  # 4 is another user's
    members = after["article_group_members"].select("group_id", "article_id")
    return after["article_groups"].select("id").join(members, F.col("id") == F.col("group_id"), "left").groupBy("id").agg(F.count("article_id").alias("n"))


@query("create_groups", "SELECT id, user_id, topic FROM article_groups UNION ALL SELECT (SELECT max(id) FROM article_groups) + row_number() OVER (ORDER BY id), id, 'New ' || id FROM users WHERE id < 40")
def create_groups(s: Star) -> DataFrame:
    new = s["users"].where("id < 40").select(F.col("id").alias("user_id"), F.concat(F.lit("New "), "id").alias("topic"))
    return changes.create_groups(s, new, NOW)["article_groups"].select("id", "user_id", "topic")


@query("add_group_members", "SELECT DISTINCT group_id, article_id FROM (SELECT group_id, article_id FROM article_group_members UNION ALL SELECT (vec_id % 5)::BIGINT, vec_id FROM embeddings)")
def add_group_members(s: Star) -> DataFrame:
    new = s["article_embeddings"].select((F.col("article_id") % 5).alias("group_id"), "article_id")
    return changes.add_members(s, new, NOW)["article_group_members"].select("group_id", "article_id")


@query("store_article_names", "SELECT article_id, lower(name) AS name FROM article_authors UNION SELECT id, lower('AUTHOR ' || (id % 6)) FROM articles")
def store_article_names(s: Star) -> DataFrame:
    new = s["articles"].select(F.col("id").alias("article_id"), F.concat(F.lit("AUTHOR "), F.col("id") % 6).alias("name"))
    return changes.store_names(s, authors=new)["article_authors"].select("article_id", F.lower("name").alias("name"))


@query("store_summaries", "SELECT user_id, article_id, CASE WHEN article_id % 2 = 0 THEN 'again' ELSE ai_summary END AS ai_summary FROM article_summaries UNION ALL SELECT 999999, 1, 'fresh'")
def store_summaries(s: Star) -> DataFrame:
    again = s["article_summaries"].where("article_id % 2 = 0").withColumn("ai_summary", F.lit("again")).select("user_id", "article_id", "ai_summary")
    return changes.store(s, "article_summaries", again.union(values(s, "user_id long, article_id long, ai_summary string", (999999, 1, "fresh"))))["article_summaries"].drop("generated_at")


@query("store_full_texts", "SELECT id, md5(CASE WHEN id % 2 = 0 THEN 'Full ' || title ELSE content END) AS digest, full_text_fetched OR id % 2 = 0 AS full_text_fetched FROM articles")
def store_full_texts(s: Star) -> DataFrame:
    full = s["articles"].where("id % 2 = 0").select("id", F.concat(F.lit("Full "), "title").alias("content"))
    return changes.set_content(s, full)["articles"].select("id", F.md5(F.col("content").cast("binary")).alias("digest"), "full_text_fetched")


@query("flag_cached_images", "SELECT id, images_cached OR id < 100 AS images_cached FROM articles")
def flag_cached_images(s: Star) -> DataFrame:
    return changes.flag_articles(s, s["articles"].where("id < 100").select("id"), "images_cached")["articles"].select("id", "images_cached")


@query("add_feeds", "SELECT id, url, title FROM feeds UNION ALL SELECT (SELECT max(id) FROM feeds) + row_number() OVER (ORDER BY url), url, url FROM (SELECT DISTINCT 'https://new.example/' || (c_custkey % 30) AS url FROM customer)")
def add_feeds(s: Star) -> DataFrame:
    new = s["newsletters"].select(F.concat(F.lit("https://new.example/"), F.col("id") % 30).alias("url"), F.lit("").alias("title"))
    known = s["feeds"].select("url", "title")
    return changes.add_feeds(s, new.union(known), NOW)["feeds"].select("id", "url", "title")


@query("rename_user_feeds", "SELECT user_id, feed_id, CASE WHEN feed_id = 2 THEN NULL WHEN feed_id = 3 THEN 'Three' ELSE user_title END AS user_title FROM user_feeds")
def rename_user_feeds(s: Star) -> DataFrame:
    asked = s["user_feeds"].where("feed_id IN (2, 3)").select("user_id", "feed_id", F.when(F.col("feed_id") == 3, "Three").otherwise("").alias("user_title"))
    return changes.rename_for_users(s, asked)["user_feeds"].select("user_id", "feed_id", "user_title")


@query("subscribe_all", "SELECT user_id, feed_id FROM user_feeds UNION SELECT id, 6 FROM users")
def subscribe_all(s: Star) -> DataFrame:
    return changes.subscribe(s, s["users"].select(F.col("id").alias("user_id"), F.lit(6).cast("long").alias("feed_id")), NOW)["user_feeds"].select("user_id", "feed_id")


@query("unsubscribe_orphans", "SELECT (SELECT count(*) FROM feeds WHERE id <> 6)::BIGINT AS feeds, (SELECT count(*) FROM articles WHERE feed_id <> 6)::BIGINT AS articles, "
       "(SELECT count(*) FROM user_feeds WHERE feed_id <> 6 AND NOT (user_id = 1 AND feed_id = 5))::BIGINT AS subscriptions, (SELECT count(*) FROM read_state WHERE article_id NOT IN (SELECT id FROM articles WHERE feed_id = 6))::BIGINT AS states")  # fmt: skip
def unsubscribe_orphans(s: Star) -> DataFrame:
    asked = s["user_feeds"].where("feed_id = 6 OR (user_id = 1 AND feed_id = 5)").select("user_id", "feed_id")
    after = changes.unsubscribe(s, asked)
    n = {"feeds": "feeds", "articles": "articles", "subscriptions": "user_feeds", "states": "read_state"}
    counts = [after[t].agg(F.count(F.lit(1)).alias(c)) for c, t in n.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.join(F.broadcast(c))
    return out


@query("feeds_fetched", f"SELECT id, CASE WHEN id % 2 = 0 THEN {_NOW} ELSE last_fetched END AS last_fetched, CASE WHEN id % 2 = 1 THEN last_error END AS last_error, CASE WHEN id % 2 = 0 THEN 0 ELSE consecutive_errors END AS consecutive_errors, CASE WHEN id % 2 = 0 THEN 'active' ELSE status END AS status FROM feeds")
def feeds_fetched(s: Star) -> DataFrame:
    asked = s["feeds"].where("id % 2 = 0").select("id", F.lit(None).cast("timestamp_ntz").alias("next_fetch_at"))
    return changes.fetched(s, asked, NOW)["feeds"].select("id", "last_fetched", "last_error", "consecutive_errors", "status")


@query(
    "feeds_failed",
    f"SELECT id, consecutive_errors + 1 AS consecutive_errors, CASE WHEN dead THEN 'dead' ELSE status END AS status, CASE WHEN dead THEN next_fetch_at ELSE {_NOW} + to_minutes(least(60 * (1 << least(consecutive_errors + 1, 6)), 43200)) END AS next_fetch_at "
    f"FROM (SELECT *, consecutive_errors + 1 >= 5 AND (last_fetched IS NULL OR date_diff('second', last_fetched, {_NOW}) > 2592000) AS dead FROM feeds)",
)
def feeds_failed(s: Star) -> DataFrame:
    asked = s["feeds"].select("id", F.lit("boom").alias("error"), F.lit(60).alias("base_minutes"))
    return changes.failed(s, asked, NOW)["feeds"].select("id", "consecutive_errors", "status", "next_fetch_at")


def _rule_requests(s: Star) -> DataFrame:
    rows = [(1, None, "category", "en", 1), (1, None, "colour", "x", 1), (1, 3, "author", " ", 1), (1, 4, "category", "EN", 3), (5, None, "tag", "de", 2), (2, 8, "author", "Author 11", 1)]
    return values(s, "user_id long, feed_id long, axis string, value string, score int", *rows)


@query("rule_faults", "SELECT * FROM (VALUES (1, NULL, 'category', 'en', 1, 'exists'), (1, NULL, 'colour', 'x', 1, 'axis'), (1, 3, 'author', ' ', 1, 'value'), (1, 4, 'category', 'EN', 3, NULL), (5, NULL, 'tag', 'de', 2, NULL), (2, 8, 'author', 'Author 11', 1, 'exists')) AS t(user_id, feed_id, axis, value, score, fault)")
def rule_faults(s: Star) -> DataFrame:
    return changes.rule_faults(s, _rule_requests(s))


@query("add_filter_rules", "SELECT id, user_id, feed_id, axis, value, score FROM filter_rules UNION ALL VALUES (7, 1, 4, 'category', 'EN', 3), (8, 5, NULL, 'tag', 'de', 2)")
def add_filter_rules(s: Star) -> DataFrame:
    return changes.add_rules(s, _rule_requests(s), NOW)["filter_rules"].drop("created_at")


@query("change_filter_rules", "SELECT id, CASE WHEN id = 2 THEN 9 ELSE score END AS score FROM filter_rules WHERE id <> 3")
def change_filter_rules(s: Star) -> DataFrame:
    after = changes.delete_rules(changes.rescore_rules(s, values(s, "id long, score int", (2, 9))), values(s, "id long", (3,)))
    return after["filter_rules"].select("id", "score")


@query("add_users", "SELECT id, name FROM users UNION ALL SELECT (SELECT max(id) FROM users) + 1, 'Newcomer'")
def add_users(s: Star) -> DataFrame:
    asked = values(s, "name string, oidc_sub string, email string", ("USER1", None, None), ("Newcomer", "sub-new", "n@mail.example"), ("Other", "sub-0", None))
    return changes.add_users(s, asked, NOW)["users"].select("id", "name")


@query(
    "set_preferences",
    "SELECT user_id, key, value FROM user_preferences WHERE NOT (user_id = 3 AND key IN ('interest_threshold', 'keywords')) UNION ALL VALUES (3, 'interest_threshold', '6.5'), (3, 'keywords', '[\"a\"]'), (3, 'notify_when', 'queue')",
)
def set_preferences(s: Star) -> DataFrame:
    rows = [(3, "interest_threshold", "6.5"), (3, "keywords", '["a"]'), (3, "notify_when", "queue"), (4, "notify_when", "never"), (4, "filter_threshold", "x"), (4, "colour", "red")]
    return changes.set_preferences(s, values(s, "user_id long, key string, value string", *rows))["user_preferences"]


@query("delete_preference", "SELECT user_id, key FROM user_preferences WHERE NOT (user_id = 3 AND key = 'keywords')")
def delete_preference(s: Star) -> DataFrame:
    return changes.forget(s, "user_preferences", values(s, "user_id long, key string", (3, "keywords")))["user_preferences"].select("user_id", "key")


@query("create_newsletters", "SELECT id, user_id, name FROM newsletters UNION ALL SELECT (SELECT max(id) FROM newsletters) + row_number() OVER (ORDER BY id), id, 'Daily' FROM users WHERE id < 10")
def create_newsletters(s: Star) -> DataFrame:
    new = s["users"].where("id < 10").select(F.col("id").alias("user_id"), F.lit("Daily").alias("name"), F.lit("daily").alias("schedule"))
    return changes.create_newsletters(s, new, NOW)["newsletters"].select("id", "user_id", "name")


@query("delete_newsletters", "SELECT id, (SELECT count(*) FROM newsletter_issues WHERE newsletter_id <> 3)::BIGINT AS n_issues FROM newsletters WHERE id <> 3")
def delete_newsletters(s: Star) -> DataFrame:
    after = changes.delete_newsletters(s, 3, values(s, "id long", (3,), (4,)))  # 4 is another user's
    return after["newsletters"].select("id").join(F.broadcast(after["newsletter_issues"].agg(F.count(F.lit(1)).alias("n_issues"))))


@query(
    "add_issue",
    f"SELECT newsletter_id, id, article_ids_json, CASE WHEN newsletter_id = 5 THEN {_NOW} ELSE last_generated_at END AS last_generated_at FROM (SELECT newsletter_id, id, article_ids_json FROM newsletter_issues UNION ALL SELECT 5, (SELECT max(id) FROM newsletter_issues) + 1, '[1,2,3]') i "
    "JOIN (SELECT id AS n, last_generated_at FROM newsletters) ON n = newsletter_id",
)
def add_issue(s: Star) -> DataFrame:
    issue = values(s, "newsletter_id long, headline string, article_ids array<long>", (5, "H", [1, 2, 3]))
    after = changes.add_issues(s, issue, NOW)
    letters = after["newsletters"].select(F.col("id").alias("newsletter_id"), "last_generated_at")
    return after["newsletter_issues"].select("newsletter_id", "id", "article_ids_json").join(letters, "newsletter_id")


@query("mark_issue_sent", f"SELECT id, CASE WHEN id % 7 = 0 THEN {_NOW} ELSE sent_at END AS sent_at FROM newsletter_issues")
def mark_issue_sent(s: Star) -> DataFrame:
    return changes.mark_sent(s, s["newsletter_issues"].where("id % 7 = 0").select("id"), NOW)["newsletter_issues"].select("id", "sent_at")


# --- links, exports, counters, vectors -------------------------------------------------


@query("group_link_items", "SELECT user_id, group_id, string_agg(id::VARCHAR, ',' ORDER BY added_at, id) AS item_ids FROM owned GROUP BY 1, 2 HAVING count(*) >= 2")
def group_link_items(s: Star) -> DataFrame:
    return shelf.group_link_items(s)


@query(
    "opml_of_all_feeds",
    """SELECT 1::INT AS place, url, '<outline type="rss" text="' || title || '" title="' || title || '" xmlUrl="' || url || '"/>' AS line
FROM feeds WHERE enabled AND status = 'active' AND id IN (SELECT feed_id FROM user_feeds)
UNION ALL SELECT 0, NULL, '<opml version="2.0"><head><title>All subscriptions</title></head><body>' UNION ALL SELECT 2, NULL, '</body></opml>'""",
)
def opml_of_all_feeds(s: Star) -> DataFrame:
    """Every active feed that somebody reads, once."""
    feeds = s["feeds"].where("enabled AND status = 'active'")
    return render.opml_lines(feeds.join(s["user_feeds"].select(F.col("feed_id").alias("id")).distinct(), "id", "left_semi").select("url", "title"))


@query(
    "fetch_result",
    """, c AS (
  SELECT count(*) AS feeds_total, count(*) FILTER (last_error IS NULL AND etag IS NULL) AS feeds_downloaded, count(*) FILTER (last_error IS NULL AND etag IS NOT NULL) AS feeds_not_modified,
         count(*) FILTER (last_error IS NOT NULL) AS feeds_errored, (SELECT count(*) FROM articles WHERE fetched_date >= TIMESTAMP '2024-01-20') AS new_articles,
         (SELECT count(*) FROM read_state WHERE ai_scored) AS processed, (SELECT count(*) FROM read_state WHERE ai_scored AND interest_score >= 8) AS high_interest FROM feeds)
SELECT unnest(range(0, 10))::INT AS nr, unnest([
  'feeds_total=' || feeds_total, 'feeds_downloaded=' || feeds_downloaded, 'feeds_not_modified=' || feeds_not_modified, 'feeds_errored=' || feeds_errored,
  'new_articles=' || new_articles, 'processed=' || processed, 'high_interest=' || high_interest,
  'Feeds: ' || feeds_total || ' checked, ' || feeds_downloaded || ' downloaded, ' || feeds_not_modified || ' unchanged, ' || feeds_errored || ' errors',
  'New articles: ' || new_articles, to_json(c)::VARCHAR]) AS line FROM c""",
)
def fetch_result(s: Star) -> DataFrame:
    outcome = F.when(F.col("last_error").isNotNull(), "error").when(F.col("etag").isNotNull(), "not_modified").otherwise("downloaded")
    counts = render.fetch_result(s["feeds"].select(outcome.alias("outcome")), s["articles"], s["read_state"].where("ai_scored"), "2024-01-20 00:00:00")
    return render.fetch_lines(counts)


@query(
    "backfilled_embeddings",
    """SELECT article_id, n::DOUBLE AS seen, 'm1' AS embedding_model FROM (
  SELECT a.id AS article_id, CASE WHEN strlen(content) >= 200 THEN CASE WHEN strlen(title) + 1 + strlen(content) >= 7497 THEN 7500 ELSE strlen(title) + 1 + strlen(content) END ELSE 0 END AS n
  FROM articles a WHERE NOT EXISTS (SELECT 1 FROM article_embeddings e WHERE e.article_id = a.id AND e.embedding_model = 'm1'))""",
)
def backfilled_embeddings(s: Star) -> DataFrame:
    """All articles without a vector of model m1 get one (here the bytes that the model saw)."""
    embed = lambda rows: rows.withColumn("embedding", F.array(F.octet_length("text").cast("float")))
    before = s["article_embeddings"].where("embedding_model = 'm1'").select("article_id")
    after = prompts.backfill_embeddings(s, embed, "m1", NOW)["article_embeddings"].join(before, "article_id", "left_anti").where("embedding_model = 'm1'")
    seen = F.coalesce(F.get("embedding", F.lit(0)), F.lit(0.0)).cast("double")
    # A character that the cut would split is left out whole: at most three bytes less.
    return after.select("article_id", F.when(seen >= 7497, 7500.0).otherwise(seen).alias("seen"), "embedding_model")


@query(
    "issue_mails",
    """SELECT id, '<!DOCTYPE html><html><head><meta charset="utf-8"><title>' || headline || '</title></head><body style="margin:0;background:#eee;font-family:sans-serif">'
 || '<div style="max-width:600px;margin:20px auto;padding:30px;background:#fff;color:#333;line-height:1.6">' || content_html || '</div></body></html>' AS mail FROM newsletter_issues""",
)
def issue_mails(s: Star) -> DataFrame:
    return s["newsletter_issues"].select("id", render.in_mail(F.col("headline"), F.col("content_html")).alias("mail"))


@query(
    "fitted_icons",
    """, src AS (SELECT vec_id AS id, 1 + vec_id % 150 AS w, 1 + vec_id * 7 % 130 AS h FROM embeddings),
dst AS (
  SELECT *, CASE WHEN w <= 64 AND h <= 64 THEN w WHEN w > h THEN 64 ELSE greatest(1, w * 64 // h) END AS dw,
         CASE WHEN w <= 64 AND h <= 64 THEN h WHEN w > h THEN greatest(1, h * 64 // w) ELSE 64 END AS dh FROM src),
px AS (SELECT id, w, h, dw, dh, x, unnest(range(0, dh)) AS y FROM (SELECT *, unnest(range(0, dw)) AS x FROM dst))
SELECT id, any_value(dw)::INT AS width, any_value(dh)::INT AS height, sum((id * 31 + (x * w // dw) * 7 + (y * h // dh) * 13) % 256)::BIGINT AS red FROM px GROUP BY 1""",
)
def fitted_icons(s: Star) -> DataFrame:
    """An image of each vector's id, fitted as an icon; the sum of its red pixels tells whether the right ones were taken."""
    made = s["article_embeddings"].select(F.col("article_id").alias("id"))
    drawn = made.withColumn("png", images.drawn(F.col("id"), 1 + F.col("id") % 150, 1 + F.col("id") * 7 % 130)).withColumn("icon", images.icon_png(F.col("png")))
    return drawn.select("id", "icon.width", "icon.height", images.red_sum(F.col("icon.data")).alias("red"))


# --- rules of many users, made from customers -----------------------------------------

_MADE_RULES = """SELECT c_custkey AS id, c_custkey % 50 AS user_id, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 20 END AS feed_id,
  CASE WHEN c_custkey % 16 = 15 THEN 'colour' WHEN c_custkey % 8 < 3 THEN 'author' WHEN c_custkey % 8 < 6 THEN 'category' ELSE 'tag' END AS axis,
  CASE WHEN c_custkey % 32 = 1 THEN ' ' WHEN c_custkey % 8 < 3 THEN 'Author ' || c_custkey % 13 WHEN c_custkey % 4 = 0 THEN 'EN' WHEN c_custkey % 4 = 1 THEN 'fr' ELSE 'De' END AS value,
  CAST(c_custkey % 11 - 5 AS INT) AS score FROM customer"""
_HELD = """, made AS (""" + _MADE_RULES + """),
held AS (
  SELECT id, user_id, feed_id, axis, value, score FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, coalesce(feed_id, -1), axis, lower(value) ORDER BY id) AS k FROM made WHERE id % 2 = 0 AND axis <> 'colour' AND trim(value) <> '') WHERE k = 1),
judged AS (
  SELECT m.*, CASE WHEN axis = 'colour' THEN 'axis' WHEN trim(value) = '' THEN 'value'
    WHEN EXISTS (SELECT 1 FROM held h WHERE h.user_id = m.user_id AND h.feed_id IS NOT DISTINCT FROM m.feed_id AND h.axis = m.axis AND lower(h.value) = lower(m.value)) THEN 'exists' END AS fault
  FROM made m WHERE id % 2 = 1)
"""


def _with_rules(s: Star) -> tuple[Star, DataFrame]:
    """A star with rules from customers, and requests for more, in order of ``seq``."""
    made = s.spark.sql(_MADE_RULES.replace("FROM customer", "FROM {customer}"), customer=s.spark.read.parquet(f"{s.path}/customer.parquet"))
    held = made.where("id % 2 = 0 AND axis <> 'colour' AND trim(value) <> ''").withColumns({"feed_key": F.coalesce("feed_id", F.lit(-1)), "low": F.lower("value")})
    first = held.groupBy("user_id", "feed_key", "axis", "low").agg(F.min(F.struct("id", "feed_id", "value", "score")).alias("f"))
    return s.replace(filter_rules=first.select("user_id", "axis", "f.*")), made.where("id % 2 = 1").withColumnRenamed("id", "seq")


@query("rules_of_feed_made", _HELD + "SELECT id, feed_id, axis, value, score FROM held WHERE user_id = 2 AND (feed_id IS NULL OR feed_id = 12)")
def rules_of_feed_made(s: Star) -> DataFrame:
    return shelf.filter_rules(_with_rules(s)[0], 2, 12).select("id", "feed_id", "axis", "value", "score")


@query("rule_faults_made", _HELD + "SELECT id AS seq, user_id, feed_id, axis, value, score, fault FROM judged")
def rule_faults_made(s: Star) -> DataFrame:
    ruled, asked = _with_rules(s)
    return changes.rule_faults(ruled, asked)


@query(
    "add_rules_made",
    _HELD + "SELECT user_id, feed_id, axis, value, score FROM held UNION ALL SELECT user_id, feed_id, axis, value, score FROM ("
    "SELECT *, row_number() OVER (PARTITION BY user_id, feed_id, axis, lower(value) ORDER BY id) AS k FROM judged WHERE fault IS NULL) WHERE k = 1",
)
def add_rules_made(s: Star) -> DataFrame:
    return changes.add_rules(*_with_rules(s), NOW)["filter_rules"].select("user_id", "feed_id", "axis", "value", "score")


@query("change_rules_made", _HELD + "SELECT id, CASE WHEN id % 5 = 0 THEN 9 ELSE score END::INT AS score FROM held WHERE id % 7 <> 0")
def change_rules_made(s: Star) -> DataFrame:
    ruled = _with_rules(s)[0]
    rules = ruled["filter_rules"]
    scored = changes.rescore_rules(ruled, rules.where("id % 5 = 0").select("id", F.lit(9).alias("score")))
    return changes.delete_rules(scored, rules.where("id % 7 = 0").select("id"))["filter_rules"].select("id", "score")


@query("summary_of_first_article", "SELECT ai_summary FROM article_summaries WHERE user_id = (SELECT min(user_id) FROM article_summaries) AND article_id = (SELECT min_by(article_id, (user_id, article_id)) FROM article_summaries)")
def summary_of_first_article(s: Star) -> DataFrame:
    first = s["article_summaries"].agg(F.min(F.struct("user_id", "article_id")).alias("f")).select("f.*")
    return s["article_summaries"].join(F.broadcast(first), ["user_id", "article_id"]).select("ai_summary")


@query(
    "touched_groups",
    "SELECT DISTINCT group_id FROM (SELECT 2 AS group_id WHERE NOT EXISTS (SELECT 1 FROM article_group_members WHERE group_id = 2 AND article_id = 5) "
    "UNION ALL SELECT o.group_id FROM owned o JOIN article_summaries x ON x.user_id = o.user_id AND x.article_id = o.id WHERE o.id % 25 = 0)",
)
def touched_groups(s: Star) -> DataFrame:
    """Groups to be summarised anew after a new member and some new article summaries."""
    after = changes.add_members(s, values(s, "group_id long, article_id long", (2, 5)), NOW)
    again = s["article_summaries"].where("article_id % 25 = 0").withColumn("ai_summary", F.concat("ai_summary", F.lit(" anew")))
    return refresh.touched_groups(s, changes.store(after, "article_summaries", again))
