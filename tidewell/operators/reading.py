"""Listings: unread, starred, queued, rule-scored and time-decayed articles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidewell.operators import readers
from tidewell.plans.scratch import broadcast_if_small
from tidewell.sources.tables import Tables


def newest(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(F.desc_nulls_last("published"), F.desc("article_id")).offset(offset).limit(limit)


def subscribed(t: Tables, user: int | None = None) -> DataFrame:
    """(user_id, article_id, feed_id, published) of subscribed feeds, of one user or of all."""
    subs = t.subscriptions if user is None else t.subscriptions.where(F.col("user_id") == user)
    return t.articles.select("article_id", "feed_id", "published").join(subs, "feed_id")


def grouped(t: Tables) -> DataFrame:
    """(user_id, article_id) of articles that sit in a group of the user."""
    return t.members.join(t.groups.select("group_id", "user_id"), "group_id").select("user_id", "article_id").distinct()


def dated(t: Tables) -> DataFrame:
    return t.articles.select(F.col("article_id").alias("id"), "feed_id", "published")


def seen(t: Tables) -> DataFrame:
    """(user_id, id) of articles that are read or sit in a group of the user."""
    return read(t).unionByName(grouped(t).withColumnRenamed("article_id", "id")).distinct()


def read(t: Tables) -> DataFrame:
    return t.state.where("read").select("user_id", F.col("article_id").alias("id")).distinct()


def scored(t: Tables, max_retries: int = 3) -> DataFrame:
    """(user_id, id) of articles that are scored or given up."""
    done = F.col("interest").isNotNull() | (F.coalesce("retries", F.lit(0)) >= max_retries)
    return t.state.where(done).select("user_id", F.col("article_id").alias("id")).distinct()


def _named(rows: DataFrame) -> DataFrame:
    return rows.select("user_id", F.col("id").alias("article_id"), *[c for c in rows.columns if c not in ("user_id", "id")])


def unread(t: Tables, user: int | None = None, threshold: int | None = None) -> DataFrame:
    """Subscribed, not read, not in one of the user's groups, rules passed.

    With a threshold subscriptions of users with rules are listed apart, so that no pair is listed twice.
    """
    subs = t.subscriptions if user is None else t.subscriptions.where(F.col("user_id") == user)
    if threshold is None:
        return _named(readers.left_over(subs, dated(t), seen(t)))
    others, own = (_named(readers.left_over(subs.join(_ruled(t), "user_id", how), dated(t), seen(t))) for how in ("left_anti", "left_semi"))
    return others.unionByName(_met(t, own, threshold))


def unread_counts(t: Tables) -> DataFrame:
    """(user_id, n_unread) of users with unread articles."""
    return readers.by_user(readers.counts(t.subscriptions, dated(t), n_unread=seen(t)), "n_unread").where("n_unread > 0")


def with_state(t: Tables) -> DataFrame:
    """(user_id, article_id, feed_id, published, ...): reading state of subscribed articles."""
    return _named(readers.of_subscribed(t.subscriptions, dated(t), t.state.withColumnRenamed("article_id", "id")))


def starred(t: Tables) -> DataFrame:
    stars = t.state.where("starred").select("user_id", F.col("article_id").alias("id"))
    return _named(readers.of_subscribed(t.subscriptions, dated(t), stars))


def unscored_counts(t: Tables) -> DataFrame:
    """(user_id, n, first_article) of each user's scoring queue."""
    left = readers.by_user(readers.counts(t.subscriptions, dated(t), n=scored(t)), "n").where("n > 0")
    first = readers.first_left(t.subscriptions, dated(t), scored(t)).withColumnRenamed("first", "first_article")
    return left.join(first, "user_id", "left")


def unread_ids(t: Tables) -> DataFrame:
    """(user_id, ids): subscribed articles that are not read, grouped ones too, joined by commas."""
    return readers.joined_ids(t.subscriptions, dated(t), read(t))


def rule_scores(t: Tables, subscribed: bool = True) -> DataFrame:
    """(user_id, article_id, rule_score) of articles, subscribed ones or all, that rules match; each rule counts once per article."""
    author = t.authors.select("article_id", F.lit("author").alias("kind"), F.lower("name").alias("value"))
    category = t.categories.select("article_id", F.lit("category").alias("kind"), F.lower("category").alias("value"))
    kind = F.when(F.col("axis") == "author", "author").otherwise("category")
    rules = t.rules.select("rule_id", "user_id", F.col("feed_id").alias("rule_feed"), kind.alias("kind"), F.lower("value").alias("value"), "score")
    hits = author.unionByName(category).join(broadcast_if_small(rules), ["kind", "value"]).withColumnRenamed("article_id", "id")
    own = readers.of_subscribed(t.subscriptions, dated(t), hits) if subscribed else hits.join(readers.light(dated(t)), "id")
    own = own.where("rule_feed IS NULL OR rule_feed = feed_id")
    once = _named(own.select("user_id", "id", "rule_id", "score").distinct())
    return once.groupBy("user_id", "article_id").agg(F.sum("score").alias("rule_score"))


def above_threshold(t: Tables, articles: DataFrame, threshold: int | None) -> DataFrame:
    """Keep articles whose rules sum to the threshold; users without rules keep all.

    Only rows of users with rules meet the scores, subscribed or not: ``articles`` says which are listed.
    """
    if threshold is None:
        return articles
    ruled = _ruled(t)
    return articles.join(ruled, "user_id", "left_anti").unionByName(_met(t, articles.join(ruled, "user_id", "left_semi"), threshold))


def _ruled(t: Tables) -> DataFrame:
    return broadcast_if_small(t.rules.select("user_id").distinct())


def _met(t: Tables, rows: DataFrame, threshold: int) -> DataFrame:
    met = rows.join(rule_scores(t, subscribed=False), ["user_id", "article_id"], "left")
    return met.where(F.coalesce("rule_score", F.lit(0)) >= threshold).select(rows.columns)


def decayed(t: Tables, now: str, threshold: float = 8.0) -> DataFrame:
    """Unread scored articles with interest over the threshold and their decayed score."""
    days = F.greatest(F.lit(0.0), F.expr(f"timestampdiff(SECOND, published, TIMESTAMP_NTZ'{now}')") / 86400.0)
    rows = t.state.where((F.col("interest") >= threshold) & ~F.col("read")).select("user_id", "article_id", "interest")
    joined = rows.join(t.articles.select("article_id", "feed_id", "published"), "article_id")
    return joined.withColumn("decayed", F.col("interest") / (1.0 + 0.1 * days))


def newsletter(
    t: Tables, user: int, min_interest: float | None = None, min_security: float | None = None, include_feeds: list[int] | None = None,
    exclude_feeds: list[int] | None = None, include_categories: list[str] | None = None, exclude_categories: list[str] | None = None,
    since: str | None = None, limit: int = 20,
) -> DataFrame:
    """Articles of an issue: only the given conditions, best interest first."""
    checks: list[Column] = [F.col("interest").isNotNull()]
    if min_interest is not None:
        checks.append(F.col("interest") >= min_interest)
    if min_security is not None:
        checks.append(F.col("security") >= min_security)
    if include_feeds:
        checks.append(F.col("feed_id").isin(include_feeds))
    if exclude_feeds:
        checks.append(~F.col("feed_id").isin(exclude_feeds))
    if since:
        checks.append(F.col("published") > F.lit(since).cast("timestamp_ntz"))
    rows = subscribed(t, user).join(t.state, ["user_id", "article_id"]).where(reduce(Column.__and__, checks))
    for names, how in ((include_categories, "left_semi"), (exclude_categories, "left_anti")):
        if names:
            listed = t.categories.where(F.lower("category").isin([n.lower() for n in names])).select("article_id")
            rows = rows.join(listed, "article_id", how)
    return rows.orderBy(F.desc("interest"), F.desc("article_id")).limit(limit).select("article_id", "feed_id", "interest", "security")


def sync_page(t: Tables, user: int, since: int | None = None, until: int | None = None, ids: list[int] | None = None, limit: int = 50) -> DataFrame:
    """A page of subscribed articles by id: an id list wins over a key range; 1 to 50 rows."""
    rows = subscribed(t, user).select("article_id", "feed_id", "published")
    if ids:
        rows = rows.where(F.col("article_id").isin(ids))
    else:
        if since is not None:
            rows = rows.where(F.col("article_id") > since)
        if until is not None:
            rows = rows.where(F.col("article_id") <= until)
    return rows.orderBy(F.desc("article_id")).limit(max(1, min(50, limit)))
