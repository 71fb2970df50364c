"""Counts and schedules: feed, score and group statistics, publishing cadence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewell.operators import readers, reading
from tidewell.sources.tables import Tables


def feed_stats(t: Tables) -> DataFrame:
    """Per user and subscribed feed with articles: total, unread, last publish date."""
    last = t.articles.groupBy("feed_id").agg(F.max("published").alias("last_published"))
    rows = readers.counts(t.subscriptions, reading.dated(t), unread=reading.seen(t)).join(last, "feed_id")
    return rows.select("user_id", "feed_id", "total", "last_published", "unread")


def feed_totals(t: Tables) -> DataFrame:
    """Feed statistics with each user's grand total as feed null."""
    rolled = feed_stats(t).rollup("user_id", "feed_id").agg(F.sum("total").alias("total"), F.sum("unread").alias("unread"))
    return rolled.where("user_id IS NOT NULL")


def score_stats(t: Tables) -> DataFrame:
    """Score buckets per user and feed; interest only counts for secure articles."""
    i, s = F.col("interest"), F.col("security")
    rows = reading.with_state(t)
    counts = {
        "scored": i.isNotNull(), "sec_high": s >= 7, "sec_mid": (s >= 4) & (s < 7), "sec_low": s < 4,
        "int_high": (s >= 7) & (i >= 8), "int_mid": (s >= 7) & (i >= 5) & (i < 8), "int_low": (s >= 7) & (i < 5),
    }
    return rows.groupBy("user_id", "feed_id").agg(*[F.count_if(c).alias(n) for n, c in counts.items()])


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0).otherwise(F.floor(part * 100 / whole)).cast("long")


def group_stats(t: Tables) -> DataFrame:
    """Unread articles of groups that are not muted, with two members or more."""
    rows = t.groups.where("NOT muted").join(t.members, "group_id").join(t.state.select("user_id", "article_id", "read"), ["user_id", "article_id"], "left")
    sums = rows.groupBy("user_id", "group_id", "topic").agg(F.count(F.lit(1)).alias("n_members"), F.count_if(~F.coalesce("read", F.lit(False))).alias("unread"))
    return sums.where("n_members >= 2 AND unread > 0")


def db_stats(t: Tables) -> DataFrame:
    """Articles and subscribers per feed; each side is summed before the join."""
    articles = t.articles.groupBy("feed_id").agg(F.count(F.lit(1)).alias("articles"))
    readers = t.subscriptions.groupBy("feed_id").agg(F.count(F.lit(1)).alias("subscribers"))
    joined = t.feeds.join(articles, "feed_id", "left").join(readers, "feed_id", "left")
    return joined.select("feed_id", "title", F.coalesce("articles", F.lit(0)).alias("articles"), F.coalesce("subscribers", F.lit(0)).alias("subscribers"))


def pending(t: Tables) -> DataFrame:
    """Per user: subscribed articles, those without a score, and those read."""
    rows = readers.counts(t.subscriptions, reading.dated(t), unscored=reading.scored(t), unread=reading.read(t))
    sums = readers.by_user(rows, "total", "unscored", "unread").where("total > 0")
    return sums.select("user_id", F.col("total").alias("subscribed"), "unscored", (F.col("total") - F.col("unread")).alias("read"))


def memberships(t: Tables) -> DataFrame:
    """(group_id, feed_ids): the feeds whose articles a group holds."""
    pairs = t.members.join(t.articles.select("article_id", "feed_id"), "article_id").select("group_id", "feed_id").distinct()
    return pairs.groupBy("group_id").agg(F.array_join(F.array_sort(F.collect_list("feed_id")), ",").alias("feed_ids"))


def group_links(t: Tables) -> DataFrame:
    """Hot links: first member, size and temperature of each group of two or more."""
    score = t.state.groupBy("article_id").agg(F.max("interest").alias("interest"))
    rows = t.members.join(score, "article_id", "left").groupBy("group_id").agg(
        F.min("article_id").alias("first_article"), F.count(F.lit(1)).alias("n_members"), F.max("interest").alias("best")
    )
    heat = F.when(F.coalesce("best", F.lit(0.0)) > 0, F.floor(F.col("best") * 10)).otherwise(F.col("n_members") * 25)
    return rows.where("n_members >= 2").select("group_id", "first_article", "n_members", F.least(heat, F.lit(100)).cast("long").alias("temperature"))


def publish_gaps(t: Tables, last: int = 11) -> DataFrame:
    """Per feed: minutes since the last post at ``now`` and the upper median gap of the last posts."""
    recent = Window.partitionBy("feed_id").orderBy(F.desc("published"), F.desc("article_id"))
    ranked = t.articles.select("feed_id", "article_id", "published").withColumn("rank", F.row_number().over(recent))
    newest = ranked.where(F.col("rank") <= last)
    gap = F.expr("timestampdiff(MINUTE, earlier, published)")
    gaps = newest.withColumn("earlier", F.lead("published").over(recent)).select("feed_id", "published", gap.alias("gap"))
    sums = gaps.groupBy("feed_id").agg(F.max("published").alias("last_post"), F.array_sort(F.collect_list(F.when(F.col("gap") > 0, F.col("gap")))).alias("gaps"))
    median = F.get("gaps", F.floor(F.size("gaps") / 2).cast("int"))
    return sums.select("feed_id", "last_post", median.alias("median_gap"))


def fetch_interval(age_minutes: Column, gap_minutes: Column) -> Column:
    """Minutes until the next fetch, by the age of the last post and the usual gap."""
    day = 1440
    gap = F.coalesce(gap_minutes, F.lit(0))
    return (
        F.when(age_minutes < 7 * day, F.when(gap < 360, 30).when(gap < day, 60).otherwise(240))
        .when(age_minutes < 30 * day, 720)
        .when(age_minutes < 90 * day, day)
        .when(age_minutes < 180 * day, 3 * day)
        .when(age_minutes < 365 * day, 7 * day)
        .otherwise(30 * day)
    )


def error_backoff(base_minutes: Column, errors: Column) -> Column:
    """The interval doubled per error, six times at most, 30 days at most."""
    return F.least(base_minutes * F.pow(F.lit(2), F.least(errors, F.lit(6))).cast("long"), F.lit(30 * 1440))
