"""Listings and look-ups over the star schema: articles, feeds, groups, users, newsletters.

Every listing takes one user, feed or article id or none; without one it is answered
for all at once, which is the form that scales.  Names are compared without case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewell.operators import readers
from tidewell.plans.scratch import broadcast_if_small
from tidewell.sources.star import NEWSLETTER_CONFIG, Star

ARTICLE = ["id", "feed_id", "guid", "title", "url", "content", "summary", "author", "published_date", "fetched_date", "linked_url", "linked_content"]
#: Articles of these many failed scorings leave the queue.
MAX_RETRIES = 3


def newest(df: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    ordered = df.orderBy(F.desc_nulls_last("published_date"), F.desc("id"))
    return ordered if limit is None else ordered.offset(offset).limit(limit)


def only(df: DataFrame, **wanted: int | str | None) -> DataFrame:
    """Rows with the given values; a value of None asks for nothing."""
    for column, value in wanted.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def has_more(page: DataFrame, size: int) -> DataFrame:
    """A page read with one row too many: its first ``size`` rows, each saying whether more follow."""
    rows = page.withColumn("i", F.row_number().over(Window.orderBy(F.desc_nulls_last("published_date"), F.desc("id"))))
    return rows.withColumn("more", F.count(F.lit(1)).over(Window.partitionBy()) > size).where(F.col("i") <= size).drop("i")


# --- articles ----------------------------------------------------------------


def article(s: Star, article_id: int | None = None) -> DataFrame:
    rows = only(s["articles"], id=article_id).select(ARTICLE)
    return rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("linked_url", "linked_content")})


def article_for_user(s: Star, user: int, article_id: int | None = None) -> DataFrame:
    """Articles with the user's own summary, where there is one."""
    own = only(s["article_summaries"], user_id=user).select(F.col("article_id").alias("id"), "ai_summary")
    return article(s, article_id).join(own, "id", "left")


def subscribed(s: Star, user: int | None = None) -> DataFrame:
    """(user_id, id, feed_id, published_date) of articles in subscribed feeds."""
    return s["articles"].select("id", "feed_id", "published_date").join(only(s["user_feeds"], user_id=user).select("user_id", "feed_id"), "feed_id")


def _state(s: Star, *columns: str) -> DataFrame:
    return s["read_state"].select("user_id", F.col("article_id").alias("id"), *columns)


def _members(s: Star) -> DataFrame:
    owned = s["article_groups"].select(F.col("id").alias("group_id"), "user_id")
    return s["article_group_members"].select("group_id", F.col("article_id").alias("id")).join(owned, "group_id")


def _dated(s: Star) -> DataFrame:
    return s["articles"].select("id", "feed_id", "published_date")


def seen(s: Star) -> DataFrame:
    """(user_id, id) of articles that are read or in a group of the user."""
    return _state(s, "read").where("read").drop("read").unionByName(_members(s).select("user_id", "id")).distinct()


def scored(s: Star) -> DataFrame:
    """(user_id, id) of articles that are scored or given up."""
    return _state(s, "ai_scored", "ai_retries").where(settled()).select("user_id", "id").distinct()


def settled() -> Column:
    """Whether a row of reading state is scored or given up."""
    return F.coalesce("ai_scored", F.lit(False)) | (F.coalesce("ai_retries", F.lit(0)) >= MAX_RETRIES)


def summarized(s: Star) -> DataFrame:
    """(user_id, id) of articles with a summary for the user."""
    return s["article_summaries"].select("user_id", F.col("article_id").alias("id")).distinct()


def _left(s: Star, done: DataFrame, user: int | None = None, feed: int | None = None, subs: DataFrame | None = None) -> DataFrame:
    subs = s["user_feeds"] if subs is None else subs
    rows = readers.left_over(only(subs, user_id=user, feed_id=feed), only(_dated(s), feed_id=feed), only(done, user_id=user))
    return rows.select("user_id", "id", "feed_id", "published_date")


def rule_scores(s: Star) -> DataFrame:
    """(user_id, id, rule_score) of articles that a user's rules match; a matching rule counts once."""
    author = s["article_authors"].select(F.col("article_id").alias("id"), F.lit("author").alias("kind"), F.lower("name").alias("value"))
    category = s["article_categories"].select(F.col("article_id").alias("id"), F.lit("category").alias("kind"), F.lower("category").alias("value"))
    kind = F.when(F.col("axis") == "author", "author").otherwise("category")
    rules = s["filter_rules"].select("user_id", F.col("feed_id").alias("rule_feed"), F.col("id").alias("rule_id"), kind.alias("kind"), F.lower("value").alias("value"), "score")
    hits = author.unionByName(category).join(broadcast_if_small(rules), ["kind", "value"])
    found = hits.join(readers.light(s["articles"].select("id", "feed_id")), "id").where("rule_feed IS NULL OR rule_feed = feed_id")
    return found.select("user_id", "id", "rule_id", "score").distinct().groupBy("user_id", "id").agg(F.sum("score").alias("rule_score"))


def passing(s: Star, rows: DataFrame, threshold: int | None) -> DataFrame:
    """Rows whose rules sum to the threshold; no or zero threshold, and users without rules, keep all.

    Only rows of users with rules meet the scores.
    """
    if not threshold:
        return rows
    ruled = _ruled(s)
    return rows.join(ruled, "user_id", "left_anti").unionByName(_met(s, rows.join(ruled, "user_id", "left_semi"), threshold))


def _ruled(s: Star) -> DataFrame:
    return broadcast_if_small(s["filter_rules"].select("user_id").distinct())


def _met(s: Star, rows: DataFrame, threshold: int) -> DataFrame:
    met = rows.join(rule_scores(s), ["user_id", "id"], "left")
    return met.where(F.coalesce("rule_score", F.lit(0)) >= threshold).select(rows.columns)


def unread_anyones(s: Star) -> DataFrame:
    """Articles that some user, or nobody, has not read; one row per reader."""
    return s["articles"].select("id", "feed_id", "published_date").join(_state(s, "read"), "id", "left").where(~F.coalesce("read", F.lit(False)))


def unread(s: Star, user: int | None = None, feed: int | None = None, threshold: int | None = None) -> DataFrame:
    """Subscribed, unread, in no group of the user, rules passed.

    Subscriptions of users with rules are listed apart, so that no pair is listed twice.
    """
    if not threshold:
        return _left(s, seen(s), user, feed)
    ruled, subs = _ruled(s), s["user_feeds"]
    others, own = (_left(s, seen(s), user, feed, subs.join(ruled, "user_id", how)) for how in ("left_anti", "left_semi"))
    return others.unionByName(_met(s, own, threshold))


def starred(s: Star, user: int | None = None, threshold: int | None = None) -> DataFrame:
    """Subscribed and starred, rules passed; grouped articles stay."""
    stars = only(_state(s, "starred").where("starred").drop("starred"), user_id=user)
    rows = readers.of_subscribed(only(s["user_feeds"], user_id=user), _dated(s), stars)
    return passing(s, rows.select("user_id", "id", "feed_id", "published_date"), threshold)


def unread_in_groups(s: Star, group: int | None = None, threshold: int | None = None) -> DataFrame:
    """(group_id, user_id, id, ...): members that the group's owner has not read, subscribed or not."""
    rows = only(_members(s), group_id=group).join(s["articles"].select("id", "feed_id", "published_date"), "id")
    rows = rows.join(_state(s, "read"), ["user_id", "id"], "left").where(~F.coalesce("read", F.lit(False))).drop("read")
    return passing(s, rows, threshold)


def group_articles(s: Star, group: int | None = None) -> DataFrame:
    """Members of groups with the group's heading."""
    members = only(s["article_group_members"], group_id=group).select("group_id", F.col("article_id").alias("id"))
    heads = s["article_groups"].select(F.col("id").alias("group_id"), "user_id", F.coalesce("display_name", "topic").alias("label"))
    return members.join(heads, "group_id").join(s["articles"].select("id", "feed_id", "published_date"), "id")


def needing(s: Star, flag: str, limit: int) -> DataFrame:
    """The newest articles whose ``full_text_fetched`` or ``images_cached`` is not set."""
    rows = s["articles"].where(~F.coalesce(flag, F.lit(False)))
    return newest(rows.select("id", "feed_id", "published_date"), limit)


def without_embeddings(s: Star, model: str) -> DataFrame:
    have = only(s["article_embeddings"], embedding_model=model).select(F.col("article_id").alias("id"))
    return s["articles"].select("id", "feed_id", "published_date").join(have, "id", "left_anti")


def unscored(s: Star, user: int | None = None) -> DataFrame:
    """The scoring queue: subscribed, not scored, not given up."""
    return _left(s, scored(s), user)


def unsummarized(s: Star, user: int | None = None) -> DataFrame:
    """Subscribed articles without a summary for the user."""
    return _left(s, summarized(s), user)


def _of_someone(count: str) -> Column:
    """Nothing waits for a user who is not known."""
    return F.when(F.col("user_id").isNull(), 0).otherwise(F.col(count)).cast("long").alias(count)


def unsummarized_counts(s: Star) -> DataFrame:
    """(user_id, n) of users with articles that have no summary."""
    return readers.by_user(readers.counts(s["user_feeds"], s["articles"], n=summarized(s)), "n").where("n > 0")


def subscribed_counts(s: Star) -> DataFrame:
    """(user_id, n): articles in each user's feeds."""
    return readers.by_user(readers.counts(s["user_feeds"], s["articles"]).withColumnRenamed("total", "n"), "n").where("n > 0")


def decayed(s: Star, now: str, threshold: float = 8.0, user: int | None = None, rules: int | None = None) -> DataFrame:
    """Unread articles whose raw interest reaches the threshold, with the score that their age leaves them.

    An article without a date is as old as its fetch.
    """
    at, date = F.lit(now).cast("timestamp_ntz"), F.coalesce("published_date", "fetched_date")
    days = F.greatest(F.lit(0.0), F.timestamp_diff("SECOND", date, at) / 86400.0)
    state = only(s["read_state"], user_id=user).where((F.col("interest_score") >= threshold) & ~F.col("read"))
    rows = state.select("user_id", F.col("article_id").alias("id"), "interest_score").join(s["articles"].select("id", "feed_id", "published_date", "fetched_date"), "id")
    scored = rows.select("user_id", "id", "feed_id", "interest_score", (F.col("interest_score") / (1.0 + 0.1 * F.coalesce(days, F.lit(0.0)))).alias("decayed"))
    return passing(s, scored, rules)


# --- feeds -------------------------------------------------------------------


def due(feeds: DataFrame, now: str) -> DataFrame:
    """Enabled, active, and to be fetched by now."""
    return feeds.where(F.col("enabled") & (F.col("status") == "active") & (F.col("next_fetch_at").isNull() | (F.col("next_fetch_at") <= F.lit(now).cast("timestamp_ntz"))))


def followed(s: Star) -> DataFrame:
    """Feeds that somebody reads."""
    return s["feeds"].join(s["user_feeds"].select(F.col("feed_id").alias("id")).distinct(), "id", "left_semi")


def user_feeds(s: Star, user: int | None = None) -> DataFrame:
    """(user_id, id, title, url): a user's enabled feeds under the user's own titles."""
    rows = only(s["user_feeds"], user_id=user).join(s["feeds"].where("enabled"), F.col("feed_id") == F.col("id"))
    return rows.select("user_id", "id", F.coalesce("user_title", "title").alias("title"), "url")


def fetch_intervals(s: Star, now: str, last: int = 11) -> DataFrame:
    """(feed_id, minutes) until each feed's next fetch, by its last posts; a day for a feed without any."""
    from tidewell.operators.stats import fetch_interval

    recent = Window.partitionBy("feed_id").orderBy(F.desc("published_date"), F.desc("id"))
    posts = s["articles"].where("published_date IS NOT NULL").select("feed_id", "id", "published_date").withColumn("i", F.row_number().over(recent)).where(F.col("i") <= last)
    gap = F.timestamp_diff("SECOND", F.lead("published_date").over(recent), F.col("published_date"))
    gaps = posts.withColumn("gap", gap).groupBy("feed_id").agg(F.max("published_date").alias("last_post"), F.array_sort(F.collect_list(F.when(F.col("gap") > 0, F.col("gap")))).alias("gaps"))
    median = F.get("gaps", F.floor(F.size("gaps") / 2).cast("int")) / 60.0
    age = F.timestamp_diff("SECOND", F.col("last_post"), F.lit(now).cast("timestamp_ntz")) / 60.0
    known = gaps.select("feed_id", fetch_interval(age, median).cast("long").alias("minutes"))
    return s["feeds"].select(F.col("id").alias("feed_id")).join(known, "feed_id", "left").select("feed_id", F.coalesce("minutes", F.lit(1440)).alias("minutes"))


def without_favicons(s: Star) -> DataFrame:
    return followed(s).join(s["feed_favicons"].select(F.col("feed_id").alias("id")), "id", "left_anti").select("id", "url", "site_url")


def feed_names(s: Star, kind: str) -> DataFrame:
    """(feed_id, name): distinct authors or categories of each feed."""
    table, column = {"author": ("article_authors", "name"), "category": ("article_categories", "category")}[kind]
    names = s[table].select(F.col("article_id").alias("id"), F.col(column).alias("name"))
    return s["articles"].select("id", "feed_id").join(names, "id").select("feed_id", "name").distinct()


def feed_metadata(s: Star) -> DataFrame:
    """(feed_id, kind, name) of authors and categories."""
    return feed_names(s, "author").withColumn("kind", F.lit("author")).unionByName(feed_names(s, "category").withColumn("kind", F.lit("category")))


def filter_rules(s: Star, user: int, feed: int | None = None) -> DataFrame:
    """A user's rules; of one feed: its own and those for every feed."""
    rules = only(s["filter_rules"], user_id=user)
    return rules if feed is None else rules.where(F.col("feed_id").isNull() | (F.col("feed_id") == feed))


def has_filter_rules(s: Star) -> DataFrame:
    """(user_id, has_rules) of every user."""
    ruled = s["filter_rules"].select(F.col("user_id").alias("id")).distinct().withColumn("has_rules", F.lit(True))
    return s["users"].select("id").join(ruled, "id", "left").select(F.col("id").alias("user_id"), F.coalesce("has_rules", F.lit(False)).alias("has_rules"))


def feed_stats(s: Star, posted: bool = False) -> DataFrame:
    """Per user and subscribed feed: all, unread and unsummarised articles, last post; feeds without articles too, unless ``posted``."""
    subs = user_feeds(s).select("user_id", F.col("id").alias("feed_id"), "title")
    last = s["articles"].groupBy("feed_id").agg(F.max("published_date").alias("last_published"))
    sums = readers.counts(subs, s["articles"], unread=seen(s), unsummarized=summarized(s))
    rows = sums.join(last, "feed_id", "inner" if posted else "left")
    return rows.select("user_id", "feed_id", "title", "last_published", "total", *[_of_someone(c) for c in ("unread", "unsummarized")])


def pending(s: Star) -> DataFrame:
    """(user_id, unscored, unsummarized) of every subscriber."""
    names = ("unscored", "unsummarized")
    rows = readers.by_user(readers.counts(s["user_feeds"], s["articles"], unscored=scored(s), unsummarized=summarized(s)), *names)
    return rows.select("user_id", *[_of_someone(c) for c in names])


# --- groups ------------------------------------------------------------------


def find_group(s: Star) -> DataFrame:
    """(user_id, article_id, group_id): each article's first group of a user."""
    return _members(s).groupBy("user_id", F.col("id").alias("article_id")).agg(F.min("group_id").alias("group_id"))


def groups_with_embeddings(s: Star, user: int | None, model: str) -> DataFrame:
    rows = only(s["article_groups"], user_id=user, embedding_model=model)
    return rows.where("embedding IS NOT NULL").select("id", "user_id", "topic", "embedding")


def article_vectors(s: Star, user: int | None, model: str, *values: Column) -> DataFrame:
    """(user_id, id, embedding or values made of it) of the model's vectors in subscribed feeds; values are made once for an article."""
    have = only(s["article_embeddings"], embedding_model=model).select(F.col("article_id").alias("id"), *(values or ["embedding"]))
    placed = s["articles"].select("id", "feed_id").join(have, "id")
    return readers.listed(only(s["user_feeds"], user_id=user), placed).drop("feed_id")


def group_stats(s: Star) -> DataFrame:
    """Unread members of groups of two or more that are not muted."""
    heads = s["article_groups"].where(~F.coalesce("muted", F.lit(False))).select(F.col("id").alias("group_id"), F.coalesce("display_name", "topic").alias("label"))
    rows = _members(s).join(heads, "group_id").join(_state(s, "read"), ["user_id", "id"], "left")
    sums = rows.groupBy("user_id", "group_id", "label").agg(F.count(F.lit(1)).alias("n_members"), F.count_if(~F.coalesce("read", F.lit(False))).alias("unread"))
    return sums.where("n_members >= 2 AND unread > 0")


def group_link_items(s: Star) -> DataFrame:
    """(user_id, group_id, item_ids): articles of groups of two or more in order of their addition, joined by commas."""
    added = s["article_group_members"].select("group_id", "added_at", F.col("article_id").alias("id"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("added_at", "id"))), lambda x: x["id"].cast("string"))
    owners = s["article_groups"].select(F.col("id").alias("group_id"), "user_id")
    rows = added.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(ids, ",").alias("item_ids")).where("n >= 2")
    return rows.join(owners, "group_id").select("user_id", "group_id", "item_ids")


def group_links(s: Star) -> DataFrame:
    """Links of groups of two or more, by owner: first added member, size, temperature by the owner's scores."""
    added = s["article_group_members"].select("group_id", F.col("article_id").alias("id"), "added_at")
    owners = s["article_groups"].select(F.col("id").alias("group_id"), "user_id")
    rows = added.join(owners, "group_id").join(_state(s, "interest_score"), ["user_id", "id"], "left")
    sums = rows.groupBy("user_id", "group_id").agg(
        F.min(F.struct("added_at", "id"))["id"].alias("first_article"), F.count(F.lit(1)).alias("n_members"), F.max("interest_score").alias("best")
    )
    heat = F.when(F.coalesce("best", F.lit(0.0)) > 0, F.floor(F.col("best") * 10)).otherwise(F.col("n_members") * 25)
    return sums.where("n_members >= 2").select("user_id", "group_id", "first_article", "n_members", F.least(heat, F.lit(100)).cast("long").alias("temperature"))


def first_titles(s: Star, titles: int = 3) -> DataFrame:
    """(group_id, titles): the titles of each group's first members."""
    rank = F.row_number().over(Window.partitionBy("group_id").orderBy("added_at", "article_id"))
    first = s["article_group_members"].withColumn("i", rank).where(F.col("i") <= titles)
    rows = first.join(s["articles"].select(F.col("id").alias("article_id"), "title"), "article_id")
    lines = F.array_sort(F.collect_list(F.struct("i", "title")))
    return rows.groupBy("group_id").agg(F.array_join(F.transform(lines, lambda x: x["title"]), " | ").alias("titles"))


# --- users -------------------------------------------------------------------


def user_by_name(s: Star, name: str) -> DataFrame:
    return s["users"].where(F.lower("name") == name.lower())


def user_by_api_key(s: Star, key: str) -> DataFrame:
    owners = s["fever_credentials"].where(F.col("api_key") == key).select(F.col("user_id").alias("id"))
    return s["users"].join(owners, "id", "left_semi")


def preference_map(s: Star) -> DataFrame:
    """(user_id, preferences map<string,string>)."""
    pairs = F.array_sort(F.collect_list(F.struct("key", "value")))
    return s["user_preferences"].groupBy("user_id").agg(F.map_from_entries(pairs).alias("preferences"))


#: Preferences that users may set, their types and what holds without them; fixed values.
PREFERENCES = {"interest_threshold": ("double", 8.0), "notify_when": ("string", "present"), "notify_min_score": ("double", 7.0), "filter_threshold": ("int", 0), "keywords": ("array<string>", [])}


def _typed(value: Column, kind: str) -> Column:
    return F.from_json(value, kind) if kind.startswith("array") else value.try_cast(kind)


def preferences(s: Star, config: dict | None = None) -> DataFrame:
    """Every user's preferences as typed columns: defaults, then configuration, then the user's values that can be read."""
    wanted = {key: F.max(F.when(F.col("key") == key, F.col("value"))).alias(key) for key in PREFERENCES}
    rows = s["users"].select(F.col("id").alias("user_id")).join(s["user_preferences"].groupBy("user_id").agg(*wanted.values()), "user_id", "left")
    columns = []
    for key, (kind, default) in PREFERENCES.items():
        value = (config or {}).get(key, default)
        fallback = F.array(*map(F.lit, value)).cast(kind) if isinstance(value, list) else F.lit(value).cast(kind)
        columns.append(F.coalesce(_typed(F.col(key), kind), fallback).alias(key))
    return rows.select("user_id", *columns)


# --- newsletters -------------------------------------------------------------


def newsletters(s: Star, user: int | None = None) -> DataFrame:
    """Newsletters with their decoded configuration."""
    return only(s["newsletters"], user_id=user).withColumn("config", F.from_json("config_json", NEWSLETTER_CONFIG))


def due_newsletters(s: Star, now: str) -> DataFrame:
    """Enabled, hourly or daily, and never generated or that long ago."""
    age = F.timestamp_diff("SECOND", F.col("last_generated_at"), F.lit(now).cast("timestamp_ntz"))
    wait = F.when(F.col("schedule") == "hourly", 3600).when(F.col("schedule") == "daily", 86400)
    return s["newsletters"].where(F.col("enabled") & wait.isNotNull() & (F.col("last_generated_at").isNull() | (age >= wait)))


def issues(s: Star, newsletter: int | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Issues without their HTML, newest first, with the decoded article ids."""
    rows = only(s["newsletter_issues"], newsletter_id=newsletter)
    rows = rows.select("id", "newsletter_id", "headline", "content_text", "generated_at", "sent_at", F.from_json("article_ids_json", "array<bigint>").alias("article_ids"))
    ordered = rows.orderBy(F.desc("generated_at"), F.desc("id"))
    return ordered if limit is None else ordered.offset(offset).limit(limit)


def newsletter_stats(s: Star) -> DataFrame:
    """(newsletter_id, name, n_issues, n_sent, latest headline) of every newsletter."""
    sums = s["newsletter_issues"].groupBy("newsletter_id").agg(
        F.count(F.lit(1)).alias("n_issues"), F.count("sent_at").alias("n_sent"), F.max_by("headline", F.struct("generated_at", "id")).alias("latest")
    )
    rows = s["newsletters"].select(F.col("id").alias("newsletter_id"), "name").join(sums, "newsletter_id", "left")
    return rows.select("newsletter_id", "name", F.coalesce("n_issues", F.lit(0)).alias("n_issues"), F.coalesce("n_sent", F.lit(0)).alias("n_sent"), "latest")


def _in(value: Column, listed: str) -> Column:
    return F.array_contains(F.col(f"config.{listed}"), value)


def issue_articles(s: Star, letters: DataFrame) -> DataFrame:
    """(newsletter_id, rank, id, interest_score) of the articles of each newsletter's next issue.

    All newsletters at once: their owners' scored articles since the last issue that meet
    the configured limits, best first, ``max_articles`` (20 where unset) of them.
    """
    wanted = letters.select(F.col("id").alias("newsletter_id"), "user_id", "config", "last_generated_at")
    state = _state(s, "interest_score", "security_score").where("interest_score IS NOT NULL").join(wanted.select("user_id").distinct(), "user_id", "left_semi")
    rows = readers.of_subscribed(s["user_feeds"], _dated(s), state).join(broadcast_if_small(wanted), "user_id")
    empty = {c: F.coalesce(F.size(f"config.{c}"), F.lit(0)) <= 0 for c in ("include_feeds", "exclude_feeds", "include_categories", "exclude_categories")}
    rows = rows.where(
        (F.col("interest_score") >= F.coalesce("config.min_interest_score", F.lit(0.0)))
        & (F.coalesce("security_score", F.lit(0.0)) >= F.coalesce("config.min_security_score", F.lit(0.0)))
        & (empty["include_feeds"] | _in(F.col("feed_id"), "include_feeds"))
        & (empty["exclude_feeds"] | ~_in(F.col("feed_id"), "exclude_feeds"))
        & (F.col("last_generated_at").isNull() | (F.col("published_date") > F.col("last_generated_at")))
    )
    names = s["article_categories"].groupBy(F.col("article_id").alias("id")).agg(F.collect_set(F.lower("category")).alias("names"))
    rows = rows.join(names, "id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))

    def shares(c: str) -> Column:
        return F.arrays_overlap("names", F.transform(f"config.{c}", F.lower))

    rows = rows.where((empty["include_categories"] | shares("include_categories")) & (empty["exclude_categories"] | ~shares("exclude_categories")))
    most = F.when(F.coalesce("config.max_articles", F.lit(0)) > 0, F.col("config.max_articles")).otherwise(20)
    rank = F.row_number().over(Window.partitionBy("newsletter_id").orderBy(F.desc("interest_score"), F.desc("id")))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most).select("newsletter_id", "rank", "id", "interest_score")
