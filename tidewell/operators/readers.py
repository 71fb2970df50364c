"""What readers have left of the articles of their feeds.

Readers times articles is far more than either table.  Counts are therefore taken as the
feed's articles less what is done, and a listing joins blocks of subscriptions, which carry the
ids done in their feed, with the articles: its pairs pass to the result without a shuffle.
Articles are (id, feed_id, ...), subscriptions (user_id, feed_id), what is done
(user_id, id), each at most once.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewell.plans.scratch import broadcast_if_small, bytes_of, row_bytes

#: Encoded bytes of the articles' ids, feeds and dates up to which they are broadcast; a driver of 750 MB holds some such tables at once, each some times larger.
LIGHT_BYTES = 24 << 20
#: Deals of the articles beyond that, at least.
DEALS = 32
#: Subscribers that are listed together, and articles of a feed whose ids a file's dictionary holds twice over.
BLOCK, PART = 256, 50_000
#: Pairs that a task lists at most, about.
TASK = 1 << 28
_SUBSCRIPTION = ["user_id", "feed_id"]


def light(articles: DataFrame) -> DataFrame:
    return broadcast_if_small(articles, LIGHT_BYTES)


def _tasks(df: DataFrame) -> int:
    return 4 * df.sparkSession.sparkContext.defaultParallelism


def of_subscribed(subs: DataFrame, articles: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows (user_id, id, ...) of subscribed articles, with the articles' columns."""
    return rows.join(light(articles), "id").join(subs.select(_SUBSCRIPTION), _SUBSCRIPTION)


def part_of(parts: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part")


def listed(subs: DataFrame, rows: DataFrame, gone: DataFrame | None = None, by: Iterable[str] = ()) -> DataFrame:
    """(user_id, feed_id, *by, id, ...): every subscription with the rows (feed_id, *by, id, ...) of its feed, less what is gone (user_id, feed_id, id).

    Pairs are made where they are written, in an order that columnar files hold in little:
    a block of subscribers at a time, article by article, so that ids are runs of a block's
    length and users one short pattern over and over.  Articles are dealt to parts whose ids
    one dictionary holds, and tasks get equal numbers of pairs of as few feeds as can be.
    """
    key = ["feed_id", *by]
    readers = subs.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("m"), F.sum(bytes_of(rows)).alias("size")).join(readers, key, "left")
    sizes = sizes.withColumn("pairs", F.coalesce("n", F.lit(0)).cast("double") * F.col("m"))
    most, pairs, size = (x or 0 for x in sizes.agg(F.max("m"), F.sum("pairs"), F.sum("size")).first())
    few = size <= LIGHT_BYTES
    parts, tasks = max(1 if few else DEALS, -(-most // PART)), max(_tasks(rows), int(pairs / TASK) + 1)
    place = Window.partitionBy(key).orderBy("user_id")
    placed = subs.select("user_id", *key, F.floor((F.row_number().over(place) - 1) / BLOCK).alias("block"))
    users = F.transform(F.sort_array(F.collect_list(F.struct("user_id"))), lambda r: r["user_id"])  # structs, as a null user is one too
    held = placed.groupBy(*key, "block").agg(users.alias("readers")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    left = F.col("readers")
    if gone is not None:  # by id, so that most articles take a block as it is
        block = [*key, "block", "part"]
        users = gone.where("id IS NOT NULL").join(placed, _SUBSCRIPTION).groupBy(*block[:-1], part_of(parts), "id").agg(F.collect_set("user_id").alias("users"))
        held = held.join(users.groupBy(block).agg(F.map_from_entries(F.collect_list(F.struct("id", "users"))).alias("gone")), block, "left")
        without = F.try_element_at("gone", F.col("id"))
        left = F.when(without.isNull(), left).otherwise(F.array_except(left, without))
    dealt = rows.withColumn("part", part_of(parts))
    if few:
        before = F.sum("pairs").over(Window.orderBy(key)) - F.col("pairs")  # one row for each feed
        within = (F.col("part") * F.ceil(F.col("n") / BLOCK) + F.col("block")) / (parts * F.ceil(F.col("n") / BLOCK))
        task = F.floor((F.col("before") + F.col("pairs") * within) * tasks / pairs).cast("int") if pairs else F.lit(0)
        held = held.join(F.broadcast(sizes.withColumn("before", before)), key).repartitionById(tasks, F.least(task, F.lit(tasks - 1)))
        found = held.join(F.broadcast(dealt), [*key, "part"])
    else:
        found = held.repartition(tasks, *key, "part").join(dealt.repartition(tasks, *key, "part").hint("merge"), [*key, "part"])
    return found.select(F.explode(left).alias("user_id"), *key, *[c for c in rows.columns if c not in key])


def left_over(subs: DataFrame, articles: DataFrame, done: DataFrame, rows: DataFrame | None = None, by: Iterable[str] = ()) -> DataFrame:
    """(user_id, feed_id, id, ...) of subscribed articles that are not done.

    ``rows`` (feed_id, id, ...) are listed in the articles' place; they may differ by more
    columns ``by`` of the subscriptions.
    """
    gone = done.join(light(articles).select("id", "feed_id"), "id")
    return listed(subs, articles if rows is None else rows, gone, by)


def totals(articles: DataFrame) -> DataFrame:
    return articles.groupBy("feed_id").agg(F.count(F.lit(1)).alias("total"))


def counts(subs: DataFrame, articles: DataFrame, **done: DataFrame) -> DataFrame:
    """The subscriptions with their articles (total), and how many of them are left of each kind of work."""
    rows = subs.join(totals(articles), "feed_id", "left")
    for name, pairs in done.items():
        gone = pairs.join(light(articles.select("id", "feed_id")), "id").groupBy(_SUBSCRIPTION).agg(F.count(F.lit(1)).alias(name))
        rows = rows.join(gone, _SUBSCRIPTION, "left")
    total = F.coalesce("total", F.lit(0))
    return rows.select(*subs.columns, total.alias("total"), *[(total - F.coalesce(name, F.lit(0))).alias(name) for name in done])


def by_user(rows: DataFrame, *names: str) -> DataFrame:
    return rows.groupBy("user_id").agg(*[F.sum(n).alias(n) for n in names])


def first_left(subs: DataFrame, articles: DataFrame, done: DataFrame) -> DataFrame:
    """(user_id, first): the smallest id left to a reader.

    A feed's ids are numbered; the first number that is missing among those done is what is left first.
    """
    ids = articles.select("feed_id", "id").where("id IS NOT NULL").distinct()
    placed = ids.withColumn("at", F.row_number().over(Window.partitionBy("feed_id").orderBy("id")))
    gone = done.join(light(placed), "id").groupBy(_SUBSCRIPTION).agg(F.sort_array(F.collect_set("at")).alias("gone"))
    missing = F.filter(F.transform("gone", lambda at, i: F.when(at != i + 1, i + 1)), lambda i: i.isNotNull())
    at = F.when(F.col("gone").isNull(), 1).otherwise(F.coalesce(F.get(missing, F.lit(0)), F.size("gone") + 1))
    rows = subs.select(_SUBSCRIPTION).join(gone, _SUBSCRIPTION, "left").select(*_SUBSCRIPTION, at.alias("at"))
    return rows.join(light(placed), ["feed_id", "at"]).groupBy("user_id").agg(F.min("id").alias("first"))


def joined_ids(subs: DataFrame, articles: DataFrame, done: DataFrame) -> DataFrame:
    """(user_id, ids): the ids left to each reader, ascending and joined by commas.

    A reader's row carries feeds and what is done in them and looks the feeds' ids up, so that
    the ids of all readers are never shuffled.  Only where the articles are too many to be
    broadcast are they grouped by reader.
    """
    ids = articles.select("id", "feed_id").where("id IS NOT NULL")
    if row_bytes(ids) > 8 * LIGHT_BYTES // 3:  # two columns of ids weigh less than other rows, and else every id is shuffled
        found = left_over(subs, ids, done).groupBy("user_id").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        return found.select("user_id", F.array_join("ids", ",").alias("ids"))
    of_feed = ids.groupBy("feed_id").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    listed = of_feed.where("feed_id IS NOT NULL").agg(F.map_from_entries(F.collect_list(F.struct("feed_id", "ids"))).alias("listed"))
    gone = done.join(F.broadcast(ids), "id").groupBy(_SUBSCRIPTION).agg(F.collect_set("id").alias("gone"))
    feeds = subs.select(_SUBSCRIPTION).join(gone, _SUBSCRIPTION, "left").groupBy("user_id").agg(F.collect_list(F.struct("feed_id", "gone")).alias("feeds"))
    none = F.array().cast("array<bigint>")

    def of(feed: Column) -> Column:
        each = F.coalesce(F.try_element_at("listed", feed["feed_id"]), none)
        return F.when(feed["gone"].isNull(), each).otherwise(F.filter(each, lambda i: ~F.array_contains(feed["gone"], i)))

    left = F.sort_array(F.flatten(F.transform("feeds", of)))
    rows = feeds.repartition(_tasks(feeds), "user_id").crossJoin(F.broadcast(listed)).select("user_id", F.array_join(left, ",").alias("ids"))
    return rows.where("ids <> ''")
