"""Work of all readers: right at the edges, and no shuffle of every reader's every article."""

from __future__ import annotations

from datetime import datetime

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidewell.operators import reading, readers, shelf
from tidewell.sources.star import Star, conform
from tidewell.sources.tables import Tables

DAY, USERS, ARTICLES = datetime(2024, 2, 1), 300, 400


def shuffled(spark, df) -> int:
    """Records that the stages of writing ``df`` put into shuffles."""
    store, gateway = spark._jsparkSession.sparkContext().statusStore(), spark.sparkContext._gateway

    def records() -> int:
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before = records()
    df.write.format("noop").mode("overwrite").save()
    return records() - before


@pytest.fixture(scope="module")
def crowd(spark):
    """Everybody reads the one feed, has read one article and scored, starred and summarised others."""
    users = spark.range(USERS).select(F.col("id").alias("user_id"))
    state = users.select(
        "user_id", (F.col("user_id") % ARTICLES).alias("article_id"), (F.col("user_id") % 2 == 0).alias("read"), F.lit(True).alias("starred"), F.lit(True).alias("ai_scored"), F.lit(9.0).alias("interest_score"),
    )
    articles = spark.range(ARTICLES).select("id", F.lit(1).alias("feed_id"), F.lit(DAY).alias("published_date"))
    tables = {
        "users": users.select(F.col("user_id").alias("id")), "user_feeds": users.withColumn("feed_id", F.lit(1)), "read_state": state, "articles": articles,
        "feeds": spark.createDataFrame([(1, "One", True)], "id long, title string, enabled boolean"),
        "article_summaries": users.select("user_id", (F.col("user_id") % ARTICLES).alias("article_id"), F.lit("s").alias("ai_summary")),
        "article_embeddings": articles.select(F.col("id").alias("article_id"), F.array(F.lit(1.0)).alias("embedding"), F.lit("m").alias("embedding_model")),
    }
    return Star(spark, {n: conform(t, n) for n, t in tables.items()})


LISTINGS = {
    "feed_stats": (shelf.feed_stats, USERS), "pending": (shelf.pending, USERS), "subscribed": (shelf.subscribed_counts, USERS), "starred": (shelf.starred, USERS),
    "unread": (shelf.unread, USERS * ARTICLES - USERS // 2), "queue": (shelf.unscored, USERS * (ARTICLES - 1)), "vectors": (lambda s: shelf.article_vectors(s, None, "m"), USERS * ARTICLES),
}


@pytest.mark.parametrize("name", sorted(LISTINGS))
def test_pairs_are_not_shuffled(spark, crowd, name):
    listing, rows = LISTINGS[name]
    assert listing(crowd).count() == rows
    assert shuffled(spark, listing(crowd)) < USERS * ARTICLES / 10


def test_what_is_left(spark):
    """Null ids are kept, what is done elsewhere does not count, readers with nothing left have no ids."""
    subs = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 9), (None, 1)], "user_id long, feed_id long")
    articles = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (None, 2), (5, 3)], "id long, feed_id long")
    done = spark.createDataFrame([(1, 1), (1, 5), (2, 1), (2, 2), (None, 1)], "user_id long, id long")
    left = sorted(((r.user_id, r.id) for r in readers.left_over(subs, articles, done).collect()), key=repr)
    assert left == sorted([(1, 2), (1, 3), (1, None), (None, 1), (None, 2)], key=repr)
    counts = {(r.user_id, r.feed_id): (r.total, r.n) for r in readers.counts(subs, articles, n=done).collect()}
    assert counts == {(1, 1): (2, 1), (1, 2): (2, 2), (2, 1): (2, 0), (3, 9): (0, 0), (None, 1): (2, 2)}
    assert {r.user_id: r.first for r in readers.first_left(subs, articles, done).collect()} == {1: 2, None: 1}
    assert {r.user_id: r.ids for r in readers.joined_ids(subs, articles, done).collect()} == {1: "2,3", None: "1,2"}
    few = readers.LIGHT_BYTES
    try:  # the same where articles are too many to be broadcast
        readers.LIGHT_BYTES = 0
        assert {r.user_id: r.ids for r in readers.joined_ids(subs, articles, done).collect()} == {1: "2,3", None: "1,2"}
    finally:
        readers.LIGHT_BYTES = few


def test_rules_hold_for_articles_that_are_not_subscribed(spark):
    """User 1's rule against author 4 takes away article 30 of feed 10, which the user does not subscribe to."""
    t = Tables(spark, "/root/testdata/sf0.001")
    assert t.subscriptions.where("user_id = 1 AND feed_id = 10").isEmpty()
    rows = spark.createDataFrame([(1, 30), (1, 31), (7, 30)], "user_id long, article_id long")
    assert {(r.user_id, r.article_id) for r in reading.above_threshold(t, rows, -1).collect()} == {(1, 31), (7, 30)}


@pytest.mark.parametrize("name", ["queue", "unread", "vectors"])
@pytest.mark.parametrize("light", [readers.LIGHT_BYTES, 0])
def test_a_listing_is_small_as_a_file(spark, crowd, tmp_path, monkeypatch, name, light):
    """Blocks of readers lie article by article: far less than the two bytes a pair that a reader at a time takes."""
    monkeypatch.setattr(readers, "LIGHT_BYTES", light)
    listing, rows = LISTINGS[name]
    ids = listing(crowd).select("user_id", "id")
    ids.write.parquet(str(tmp_path / "out"))
    pages = [pq.ParquetFile(f).metadata.row_group(0) for f in (tmp_path / "out").glob("*.parquet") if pq.ParquetFile(f).metadata.num_rows]
    assert sum(g.num_rows for g in pages) == rows and spark.read.parquet(str(tmp_path / "out")).distinct().count() == rows
    assert sum(g.column(k).total_compressed_size for g in pages for k in range(2)) < rows / 3


def test_parts_and_blocks_lose_no_pair(spark, crowd, monkeypatch):
    """Blocks of seven readers and parts of 30 articles, by broadcast and without."""
    monkeypatch.setattr(readers, "BLOCK", 7)
    monkeypatch.setattr(readers, "PART", 30)
    monkeypatch.setattr(readers, "TASK", 1000)
    want = {(u, a) for u in range(USERS) for a in range(ARTICLES) if not (u % ARTICLES == a and u % 2 == 0)}
    for light in (readers.LIGHT_BYTES, 0):
        monkeypatch.setattr(readers, "LIGHT_BYTES", light)
        found = [(r.user_id, r.id) for r in shelf.unread(crowd).collect()]
        assert len(found) == len(want) and set(found) == want
