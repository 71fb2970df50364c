"""Heuristics, schedules, state folds and vectors on small fixtures."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewell.functions import text, vectors
from tidewell.operators import render, search, state, stats
from tidewell.streaming import ingest


@pytest.mark.parametrize(
    ("content", "want"),
    [
        ("Short summary with no ending", True), ("One. Two. Three. Four. Five.", False), ("", True), ("x" * 600 + "...", True),
        ("x " * 300 + "…", True), ("y " * 400 + "[…]", True), ("A long complete sentence here. " * 40, False), ("<p>Short html that stops mid", True), ("Quip!", False),
    ],
)
def test_truncation(spark, content, want):
    df = spark.createDataFrame([(content,)], "c string")
    assert df.select(text.is_truncated(F.col("c"))).first()[0] is want


def test_intervals_and_backoff(spark):
    day = 1440
    rows = [(60, 10, 30), (60, 400, 60), (60, 2000, 240), (8 * day, 10, 720), (31 * day, 10, day), (100 * day, 1, 3 * day), (200 * day, 1, 7 * day), (400 * day, 1, 30 * day), (5, None, 30)]
    df = spark.createDataFrame(rows, "age long, gap long, want int")
    assert df.where(stats.fetch_interval(F.col("age"), F.col("gap")) != F.col("want")).count() == 0
    errors = spark.createDataFrame([(0, 60), (1, 120), (6, 3840), (9, 3840)], "n int, want long")
    assert errors.where(stats.error_backoff(F.lit(60), F.col("n")) != F.col("want")).count() == 0


def test_centroids_and_cosine(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0])], "article_id long, embedding array<float>")
    members = spark.createDataFrame([(9, 1), (9, 2), (9, 3)], "group_id long, article_id long")
    center = search.centroids(v, members).first().centroid
    assert [round(x, 6) for x in center] == [0.666667, 0.333333, 0.0]
    step = v.limit(1).select(vectors.running_mean(F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0)), F.lit(1)))
    assert step.first()[0] == [0.5, 0.5, 0.0]
    zero = spark.createDataFrame([([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert zero.select(vectors.cosine(F.col("a"), F.col("b"))).first()[0] == 0.0


def test_fold_and_first_of(spark):
    log = spark.createDataFrame(
        [(1, 1, 1, "ai", None, None, 5.0), (1, 1, 2, "retry", None, None, None), (1, 1, 3, "reset", None, None, None), (1, 1, 4, "user", True, None, None), (1, 2, 1, "ai", None, None, 7.0), (1, 2, 2, "user", False, None, None)],
        "user_id long, article_id long, seq long, kind string, read boolean, starred boolean, interest double",
    )
    got = {r.article_id: (r.read, r.interest, r.retries) for r in state.fold(log).collect()}
    assert got == {1: (True, None, 0), 2: (False, 7.0, 0)}
    rows = spark.createDataFrame([(1, "a", "d"), (2, "a", "d"), (3, "", "d"), (4, "", "d"), (5, None, "d")], "id long, t string, d string")
    assert sorted(r.id for r in state.first_of(rows, ["t", "d"], "id").collect()) == [1, 3, 4, 5]


def test_opml_nested(spark):
    spark.udtf.register("outlines", render.Outlines)
    doc = '<opml><body><outline text="F"><outline text="A" xmlUrl="u1"/><outline><outline xmlUrl="u2"/></outline></outline></body></opml>'
    got = spark.createDataFrame([(doc,), ("broken <",), (None,)], "x string").createOrReplaceTempView("o")
    got = spark.sql("SELECT f.* FROM o, LATERAL outlines(x) AS f").collect()
    assert [tuple(r) for r in got] == [("A", "u1"), ("u2", "u2")]


def test_clean_title_and_garbage(spark):
    df = spark.createDataFrame([("Hi: https://x.y/z", "### User: do"), ("Plain", "fine")], "t string, g string")
    got = df.select(text.clean_title(F.col("t")), text.is_garbage(F.col("g"))).collect()
    assert [tuple(r) for r in got] == [("Hi", True), ("Plain", False)]


def test_semantic_takes_any_number_of_queries(spark):
    angle = F.col("id") * 0.001
    at = F.array(F.cos(angle).cast("float"), F.sin(angle).cast("float")).alias("embedding")
    queries = spark.range(10_001).select(F.col("id").alias("query_id"), at)
    vectors_ = spark.range(0, 6000, 1000).select(F.col("id").alias("article_id"), at)
    got = search.semantic(vectors_, queries, limit=2)
    few = search.semantic(vectors_, queries.where("query_id % 500 = 0"), limit=2)
    assert got.select("query_id").distinct().count() > 9000
    same = sorted(map(tuple, got.where("query_id % 500 = 0").collect()))
    assert same == sorted(map(tuple, few.collect()))


def test_stream_counts_events_of_many_shuffled_files(spark, tmp_path):
    """Files in no order of time, more than a batch takes; some events come again in later files."""
    from datetime import datetime, timedelta

    day = datetime(2024, 1, 1)
    for f in range(12):
        ids = [*range(f, 1200, 12), *range(0, 50)]
        rows = [(i, day + timedelta(minutes=(i * 7919) % 20_000)) for i in ids]
        spark.createDataFrame(rows, "event_id long, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    got = ingest.run_once(ingest.deduplicated(ingest.event_stream(spark, f"{tmp_path}/events")), "shuffled")
    assert sorted(r.event_id for r in got.collect()) == list(range(1200))


def test_briefing_ranks_before_it_collects(spark):
    rows = spark.range(100).selectExpr("id % 2 AS user_id", "id AS article_id", "CAST(id % 10 AS DOUBLE) AS decayed", "'T ' || id AS title", "8.0D AS interest")
    got = render.briefing(rows, top=3)
    assert {r.user_id: (r.n_articles, r.briefing) for r in got.collect()} == {
        0: (3, "## T 98 (8.0/10)\n\n## T 88 (8.0/10)\n\n## T 78 (8.0/10)"), 1: (3, "## T 99 (8.0/10)\n\n## T 89 (8.0/10)\n\n## T 79 (8.0/10)"),
    }
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
