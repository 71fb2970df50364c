"""Scoring of the queue: equal questions are asked once, and every reader gets the answer."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewell.operators import prompts, readers
from tidewell.plans.scratch import materialize
from tidewell.sources.star import Star, conform
from tests.test_readers import shuffled

USERS, ARTICLES = 40, 12


def crowd(spark) -> Star:
    """User 1 asks about security in words of its own, user 2 has keywords; article 0 is scored by all, of article 1 a call failed for user 3."""
    users = spark.range(USERS)
    subs = users.select(F.col("id").alias("user_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("feed_id")).where("user_id <> 4 OR feed_id = 1")
    articles = spark.range(ARTICLES).select("id", (F.col("id") % 2 + 1).alias("feed_id"), F.concat(F.lit("t"), "id").alias("title"), F.lit("some long content").alias("content"))
    state = users.select(F.col("id").alias("user_id"), F.lit(0).alias("article_id"), F.lit(True).alias("read"), F.lit(True).alias("ai_scored"), F.lit(9.0).alias("interest_score"))
    failed = spark.createDataFrame([(3, 1, True, False, None)], "user_id long, article_id int, read boolean, ai_scored boolean, interest_score double")
    tables = {
        "users": users, "user_feeds": subs, "articles": articles, "read_state": state.union(failed),
        "user_prompts": spark.createDataFrame([(1, "security", "Mine {{.Title}}")], "user_id long, prompt_type string, prompt_template string"),
        "user_preferences": spark.createDataFrame([(2, "keywords", '["bees"]')], "user_id long, key string, value string"),
        "article_summaries": spark.createDataFrame([(5, 6, "old")], "user_id long, article_id long, ai_summary string"),
    }
    return Star(spark, {n: conform(t, n) for n, t in tables.items()})


def test_every_reader_gets_the_answers(spark, monkeypatch):
    rows = {}

    def keep(df, label):
        out = materialize(df, label)
        rows[label] = out.count()
        return out

    def model(sql):
        return lambda asked: asked.withColumn("response", F.expr(sql))

    safe = "'{\"safe\": ' || (id % 3 <> 0) || ', \"score\": ' || IF(prompt LIKE 'Mine%', 9, 8) || ', \"reasoning\": \"r\"}'"
    security = model(f"CASE WHEN id = 5 THEN NULL ELSE {safe} END")
    curation = model("CASE WHEN id = 7 THEN NULL WHEN prompt LIKE '%bees%' THEN '{\"interest_score\": 7}' ELSE '{\"interest_score\": 4}' END")
    found = []
    for limit in (readers.LIGHT_BYTES, 0):  # with broadcasts, and without
        monkeypatch.setattr(readers, "LIGHT_BYTES", limit)
        after = prompts.process(crowd(spark), security, curation, model("'Short'"), keep)
        found.append({(r.user_id, r.article_id): r for r in after["read_state"].collect()})
        summaries = {(r.user_id, r.article_id): r.ai_summary for r in after["article_summaries"].collect()}
    assert found[0] == found[1]
    state = found[0]
    due = {(u, a) for u in range(USERS) for a in range(ARTICLES) if u != 4 or a % 2 == 0}
    assert set(state) == due and after["read_state"].count() == len(due)
    for (u, a), r in state.items():
        if a == 0:
            assert (r.ai_scored, r.interest_score, r.read) == (True, 9.0, True)
        elif a in (5, 7):
            assert (r.ai_scored, r.interest_score, r.ai_retries) == (False, None, 1)
        else:
            assert (r.ai_scored, r.security_score) == (True, 9.0 if u == 1 else 8.0)
            assert r.interest_score == (0.0 if a % 3 == 0 else 7.0 if u == 2 else 4.0)
            assert r.read == ((u, a) == (3, 1)) and (r.ai_retries or 0) == 0
    told = {(u, a): "Short" for u, a in due if a and a % 3 and a != 5}
    assert summaries == told | {(5, 6): "old"}
    assert rows["security"] <= 2 * ARTICLES and rows["curation"] <= 2 * ARTICLES and rows["summarization"] <= ARTICLES  # not users times articles


@pytest.mark.parametrize("light", [readers.LIGHT_BYTES, 0])
def test_pairs_meet_no_reading_state(spark, monkeypatch, light):
    """However large reading state is: 300 readers with a failed article each, 90 articles."""
    monkeypatch.setattr(readers, "LIGHT_BYTES", light)
    users = spark.range(300)
    articles = spark.range(90).select("id", F.lit(1).alias("feed_id"), F.concat(F.lit("t"), "id").alias("title"), F.lit("some long content").alias("content"))
    state = users.select(F.col("id").alias("user_id"), (F.col("id") % 90).alias("article_id"), F.lit(True).alias("read"), F.lit(False).alias("ai_scored"), F.lit(1).alias("ai_retries"))
    tables = {"users": users, "user_feeds": users.select(F.col("id").alias("user_id"), F.lit(1).alias("feed_id")), "articles": articles, "read_state": state}
    s = Star(spark, {n: conform(t, n) for n, t in tables.items()})

    def model(sql):
        return lambda asked: asked.withColumn("response", F.expr(sql))

    after = prompts.process(s, model("CASE WHEN id > 0 THEN '{\"safe\": true, \"score\": 8}' END"), model("'{\"interest_score\": 5}'"), model("'Short'"), materialize)
    assert shuffled(spark, after["read_state"]) < 300 * 90 / 5
    found = {(r.user_id, r.article_id): r for r in after["read_state"].collect()}
    assert len(found) == after["read_state"].count() == 300 * 90
    for (u, a), r in found.items():
        own = u % 90 == a
        assert (bool(r.read), r.ai_scored, r.ai_retries, r.interest_score) == (own, a > 0, own + (a == 0), 5.0 if a else None)


def test_contents_are_not_shuffled_by_user(spark):
    """Few users ask about all articles: their prompts and keywords go to the contents."""
    seen = []

    def model(rows):
        seen.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return rows.withColumn("response", F.lit("{\"safe\": true, \"score\": 8, \"interest_score\": 5}"))

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # what Spark estimates does not count
    try:
        prompts.looked(crowd(spark), model, model, model, materialize)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    top = [next(line for line in plan.splitlines() if "Join " in line) for plan in seen]
    assert len(top) == 3 and all("strategy=broadcast" in line for line in top)
