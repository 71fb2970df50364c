"""Fixture tables of the star schema: what a reader sees before and after changes."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewell.functions import html
from tidewell.operators import changes, ingest, migrate, prompts, refresh, shelf
from tidewell.plans.scratch import materialize
from tidewell.sources import feedfiles
from tidewell.sources.star import SCHEMAS, Star, conform

NOW, DAY = "2024-03-01 00:00:00", datetime(2024, 2, 1)


def star(spark, **rows):
    """A star of tables given as (columns, rows)."""
    return Star(spark, {n: conform(spark.createDataFrame(r, c), n) for n, (c, r) in rows.items()})


@pytest.fixture
def reader(spark):
    """User 1 reads feed 1 with three articles, two of them in a group; feed 2 is not subscribed."""
    return star(
        spark,
        feeds=("id long, url string, title string, enabled boolean, status string", [(1, "u1", "One", True, "active"), (2, "u2", "Two", True, "active")]),
        articles=("id long, feed_id long, guid string, title string, content string, published_date timestamp_ntz, fetched_date timestamp_ntz", [(i, 1 if i < 4 else 2, f"g{i}", f"T{i}", "c", DAY, DAY) for i in range(1, 5)]),
        users=("id long, name string", [(1, "Ann")]),
        user_feeds=("user_id long, feed_id long", [(1, 1)]),
        article_groups=("id long, user_id long, topic string, muted boolean", [(9, 1, "Test Group", False)]),
        article_group_members=("group_id long, article_id long, added_at timestamp_ntz", [(9, 1, DAY), (9, 2, DAY)]),
    )


def ids(df):
    return sorted(r.id for r in df.collect())


def test_groups_hide_mute_and_disband(spark, reader):
    assert ids(shelf.unread(reader, 1)) == [3]
    assert ids(shelf.unread_in_groups(reader, 9)) == [1, 2]
    assert [(r.label, r.unread) for r in shelf.group_stats(reader).collect()] == [("Test Group", 2)]
    assert [(r.feed_id, r.unread) for r in shelf.feed_stats(reader).collect()] == [(1, 1)]
    assert shelf.group_stats(changes.mute(reader, 9, NOW)).count() == 0
    free = changes.disband(reader, 1, spark.createDataFrame([(9,)], "id long"))
    assert ids(shelf.unread(free, 1)) == [1, 2, 3] and free["article_group_members"].count() == 0


def test_rules_and_thresholds(spark, reader):
    s = changes.store_names(reader, authors=spark.createDataFrame([(3, "Alice", None)], "article_id long, name string, email string"))
    assert ids(shelf.unread(s, 1, threshold=5)) == [3]  # no rules: all pass
    rule = "user_id long, feed_id long, axis string, value string, score int"
    s = changes.add_rules(s, spark.createDataFrame([(1, None, "author", "ALICE", 5)], rule), NOW)
    assert [ids(shelf.unread(s, 1, threshold=t)) for t in (None, 0, 1, 10)] == [[3], [3], [3], []]
    again = changes.rule_faults(s, spark.createDataFrame([(1, None, "author", "alice", 1)], rule)).first()
    assert again.fault == "exists"


def test_retries_leave_the_queue_and_resets_return_it(spark, reader):
    one = spark.createDataFrame([(1, 3)], "user_id long, article_id long")
    s = reader
    for _ in range(3):
        s = changes.retry(s, one)
        s = s.replace(read_state=materialize(s["read_state"], "state"))
    assert ids(shelf.unscored(s, 1)) == [1, 2]
    assert ids(shelf.unscored(changes.reset_scores(s, 1), 1)) == [1, 2, 3]
    scored = changes.score(s, spark.createDataFrame([(1, 3, 9.0, 8.0, None)], "user_id long, article_id long, interest_score double, security_score double, security_reason string"))
    row = scored["read_state"].first()
    assert (row.ai_scored, row.read, row.interest_score) == (True, False, 9.0)
    assert [round(r.decayed, 2) for r in shelf.decayed(scored, "2024-02-02 00:00:00").collect()] == [8.18]


def test_embeddings_are_missing_by_model_and_replaced(spark, reader):
    vectors = "article_id long, embedding array<float>, embedding_model string"
    s = changes.store(reader, "article_embeddings", spark.createDataFrame([(1, [1.0], "M")], vectors))
    assert ids(shelf.without_embeddings(s, "M")) == [2, 3, 4] and ids(shelf.without_embeddings(s, "other")) == [1, 2, 3, 4]
    s = changes.store(s, "article_embeddings", spark.createDataFrame([(1, [2.0], "M")], vectors))
    assert [r.embedding for r in s["article_embeddings"].collect()] == [[2.0]]


def test_unsubscribing_the_last_reader_deletes_the_feed(spark, reader):
    gone = changes.unsubscribe(reader, spark.createDataFrame([(1, 1)], "user_id long, feed_id long"))
    assert ids(gone["feeds"]) == [2] and ids(gone["articles"]) == [4]
    assert gone["article_group_members"].count() == 0


def test_ids_follow_the_order(spark):
    s = changes.add_feeds(Star(spark, {}), spark.range(500).select(F.format_string("u%04d", "id").alias("url"), F.lit(None).cast("string").alias("title")), NOW)
    assert [(r.id, r.url, r.title) for r in s["feeds"].orderBy("id").collect()] == [(k + 1, f"u{k:04d}", f"u{k:04d}") for k in range(500)]


RSS = """<rss xmlns:media="http://search.yahoo.com/mrss/"><channel><item><guid>article-1</guid><title>Test Article</title><link>https://x.example/1</link>
<description>Only a description</description><pubDate>Mon, 05 Feb 2024 10:00:00 +0100</pubDate></item>
<item><title>Video</title><link>https://x.example/2</link><media:group><media:thumbnail url="t.jpg"/><media:description>About</media:description></media:group></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>a1</id><title>Up</title><link href="https://x.example/3"/><content>Body</content>
<author><name>Bob</name><email>b@x.example</email></author><category term="go"/><updated>2024-02-06T00:00:00Z</updated></entry></feed>"""
JSON = '{"items": [{"id": 5, "title": "J", "url": "https://x.example/5", "content_html": "<p>j</p>", "date_published": "2024-02-07T01:00:00+01:00"}]}'


def test_feed_files_become_articles_once(spark, reader):
    files = spark.createDataFrame([(1, RSS), (1, ATOM), (2, JSON), (2, "broken <"), (2, None)], "feed_id long, body string")
    items = feedfiles.items(files)
    s = ingest.store_items(reader, items, NOW)
    s = s.replace(articles=materialize(s["articles"], "articles"), article_authors=materialize(s["article_authors"], "authors"))
    new = {r.title: r for r in s["articles"].where("id > 4").collect()}
    assert set(new) == {"Test Article", "Video", "Up", "J"}
    assert (new["Test Article"].guid, new["Test Article"].content, new["Test Article"].published_date) == ("article-1", "Only a description", datetime(2024, 2, 5, 9))
    assert new["Video"].content == '<p><a href="https://x.example/2"><img src="t.jpg" alt="video thumbnail"></a></p><p>About</p>'
    assert (new["Up"].author, new["Up"].published_date) == ("Bob", datetime(2024, 2, 6)) and new["J"].published_date == datetime(2024, 2, 7)
    assert [r.category for r in s["article_categories"].collect()] == ["go"]
    assert ingest.store_items(s, items, NOW)["articles"].count() == 8


def test_html_functions():
    head = '<head><link rel=alternate type="application/atom+xml" href="/f" title=" A "><link rel=alternate type=text/html href=x><link rel="Shortcut Icon" href="i.ico"></head><body><link rel=icon href=no>'
    assert html.feed_links_of(head, "https://x.example/a/b") == [{"url": "https://x.example/f", "title": "A", "type": "atom"}]
    assert html.icon_of(head, "https://x.example/a/b") == "https://x.example/a/i.ico" and html.icon_of(head, None) == ""
    many = "".join(f'<img src="/{k}.png">' for k in range(30)) + '<img src="/0.png"><img src="ftp://x/y.png"><img src="data:a">'
    assert html.images_of(many, "https://x.example") == [f"https://x.example/{k}.png" for k in range(20)]
    assert html.og_image_of('<meta property="og:image" content="https://pbs.twimg.com/a.jpg">') == "https://pbs.twimg.com/a.jpg"
    got = html.rewritten('<p>x &amp; <img src="a.png?1" width=3 style="float:left; color:red"><img src="a.png?2"><a href="u" rel="me">l</a></p>', set())
    assert got == '<p>x &amp; <img src="a.png?1" style="color:red"><a href="u" rel="me noopener" target="_blank">l</a></p>'
    assert html.rewritten('<img src="u"><img src="v">', None, {"u": 7}) == '<img src="/images/7"><img src="v">'
    assert html.rewritten("", set()) == "" and html.rewritten(None) is None


def test_link_posts(spark):
    rows = [('<a HREF="https://Other.example/X">x</a>', "https://me.example/1", "https://other.example/x"), ('<a href="https://me.example/2">x</a>', "https://me.example/1", ""),
            ('<a href="https://o.example/p.JPG">x</a>', "https://me.example/1", ""), ("word " * 60 + '<a href="https://o.example">x</a>', "https://me.example/1", "")]
    df = spark.createDataFrame(rows, "c string, u string, want string")
    assert df.where(html.link_post_url(F.col("c"), F.col("u")) != F.col("want")).count() == 0


def test_newsletters_and_issues(spark, reader):
    s = changes.create_newsletters(reader, spark.createDataFrame([(1, "L", "daily", None)], "user_id long, name string, schedule string, config_json string"), NOW)
    assert [(r.n_issues, r.latest) for r in shelf.newsletter_stats(s).collect()] == [(0, None)]
    assert ids(shelf.due_newsletters(s, NOW)) == [1]
    s = changes.score(s, spark.createDataFrame([(1, 3, 9.0, 8.0, None)], "user_id long, article_id long, interest_score double, security_score double, security_reason string"))
    answer = lambda rows: rows.withColumn("response", F.lit('{"headline": "Head", "body": "B"}'))
    s = prompts.write_issues(s, shelf.newsletters(s), answer, NOW)
    assert [(r.headline, r.article_ids) for r in shelf.issues(s).collect()] == [("Head", [3])]
    assert shelf.due_newsletters(s, "2024-03-01 12:00:00").count() == 0


def test_answers_are_written_once(spark, reader, tmp_path):
    """Any number of actions on the result calls the model once for a newsletter, though its answers differ."""
    calls = tmp_path / "calls"
    calls.mkdir()

    @F.udf("string")
    def answer(prompt):
        import uuid

        name = uuid.uuid4().hex
        (calls / name).touch()
        return f'{{"headline": "{name}", "body": "{name}"}}'

    s = changes.create_newsletters(reader, spark.createDataFrame([(1, "L", "daily", None)], "user_id long, name string, schedule string, config_json string"), NOW)
    s = changes.score(s, spark.createDataFrame([(1, 3, 9.0, 8.0, None)], "user_id long, article_id long, interest_score double, security_score double, security_reason string"))
    s = prompts.write_issues(s, shelf.newsletters(s), lambda rows: rows.withColumn("response", answer.asNondeterministic()("prompt")), NOW)
    rows = [shelf.issues(s).first() for _ in range(3)]
    assert shelf.newsletters(s).count() == 1 and len({r.headline for r in rows}) == 1
    assert [x.name for x in calls.iterdir()] == [rows[0].headline]


def test_contradicting_requests_have_one_outcome(spark, reader):
    key = "user_id long, article_id long"
    s = changes.mark(reader, spark.createDataFrame([(1, 3, True, 1), (1, 3, False, 2), (1, 4, False, 1), (1, 4, True, 2)], f"{key}, read boolean, seq long"), NOW)
    s = changes.retry(s, spark.createDataFrame([(1, 3)] * 2 + [(1, 9)] * 3, key))
    s = changes.retry(s, spark.createDataFrame([(1, 3)], key))
    assert {r.article_id: (r.read, r.ai_retries) for r in s["read_state"].collect()} == {3: (False, 3), 4: (True, 0), 9: (False, 3)}
    tied = spark.createDataFrame([(1, k % 3, k % 2 == 0) for k in range(12)], f"{key}, starred boolean")
    for n in (1, 3, 7):
        starred = changes.star_marks(reader, tied.repartition(n))["read_state"]
        assert {r.article_id: r.starred for r in starred.collect()} == {0: True, 1: True, 2: True}
    scores = f"{key}, interest_score double, security_score double, security_reason string, seq long"
    s = changes.score(reader, spark.createDataFrame([(1, 1, 1.0, 2.0, "b", 2), (1, 1, 9.0, 9.0, "z", 1)], scores))
    assert [(r.interest_score, r.security_reason) for r in s["read_state"].collect()] == [(1.0, "b")]
    added = changes.add_feeds(reader, spark.createDataFrame([("u9", "late", 2), ("u9", "early", 1), ("u1", "x", 1)], "url string, title string, seq long"), NOW)
    assert [r.title for r in added["feeds"].where("url = 'u9'").collect()] == ["early"] and added["feeds"].count() == 3


def test_prompts_are_filled_once(spark):
    df = spark.createDataFrame([("a {{.Title}} {{.Content}}", "{{.Content}}", "c")], "t string, x string, y string")
    assert df.select(prompts.rendered(F.col("t"), Title=F.col("x"), Content=F.col("y"))).first()[0] == "a {{.Content}} c"


def test_clusters_of_an_answer(spark):
    text = 'Sure: {"groups": [{"topic": "A", "article_indices": [0, 2]}, {"topic": "B", "article_indices": [2, 1]}]}'
    got = prompts.clusters(spark.createDataFrame([(1, text)], "user_id long, response string")).collect()
    assert sorted((r.place, r.topic) for r in got) == [(0, "A"), (1, "B"), (2, "A")]


def test_migration_maps_ids_and_keeps_what_is_there(spark, reader):
    target = star(spark, feeds=("id long, url string, title string", [(50, "u1", "Own title")]), users=("id long, name string", [(60, "Ann")]))
    out = migrate.migrate(reader, target)
    assert sorted((r.id, r.url, r.title) for r in out["feeds"].collect()) == [(50, "u1", "Own title"), (51, "u2", "Two")]
    assert [(r.user_id, r.feed_id) for r in out["user_feeds"].collect()] == [(60, 50)]
    assert out["articles"].count() == 4 and out["article_group_members"].count() == 2
    assert migrate.migrate(reader, out)["articles"].count() == 4


def test_a_saved_star_is_loaded(spark, reader, tmp_path):
    reader.save(str(tmp_path))
    back = Star.load(spark, str(tmp_path), ["feeds", "articles", "users", "user_feeds", "article_groups", "article_group_members"])
    assert ids(shelf.unread(back, 1)) == [3] and back["newsletters"].columns == [c.strip().split(" ")[0] for c in SCHEMAS["newsletters"].split(",")]


def test_differences_of_tables(spark):
    schema = "k long, j string, v string, w array<int>"
    old = spark.createDataFrame([(1, "a", "x", [1]), (1, "b", "y", None), (2, None, None, []), (3, "a", "z", [1])], schema)
    new = spark.createDataFrame([(1, "a", "x", [1]), (1, "b", None, None), (2, None, None, None), (4, "a", "z", [1])], schema)
    got = {(r.k, r.j): r.change for r in refresh.difference(old, new, ["k", "j"]).collect()}
    assert got == {(1, "b"): "changed", (2, None): "changed", (3, "a"): "gone", (4, "a"): "added"}
    assert refresh.difference(old, old, ["k", "j"]).count() == 0


def test_only_touched_groups_reach_the_model(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    @F.udf("string")
    def answer(prompt):
        import hashlib

        (calls / hashlib.md5(prompt.encode()).hexdigest()).write_text(prompt)
        return "no JSON at all" if "Topic: plain" in prompt else '{"headline": "H", "summary": "S"}' if "JSON" in prompt else " Refined "

    model = lambda rows: rows.withColumn("response", answer.asNondeterministic()("prompt"))
    s = star(
        spark,
        articles=("id long, title string", [(k, f"T{k}") for k in range(1, 12)]),
        users=("id long, name string", [(1, "Ann"), (2, "Bo")]),
        article_groups=("id long, user_id long, topic string", [(1, 1, "one"), (2, 1, "two"), (3, 2, "plain"), (4, 2, "still"), (5, 2, "single")]),
        article_group_members=("group_id long, article_id long", [(1, 1), (1, 2), (2, 3), (2, 4), (3, 5), (3, 6), (4, 7), (4, 8), (5, 9)]),
        article_summaries=("user_id long, article_id long, ai_summary string", [(u, k, f"sum {k}") for u, ks in ((1, range(1, 6)), (2, range(5, 10))) for k in ks]),
        read_state=("user_id long, article_id long, interest_score double", [(1, 1, 9.0), (2, 5, 4.0)]),
        group_summaries=("group_id long, headline string, summary string", [(4, "kept", "kept"), (1, "old", "old")]),
    )
    after = changes.add_members(s, spark.createDataFrame([(1, 5), (5, 10)], "group_id long, article_id long"), NOW)
    after = changes.store(after, "article_summaries", spark.createDataFrame([(2, 6, "changed"), (1, 6, "of another user")], "user_id long, article_id long, ai_summary string"))
    assert sorted(r.group_id for r in refresh.touched_groups(s, after).collect()) == [1, 3, 5]
    out = refresh.refresh_groups(s, after, model, model, NOW)
    rows = {r.group_id: (r.headline, r.summary, r.article_count, r.max_interest_score) for r in out["group_summaries"].collect()}
    assert rows == {1: ("H", "S", 3, 9.0), 3: ("", "no JSON at all", 2, 5.0), 4: ("kept", "kept", None, None), 5: ("", "sum 9", 1, 5.0)}
    assert {r.id: r.topic for r in out["article_groups"].collect()} == {1: "Refined", 2: "two", 3: "plain", 4: "still", 5: "single"}
    asked = sorted(p.read_text() for p in calls.iterdir())
    assert len(asked) == 3 and sum("1. T1" in a and "3. T5" in a for a in asked) == 1  # two groups and one topic
    assert refresh.touched_groups(out, out).count() == 0


def test_numbers_do_not_depend_on_the_run(spark):
    """Range bounds are sampled by every run; rows keep their ids through all of them."""
    table = spark.createDataFrame([], "id long, guid string")
    rows = spark.range(4_000, numPartitions=8).select(F.lit(None).cast("long").alias("id"), F.sha1(F.col("id").cast("string")).alias("guid"), F.lit("c").alias("content"))
    numbers = changes.numbered(table, rows, ["guid"])
    assert "RepartitionByExpression" not in numbers._jdf.queryExecution().optimizedPlan().toString()  # read back, not numbered anew
    first, again = numbers.select("guid", "id", "content"), numbers.where("length(guid) > 0").select("guid", F.col("id").alias("other"), F.lit(1).alias("x"))
    assert first.agg(F.min("id"), F.max("id"), F.count_distinct("id")).first()[:] == (1, 4_000, 4_000)
    assert first.join(again, "guid").where("id = other").count() == 4_000
