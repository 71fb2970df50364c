"""Text renderings: briefing, OPML export and import."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import udtf

from tidewell.functions.text import rfc3339, truncate


def briefing(rows: DataFrame, top: int = 20) -> DataFrame:
    """(user_id, n_articles, briefing): the best articles as markdown headings."""
    best = Window.partitionBy("user_id").orderBy(F.desc("decayed"), F.desc("article_id"))
    lines = F.array_sort(F.collect_list(F.struct("i", "line")))
    line = F.format_string("## %s (%.1f/10)", F.regexp_replace("title", r"\s+", " "), F.col("interest"))
    cut = rows.withColumn("i", F.row_number().over(best)).where(F.col("i") <= top)
    grouped = cut.withColumn("line", line).groupBy("user_id").agg(lines.alias("l"))
    return grouped.select("user_id", F.size("l").cast("long").alias("n_articles"), F.array_join(F.transform("l", lambda x: x["line"]), "\n\n").alias("briefing"))


def escape_xml(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def _xml(c: str) -> Column:
    return escape_xml(F.col(c))


def opml(feeds: DataFrame) -> DataFrame:
    """(user_id, opml): each user's feeds (title, url) as an OPML 2.0 document."""
    outline = F.concat(F.lit('<outline type="rss" text="'), _xml("title"), F.lit('" title="'), _xml("title"), F.lit('" xmlUrl="'), _xml("url"), F.lit('"/>'))
    body = feeds.select("user_id", "title", outline.alias("o")).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("title", "o"))).alias("l"))
    lines = F.array_join(F.transform("l", lambda x: x["o"]), "")
    return body.select("user_id", F.concat(F.lit('<opml version="2.0"><head><title>Subscriptions</title></head><body>'), lines, F.lit("</body></opml>")).alias("opml"))


@udtf(returnType="title: string, url: string")
class Outlines:
    """Feeds of an OPML text at any depth; a missing title falls back to text, then url."""

    def eval(self, text: str) -> Iterator[tuple[str, str]]:
        try:
            root = ET.fromstring(text or "")
        except ET.ParseError:
            return
        for node in root.iter("outline"):
            url = node.get("xmlUrl")
            if url:
                yield node.get("title") or node.get("text") or url, url


def opml_lines(feeds: DataFrame, title: str = "All subscriptions") -> DataFrame:
    """(place, url, line): one OPML 2.0 document of any number of feeds (title, url), each address once.

    A row a line, places 0 (head), 1 (outlines, by address) and 2 (end), so that a document of all feeds never passes one task.
    """
    once = feeds.groupBy("url").agg(F.min("title").alias("title"))
    outline = F.concat(F.lit('<outline type="rss" text="'), _xml("title"), F.lit('" title="'), _xml("title"), F.lit('" xmlUrl="'), _xml("url"), F.lit('"/>'))
    ends = [(0, f'<opml version="2.0"><head><title>{title}</title></head><body>'), (2, "</body></opml>")]
    frame = feeds.sparkSession.createDataFrame([(p, None, x) for p, x in ends], "place int, url string, line string")
    return frame.union(once.select(F.lit(1).alias("place"), "url", outline.alias("line")))


def in_mail(title: Column, body: Column) -> Column:
    """A newsletter's body as an HTML mail: a sheet of 600 pixels in the middle, styles in place, as mail readers want it."""
    head = F.concat(F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"><title>'), escape_xml(title), F.lit("</title></head>"))
    sheet = '<body style="margin:0;background:#eee;font-family:sans-serif"><div style="max-width:600px;margin:20px auto;padding:30px;background:#fff;color:#333;line-height:1.6">'
    return F.concat(head, F.lit(sheet), F.coalesce(body, F.lit("")), F.lit("</div></body></html>"))


# --- lines for consoles and mails: one row a line, so that no list passes one group -----------


def article_lines(rows: DataFrame) -> DataFrame:
    """(id, line) of articles (id, title, url, published_date)."""
    line = F.format_string("id=%d\ttitle=%s\turl=%s\tpublished=%s", "id", F.coalesce("title", F.lit("")), F.coalesce("url", F.lit("")), rfc3339(F.col("published_date")))
    return rows.select("id", line.alias("line"))


def group_lines(members: DataFrame) -> DataFrame:
    """(group_id, place, line) of members (group_id, topic, id, title, url, score): a heading at place 0, then by score."""
    head = members.groupBy("group_id", "topic").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"))
    heads = head.select("group_id", F.lit(0).alias("place"), F.format_string("topic=%s\tcount=%d\tmax_score=%.1f", "topic", "n", "best").alias("line"))
    order = Window.partitionBy("group_id").orderBy(F.desc("score"), F.desc("id"))
    line = F.format_string("  id=%d\ttitle=%s\turl=%s\tscore=%.1f", "id", F.coalesce("title", F.lit("")), F.coalesce("url", F.lit("")), "score")
    return heads.unionByName(members.select("group_id", F.row_number().over(order).alias("place"), line.alias("line")))


def notification_lines(rows: DataFrame) -> DataFrame:
    """(user_id, id, line) of high-interest articles (user_id, id, score, title, url)."""
    return rows.select("user_id", "id", F.format_string("notification\tid=%d\tscore=%.1f\ttitle=%s\turl=%s", "id", "score", F.coalesce("title", F.lit("")), F.coalesce("url", F.lit(""))).alias("line"))


def status_lines(rows: DataFrame, safe: float = 7.0) -> DataFrame:
    """(user_id, id, line) of scored articles (user_id, id, title, interest_score, security_score)."""
    status = F.when(F.col("security_score") >= safe, "processed").otherwise("unsafe")
    line = F.format_string("event=article_%s\tid=%d\tinterest=%.1f\tsecurity=%.1f\ttitle=%s", status, "id", "interest_score", "security_score", F.coalesce("title", F.lit("")))
    return rows.select("user_id", "id", line.alias("line"))


def digest(rows: DataFrame, top: int = 20) -> DataFrame:
    """(user_id, text): a user's best articles (user_id, id, score, title, url, summary) as a markdown list; the heading counts all."""
    best = Window.partitionBy("user_id").orderBy(F.desc("score"), F.desc("id"))
    n = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    summary = F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit("  "), truncate(F.col("summary"), 200), F.lit("\n\n"))).otherwise("")
    cut = rows.withColumn("i", F.row_number().over(best)).where(F.col("i") <= top)
    lines = cut.select("user_id", "i", F.concat(F.format_string("- [%s](%s)\n", "title", "url"), summary).alias("line"))
    body = lines.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("l"))
    head = F.format_string("Found %d high-interest article(s):\n\n", "n")
    return body.join(n, "user_id").select("user_id", F.concat(head, F.array_join(F.transform("l", lambda x: x["line"]), "")).alias("text"))


#: Counters of a fetch in order; fixed names.
FETCHED = ["feeds_total", "feeds_downloaded", "feeds_not_modified", "feeds_errored", "new_articles", "processed", "high_interest"]


def fetch_result(feeds: DataFrame, articles: DataFrame, scored: DataFrame, since: str, high: float = 8.0) -> DataFrame:
    """One row of counters of a fetch since a time: feeds (outcome), articles (fetched_date), scored (interest_score)."""
    of = lambda kind: F.count_if(F.col("outcome") == kind)
    counts = feeds.agg(F.count(F.lit(1)).alias("feeds_total"), of("downloaded").alias("feeds_downloaded"), of("not_modified").alias("feeds_not_modified"), of("error").alias("feeds_errored"))
    new = articles.agg(F.count_if(F.col("fetched_date") >= F.lit(since).cast("timestamp_ntz")).alias("new_articles"))
    done = scored.agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.col("interest_score") >= high).alias("high_interest"))
    return counts.crossJoin(F.broadcast(new)).crossJoin(F.broadcast(done)).select(FETCHED)  # one row each


def fetch_lines(result: DataFrame) -> DataFrame:
    """(nr, line): the counters as lines of name and number, as a sentence for people, and as JSON."""
    plain = [F.format_string(f"{c}=%d", F.col(c)) for c in FETCHED]
    said = F.format_string("Feeds: %d checked, %d downloaded, %d unchanged, %d errors", *[F.col(c) for c in FETCHED[:4]])
    lines = F.array(*plain, said, F.format_string("New articles: %d", "new_articles"), F.to_json(F.struct(*FETCHED)))
    return result.select(F.posexplode(lines).alias("nr", "line"))
