"""Feed items to articles: fall-backs, cross-posts and repeats, authors and categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewell.functions.html import sanitize
from tidewell.operators.changes import numbered, store_names, without
from tidewell.operators.state import first_of
from tidewell.sources.star import Star, conform


def media_html(link: Column, thumbnail: Column, description: Column) -> Column:
    """A linked thumbnail and a paragraph for items that only have media; empty where they have neither."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    picture = F.concat(F.lit('<p><a href="'), F.coalesce(link, F.lit("")), F.lit('"><img src="'), thumbnail, F.lit('" alt="video thumbnail"></a></p>'))
    return F.concat(F.when(some(thumbnail), picture).otherwise(""), F.when(some(description), F.concat(F.lit("<p>"), description, F.lit("</p>"))).otherwise(""))


def articles_of(items: DataFrame) -> DataFrame:
    """Items as article rows: content falls back to the description, then to media; the date to the update."""
    filled = F.coalesce(F.nullif(sanitize(F.col("content")), F.lit("")), F.nullif(sanitize(F.col("description")), F.lit("")), media_html(F.col("link"), F.col("thumbnail"), F.col("media_description")))
    return items.select(
        "feed_id", "place", "guid", sanitize(F.col("title")).alias("title"), F.col("link").alias("url"), filled.alias("content"), sanitize(F.col("description")).alias("summary"),
        F.coalesce(sanitize(F.get("authors", 0)["name"]), F.lit("")).alias("author"), F.coalesce("published", "updated").alias("published_date"), "authors", "categories",
    )


def store_items(s: Star, items: DataFrame, now: str) -> Star:
    """The star with the items' new articles.

    Skipped: a title and date that an article, or an earlier item, already has (cross-posts),
    and a guid that its feed already has.  Items count in order of feed and place.
    """
    rows = articles_of(items).withColumn("order", F.struct("feed_id", "place"))
    known = s["articles"].where("title <> '' AND published_date IS NOT NULL").select("title", "published_date")
    rows = first_of(rows, ["title", "published_date"], "order").join(known.distinct(), ["title", "published_date"], "left_anti")
    rows = without(first_of(rows, ["feed_id", "guid"], "order"), s["articles"].select("feed_id", "guid"))
    fresh = numbered(s["articles"], rows, ["feed_id", "place"]).withColumns({"fetched_date": F.lit(now).cast("timestamp_ntz"), "full_text_fetched": F.lit(False), "images_cached": F.lit(False)})
    out = s.replace(articles=s["articles"].unionByName(conform(fresh, "articles")))
    authors = fresh.select(F.col("id").alias("article_id"), F.inline("authors")).where("coalesce(name, '') <> ''")
    categories = fresh.select(F.col("id").alias("article_id"), F.explode("categories").alias("category"))
    return store_names(out, authors, categories)


def full_texts(s: Star, pages: DataFrame) -> Star:
    """Articles that are cut off, replaced by their pages' text (id, text) where that is longer and about the same.

    Accepted: 300 characters more, no contact page, a common phrase.  Every article with a
    page is done with, whatever came of it.
    """
    from tidewell.functions import text
    from tidewell.operators.changes import flag_articles, set_content

    rows = s["articles"].select("id", F.coalesce("content", F.lit("")).alias("content")).join(pages, "id").where(text.is_truncated(F.col("content")))
    longer = text.text_length(F.col("text")) >= text.text_length(F.col("content")) + 300
    good = rows.where(longer & ~text.looks_like_contacts(F.col("text")) & text.shingle_overlap(text.strip_tags(F.col("content")), text.strip_tags(F.col("text"))))
    return flag_articles(set_content(s, good.select("id", F.col("text").alias("content"))), pages.select("id"), "full_text_fetched")
