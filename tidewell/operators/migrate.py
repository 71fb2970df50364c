"""One star copied into another: ids are mapped by what rows are known by, conflicts are skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewell.operators.changes import inserted, numbered, without
from tidewell.operators.state import orphans
from tidewell.sources.star import Star, conform

#: Tables that hang on users, feeds, articles and groups, with what their rows are known by, in the order they are copied.
HANGING = {
    "user_feeds": ["user_id", "feed_id"], "read_state": ["user_id", "article_id"], "user_preferences": ["user_id", "key"], "user_prompts": ["user_id", "prompt_type"],
    "article_authors": ["article_id", "name"], "article_categories": ["article_id", "category"], "article_summaries": ["user_id", "article_id"],
    "fever_credentials": ["user_id"], "feed_favicons": ["feed_id"],
}
#: Columns that a copy leaves out; fixed values.
LEFT_OUT = {"read_state": ["security_reason"], "article_groups": ["display_name", "muted"]}


def copied(target: DataFrame, source: DataFrame, name: str, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The target with the source's new rows, and the map (old, new) of all the source's ids."""
    rows = source.withColumn("old", F.col("id"))
    fresh = numbered(target, without(rows.dropDuplicates(keys), target.select(keys)), order)
    out = target.unionByName(conform(fresh, name))
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return out, rows.select("old", *keys).alias("a").join(out.select(F.col("id").alias("new"), *keys).alias("b"), on).select("old", "new")


def mapped(df: DataFrame, ids: DataFrame, column: str, optional: bool = False) -> DataFrame:
    """Rows with the column's ids exchanged; those without a counterpart go, or where optional keep null."""
    joined = df.join(ids.select(F.col("old").alias(column), "new"), column, "left" if optional else "inner")
    return joined.drop(column).withColumnRenamed("new", column)


def with_orphans(s: Star) -> Star:
    """A user ``user_<id>`` for every id that is used and unknown."""
    used = [s[t].select("user_id") for t in ("user_feeds", "read_state", "article_groups", "filter_rules")]
    lost = orphans(s["users"].select(F.col("id").alias("user_id")), *used)
    return s.replace(users=s["users"].unionByName(conform(lost.select(F.col("user_id").alias("id"), F.concat(F.lit("user_"), "user_id").alias("name")), "users")))


def migrate(source: Star, target: Star) -> Star:
    source = with_orphans(source)
    feeds, feed_ids = copied(target["feeds"], source["feeds"], "feeds", ["url"], ["url"])
    users, user_ids = copied(target["users"], source["users"], "users", ["name"], ["name"])
    articles, article_ids = copied(target["articles"], mapped(source["articles"], feed_ids, "feed_id"), "articles", ["feed_id", "guid"], ["feed_id", "guid"])
    maps = {"feed_id": feed_ids, "user_id": user_ids, "article_id": article_ids}
    out = {"feeds": feeds, "users": users, "articles": articles}
    for name, keys in HANGING.items():
        rows = source[name].drop(*LEFT_OUT.get(name, []))
        for column in set(rows.columns) & set(maps):
            rows = mapped(rows, maps[column], column)
        out[name] = inserted(name, target[name], rows, keys)
    groups = mapped(source["article_groups"].drop(*LEFT_OUT["article_groups"]), user_ids, "user_id").withColumn("muted", F.lit(False))
    out["article_groups"], group_ids = copied(target["article_groups"], groups, "article_groups", ["user_id", "topic"], ["user_id", "topic"])
    members = mapped(mapped(source["article_group_members"], group_ids, "group_id"), article_ids, "article_id")
    out["article_group_members"] = inserted("article_group_members", target["article_group_members"], members, ["group_id", "article_id"])
    out["group_summaries"] = inserted("group_summaries", target["group_summaries"], mapped(source["group_summaries"], group_ids, "group_id"), ["group_id"])
    rules = mapped(source["filter_rules"].withColumn("rule_feed", F.col("feed_id")), user_ids, "user_id")
    rules = mapped(rules, feed_ids, "feed_id", optional=True).where("rule_feed IS NULL OR feed_id IS NOT NULL")
    out["filter_rules"], _ = copied(target["filter_rules"], rules, "filter_rules", ["user_id", "feed_id", "axis", "value"], ["user_id", "axis", "value"])
    images = mapped(source["article_images"], article_ids, "article_id")
    out["article_images"], _ = copied(target["article_images"], images, "article_images", ["article_id", "original_url"], ["article_id", "original_url"])
    return target.replace(**out)
