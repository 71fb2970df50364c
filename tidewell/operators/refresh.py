"""Refresh of what depends on changed rows: the difference of two stars decides which groups are written anew.

Tables are compared by key and a digest of the other columns, so only keys and digests are
shuffled.  A group is touched if a member came or went, if its topic changed, or if a
member's title, or its summary or score for the group's owner, changed; only touched groups
reach the model.

Defined cases: a group without a summarised member keeps what it has; one with a single
such member takes its summary and no model is called; an answer that is no JSON is the
summary itself; a failed call leaves the group's summary as it was; rows that repeat a key
are compared by their greatest digest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from tidewell.functions import text
from tidewell.operators import changes
from tidewell.operators.prompts import Model, asked, read_json, refined_topics
from tidewell.plans.scratch import materialize
from tidewell.sources.star import Star

#: Members of a group that a prompt holds, best first, and members from which a topic is refined.
MOST, REFINED_FROM = 50, 3
_TOPIC = "Name the event or theme of this summary in at most ten words. Answer with the name only.\n\n"


def difference(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change) of rows that are ``added``, ``gone`` or ``changed``."""
    sides = []
    for name, table in (("old", before), ("new", after)):
        rest = F.to_json(F.struct(F.lit(1).alias("_"), *[F.col(c) for c in sorted(table.columns) if c not in keys]))
        sides.append(table.select(*keys, F.lit(name).alias("side"), F.sha2(rest, 256).alias("digest")))
    both = sides[0].union(sides[1]).groupBy(*keys)
    both = both.agg(*[F.max(F.when(F.col("side") == n, F.col("digest"))).alias(n) for n in ("old", "new")])
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "gone").when(F.col("old") != F.col("new"), "changed")
    return both.select(*keys, change.alias("change")).where("change IS NOT NULL")


def touched_groups(before: Star, after: Star) -> DataFrame:
    """(group_id) of groups whose summary is no longer that of its members."""
    keys = ["group_id", "article_id"]
    members = difference(before["article_group_members"].select(keys), after["article_group_members"].select(keys), keys).select("group_id")
    topics = [s["article_groups"].select(F.col("id").alias("group_id"), "topic") for s in (before, after)]
    found = members.union(difference(*topics, ["group_id"]).select("group_id"))
    owners = after["article_group_members"].select(keys).join(after["article_groups"].select(F.col("id").alias("group_id"), "user_id"), "group_id")
    titles = [s["articles"].select(F.col("id").alias("article_id"), "title") for s in (before, after)]
    found = found.union(owners.join(difference(*titles, ["article_id"]), "article_id").select("group_id"))
    own = ["user_id", "article_id"]
    for name, column in (("article_summaries", "ai_summary"), ("read_state", "interest_score")):
        now = difference(*[s[name].select(*own, column) for s in (before, after)], own)
        found = found.union(owners.join(now, own).select("group_id"))
    return found.distinct().join(after["article_groups"].select(F.col("id").alias("group_id")), "group_id", "left_semi")


def group_inputs(s: Star, groups: DataFrame, most: int = MOST) -> DataFrame:
    """(group_id, user_id, topic, n, best, inputs): summarised members of groups, the best ``most`` of them as structs."""
    heads = s["article_groups"].select(F.col("id").alias("group_id"), "user_id", "topic").join(groups, "group_id", "left_semi")
    rows = s["article_group_members"].select("group_id", "article_id").join(heads, "group_id")
    rows = rows.join(s["article_summaries"].select("user_id", "article_id", "ai_summary"), ["user_id", "article_id"])
    rows = rows.join(s["read_state"].select("user_id", "article_id", "interest_score"), ["user_id", "article_id"], "left")
    rows = rows.join(s["articles"].select(F.col("id").alias("article_id"), "title"), "article_id").withColumn("score", F.coalesce("interest_score", F.lit(5.0)))
    sums = rows.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"))
    best = Window.partitionBy("group_id").orderBy(F.desc("score"), "article_id")
    cut = rows.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most)
    inputs = F.array_sort(F.collect_list(F.struct("place", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("ai_summary", F.lit("")).alias("summary"), "score")))
    return cut.groupBy("group_id", "user_id", "topic").agg(inputs.alias("inputs")).join(sums, "group_id")


def refresh_groups(before: Star, after: Star, summaries: Model, topics: Model, now: str, config: dict | None = None, keep: Callable[[DataFrame, str], DataFrame] = materialize) -> Star:
    """``after`` with summaries of the touched groups, and topics of those of three or more members."""
    rows = keep(group_inputs(after, touched_groups(before, after)), "group-inputs")
    line = lambda x: F.format_string("%d. %s\n   Summary: %s\n   Interest Score: %.1f", x["place"], x["title"], x["summary"], x["score"])
    articles = F.array_join(F.transform("inputs", line), "\n\n")
    single = rows.where("n = 1").select("group_id", F.lit("").alias("headline"), F.get("inputs", F.lit(0))["summary"].alias("summary"), "n", "best")
    many = rows.where("n > 1").withColumns({"lines": articles, "title": F.lit(""), "content": F.lit("")})
    many = asked(after, many, "group_summary", summaries, config, Topic=F.coalesce("topic", F.lit("")), Articles=F.col("lines"))
    many = keep(many.select("group_id", "user_id", "n", "best", F.trim("response").alias("response")), "group-answers").where("response IS NOT NULL")
    said = read_json(F.col("response"), "headline STRING, summary STRING")
    known = F.coalesce(said["summary"], said["headline"]).isNotNull()
    written = many.select("group_id", F.when(known, F.coalesce(said["headline"], F.lit(""))).otherwise("").alias("headline"), F.when(known, F.coalesce(said["summary"], F.lit(""))).otherwise(F.col("response")).alias("summary"), "n", "best")
    done = written.union(single)
    stored = done.withColumnsRenamed({"n": "article_count", "best": "max_interest_score"}).withColumn("generated_at", F.lit(now).cast("timestamp_ntz"))
    out = changes.summarize_groups(after, stored)
    large = written.where(F.col("n") >= REFINED_FROM).select(F.col("group_id").alias("id"), F.concat(F.lit(_TOPIC), text.truncate_bytes(F.col("summary"), 1000)).alias("prompt"))
    named = keep(topics(large.withColumns({"temperature": F.lit(0.3), "model": F.lit("")})).select("id", "response"), "topics")
    return changes.refine_topics(out, refined_topics(named.where("trim(response) != ''")))
