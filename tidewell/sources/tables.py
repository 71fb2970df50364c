"""The content star schema as lazy DataFrames over a folder of Parquet tables.

Feeds and articles come from ``documents``, users, subscriptions and reading state
from ``events``, scores from ``labels``, groups from ``embeddings``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

#: The clock of the catalogue's queries; operators take it as a parameter.
NOW = "2024-02-01 00:00:00"
#: (rule_id, user_id, feed_id or null for every feed, axis, value, score)
RULES = [
    (1, 1, None, "category", "EN", 2),
    (2, 1, 3, "category", "fr", 5),
    (3, 1, None, "author", "author 4", -3),
    (4, 1, None, "tag", "de", -1),
    (5, 2, None, "category", "es", 4),
    (6, 2, 8, "author", "AUTHOR 11", 6),
]


@dataclass(frozen=True)
class Tables:
    spark: SparkSession
    path: str

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def feeds(self) -> DataFrame:
        return self.read("documents").select(F.expr("CAST(substr(source, 4) AS BIGINT)").alias("feed_id"), F.col("source").alias("title")).distinct()

    @cached_property
    def articles(self) -> DataFrame:
        return self.read("documents").select(
            F.col("doc_id").alias("article_id"),
            F.expr("CAST(substr(source, 4) AS BIGINT)").alias("feed_id"),
            F.substring("text", 1, 60).alias("title"),
            F.col("text").alias("content"),
            "lang",
            F.expr("timestampadd(MINUTE, (doc_id * 7919) % 43200, TIMESTAMP_NTZ'2024-01-01 00:00:00')").alias("published"),
        )

    @cached_property
    def categories(self) -> DataFrame:
        return self.articles.select("article_id", F.col("lang").alias("category"))

    @cached_property
    def authors(self) -> DataFrame:
        return self.articles.select("article_id", F.expr("concat('Author ', article_id % 13)").alias("name"))

    @cached_property
    def users(self) -> DataFrame:
        return self.read("events").select("user_id").distinct()

    @cached_property
    def subscriptions(self) -> DataFrame:
        # (user_id * 7 + feed_id) % 3 = 0, as an equi-join
        users = self.users.withColumn("r", F.expr("pmod(user_id, 3)"))
        return users.join(self.feeds.select("feed_id", F.expr("pmod(-feed_id, 3)").alias("r")), "r").drop("r")

    @cached_property
    def state(self) -> DataFrame:
        """Reading state per (user, article), folded from the event log."""
        folded = self.read("events").groupBy("user_id", F.expr("event_id % 200").alias("article_id")).agg(
            F.bool_or(F.col("event_type").isin("view", "click")).alias("read"),
            F.bool_or(F.col("event_type") == "purchase").alias("starred"),
            F.least(F.lit(10.0), F.max("value") / 10).alias("interest"),
            F.count_if(F.col("event_type") == "error").alias("retries"),
        )
        security = self.read("labels").select(
            F.col("doc_id").alias("article_id"), F.expr("CASE WHEN toxic = 1 THEN 2.0D WHEN quality = 1 THEN 9.0D ELSE 5.0D END").alias("security")
        )
        return folded.join(security, "article_id", "left").withColumn("security", F.coalesce("security", F.lit(5.0)))

    @cached_property
    def rules(self) -> DataFrame:
        return self.spark.createDataFrame(RULES, "rule_id long, user_id long, feed_id long, axis string, value string, score int")

    @cached_property
    def vectors(self) -> DataFrame:
        return self.read("embeddings").select(F.col("vec_id").alias("article_id"), "embedding")

    @cached_property
    def members(self) -> DataFrame:
        return self.read("embeddings").select(F.col("label").cast("long").alias("group_id"), F.col("vec_id").alias("article_id"))

    @cached_property
    def groups(self) -> DataFrame:
        """A group belongs to the user of its own number."""
        return self.members.select("group_id").distinct().select(
            "group_id", F.col("group_id").alias("user_id"), F.expr("concat('Topic ', group_id)").alias("topic"), F.expr("group_id % 5 = 4").alias("muted")
        )
