"""Per-user state as an append-only log and its fold; ingest de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def fold(log: DataFrame) -> DataFrame:
    """Current state per (user, article) of a log of (seq, kind, read, starred, interest).

    ``user`` events set read, ``star`` starred, ``ai`` interest, ``retry`` counts up;
    ``reset`` voids the scores and retries before it.
    """
    keys = ["user_id", "article_id"]
    reset = log.where("kind = 'reset'").groupBy(*keys).agg(F.max("seq").alias("reset_seq"))
    rows = log.join(reset, keys, "left").withColumn("live", F.col("seq") > F.coalesce("reset_seq", F.lit(-1)))

    def latest(column: str, kind: str, live: bool = False):
        use = (F.col("kind") == kind) & (F.col("live") if live else F.lit(True))
        return F.max(F.when(use, F.struct("seq", column)))[column].alias(column)

    return rows.groupBy(*keys).agg(
        latest("read", "user"), latest("starred", "star"), latest("interest", "ai", live=True),
        F.count_if((F.col("kind") == "retry") & F.col("live")).alias("retries"),
    )


def mark_read(articles: DataFrame, user: int, before: str | None, seq: int) -> DataFrame:
    """Log rows that mark articles read up to a date; articles without a date are included."""
    rows = articles
    if before is not None:
        rows = rows.where(F.col("published").isNull() | (F.col("published") <= F.lit(before).cast("timestamp_ntz")))
    return rows.select(
        F.lit(user).cast("long").alias("user_id"), "article_id", F.lit(seq).cast("long").alias("seq"), F.lit("user").alias("kind"),
        F.lit(True).alias("read"), F.lit(None).cast("boolean").alias("starred"), F.lit(None).cast("double").alias("interest"),
    )


def first_of(df: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """The first row of each key by arrival; rows with a null or empty key part all stay."""
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull() & (F.col(k).cast("string") != "")
    w = Window.partitionBy(*keys).orderBy(arrival)
    ranked = df.where(whole).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    return ranked.union(df.where(~F.coalesce(whole, F.lit(False))))


def orphans(known: DataFrame, *tables: DataFrame) -> DataFrame:
    """User ids that some table uses and the user table lacks."""
    used = tables[0].select("user_id")
    for t in tables[1:]:
        used = used.union(t.select("user_id"))
    return used.distinct().join(known.select("user_id"), "user_id", "left_anti")
