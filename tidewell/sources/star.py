"""The content star schema as a set of tables, from Parquet files of that schema.

A ``Star`` maps table names to lazy DataFrames.  It never changes: a state change
(``tidewell.operators.changes``) returns a star with other tables, and ``save`` writes
one to a folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Tables and their columns; fixed values.
SCHEMAS = {
    "feeds": "id BIGINT, url STRING, title STRING, description STRING, site_url STRING, last_fetched TIMESTAMP_NTZ, last_error STRING, etag STRING, last_modified STRING, "
    "enabled BOOLEAN, created_at TIMESTAMP_NTZ, consecutive_errors INT, next_fetch_at TIMESTAMP_NTZ, status STRING",
    "articles": "id BIGINT, feed_id BIGINT, guid STRING, title STRING, url STRING, content STRING, summary STRING, author STRING, published_date TIMESTAMP_NTZ, fetched_date TIMESTAMP_NTZ, "
    "linked_url STRING, linked_content STRING, full_text_fetched BOOLEAN, images_cached BOOLEAN",
    "users": "id BIGINT, name STRING, oidc_sub STRING, email STRING, created_at TIMESTAMP_NTZ",
    "user_feeds": "user_id BIGINT, feed_id BIGINT, subscribed_at TIMESTAMP_NTZ, user_title STRING",
    "read_state": "user_id BIGINT, article_id BIGINT, read BOOLEAN, starred BOOLEAN, interest_score DOUBLE, security_score DOUBLE, read_date TIMESTAMP_NTZ, ai_scored BOOLEAN, ai_retries INT, security_reason STRING",
    "article_authors": "article_id BIGINT, name STRING, email STRING",
    "article_categories": "article_id BIGINT, category STRING",
    "filter_rules": "id BIGINT, user_id BIGINT, feed_id BIGINT, axis STRING, value STRING, score INT, created_at TIMESTAMP_NTZ",
    "article_groups": "id BIGINT, user_id BIGINT, topic STRING, embedding ARRAY<FLOAT>, embedding_model STRING, display_name STRING, muted BOOLEAN, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ",
    "article_group_members": "group_id BIGINT, article_id BIGINT, added_at TIMESTAMP_NTZ",
    "group_summaries": "group_id BIGINT, headline STRING, summary STRING, article_count INT, max_interest_score DOUBLE, generated_at TIMESTAMP_NTZ",
    "article_summaries": "user_id BIGINT, article_id BIGINT, ai_summary STRING, generated_at TIMESTAMP_NTZ",
    "article_embeddings": "article_id BIGINT, embedding ARRAY<FLOAT>, embedding_model STRING, created_at TIMESTAMP_NTZ",
    "newsletters": "id BIGINT, user_id BIGINT, name STRING, schedule STRING, config_json STRING, prompt_template STRING, email_recipient STRING, enabled BOOLEAN, last_generated_at TIMESTAMP_NTZ, "
    "created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ",
    "newsletter_issues": "id BIGINT, newsletter_id BIGINT, headline STRING, content_html STRING, content_text STRING, article_ids_json STRING, generated_at TIMESTAMP_NTZ, sent_at TIMESTAMP_NTZ",
    "user_preferences": "user_id BIGINT, key STRING, value STRING",
    "user_prompts": "user_id BIGINT, prompt_type STRING, prompt_template STRING, temperature DOUBLE, model STRING, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ",
    "fever_credentials": "user_id BIGINT, api_key STRING",
    "article_images": "id BIGINT, article_id BIGINT, original_url STRING, data BINARY, mime_type STRING, width INT, height INT",
    "feed_favicons": "feed_id BIGINT, data BINARY, mime_type STRING",
}
NEWSLETTER_CONFIG = (
    "min_interest_score DOUBLE, min_security_score DOUBLE, include_feeds ARRAY<BIGINT>, exclude_feeds ARRAY<BIGINT>, "
    "include_categories ARRAY<STRING>, exclude_categories ARRAY<STRING>, max_articles INT"
)


class Star(Mapping):
    """Tables by name, given as frames or as functions that read them; others are empty."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame | Callable[[], DataFrame]]) -> None:
        unknown = set(tables) - set(SCHEMAS)
        if unknown:
            raise KeyError(f"no such tables: {sorted(unknown)}")
        self.spark, self._tables = spark, dict(tables)

    @classmethod
    def load(cls, spark: SparkSession, path: str, names: list[str] | None = None) -> Star:
        """The tables ``<path>/<name>.parquet``; ``names`` says which of them exist."""
        return cls(spark, {n: conform(spark.read.parquet(f"{path}/{n}.parquet"), n) for n in names or SCHEMAS})

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.createDataFrame([], SCHEMAS[name])
        if not isinstance(self._tables[name], DataFrame):
            self._tables[name] = self._tables[name]()
        return self._tables[name]

    def __iter__(self) -> Iterator[str]:
        return iter(SCHEMAS)

    def __len__(self) -> int:
        return len(SCHEMAS)

    def replace(self, **tables: DataFrame) -> Star:
        """A star with some tables exchanged."""
        return Star(self.spark, {**self._tables, **{n: conform(t, n) for n, t in tables.items()}})

    def save(self, path: str, mode: str = "error") -> None:
        for name in self._tables:
            self[name].write.mode(mode).parquet(f"{path}/{name}.parquet")


def conform(df: DataFrame, name: str) -> DataFrame:
    """Columns in the table's order and types; missing ones are null, others are dropped."""
    fields = [f.strip().split(" ", 1) for f in SCHEMAS[name].split(",")]
    return df.select(*[(F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in fields])
