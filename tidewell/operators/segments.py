"""Upkeep of a full-text index: immutable segments, tombstones, merges by size.

A change writes a segment of its own: postings of the articles that are new or different,
and the ids of all that it touches, which void those articles in every older segment.
Reading unites the segments and drops what is void.  Segments of one size class are merged
as soon as there are ``fan_out`` of them, and smaller ones into a larger one that follows;
a row is so rewritten once per size class, and a change costs its own size times the
logarithm of the index.

The list of segments is a small table, written anew (as JSON, a version per folder) after
the segment is complete: a reader sees the last whole version, and a job that dies leaves
files that no version names.  One writer at a time.

Defined cases: of several changes to one article in a batch the last by ``seq`` counts,
the greatest row on ties; deleting an unknown id does nothing; an empty batch writes
nothing; null ids are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.operators.fulltext import BUCKETS, FIELDS, SIZES, Index, dealt, postings_of
from tidewell.plans.scratch import broadcast_if_small, delete

_MANIFEST = "version long, nr long, path string, n_articles long, n_rows long, n_gone long"


def last_of_each(changes: DataFrame) -> DataFrame:
    """One row per id: the last by ``seq``, if there is such a column, and the greatest on ties."""
    columns = ["id", "deleted", *FIELDS]
    texts = [(F.col(f) if f in changes.columns else F.lit(None)).cast("string").alias(f) for f in FIELDS]
    deleted = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in changes.columns else F.lit(False)
    seq = F.col("seq") if "seq" in changes.columns else F.lit(0)
    rows = changes.where("id IS NOT NULL").select(F.col("id").cast("long").alias("id"), seq.alias("seq"), deleted.alias("deleted"), *texts)
    last = F.max(F.struct("seq", "deleted", *FIELDS)).alias("last")
    return rows.groupBy("id").agg(last).select("id", *[F.col(f"last.{c}").alias(c) for c in columns[1:]])


class SegmentedIndex:
    """An index below a shared folder that takes changes."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, fan_out: int = 4) -> None:
        self.spark, self.root, self.buckets, self.fan_out = spark, root.rstrip("/"), buckets, fan_out
        #: Rows of segments written, and read by merges, since this object was made.
        self.written = self.merged = 0
        self.version, self.segments = 0, []
        self._schema = postings_of(spark.createDataFrame([], "id long")).schema

    @classmethod
    def open(cls, spark: SparkSession, root: str, buckets: int = BUCKETS, fan_out: int = 4) -> SegmentedIndex:
        """The last version of an index that was written before."""
        index = cls(spark, root, buckets, fan_out)
        versions = spark.read.schema(_MANIFEST).option("recursiveFileLookup", "true").json(f"{index.root}/manifest")
        rows = versions.where(F.col("version") == versions.agg(F.max("version")).first()[0]).orderBy("nr").collect()  # a few dozen segments
        index.segments = [r.asDict() for r in rows if r.nr is not None]
        index.version = max((r.version for r in rows), default=0)
        return index

    def _commit(self, segments: list[dict]) -> None:
        """The next version of the list; an empty list is a row of nulls."""
        self.version += 1
        rows = [{**s, "version": self.version} for s in segments] or [{"version": self.version}]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.json(f"{self.root}/manifest/{self.version}")
        self.segments = segments

    def _written(self, nr: int, postings: DataFrame, gone: DataFrame) -> dict:
        """A segment on disk: its postings by bucket, and the ids that it voids in older ones."""
        path = f"{self.root}/segment-{nr}-{uuid.uuid4().hex}"
        dealt(postings).write.partitionBy("bucket").parquet(f"{path}/postings")
        gone.select("article_id").write.parquet(f"{path}/gone")
        rows = self._postings(path)
        n_articles, n_rows = rows.agg(F.count_if(F.col("bucket") == SIZES), F.count(F.lit(1))).first()
        self.written += n_rows
        return {"nr": nr, "path": path, "n_articles": n_articles, "n_rows": n_rows, "n_gone": self._gone(path).count()}

    def _postings(self, path: str) -> DataFrame:
        return self.spark.read.schema(self._schema).parquet(f"{path}/postings")

    def _gone(self, path: str) -> DataFrame:
        return self.spark.read.schema("article_id long").parquet(f"{path}/gone")

    def _live(self, segments: list[dict]) -> DataFrame:
        """Rows of the segments that no later one of them voids."""
        empty = self.spark.createDataFrame([], self._schema)
        united, voided = empty.withColumn("nr", F.lit(0).cast("long")), self.spark.createDataFrame([], "gone_id long, gone_nr long")
        for s in segments:
            united = united.unionByName(self._postings(s["path"]).withColumn("nr", F.lit(s["nr"]).cast("long")))
            if s["n_gone"]:
                voided = voided.union(self._gone(s["path"]).select("article_id", F.lit(s["nr"]).cast("long")))
        last = broadcast_if_small(voided.groupBy("gone_id").agg(F.max("gone_nr").alias("gone_nr")))
        return united.join(last, (F.col("article_id") == F.col("gone_id")) & (F.col("nr") < F.col("gone_nr")), "left_anti").drop("nr")

    def apply(self, changes: DataFrame) -> None:
        """Articles (id, the indexed fields, deleted, seq) that are new, changed or deleted."""
        last = last_of_each(changes)
        nr = max((s["nr"] for s in self.segments), default=0) + 1
        touched = last.select(F.col("id").alias("article_id")) if self.segments else self.spark.createDataFrame([], "article_id long")
        made = self._written(nr, postings_of(last.where("NOT deleted"), self.buckets), touched)
        if not made["n_rows"] and not made["n_gone"]:
            delete(self.spark, made["path"])
            return
        self._commit([*self.segments, made])
        while n := self._due():
            self._replace(n)

    def _class(self, segment: dict) -> int:
        """Size class: powers of ``fan_out`` of rows, tombstones counted."""
        n, k = segment["n_rows"] + segment["n_gone"], 0
        while n >= self.fan_out:
            n, k = n // self.fan_out, k + 1
        return k

    def _due(self) -> int:
        """How many of the newest segments to merge: smaller ones below the newest, or ``fan_out`` of its class.

        Size classes so never rise towards the newest, which bounds the number of segments by
        ``fan_out`` per class; and a row that is merged ends in a higher class.
        """
        *older, newest = map(self._class, self.segments)
        smaller = next((k for k, c in enumerate(reversed(older)) if c >= newest), len(older))
        if smaller:
            return smaller + 1
        equal = 1 + next((k for k, c in enumerate(reversed(older)) if c != newest), len(older))
        return equal if equal >= self.fan_out else 0

    def _replace(self, n: int) -> None:
        """The newest ``n`` segments become one."""
        before, run = self.segments[:-n], self.segments[-n:]
        self.merged += sum(s["n_rows"] for s in run)
        gone = self.spark.createDataFrame([], "article_id long")
        if before:
            for s in run:
                gone = gone.union(self._gone(s["path"]))
        made = self._written(run[-1]["nr"], self._live(run), gone.distinct())
        self._commit([*before, made])

    def compact(self) -> None:
        """All segments become one; what no version needs is deleted."""
        old = list(self.segments)
        if len(old) > 1 or old and old[0]["n_gone"]:
            self._replace(len(old))
        for s in old:
            if s not in self.segments:
                delete(self.spark, s["path"])

    def index(self) -> Index:
        """What can be searched now."""
        return Index(self._live(self.segments), self.buckets)
