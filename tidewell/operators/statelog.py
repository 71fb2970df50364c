"""Reading state as a log in buckets: requests are appended, state is folded, buckets are compacted.

A request (a mark, a star, a score, a failed scoring, a reset) becomes one row of the log,
so a batch of requests writes its own size, whatever the size of the state.  Rows lie in
buckets by (user, article).  The state of a key is a fold over its rows, in the order of
batches and, inside a batch, of ``seq``: the last mark, the last star, the last score and
the number of failures since the last reset, each for itself.  Compaction writes those
buckets anew in which enough rows have gathered, as the few rows that fold to the same
state; other buckets are not read.

The list of batches and of each bucket's base is a small table, written as a new version
(JSON, a folder per version) after the data are complete; what a job that died has left is
in no version.  One writer at a time.

Defined cases: requests of one batch without ``seq``, or with equal ones, are tied, and the
greatest values win; every failure counts, repeated rows too; a reset of a key without rows
leaves no row; null user or article ids are ignored; an empty batch writes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewell.plans.scratch import delete
from tidewell.sources.star import conform

KEYS = ["user_id", "article_id"]
BUCKETS = 16
_ROW = (
    "user_id long, article_id long, epoch long, seq long, kind string, read boolean, read_date timestamp_ntz, starred boolean, "
    "interest_score double, security_score double, security_reason string, n long"
)
_COLUMNS = [c.split()[0] for c in _ROW.split(", ")]
_MANIFEST = "version long, kind string, path string, nr long, n_rows long"
_SCORE = ["interest_score", "security_score", "security_reason"]


def _order() -> Column:
    return F.struct("epoch", "seq")


def folded(rows: DataFrame) -> DataFrame:
    """Per key: last mark, star and score, last reset, and failures after it, as structs with their order."""

    def last(kind: str, *columns: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.struct(_order().alias("o"), *columns))).alias(kind)

    lasts = rows.groupBy(*KEYS).agg(
        last("user", "read", "read_date"), last("star", "starred"), last("score", *_SCORE), last("reset"),
        F.count_if(F.col("kind") != "reset").alias("n_rows"),
    )
    resets = lasts.where("reset IS NOT NULL").select(*KEYS, F.col("reset.o").alias("at"))
    failed = rows.where("kind = 'retry'").join(resets, KEYS, "left").where("at IS NULL OR struct(epoch, seq) > at")
    failed = failed.groupBy(*KEYS).agg(F.struct(F.max(_order()).alias("o"), F.sum("n").alias("n")).alias("retry"))
    score = F.when(F.col("reset").isNull() | (F.col("score.o") > F.col("reset.o")), F.col("score"))
    return lasts.where("n_rows > 0").withColumn("score", score).join(failed, KEYS, "left").select(*KEYS, "user", "star", "score", "retry")


def state_of(rows: DataFrame) -> DataFrame:
    """The table ``read_state`` that the rows fold to."""
    no = F.lit(False)
    values = {
        "read": F.coalesce("user.read", no), "read_date": F.col("user.read_date"), "starred": F.coalesce("star.starred", no), "ai_scored": F.col("score").isNotNull(),
        "ai_retries": F.coalesce("retry.n", F.lit(0)), **{c: F.col(f"score.{c}") for c in _SCORE},
    }
    return conform(folded(rows).select(*KEYS, *[v.alias(c) for c, v in values.items()]), "read_state")


def compacted(rows: DataFrame) -> DataFrame:
    """The fewest rows that fold to the same state, also with all that follows them."""

    def row(kind: str, *columns: str) -> Column:
        own = [(F.col(f"{kind}.{c}") if c in columns else F.lit(None)).cast(t).alias(c) for c, t in (x.split() for x in _ROW.split(", ")[5:])]
        return F.when(F.col(kind).isNotNull(), F.struct(F.col(f"{kind}.o.epoch").alias("epoch"), F.col(f"{kind}.o.seq").alias("seq"), F.lit(kind).alias("kind"), *own))

    # A key stays known when nothing but a reset is left of it.
    none = F.expr("user IS NULL AND star IS NULL AND score IS NULL AND retry IS NULL")
    before_all = F.struct(F.lit(-1).cast("long").alias("epoch"), F.lit(0).cast("long").alias("seq"))
    each = folded(rows).withColumn("touch", F.when(none, F.struct(before_all.alias("o"))))
    kinds = {"user": ("read", "read_date"), "star": ("starred",), "score": tuple(_SCORE), "retry": ("n",), "touch": ()}
    every = F.array_compact(F.array(*[row(k, *c) for k, c in kinds.items()]))
    return each.select(*KEYS, F.inline(every)).select(_COLUMNS)


class StateLog:
    """The state below a shared folder."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.version, self.epoch = 0, 0
        #: Batches of the log, (epoch: path and rows), and the base of each compacted bucket: (path, last epoch in it).
        self.batches: dict[int, tuple[str, int]] = {}
        self.bases: dict[int, tuple[str, int]] = {}
        #: Rows written by appends and by compactions since this object was made.
        self.appended = self.rewritten = 0

    @classmethod
    def open(cls, spark: SparkSession, root: str, buckets: int = BUCKETS) -> StateLog:
        """The last version of a log that was written before."""
        log = cls(spark, root, buckets)
        versions = spark.read.schema(_MANIFEST).option("recursiveFileLookup", "true").json(f"{log.root}/manifest")
        rows = versions.where(F.col("version") == versions.agg(F.max("version")).first()[0]).collect()  # batches and buckets
        for r in rows:
            if r.kind == "batch":
                log.batches[r.nr] = (r.path, r.n_rows)
            elif r.kind == "base":
                log.bases[r.nr] = (r.path, r.n_rows)
            else:
                log.version, log.epoch = r.version, r.nr
        return log

    def _commit(self) -> None:
        self.version += 1
        rows = [(self.version, "epoch", None, self.epoch, 0)]
        rows += [(self.version, "batch", path, nr, n) for nr, (path, n) in self.batches.items()]
        rows += [(self.version, "base", path, bucket, upto) for bucket, (path, upto) in self.bases.items()]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.json(f"{self.root}/manifest/{self.version}")

    def _write(self, rows: DataFrame, name: str) -> tuple[str, int]:
        """Rows by bucket in a folder of their own, and how many."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64(*KEYS), F.lit(self.buckets)).cast("int")
        rows.select(*_COLUMNS, bucket.alias("bucket")).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)
        return path, self._read(path).count()

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema(f"{_ROW}, bucket int").parquet(path)

    def rows(self, buckets: list[int] | None = None) -> DataFrame:
        """Live rows, of some buckets or all: the bases, and what came after them.

        Buckets are folders, so conditions on them leave files out.
        """
        wanted = range(self.buckets) if buckets is None else buckets
        out = self.spark.createDataFrame([], f"{_ROW}, bucket int")
        by_path: dict[str, list[int]] = {}
        for b in wanted:
            if b in self.bases:
                by_path.setdefault(self.bases[b][0], []).append(b)
        for path, own in by_path.items():
            out = out.unionByName(self._read(path).where(F.col("bucket").isin(own)))
        for epoch, (path, _) in self.batches.items():
            own = [b for b in wanted if b not in self.bases or self.bases[b][1] < epoch]
            if own:
                out = out.unionByName(self._read(path).where(F.col("bucket").isin(own)))
        return out

    def state(self) -> DataFrame:
        return state_of(self.rows())

    def append(self, kind: str, requests: DataFrame, **values: Column) -> None:
        """One batch of requests (user_id, article_id, the values, and seq if their order matters)."""
        epoch = self.epoch + 1
        given = {"epoch": F.lit(epoch), "kind": F.lit(kind), "n": F.lit(1), **values}
        if "seq" not in requests.columns:
            given["seq"] = F.lit(0)
        types = dict(x.split() for x in _ROW.split(", "))
        columns = [(given[c] if c in given else F.col(c) if c in requests.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()]
        path, n = self._write(requests.where("user_id IS NOT NULL AND article_id IS NOT NULL").select(columns), f"batch-{epoch}")
        if not n:
            delete(self.spark, path)
            return
        self.epoch, self.appended = epoch, self.appended + n
        self.batches[epoch] = (path, n)
        self._commit()

    # What a reader or the scoring does; columns beside the key are named in each.

    def mark(self, requests: DataFrame, now: str) -> None:
        """(read)"""
        self.append("user", requests, read_date=F.when(F.col("read"), F.lit(now).cast("timestamp_ntz")))

    def star(self, requests: DataFrame) -> None:
        """(starred)"""
        self.append("star", requests)

    def score(self, requests: DataFrame) -> None:
        """(interest_score, security_score, security_reason)"""
        self.append("score", requests)

    def retry(self, requests: DataFrame) -> None:
        """One failure per row."""
        self.append("retry", requests)

    def reset(self, user: int, insecure_below: float | None = None) -> None:
        """A user's articles go back to the queue: all, or those whose security is below a limit."""
        hit = F.col("user_id") == user
        if insecure_below is not None:
            hit = hit & (F.col("security_score") < insecure_below)
        self.append("reset", self.state().where(hit).select(*KEYS))

    def compact(self, least: int = 1) -> list[int]:
        """Write buckets anew in which at least ``least`` rows came after their base; returns them."""
        after = self.spark.createDataFrame([], "bucket int, n long")
        for epoch, (path, _) in self.batches.items():
            own = [b for b in range(self.buckets) if b not in self.bases or self.bases[b][1] < epoch]
            after = after.union(self._read(path).where(F.col("bucket").isin(own)).groupBy("bucket").agg(F.count(F.lit(1))))
        counts = after.groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        touched = sorted(r.bucket for r in counts.select("bucket").collect())  # at most as many as buckets
        if not touched:
            return []
        path, n = self._write(compacted(self.rows(touched)), f"base-{self.epoch}")
        self.rewritten += n
        old = {p for p, _ in self.bases.values()}
        self.bases |= {b: (path, self.epoch) for b in touched}
        done = {e: p for e, (p, _) in self.batches.items() if not self._open(e, p)}
        self.batches = {e: v for e, v in self.batches.items() if e not in done}
        self._commit()
        for p in [*done.values(), *(old - {p for p, _ in self.bases.values()})]:
            delete(self.spark, p)
        return touched

    def _open(self, epoch: int, path: str) -> bool:
        """Whether some bucket still needs a batch."""
        own = [b for b in range(self.buckets) if b not in self.bases or self.bases[b][1] < epoch]
        return bool(own) and not self._read(path).where(F.col("bucket").isin(own)).isEmpty()
