"""The poll cycle as a stream: articles wait for a model, failures come back later, answers are written once.

Two streams meet per user in a stateful queue: articles that arrive, and the outcomes of
earlier calls (the answers folder read as a stream).  The queue lives in the state store: a
count of attempts per article, and a timer for the next one, each after twice the time.
Its output, the attempts that are due, goes to the sink, which calls the model and writes
the answers of a micro-batch under the batch's number.  A restart repeats a batch with
the same rows and number; if its answers are there, no model is called.

So a model is called once per attempt, unless a job dies inside the call itself; then that
batch's call is repeated, and the attempts carry their number, by which a service can tell.
A run is one micro-batch over what is there (a stream with timers never runs dry, so it is
not drained); outcomes are read by the next run.

Defined cases: an article that arrives again, waiting or done, is not asked about again; an
outcome of an unknown article, and one that comes twice, changes nothing; after ``most``
failures an article is given up; null ids are ignored; a run without new rows calls nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Where an article stands: waiting for an outcome, waiting for a timer, answered, given up.
ASKED, RESTING, DONE, GIVEN_UP = 0, 1, 2, 3
ATTEMPTS = "user_id long, article_id long, attempt int"
ANSWERS = f"{ATTEMPTS}, response string"
#: Rows with a ``prompt`` to the same rows with a ``response``; null means that the call failed.
Model = Callable[[DataFrame], DataFrame]


class Queue(StatefulProcessor):
    """One user's articles: arrivals and outcomes in, attempts out."""

    def __init__(self, most: int, rest_ms: int) -> None:
        self.most, self.rest_ms = most, rest_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.articles = handle.getMapState("articles", "article_id long", "attempt int, stands int, due long")

    def _attempts(self, key: tuple, due: list[tuple[int, int]]) -> pd.DataFrame:
        for article, attempt in due:
            self.articles.updateValue((article,), (attempt, ASKED, 0))
        return pd.DataFrame({"user_id": key[0], "article_id": [a for a, _ in due], "attempt": [n for _, n in due]}, columns=["user_id", "article_id", "attempt"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, fresh = timerValues.getCurrentProcessingTimeInMs(), []
        batch = pd.concat(list(rows)).sort_values(["article_id", "attempt"], kind="stable")
        for row in batch.itertuples():
            article = int(row.article_id)
            known = self.articles.getValue((article,)) if self.articles.containsKey((article,)) else None
            if row.attempt == 0:  # an arrival
                if known is None and article not in fresh:
                    fresh.append(article)
            elif known is not None and known[1] == ASKED and known[0] == row.attempt:
                if not row.failed:
                    self.articles.updateValue((article,), (known[0], DONE, 0))
                elif known[0] >= self.most:
                    self.articles.updateValue((article,), (known[0], GIVEN_UP, 0))
                else:
                    due = now + self.rest_ms * 2 ** (known[0] - 1)
                    self.articles.updateValue((article,), (known[0], RESTING, due))
                    self.handle.registerTimer(due)
        if fresh:
            yield self._attempts(key, [(a, 1) for a in fresh])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted((k[0], v[0] + 1) for k, v in self.articles.iterator() if v[1] == RESTING and v[2] <= now)
        if due:
            yield self._attempts(key, due)

    def close(self) -> None:
        pass


def attempts(arrivals: DataFrame, outcomes: DataFrame, most: int = 3, rest_ms: int = 60_000) -> DataFrame:
    """Attempts (user_id, article_id, attempt) that are due, of two streams.

    ``arrivals``: user_id, article_id.  ``outcomes``: what the sink wrote.
    """
    ids = [F.col(c).cast("long").alias(c) for c in ("user_id", "article_id")]
    came = arrivals.select(*ids, F.lit(0).alias("attempt"), F.lit(False).alias("failed"))
    ended = outcomes.select(*ids, F.col("attempt").cast("int").alias("attempt"), F.col("response").isNull().alias("failed"))
    rows = came.unionByName(ended).where("user_id IS NOT NULL AND article_id IS NOT NULL")
    return rows.groupBy("user_id").transformWithStateInPandas(statefulProcessor=Queue(most, rest_ms), outputStructType=ATTEMPTS, outputMode="Update", timeMode="ProcessingTime")


def answers(spark: SparkSession, root: str) -> DataFrame:
    """All answers so far: user_id, article_id, attempt, response."""
    return spark.read.schema(ANSWERS).option("recursiveFileLookup", "true").parquet(f"{root}/answers")


def latest(spark: SparkSession, root: str) -> DataFrame:
    """The last answer of each article, and after how many attempts."""
    last = F.max(F.struct("attempt", "response")).alias("last")
    return answers(spark, root).groupBy("user_id", "article_id").agg(last).select("user_id", "article_id", "last.attempt", "last.response")


def _written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(done)


def poll(arrivals: DataFrame, prompts: DataFrame, model: Model, root: str, most: int = 3, rest_ms: int = 60_000) -> None:
    """One run over all that arrived since the last one, and all retries that are due.

    ``arrivals`` is a stream of (user_id, article_id); ``prompts`` a table (user_id,
    article_id, prompt) or (article_id, prompt); ``root`` a shared folder with the answers
    and the checkpoint.  The state store must be RocksDB.
    """
    spark = arrivals.sparkSession
    if not _written(spark, f"{root}/answers/none"):
        spark.createDataFrame([], ANSWERS).write.mode("overwrite").parquet(f"{root}/answers/none")  # a folder that can be streamed
    outcomes = spark.readStream.schema(ANSWERS).option("recursiveFileLookup", "true").parquet(f"{root}/answers")
    keys = [c for c in ("user_id", "article_id") if c in prompts.columns]

    def ask(batch: DataFrame, number: int) -> None:
        path = f"{root}/answers/batch-{number}"
        if _written(spark, path):  # a repeated batch: its state is made again, its answers are there
            batch.write.format("noop").mode("overwrite").save()
            return
        asked = model(batch.join(prompts, keys))
        names = [c.split()[0] for c in ANSWERS.split(", ")]
        asked.select(names).write.mode("overwrite").parquet(path)

    due = attempts(arrivals, outcomes, most, rest_ms)
    query = due.writeStream.foreachBatch(ask).outputMode("update").option("checkpointLocation", f"{root}/checkpoint").trigger(once=True).start()
    query.awaitTermination()
