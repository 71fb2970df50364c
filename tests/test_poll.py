"""The poll cycle: retries with a limit, and a stop in the middle that calls no model twice."""

from __future__ import annotations

import time
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.test_grouping import rocks  # noqa: F401
from tidewell.streaming import poll

ARRIVALS = "user_id long, article_id long"


def counting(calls, fails):
    """A model that leaves a file per call and fails where ``fails`` says (article: attempts that fail)."""

    @F.udf("string")
    def answer(user, article, attempt):
        (calls / f"{user}-{article}-{attempt}-{uuid.uuid4().hex}").touch()
        return None if attempt in fails.get(article, ()) else f"a{article}"

    return lambda rows: rows.withColumn("response", answer.asNondeterministic()("user_id", "article_id", "attempt"))


def called(calls):
    return Counter(tuple(map(int, p.name.split("-")[:3])) for p in calls.iterdir())


@pytest.fixture
def world(spark, tmp_path, rocks):  # noqa: F811
    (tmp_path / "in").mkdir()
    (tmp_path / "calls").mkdir()

    class World:
        root, calls = f"{tmp_path}/poll", tmp_path / "calls"
        prompts = spark.createDataFrame([(a, f"p{a}") for a in range(10)], "article_id long, prompt string")

        def arrive(self, *rows):
            spark.createDataFrame(list(rows), ARRIVALS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

        def run(self, model):
            stream = spark.readStream.schema(ARRIVALS).parquet(f"{tmp_path}/in")
            poll.poll(stream, self.prompts, model, self.root, rest_ms=1)

        def latest(self):
            return {(r.user_id, r.article_id): (r.attempt, r.response) for r in poll.latest(spark, self.root).collect()}

    return World()


def test_failures_come_back_until_they_are_given_up(world):
    model = counting(world.calls, {2: {1}, 3: {1, 2, 3, 4}})
    world.arrive((1, 1), (1, 2), (2, 3), (2, 1), (1, 1), (None, 4), (1, None))
    for k in range(8):
        if k == 1:
            world.arrive((1, 1), (2, 5))  # one again, one new
        world.run(model)
        time.sleep(0.02)
    assert called(world.calls) == {(1, 1, 1): 1, (1, 2, 1): 1, (1, 2, 2): 1, (2, 3, 1): 1, (2, 3, 2): 1, (2, 3, 3): 1, (2, 1, 1): 1, (2, 5, 1): 1}
    assert world.latest() == {(1, 1): (1, "a1"), (1, 2): (2, "a2"), (2, 3): (3, None), (2, 1): (1, "a1"), (2, 5): (1, "a5")}


def test_a_stop_in_the_middle_calls_no_model_twice(spark, world, monkeypatch):
    """The run dies after the answers are written and before the batch is committed."""
    model = counting(world.calls, {2: {1}})
    world.arrive((1, 1), (1, 2))
    world.run(model)
    world.arrive((1, 3), (2, 4))
    seen, real = [], poll._written

    def dies(session, path):
        done = real(session, path)
        if path.endswith("batch-1") and not done and not seen:
            seen.append(path)
            model(session.createDataFrame([(1, 3, 1), (2, 4, 1)], poll.ATTEMPTS)).select("user_id", "article_id", "attempt", "response").write.parquet(path)
            raise RuntimeError("the driver is lost")
        return done

    monkeypatch.setattr(poll, "_written", dies)
    with pytest.raises(Exception):  # noqa: B017
        world.run(model)
    assert seen
    before = called(world.calls)
    assert before[1, 3, 1] == before[2, 4, 1] == 1
    for _ in range(4):
        world.run(model)
        time.sleep(0.02)
    assert called(world.calls) == {(1, 1, 1): 1, (1, 2, 1): 1, (1, 2, 2): 1, (1, 3, 1): 1, (2, 4, 1): 1}
    assert world.latest() == {(1, 1): (1, "a1"), (1, 2): (2, "a2"), (1, 3): (1, "a3"), (2, 4): (1, "a4")}
