"""The state log against a plain loop over requests."""

from __future__ import annotations

import random
from datetime import datetime

from pyspark.sql import functions as F

from tidewell.operators.statelog import StateLog

NOW = datetime(2024, 3, 1)
KEY = "user_id long, article_id long"
SCHEMAS = {
    "mark": f"{KEY}, seq long, read boolean", "star": f"{KEY}, seq long, starred boolean", "retry": f"{KEY}, seq long",
    "score": f"{KEY}, seq long, interest_score double, security_score double, security_reason string",
}


def empty_row():
    return {"read": False, "read_date": None, "starred": False, "ai_scored": False, "ai_retries": 0, "interest_score": None, "security_score": None, "security_reason": None}


def play(state, kind, rows):
    """Apply a batch in order of seq."""
    for r in sorted((r for r in rows if None not in r[:2]), key=lambda r: r[2]):
        x = state.setdefault(r[:2], empty_row())
        if kind == "mark":
            x.update(read=r[3], read_date=NOW if r[3] else None)
        elif kind == "star":
            x.update(starred=r[3])
        elif kind == "retry":
            x["ai_retries"] += 1
        else:
            x.update(ai_scored=True, interest_score=r[3], security_score=r[4], security_reason=r[5])


def play_reset(state, user, below):
    for k, x in state.items():
        if k[0] == user and (below is None or x["security_score"] is not None and x["security_score"] < below):
            x.update(ai_scored=False, ai_retries=0, interest_score=None, security_score=None, security_reason=None)


def same(log, state):
    got = {(r.user_id, r.article_id): {k: v for k, v in r.asDict().items() if k not in ("user_id", "article_id")} for r in log.state().collect()}
    assert got == state


def send(spark, log, state, kind, rows):
    df = spark.createDataFrame(rows, SCHEMAS[kind])
    log.mark(df, str(NOW)) if kind == "mark" else getattr(log, kind)(df)
    play(state, kind, rows)


def batch(r, kind, n, users=4, articles=6):
    extra = {"mark": lambda: (r.random() < 0.5,), "star": lambda: (r.random() < 0.5,), "retry": tuple, "score": lambda: (float(r.randint(0, 9)), float(r.randint(0, 9)), r.choice([None, "x"]))}
    return [(r.randint(1, users), r.randint(1, articles), k, *extra[kind]()) for k in r.sample(range(1000), n)]


def test_any_order_of_requests_and_compactions(spark, tmp_path):
    r, log, state = random.Random(3), StateLog(spark, f"file://{tmp_path}/s", buckets=3), {}
    for k, step in enumerate("mark score retry compact star retry reset mark compact retry score reset compact star mark".split()):
        if step == "compact":
            log.compact(least=2)
        elif step == "reset":
            below = None if k % 2 else 5.0
            log.reset(2, below)
            play_reset(state, 2, below)
        else:
            send(spark, log, state, step, batch(r, step, 12))
        if k % 3 == 2:
            same(log, state)
    same(log, state)
    again = StateLog.open(spark, log.root, buckets=3)
    assert (again.version, again.epoch, again.batches, again.bases) == (log.version, log.epoch, log.batches, log.bases)
    send(spark, again, state, "mark", batch(r, "mark", 9))
    assert again.compact() and not again.batches
    same(again, state)


def test_the_last_of_contradicting_requests_wins(spark, tmp_path):
    log, state = StateLog(spark, f"file://{tmp_path}/s"), {}
    send(spark, log, state, "mark", [(1, 1, 2, False), (1, 1, 1, True), (1, 2, 5, True), (1, 2, 4, False)])
    send(spark, log, state, "score", [(1, 1, 1, 3.0, 4.0, None), (1, 1, 9, 5.0, 6.0, "r")])
    send(spark, log, state, "retry", [(1, 1, 0), (1, 1, 0), (1, 1, 0), (2, None, 0), (None, 2, 0)])
    send(spark, log, state, "mark", [(1, 1, 0, True)])  # a later batch counts more than a greater seq
    same(log, state)
    assert state[1, 1]["ai_retries"] == 3 and state[1, 1]["read"] and state[1, 2]["read"]
    for _ in range(2):  # without an order the greatest values win, always
        log.star(spark.createDataFrame([(7, 7, False), (7, 7, True), (7, 7, False)], f"{KEY}, starred boolean"))
        assert log.state().where("user_id = 7").first().starred


def test_resets_keep_known_keys_and_make_none(spark, tmp_path):
    log, state = StateLog(spark, f"file://{tmp_path}/s"), {}
    send(spark, log, state, "score", [(1, 1, 0, 1.0, 1.0, None)])
    log.append("reset", spark.createDataFrame([(1, 1), (1, 9)], KEY))
    play_reset(state, 1, None)
    same(log, state)
    log.compact()
    same(log, state)
    send(spark, log, state, "retry", [(1, 1, 0)])
    same(log, state)
    log.compact()
    same(log, state)


def test_requests_write_their_own_size(spark, tmp_path):
    log = StateLog(spark, f"file://{tmp_path}/s", buckets=8)
    log.mark(spark.range(20_000).select((F.col("id") % 50).alias("user_id"), F.col("id").alias("article_id"), F.lit(True).alias("read")), str(NOW))
    assert log.compact() == list(range(8)) and log.rewritten == 20_000
    log.appended = log.rewritten = 0
    log.star(spark.createDataFrame([(1, 1, True), (1, 51, True)], f"{KEY}, starred boolean"))
    touched = log.compact()
    assert log.appended == 2 and 1 <= len(touched) <= 2
    assert log.rewritten < 20_000 * 2.5 / 8 + 2 and log.state().count() == 20_000
    assert log.compact() == []
    assert log.state().where("starred").count() == 2 and log.state().where("read").count() == 20_000


def test_empty_batches_write_nothing(spark, tmp_path):
    log = StateLog(spark, f"file://{tmp_path}/s")
    log.retry(spark.createDataFrame([], KEY))
    log.reset(1)
    assert log.version == 0 and log.compact() == [] and log.state().count() == 0
