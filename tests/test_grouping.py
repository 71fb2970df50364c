"""Online grouping against a plain loop, over several micro-batches and a restart."""

from __future__ import annotations

import numpy as np
import pytest

from tidewell.plans.scratch import shared_dir
from tidewell.streaming import grouping

ARRIVALS = "user_id long, article_id long, arrival long, embedding array<float>"
EXISTING = "user_id long, group_id long, n long, embedding array<float>"


def plain(arrivals, existing, least=0.75):
    """One article after another; groups as [id, n, centroid]."""
    users, out = {}, {}
    for u, g, n, v in sorted(existing, key=lambda r: r[1]):
        if v:
            users.setdefault(u, []).append([g, n, np.array(v, np.float32)])
    for u, a, at, v in sorted(arrivals, key=lambda r: (r[2], r[1])):
        groups, best, most = users.setdefault(u, []), None, 0.0
        if not v or not any(v):
            out[u, a] = None
            continue
        v = np.array(v, np.float32)
        for g in groups:
            x, y = g[2].astype(float), v.astype(float)
            if len(x) == len(y):
                cos = float(x @ y / np.sqrt((x * x).sum() * (y * y).sum()))
                if cos > most:
                    best, most = g, cos
        if best is not None and most >= least:
            best[2] = ((best[2] * np.float32(best[1]) + v) / np.float32(best[1] + 1)).astype(np.float32)
            best[1] += 1
            out[u, a] = best[0]
        else:
            groups.append([min([0, *(g[0] for g in groups)]) - 1, 1, v])
            out[u, a] = groups[-1][0]
    return out


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


def run(spark, folder, existing, out, state, least=0.75):
    stream = spark.readStream.schema(ARRIVALS).option("maxFilesPerTrigger", 1).parquet(folder)
    start = spark.createDataFrame(existing, EXISTING) if existing is not None else None
    query = grouping.grouped(stream, start, least).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return {(r.user_id, r.article_id): r.group_id for r in spark.read.parquet(out).collect()}


def test_equals_a_loop_over_batches_and_a_restart(spark, rocks, tmp_path):
    r = np.random.default_rng(2)
    centers = r.normal(size=(5, 8))
    arrivals = []
    for k in range(120):
        v = (centers[r.integers(5)] + r.normal(scale=0.45, size=8)).astype(np.float32).tolist()
        arrivals.append((int(r.integers(3)) + 1 if k % 17 else None, k, k, v))
    arrivals[7] = (*arrivals[7][:3], None)
    arrivals[8] = (*arrivals[8][:3], [])
    arrivals[9] = (*arrivals[9][:3], [0.0] * 8)
    arrivals[50] = (*arrivals[50][:3], [1.0, 2.0])
    existing = [(1, 11, 2, centers[0].tolist()), (1, 12, 1, centers[1].tolist()), (2, 13, 0, centers[2].tolist()), (2, 14, 3, None), (9, 15, 1, centers[0].tolist())]
    folder, out, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))
    for k in range(0, 80, 20):
        spark.createDataFrame(arrivals[k : k + 20], ARRIVALS).coalesce(1).write.mode("append").parquet(folder)
    run(spark, folder, existing, out, state)
    for k in range(80, 120, 20):
        spark.createDataFrame(arrivals[k : k + 20], ARRIVALS).repartition(2).coalesce(1).write.mode("append").parquet(folder)
    got = run(spark, folder, existing, out, state)
    exist32 = [(u, g, n, np.array(v, np.float32).tolist() if v else None) for u, g, n, v in existing]
    want = plain(arrivals, exist32)
    assert got == want
    assert {11, 12, 13} & set(got.values()) and min(x for x in got.values() if x is not None) < 0


def test_means_move_as_published():
    f = lambda *x: np.array(x, np.float32)
    assert np.allclose(grouping.incremental_mean(f(1, 0, 0), f(0, 1, 0), 1), [0.5, 0.5, 0])
    assert np.allclose(grouping.incremental_mean(f(1, 0, 0), f(0, 1, 0), 2), [2 / 3, 1 / 3, 0], atol=1e-6)


def test_thresholds_and_best_match():
    f = lambda *x: np.array(x, np.float32)
    g = grouping.Groups(0.75)
    assert g.assign(f(1, 0)) == (-1, True, 0.0)
    assert g.assign(f(1, 0.1))[:2] == (-1, False)
    assert g.assign(f(0, 1))[:2] == (-2, True)
    assert g.assign(f(0.2, 1))[:2] == (-2, False)
    assert g.assign(f(-1, -1))[:2] == (-3, True) and g.assign(f(1, 1, 1))[:2] == (-4, True)
    assert g.assign(f()) == (None, False, 0.0)
