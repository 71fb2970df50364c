"""Online grouping: articles join the group whose centroid they resemble, as they arrive.

State is kept per user by ``transformWithStateInPandas``: a map from group to its size and
centroid.  In arrival order, an article goes to the group of the greatest cosine (the
earliest on ties) if that reaches ``least``, and moves its centroid by an incremental
mean; else it opens a group.  Groups that exist before the stream starts are initial state.

The order makes a user's articles of one micro-batch a sequence, so they are sorted in one
task; micro-batches bound how many those are, and users are spread over tasks.  State holds
one row per group, never the articles.

Defined cases: a null or empty vector, or one without a direction, joins and opens nothing
(its group is null); a cosine of vectors of different lengths is 0, and a cosine of 0 or
less joins nothing; arrivals with equal order are taken by article id; null users are a
user of their own.  Existing groups keep their ids, new ones count down from -1 per user.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "user_id long, article_id long, arrival long, group_id long, opened boolean, cos double"
_KEY, _VALUE = "group_id long", "place long, n long, centroid array<float>"


def incremental_mean(old: np.ndarray, new: np.ndarray, n: int) -> np.ndarray:
    """The mean of n + 1 vectors from that of n and one more, in single precision."""
    n32 = np.float32(n)
    return (old * n32 + new) / (n32 + np.float32(1))


class Groups:
    """A user's groups in order of appearance, and the assignment of one article after another."""

    def __init__(self, least: float) -> None:
        self.least, self.ids, self.sizes, self.centroids = least, [], [], []
        self.touched: set[int] = set()

    def add(self, group: int, n: int, centroid: np.ndarray) -> None:
        self.ids.append(group)
        self.sizes.append(n)
        self.centroids.append(centroid)

    def cosines(self, vector: np.ndarray) -> np.ndarray:
        """Cosine with every centroid in double precision; 0 where lengths differ."""
        out, norm = np.zeros(len(self.ids)), np.sqrt((vector.astype(float) ** 2).sum())
        alike = [k for k, c in enumerate(self.centroids) if len(c) == len(vector)]
        if alike:
            matrix = np.stack([self.centroids[k] for k in alike]).astype(float)
            norms = np.sqrt((matrix**2).sum(axis=1)) * norm
            out[alike] = np.divide(matrix @ vector.astype(float), norms, out=np.zeros(len(alike)), where=norms > 0)
        return out

    def assign(self, vector: np.ndarray) -> tuple[int | None, bool, float]:
        """(group, whether it was opened, greatest cosine) of the next article."""
        if not len(vector) or not np.any(vector):
            return None, False, 0.0
        cos = self.cosines(vector)
        best = int(cos.argmax()) if len(cos) else -1
        if best >= 0 and cos[best] > 0 and cos[best] >= self.least:
            n = self.sizes[best]
            self.centroids[best] = incremental_mean(self.centroids[best], vector, n) if n > 0 else vector
            self.sizes[best] += 1
            self.touched.add(best)
            return self.ids[best], False, float(cos[best])
        self.add(min([0, *self.ids]) - 1, 1, vector)
        self.touched.add(len(self.ids) - 1)
        return self.ids[-1], True, max(0.0, float(cos[best])) if best >= 0 else 0.0


def _vector(value: object) -> np.ndarray:
    return np.asarray([] if value is None else value, np.float32)


class OnlineGroups(StatefulProcessor):
    """The processor of one user's arrivals."""

    def __init__(self, least: float) -> None:
        self.least = least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("groups", _KEY, _VALUE)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        place = sum(1 for _ in self.state.keys())
        for g in initialState.sort_values("group_id").itertuples():
            if g.embedding is not None and len(g.embedding):
                self.state.updateValue((int(g.group_id),), (place, int(g.n), [float(x) for x in g.embedding]))
                place += 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        groups = Groups(self.least)
        for _, group, n, centroid in sorted((value[0], k[0], value[1], value[2]) for k, value in self.state.iterator()):
            groups.add(group, n, _vector(centroid))
        arrived = pd.concat(list(rows)).sort_values(["arrival", "article_id"], kind="stable")
        found = [groups.assign(_vector(v)) for v in arrived["embedding"]]
        for k in sorted(groups.touched):
            self.state.updateValue((groups.ids[k],), (k, groups.sizes[k], [float(x) for x in groups.centroids[k]]))
        group, opened, cos = zip(*found, strict=True)
        out = arrived[["user_id", "article_id", "arrival"]].assign(group_id=pd.array(group, "Int64"), opened=opened, cos=cos)
        out["user_id"] = key[0]
        yield out

    def close(self) -> None:
        pass


def grouped(arrivals: DataFrame, existing: DataFrame | None = None, least: float = 0.75) -> DataFrame:
    """Assignments (user_id, article_id, arrival, group_id, opened, cos) of a stream of arrivals.

    ``arrivals``: user_id, article_id, arrival (their order), embedding.  ``existing``:
    user_id, group_id, n (articles in it), embedding.  Keep the state in RocksDB.
    """
    typed = arrivals.select(*[F.col(c).cast("long").alias(c) for c in ("user_id", "article_id", "arrival")], F.col("embedding").cast("array<float>").alias("embedding"))
    start = None
    if existing is not None:
        start = existing.select(*[F.col(c).cast("long").alias(c) for c in ("user_id", "group_id", "n")], F.col("embedding").cast("array<float>").alias("embedding")).groupBy("user_id")
    return typed.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=OnlineGroups(least), outputStructType=OUTPUT, outputMode="Append", timeMode="None", initialState=start
    )
