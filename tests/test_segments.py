"""A changed index equals a rebuilt one, and changes cost their own size."""

from __future__ import annotations

import random

import pytest

from tests.test_fulltext import QUERIES, articles_of, feeds_of, found, made_articles, queries_of
from tidewell.operators import fulltext
from tidewell.operators.segments import SegmentedIndex

CHANGES = "id long, title string, summary string, content string, linked_content string, deleted boolean, seq long"


def changes_of(spark, *rows):
    return spark.createDataFrame(list(rows), CHANGES)


def put(row, seq=1):
    return (row[0], *row[2:], False, seq)


def same_as_rebuilt(spark, index, rows):
    articles = articles_of(spark, rows)
    feeds, queries = feeds_of(spark, (1, 1)), queries_of(spark, *QUERIES)
    want = found(fulltext.search(queries, fulltext.build(articles), articles, feeds, limit=None))
    assert found(fulltext.search(queries, index.index(), articles, feeds, limit=None)) == want and want


def test_inserts_updates_and_deletes_equal_a_rebuild(spark, tmp_path):
    index = SegmentedIndex(spark, f"file://{tmp_path}/i", buckets=2, fan_out=2)
    rows = {r[0]: r for r in made_articles(1, 40)}
    index.apply(changes_of(spark, *map(put, rows.values())))
    other = {r[0]: r for r in made_articles(2, 50)}
    steps = [
        [put(other[45]), put(other[46])],
        [put(other[3]), (4, None, None, None, None, True, 1), (99, None, None, None, None, True, 1)],
        [put(other[45]), (45, None, None, None, None, True, 2), put(other[4]), (46, None, None, None, None, True, 1), put(other[46], 2), (None, "a", None, None, None, False, 1)],
        [(3, None, None, None, None, False, 5)],
    ]
    for step in steps:
        index.apply(changes_of(spark, *step))
    rows |= {46: other[46], 4: other[4], 3: (3, 0, None, None, None, None)}
    same_as_rebuilt(spark, index, list(rows.values()))
    assert len(index.segments) > 1
    again = SegmentedIndex.open(spark, index.root, buckets=2, fan_out=2)
    assert again.segments == [{**s, "version": again.version} for s in index.segments]
    same_as_rebuilt(spark, again, list(rows.values()))
    again.compact()
    assert len(again.segments) == 1 and again.segments[0]["n_gone"] == 0 and again.segments[0]["n_articles"] == len(rows)
    same_as_rebuilt(spark, SegmentedIndex.open(spark, index.root, buckets=2), list(rows.values()))


def test_changes_cost_their_own_size(spark, tmp_path):
    index = SegmentedIndex(spark, f"file://{tmp_path}/i", buckets=1, fan_out=3)
    index.apply(changes_of(spark, *map(put, made_articles(3, 600))))
    whole, index.written = index.written, 0
    r = made_articles(4, 700)
    for k in range(9):
        index.apply(changes_of(spark, put(r[600 + k])))
    own = sum(s["n_rows"] for s in index.segments[1:])
    assert index.segments[0]["n_rows"] == whole > 5000  # the large segment was never read by a merge
    assert index.merged <= 3 * own and index.written <= 4 * own and own < whole / 20
    assert len(index.segments) <= 1 + 2 * 5


def test_size_classes_never_rise(spark, tmp_path, monkeypatch):
    """The policy alone: any order of sizes leaves few segments, whose classes never rise towards the newest."""
    index, r = SegmentedIndex(spark, f"file://{tmp_path}/i", fan_out=3), random.Random(7)

    def merged(n):
        run = index.segments[-n:]
        index.segments[-n:] = [{"n_rows": sum(s["n_rows"] for s in run), "n_gone": 0}]
        index.merged += index.segments[-1]["n_rows"]

    total = 0
    for _ in range(2000):
        size = 3 ** r.randint(0, 7)
        total += size
        index.segments.append({"n_rows": size, "n_gone": 0})
        while n := index._due():
            merged(n)
        classes = list(map(index._class, index.segments))
        assert classes == sorted(classes, reverse=True) and max(map(classes.count, classes)) < 3
    assert index.merged < 16 * total


@pytest.mark.parametrize("rows", [[], [(None, "a", None, None, None, False, 1)]])
def test_nothing_to_do(spark, tmp_path, rows):
    index = SegmentedIndex(spark, f"file://{tmp_path}/i")
    index.apply(changes_of(spark, *rows))
    assert index.segments == [] and index.version == 0 and index.index().sizes().first().n == 0
