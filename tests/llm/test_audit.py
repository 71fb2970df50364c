"""The filter audit against a plain replay in Python."""

from __future__ import annotations

import re
from collections import Counter
from itertools import permutations

from tests.llm.conftest import DOCS, rows_of, words
from tidewell.llm import audit

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute(docs, labels):
    """docs: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    good, toxic = ({d for d, *v in labels if d is not None and v[k] == 1} for k in (0, 1))
    firsts = {}
    for d, t, _ in docs:
        if d is not None:
            firsts[t or ""] = min(d, firsts.get(t or "", d))
    rows = []
    for d, t, part in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > firsts[t],
        }
        rows.append((part or "", fails, d in good, d in toxic))
    out, shares = Counter(), Counter()
    for part, fails, g, x in rows:
        for order in map("".join, permutations("ABCDE")):
            first = next((s for s, f in enumerate(order, 1) if fails[f]), 6)
            for s, f in enumerate(order, 1):
                k = (part, order, s)
                values = (first > s, first == s, fails[f] and first < s, [a for a, b in fails.items() if b] == [f], first == s and g, first == s and x)
                for name, v in zip(COLUMNS[3:9], values, strict=True):
                    out[k, name] += v
                shares[part, f] += first == s
    keys = {k for k, _ in out}
    return sorted((*k, *(out[k, n] for n in COLUMNS[3:9]), shares[k[0], k[1][k[2] - 1]]) for k in keys)


def replayed(docs, labels):
    return sorted(map(tuple, audit.replay(docs, labels).select(COLUMNS).collect()))


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, part string, first long")


def test_replay_against_brute_force(spark, odd):
    clean = words(7, 60)
    extra = rows_of(
        (20, clean, "x"), (21, clean, "x"), (22, clean.upper(), "x"), (23, clean + " #", None), (24, "a b " * 40, ""), (25, "a b " * 40, "x"),
        (None, clean, "x"), (20, clean, "x"), (26, "A" + clean[:18], "x"), (27, "A" + clean[:19], "x"), (28, "A" + clean[:20], "x"), (29, "$ $ x" * 9, "x"),
    )
    docs = odd.union(spark.createDataFrame(extra, DOCS))
    labels = [(20, 1, 0, "p", 1), (20, 0, 1, "p", 1), (21, 1, 1, "p", 1), (24, None, 1, "p", 1), (None, 1, 1, "p", 1), (3, 1, None, "p", 1), (99, 1, 1, "p", 1)]
    want = brute([(r.doc_id, r.text, r.source) for r in docs.collect()], [x[:3] for x in labels])
    assert len(want) == 5 * 600
    assert replayed(docs, labels_of(spark, labels)) == want


def test_a_part_may_hold_nearly_all_rows(spark, monkeypatch):
    monkeypatch.setattr(audit, "TASK_ROWS", 50)
    docs = rows_of(*[(k, f"same {k % 7} #" if k % 3 else None, "hot" if k % 10 else f"p{k}") for k in range(300)])
    want = brute([(r[0], r[1], r[3]) for r in docs], [(0, 1, 0)])
    assert replayed(spark.createDataFrame(docs, DOCS), labels_of(spark, [(0, 1, 0, "", 0)])) == want


def test_empty_tables(spark, odd, empty):
    none = labels_of(spark, [])
    assert replayed(empty, none) == []
    assert {r[-2] for r in replayed(odd, none)} == {0}


def test_all_orders_once(spark):
    orders = [r.filter_order for r in audit.orders_of(spark.range(1)).collect()]
    assert sorted(orders) == sorted(map("".join, permutations("ABCDE")))
