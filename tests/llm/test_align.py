"""Token alignment against a two-pointer loop over whole encodings."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tests.llm.conftest import DOCS, rows_of
from tidewell.llm import align

PATHS = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


@pytest.fixture(scope="module")
def coders():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    return a, b


def token_bytes(coders, x, y):
    a, b = coders
    plain = align.byte_alphabet()
    left = [t.encode() if i == 50256 else bytes(plain[c] for c in t) for i in x for t in [a.id_to_token(i)]]
    right = [bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in y for p in [b.id_to_piece(i)]]
    return left, right


def brute_groups(coders, text):
    """Groups of a text's ids by two pointers; None where it has no tokens."""
    if not text:
        return None
    x, y = coders[0].encode(" " + text, add_special_tokens=False).ids, coders[1].encode(text)
    left, right = token_bytes(coders, x, y)
    data = (" " + text).encode("utf-8", "surrogatepass")
    if b"".join(left) != data or b"".join(right) != data:
        return None
    out, i, j, p, q, a, b = [], 0, 0, 0, 0, [], []
    while i < len(x) or j < len(y):
        if p <= q and i < len(x):
            a.append(x[i])
            p, i = p + len(left[i]), i + 1
        else:
            b.append(y[j])
            q, j = q + len(right[j]), j + 1
        if p == q and a and b:
            out.append((a, b))
            a, b = [], []
    return out


def brute(coders, texts):
    every = [brute_groups(coders, t) for t in texts]
    linked = [Counter((p, q) for a, b in g or () for p in a for q in b) for g in every]
    counts = Counter(k for c in linked for k in c)
    most_a, most_b = Counter(), Counter()
    for (p, q), n in counts.items():
        most_a[p], most_b[q] = max(n, most_a[p]), max(n, most_b[q])
    rows = []
    for g, c in zip(every, linked, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g or ())
        best = (sum(n for k, n in c.items() if counts[k] == most[k[s]]) for s, most in enumerate((most_a, most_b)))
        digest = hashlib.sha256(text.encode()).hexdigest() if g else ""
        rows.append((sum(len(a) for a, _ in g or ()), sum(len(b) for _, b in g or ()), len(g or ()), sum(c.values()), *best, sum(n * counts[k] for k, n in c.items()), digest))
    return rows


def aligned(docs):
    return sorted(((r[0], *r[1:]) for r in align.align(docs, *PATHS).collect()), key=repr)


ODD = [" ", "  ", "\n", "\t", "\r\n", "a", "b", "the", " The", "'s", "'ll", "1", "23", ".", "!?", "é", "ü", "日本", "語", "😀", " ", "　", "\x1c", "\x85",
       " ", "\0", "<s>", "</s>", "<|endoftext|>", "<0x41>", "_", "ſ", "̈", "‍", "ｆ", "▁"]


def odd_texts(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice(ODD[:-1] if k % 9 else ODD) for _ in range(r.randint(1, 30))) for k in range(n)]


@pytest.mark.parametrize("slice_chars", [5, 1 << 20])
def test_documents_against_two_pointers(coders, monkeypatch, slice_chars):
    monkeypatch.setattr(align, "SLICE", slice_chars)
    work = align.Aligner(*PATHS)
    assert work.ranks
    for text in [*odd_texts(slice_chars, 3000), "a" * 5000, " " * 5000 + "x", "é" * 3000, "ab" * 3000 + " " + "x\n" * 2000, "<|endoftext|>" * 200]:
        found, want = work.document(text), brute(coders, [text])[0]
        assert (*found[:4], found[4]) == (*want[:4], want[-1]), text
        links = Counter(p << 31 | q for a, b in brute_groups(coders, text) or () for p in a for q in b)
        assert dict(zip(found[5].tolist(), found[6].tolist(), strict=True)) == links


def test_long_groups_count_distinct_ids_first(monkeypatch):
    r = np.random.default_rng(1)
    a, b = r.integers(0, 9, 400), r.integers(0, 9, 300)
    to_a, to_b = np.array([1, 200, 203, 400]), np.array([2, 150, 152, 300])
    want = Counter()
    for lo, hi, low, high in zip([0, *to_a], to_a, [0, *to_b], to_b, strict=False):
        want.update((int(p) << 31 | int(q)) for p in a[lo:hi] for q in b[low:high])
    for listed in (0, 10, 10**9):
        monkeypatch.setattr(align, "LISTED", listed)
        assert dict(zip(*(v.tolist() for v in align.count_pairs(a, b, to_a, to_b)), strict=True)) == want


def test_counts_go_back_to_documents(spark, odd, coders):
    extra = [(100 + k, t, "s") for k, t in enumerate(odd_texts(3, 60))]
    docs = odd.union(spark.createDataFrame(rows_of(*extra, (100, "the cat", "s"), (100, "the cat", "s"), (None, "the cat", "s")), DOCS))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted(((d, *v) for (d, _), v in zip(rows, brute(coders, [t for _, t in rows]), strict=True)), key=repr)
    assert aligned(docs) == want
    assert any(not r[-1] for r in want) and any(r[5] < r[4] for r in want)


def test_pairs_beyond_the_broadcast_bound(spark, odd, monkeypatch):
    want = aligned(odd)
    monkeypatch.setattr(align, "broadcast_if_small", lambda df: df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert aligned(odd) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_empty_table(spark, empty):
    assert align.align(empty, *PATHS).collect() == []
