"""Operators over documents against brute force on odd and small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import DOCS, rows_of, words
from tidewell.llm import components, decontam, licenses, lm, near, packing, quality, queries, sharding, simhash, substring

PLAIN, LETTERS = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def key(x):
    return repr(x)


# --- quality -----------------------------------------------------------------


def brute_quality(t):
    t = t or ""
    w = re.findall(PLAIN, t)
    lines, seen, dup = t.split("\n"), set(), 0
    for line in lines:
        if re.search(PLAIN, line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)


def test_quality_signals(odd, empty):
    got = quality.document_quality(odd).select("doc_id", *[F.col("q")[c] for c in quality.SIGNALS]).collect()
    assert sorted(map(tuple, got), key=key) == sorted(((d, *brute_quality(t)) for d, t in texts(odd)), key=key)
    assert quality.document_quality(empty).count() == 0
    assert quality.keep_good(empty).columns == empty.columns


def test_bad_host_only_loses_soft_failures(spark):
    clean = words(1, 100)
    noisy = " ".join(f"{w} #$%" for w in words(2, 100).split())
    rows = [(i, noisy, "bad") for i in range(30)] + [(100, clean, "bad"), (101, noisy, "good"), (102, noisy, None)]
    rows += [(200 + i, words(i + 10, 90), "good") for i in range(30)]
    docs = spark.createDataFrame(rows_of(*rows), DOCS)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert ids == {100, 101, 102} | {200 + i for i in range(30)}
    judged = {r.doc_id: r.kept for r in quality.document_quality(docs).collect()}
    assert {d for d, k in judged.items() if k} == ids


def test_a_task_of_the_quality_stage_feeds_one_python_worker(spark):
    docs = spark.createDataFrame(rows_of((1, words(1, 90), "a"), (2, "short", "a"), (3, words(2, 90), None)), DOCS)
    kept = quality.keep_good(docs)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1
    assert {r.doc_id for r in kept.collect()} == {1, 3}


# --- simhash -----------------------------------------------------------------


def brute_fingerprint(t, size=3):
    w = low(t).split() if t else []
    w = re.findall(PLAIN, low(t))
    if not w:
        return 0
    s = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(values, linked):
    label = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i in range(len(values)):
            for j in range(len(values)):
                if linked(values[i], values[j]) and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


@pytest.mark.parametrize("cap", [64, 1])
def test_simhash_components(odd, empty, cap):
    rows = texts(odd)
    fps = [brute_fingerprint(t) for _, t in rows]
    labels = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    least = defaultdict(lambda: None)
    for (d, _), g in zip(rows, labels, strict=True):
        if d is not None:
            least[g] = d if least[g] is None else min(least[g], d)
    want = [(d, f, least[g]) for (d, _), f, g in zip(rows, fps, labels, strict=True)]
    got = [(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.simhash_components(odd, bucket_cap=cap).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert simhash.simhash_components(empty).count() == 0


@pytest.mark.parametrize("cap", [64, 2])
def test_links_connect_close_fingerprints(spark, cap):
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**62), 2**62, 40)
    values = {int(b) for b in base}
    for b in base[:12]:
        for _ in range(12):
            values.add(int(b) ^ (1 << int(rng.integers(0, 62))) ^ (1 << int(rng.integers(0, 62))))
    values = sorted(values)
    want = brute_components(values, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2)
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    got = {r.node: r.label for r in components.components(simhash.links(fps, cap)).collect()}
    assert [got.get(v, v) for v in values] == [values[g] for g in want]


def test_near_duplicates_keep_one(spark, empty):
    rows, clean = [], []
    for k in range(20):
        base = words(1000 + k, 200).split()
        rows.append((10 * k, " ".join(base), "a"))
        clean.append(10 * k)
        for j in range(1, 4):
            copy = list(base)
            copy[50 * j] = "changed"
            rows.append((10 * k + j, " ".join(copy), "a"))
    rows += [(500, rows[0][1], "a"), (0, rows[0][1], "a"), (501, None, "a"), (502, "", "a")]
    docs = spark.createDataFrame(rows_of(*rows), DOCS)
    kept = near.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted([*clean, 501])
    assert near.keep_one_of_each(empty).count() == 0


@pytest.mark.parametrize("share", [0.6, 0.7, 0.75, 0.79, 0.8, 0.82, 0.85])
def test_near_pairs_are_judged_by_exact_similarity(spark, share):
    """Pairs planted at a Jaccard similarity: all from 0.8 on are found, none below."""
    rows = []
    for k in range(40):
        # 500 shingles of distinct words; each changed word ends in five of the copy's
        base = [f"w{k}x{i}" for i in range(504)]
        own = round(500 * (1 - share) / (1 + share))
        if own and share >= 0.8:  # not below the limit by rounding
            own = int(500 * (1 - share) / (1 + share) + 1e-9)
        copy = base[: 504 - own] + [f"v{k}x{i}" for i in range(own)]
        rows += [(2 * k, " ".join(base), "a"), (2 * k + 1, " ".join(copy), "a")]
    docs = spark.createDataFrame(rows_of(*rows), DOCS)
    kept = sorted(r.doc_id for r in near.keep_one_of_each(docs).collect())
    assert kept == (list(range(0, 80, 2)) if share >= 0.8 else list(range(80)))


def test_near_duplicates_count_shingles_once(spark):
    line = "one two three four five six seven eight nine ten "
    docs = spark.createDataFrame(rows_of((1, line * 2, "a"), (2, line * 30, "a"), (3, line * 2 + "eleven", "a")), DOCS)
    assert sorted(r.doc_id for r in near.keep_one_of_each(docs).collect()) == [1]


@pytest.mark.parametrize("crowd", [8, 0])
def test_crowded_family_against_brute_force(spark, monkeypatch, crowd):
    """Pages of one template: far ones all stay, each near copy finds its page in the crowd."""
    monkeypatch.setattr(near, "CROWD", crowd)
    template = [f"t{i}" for i in range(300)]
    rows = []
    for k in range(150):
        page = template + [f"p{k}x{i}" for i in range(90)]
        rows.append((10 * k, " ".join(page), "a"))
        if k % 3 == 0:  # 0.8 or a little more with its own page only
            rows.append((10 * k + 1, " ".join(page[:-40] + [f"q{k}x{i}" for i in range(40)]), "a"))
    sets = [set(near.shingle_set(t).tolist()) for _, t, _ in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if 9 * shared >= 4 * (len(a) + len(sets[j])):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    want = sorted(min(rows[i][0] for i in range(len(rows)) if label[i] == g) for g in set(label))
    assert 100 < len(want) < len(rows)
    got = near.keep_one_of_each(spark.createDataFrame(rows_of(*rows), DOCS))
    assert sorted(r.doc_id for r in got.collect()) == want


def test_near_groups_are_found_by_fingerprints_first(spark, monkeypatch):
    """Texts within two bits are linked by multi-index hashing and leave no pair to the shingles."""
    tried, check = [], near.verified

    def verified(pairs, *rest):
        tried.append(pairs.count())
        return check(pairs, *rest)

    monkeypatch.setattr(near, "verified", verified)
    base = [f"w{k}" for k in range(3000)]
    rows = [(k, " ".join([*base, f"end{k}"]), "a") for k in range(3)] + [(9, words(9, 80), "b")]
    kept = near.keep_one_of_each(spark.createDataFrame(rows_of(*rows), DOCS))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 9]
    assert tried[0] >= 2 and not any(tried[1:])


def written_rows(monkeypatch) -> dict[str, int]:
    """Rows of the last scratch table of each name that the stage writes."""
    rows, write = {}, near.materialize

    def materialize(df, label):
        out = write(df, label)
        rows[label] = out.count()
        return out

    monkeypatch.setattr(near, "materialize", materialize)
    return rows


def test_a_group_of_near_copies_leaves_no_cells(spark, monkeypatch):
    """Copies whose fingerprints are far apart are joined by MinHash, before each of their shingles is a row."""
    rows = written_rows(monkeypatch)
    base = [f"w{i}" for i in range(400)]
    copies = []
    for k in range(120):
        copy = list(base)
        for at in (7 * k % 390, (7 * k + 130) % 390, (7 * k + 260) % 390):
            copy[at] = f"c{k}x{at}"
        copies.append((k, " ".join(copy), "a"))
    assert len({near.simhash.majority(near.shingle_set(t).astype(">i8").view(">u8")) for _, t, _ in copies}) > 100
    kept = near.keep_one_of_each(spark.createDataFrame(rows_of(*copies, (500, words(7, 80), "b")), DOCS))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 500]
    assert rows["cells"] < 120 * len(base) // 50


def test_sets_travel_only_for_pairs_that_wide_sketches_leave(spark, monkeypatch):
    """Pairs that share half their shingles are dropped before their sets are shuffled."""
    rows = written_rows(monkeypatch)
    half = [f"t{i}" for i in range(1200)]
    pages = [(k, " ".join(half + [f"p{k}x{i}" for i in range(1200)]), "a") for k in range(12)]
    docs = spark.createDataFrame(rows_of(*pages), DOCS)
    texts = docs.selectExpr("doc_id as doc", "cast(cast(doc_id as string) as binary) as key", "text")
    classes = near.classes_of(near.profiles(texts, near.Fraction("0.8")))
    a, b = classes.selectExpr("id as u"), classes.selectExpr("id as v")
    found = near.verified(a.crossJoin(b).where("u < v"), classes, texts.select("key", "text"), False, near.Fraction("0.8"))
    assert found.count() == 0 and rows["needed"] == 12 and rows["close"] == 0


@pytest.mark.parametrize("more, alike", [(115, True), (125, True), (126, False), (140, False)])
def test_sketches_of_two_widths_lose_no_pair(spark, more, alike):
    """Sets of 500 shingles and of over 600 have sketches of 512 and 1024 bins; the limit is at 625."""
    base = [[f"w{k}x{i}" for i in range(504)] for k in range(20)]
    rows = [(2 * k, " ".join(b), "a") for k, b in enumerate(base)]
    rows += [(2 * k + 1, " ".join(b + [f"v{k}x{i}" for i in range(more)]), "a") for k, b in enumerate(base)]
    kept = sorted(r.doc_id for r in near.keep_one_of_each(spark.createDataFrame(rows_of(*rows), DOCS)).collect())
    assert kept == (list(range(0, 40, 2)) if alike else list(range(40)))


# --- substring ---------------------------------------------------------------


def brute_substring(rows, window):
    docs = sorted({(d is not None, d or 0, t or "") for d, t in rows})
    ties = defaultdict(set)
    for a, d, t in docs:
        ties[a, d].add(t)
    # rows of one id and different texts are ordered by their texts' hashes; callers avoid them
    first = {}
    for a, d, t in docs:
        w = re.findall(PLAIN, t)
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), (a, d, i))
    out = []
    for d, t in rows:
        w = re.findall(PLAIN, t or "")
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] != (d is not None, d or 0, i):
                gone |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_substring_dedup(odd, empty):
    docs = odd.where("NOT (doc_id <=> 2 AND text LIKE 'same id%')")
    got = substring.deduplicated(docs).select("row.doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute_substring(texts(docs), 20), key=key)
    cut = substring.without_repeats(docs)
    assert cut.columns == docs.columns
    assert {r.doc_id: r.text for r in cut.collect()}[1] == {r.doc_id: r.text for r in docs.collect()}[1].replace(words(2, 60), "")
    assert substring.without_repeats(empty).count() == 0


@pytest.mark.parametrize("nothing", ["", None, " \n"])
def test_substring_dedup_between_empty_texts(spark, nothing):
    shared = words(41, 25)
    items = [(0, nothing), (1, shared), (2, nothing), (3, nothing), (4, shared), (5, shared + " " + words(42, 9)), (6, nothing), (7, nothing)]
    docs = spark.createDataFrame(rows_of(*[(d, t, "a") for d, t in items]), DOCS)
    got = {r.row.doc_id: (r.n_words, r.n_removed) for r in substring.deduplicated(docs).collect()}
    size = {d: len((t or "").split()) for d, t in items}
    assert got == {d: (size[d], 25 if d in (4, 5) else 0) for d, _ in items}


def test_substring_dedup_of_periodic_texts(spark):
    cycles = {k: [f"p{k}x{j}" for j in range(k)] for k in (1, 2, 5, 7, 12, 13, 19)}
    rows = [(k, " ".join((c * 60)[:n])) for k, c in cycles.items() for n in (20 + k, 57 + k)]
    rows = [(10 * d + i, t) for i, (d, t) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring.deduplicated(docs).select("row.doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(brute_substring(rows, 20))


def test_word_hashes_follow_the_words():
    long = "y" * (substring.BLOCK + 3)
    words = ["a", "b", "ab", "ba", long, "é", "z" * (substring.BLOCK - 1), "a", long, *["ab", "c"] * substring.BLOCK]
    h, sizes = substring.word_hashes(("\t" + " \n".join(words) + " ").encode())
    assert len(h) == len(words) and len(set(h.tolist())) == len(set(words))
    assert sizes.tolist() == [len(w.encode()) for w in words]
    own = {w: substring.word_hashes(w.encode())[0][0] for w in set(words)}
    assert [own[w] for w in words] == h.tolist()


def test_words_of_equal_hashes_are_told_apart(spark):
    """Two words that a polynomial modulo 2**64 cannot tell apart: nothing repeats, nothing goes."""
    parity = "".join("a" if k.bit_count() % 2 == 0 else "b" for k in range(2048))
    pair = [parity, parity.translate(str.maketrans("ab", "ba"))]
    assert len({substring.word_hashes(w.encode())[0][0] for w in pair}) == 1
    rest = words(77, 24).split()
    rows = [(k, " ".join(rest[:12] + [w] + rest[12:])) for k, w in enumerate(pair)]
    docs = spark.createDataFrame([*rows, (2, rows[0][1])], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in substring.deduplicated(docs).select("row.doc_id", "n_removed").collect()}
    assert got == {0: 0, 1: 0, 2: 25}


def test_the_automaton_decides(spark, monkeypatch):
    """What the automaton does not match is not removed."""
    phrases = [b"a b c d e f g h", b"b c d e f g h i"]
    found = substring.Phrases(phrases)
    assert found.starts(b"x a b c d e f g h i b c d e f g h".split()) == [1, 2]
    assert found.starts(b"a b c d e f g unknown".split()) == []
    run = substring._locate(20)
    text = words(5, 25)
    docs = pa.table({"row_key": pa.array([b"k", b"l"]), "row": [5, 6], "text": [text, text]})
    bases = [(b"k", 0, None, None), (b"l", 100, None, None)]
    kinds = [("key", pa.binary()), ("base", pa.int64()), ("row", pa.int64()), ("pos", pa.int32())]
    # no places, a place of another text, and places in the first text only: the other's are located
    for places, runs in (([], 0), ([(7, 0)], 0), ([(5, p) for p in range(18)], 2)):
        rows = bases + [(None, None, r, p) for r, p in places]
        known = pa.table({c: pa.array([x[k] for x in rows], t) for k, (c, t) in enumerate(kinds)})
        got = run(docs, known)
        assert len(set(got.column("base").to_pylist())) == runs
        assert got.num_rows == 0 or sum(got.column("n").to_pylist()) == 12


def test_substring_dedup_of_a_row_repeated_very_often(spark):
    rows = [(1, words(5, 30))] * 3000 + [(2, words(5, 30)), (3, words(6, 30))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring.deduplicated(docs).groupBy("row.doc_id", "n_removed").count().collect()
    assert sorted(map(tuple, got)) == [(1, 0, 3000), (2, 30, 1), (3, 0, 1)]


# --- language model ----------------------------------------------------------


def test_code_lengths_are_a_distribution():
    data = b"abracadabra alakazam abrakadabra" * 3
    grams, n = np.unique(lm.grams_of(data), return_counts=True)
    zero1 = np.zeros((512, 512))
    for g, c in zip(grams, n, strict=True):
        zero1[(g >> 9) & 511, g & 511] += c
    zero = zero1.sum(axis=0)
    context = int(lm.grams_of(b"abra")[-2] >> 9 << 9 | ord("r"))  # some seen context
    for ctx in {int(g) >> 9 for g in grams[:20]} | {context >> 9}:
        every = np.array([ctx << 9 | s for s in [*range(256), lm.STOP]])
        two = ctx & ((1 << 18) - 1)
        group = grams[(grams >> 9 & ((1 << 18) - 1)) == two]
        counts = {int(g): int(c) for g, c in zip(grams, n, strict=True)}
        rest = np.array([g for g in group if int(g) not in set(every.tolist())], dtype=np.int64)
        both = np.concatenate([every, rest])
        out = lm.code_lengths(both, np.array([counts.get(int(g), 0) for g in both]), zero1[ctx & 511], zero)
        assert abs((10 ** out[:257]).sum() - 1) < 1e-9


def test_lm_base_and_held_out(spark, small, odd, empty):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for table in (docs, odd):
        got = lm.score_texts(table).collect()
        rows = texts(table)
        held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
        tokens = {i: re.findall(PLAIN, low(t)) + ["\n"] for i, (_, t) in enumerate(rows)}
        c = Counter(x for i, (d, _) in enumerate(rows) if not held(d) for x in tokens[i])
        n, v = sum(c.values()), len(c)
        want = []
        for i, (d, _) in enumerate(rows):
            base = sum(np.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens[i])
            want.append((d, held(d), len(tokens[i]), sum(c[x] > 0 for x in tokens[i]), n, round(base, 4)))
        assert sorted([(*r[:5], round(r.base_score, 4)) for r in got], key=key) == sorted(want, key=key)
    # held-out code length against an order-0 byte model of the same training texts
    scores = {r.doc_id: r.score for r in lm.score_texts(docs).collect() if r.held_out}
    data = {d: (t or "").encode() for d, t in texts(docs)}
    seen = Counter(b for d, t in data.items() if d not in scores for b in t)
    total = sum(seen.values())
    plain = sum(np.log10((seen[b] + 0.1) / (total + 25.6)) for d in scores for b in data[d])
    assert sum(scores.values()) > 0.75 * plain
    assert lm.score_texts(empty).count() == 0


def brute_ppm(train, data):
    """log10 probability of a text symbol by symbol, from dictionaries of contexts."""
    counts = defaultdict(Counter)
    pad = lambda t: [lm.START] * lm.ORDER + list(t) + [lm.STOP]
    for t in train:
        a = pad(t)
        for i in range(lm.ORDER, len(a)):
            for k in range(lm.ORDER + 1):
                counts[tuple(a[i - k : i])][a[i]] += 1
    a, total = pad(data), 0.0
    for i in range(lm.ORDER, len(a)):
        gone, p = set(), 1.0
        for k in range(lm.ORDER, -1, -1):
            seen = counts.get(tuple(a[i - k : i]), {})
            live = {s: c for s, c in seen.items() if s not in gone}
            if not live:
                continue
            if a[i] in live:
                p *= live[a[i]] / (sum(live.values()) + len(live))
                break
            p *= len(live) / (sum(live.values()) + len(live))
            gone |= set(seen)
        else:
            p /= lm.SYMBOLS - len(counts.get((), {}))
        total += np.log10(p)
    return total


@pytest.mark.parametrize("part", [1 << 20, 5])
def test_held_out_scores_against_plain_matching(spark, monkeypatch, part):
    import random

    monkeypatch.setattr(lm, "PART", part)
    r = random.Random(11)
    rows = [(d, "".join(r.choice("abcde éA\n") for _ in range(r.randrange(40)))) for d in range(120)] + [(500, None), (None, "Abé"), (3, "again")]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    train = [(t or "").encode() for d, t in rows if not held(d)]
    got = sorted((repr(x.doc_id), x.held_out, round(x.score, 8)) for x in lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted((repr(d), held(d), round(brute_ppm(train, (t or "").encode()), 8)) for d, t in rows)


def test_lm_without_training_texts(spark):
    ids = [d for d in range(200) if zlib.crc32(str(d).encode()) % 10 == 0]
    got = lm.score_texts(spark.createDataFrame([(d, "ab") for d in ids], "doc_id long, text string")).collect()
    assert {(x.held_out, x.n_known, x.train_tokens, round(x.score, 6)) for x in got} == {(True, 0, 0, round(-3 * np.log10(257), 6))}


# --- sharding ----------------------------------------------------------------


def test_shards_fit(spark, odd, empty):
    rows = [(i % 97 if i % 3 else 5, 100 + i % 50) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, bytes long")
    out = sharding.extendible_shards(df, "doc_id", F.col("bytes"), 4000).collect()
    assert sorted((r.doc_id, r.bytes) for r in out) == sorted(rows)
    by = defaultdict(int)
    for r in out:
        assert len(r.shard) == r.shard_depth
        by[r.shard] += r.bytes
    assert max(by.values()) <= 4000
    leaves = sorted(by)
    assert not any(b.startswith(a) for a, b in zip(leaves, leaves[1:], strict=False))
    for shard in by:  # its parent was oversized
        assert sum(n for s, n in by.items() if s.startswith(shard[:-1])) > 4000
    one = sharding.extendible_shards(odd.select("doc_id", F.octet_length("text").alias("b")), "doc_id", F.col("b"), 1000)
    assert one.count() == odd.count()
    assert sharding.extendible_shards(empty, "doc_id", F.lit(1), 10).count() == 0


# --- decontamination ---------------------------------------------------------


def brute_hits(docs, items, window=13):
    wins = defaultdict(set)
    for i, t in items:
        w = re.findall(LETTERS, low(t))
        for s in range(max(0, len(w) - window) + 1 if w else 0):
            wins[tuple(w[s : s + window])].add(i)
    sizes, out = {len(w) for w in wins}, []
    for d, t in docs:
        w = re.findall(LETTERS, low(t))
        hit, found = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (x := tuple(w[s : s + n])) in wins:
                    hit |= set(range(s, s + n))
                    found |= wins[x]
        out.append((d, len(w), len(hit), sorted(map(str, found)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def test_decontamination(spark, odd, empty):
    items = [(1, words(2, 60)), (2, "One"), (3, "ÀB! àb"), (4, None), (5, ""), (11, words(1, 40)), (12, words(1, 40)), (13, "zz"), (14, words(77, 2))]
    table = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, n_hit string")
    got = [(r.row.doc_id, r.n_words, r.n_hit, list(r.item_ids), r.contaminated) for r in decontam.judged(odd, table).collect()]
    assert sorted(got, key=key) == sorted(brute_hits(texts(odd), items), key=key)
    assert decontam.keep_clean(odd, table).columns == odd.columns
    assert decontam.keep_clean(empty, table).count() == 0
    assert decontam.judged(odd, table.limit(0)).where("n_hit > 0").count() == 0


# --- licenses ----------------------------------------------------------------


def test_license_scan(spark, empty):
    rows = [
        (1, "Released under the MIT License."), (2, "x Licensed under the Apache License, Version 2.0. y CC BY-NC 4.0"),
        (3, "This work is licensed under the GNU General Public License, version 3."), (4, None), (5, ""),
        (6, "plain words about a license"), (7, "under the MIT license under the mit license"), (None, "CC-BY NC"),
        (8, "general public version license the work"), (2, "cc by sa"),
    ]
    docs = spark.createDataFrame([(d, t, 1.0) for d, t in rows], "doc_id long, text string, score double")
    out = licenses.scan(docs).collect()
    for (d, t), r in zip(rows, out, strict=True):
        w = re.findall(LETTERS, low(t))
        at = sorted((i, lab) for p, lab in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        base = {x for _, x in at}
        assert (r.doc_id, r.n_words, r.n_base) == (d, len(w), len(at))
        assert (r.first_word, r.last_word) == ((at[0][0], at[-1][0]) if at else (None, None))
        assert r.base_labels == ",".join(sorted(base)) and base <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    labels = [r.labels for r in out]
    assert labels[:3] == ["mit", "apache-2,cc-by-nc", "gpl-3"] and labels[5] == "" and labels[8] == ""
    assert licenses.scan(empty).count() == 0


def brute_labels(words, index):
    """Every start of every template, scored and searched for key phrases."""
    at = defaultdict(list)
    for p, w in enumerate(words):
        at[w].append(p)
    out = set()
    for t, template in enumerate(index.words):
        for start in range(-index.slack[t], len(words)):
            if index.share(t, start, at) >= licenses.MIN_SHARE and index.stands(t, start, words):
                out.add(index.labels[t])
                break
    return out


def test_license_labels_against_every_alignment(spark):
    """Licences among other words, with words put in, left out and changed, and two in one text."""
    import random

    r = random.Random(7)
    prose = ["die", "mole", "under", "the", "of", "license", "software", "and", *words(9, 60).split()]
    rows = []
    for k, (_, text, _) in enumerate(licenses.TEMPLATES * 2):
        body = []
        for w in text.split():
            roll = r.random()
            if k >= len(licenses.TEMPLATES) and roll < 0.03:
                continue
            body.append(w)
            if k >= len(licenses.TEMPLATES) and roll > 0.97:
                body.append(r.choice(prose))
        around = [r.choice(prose) for _ in range(r.randrange(150))]
        other = licenses.TEMPLATES[r.randrange(len(licenses.TEMPLATES))][1] if k % 3 == 0 else ""
        rows.append((k, " ".join([*around, *body, *around[::-1], other])))
    rows += [(1000 + k, " ".join(r.choice(prose) for _ in range(400))) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: set(x.labels.split(",")) - {""} for x in licenses.scan(docs).collect()}
    vocabulary = set(licenses.Index(licenses.TEMPLATES).postings)
    index = licenses.Index(licenses.TEMPLATES, *licenses.document_frequencies(docs, vocabulary))
    clean = {d: t for d, t in rows}
    missed = extra = held = 0
    for d, t in rows:
        w = licenses.letter_words(t)
        want = brute_labels(w, index)
        base = {label for _, label in licenses.places(w)}
        held += len(want)
        missed += len(want - got[d])
        extra += len(got[d] - want - base)
    assert held > 80 and extra == 0 and missed <= held // 50
    for k, (label, _, _) in enumerate(licenses.TEMPLATES):
        assert label in got[k], label
    assert all(not got[d] for d in clean if d >= 1000)


def test_license_scan_of_odd_texts(spark):
    long = " ".join(["the", "of", "license"] * 100_000)
    text = licenses.TEMPLATES[0][1]
    docs = spark.createDataFrame([(None, text), (None, text), (1, long), (2, "x " * 200_000 + text)], "doc_id long, text string")
    got = [(r.doc_id, r.labels) for r in licenses.scan(docs).collect()]
    assert got == [(None, "mit"), (None, "mit"), (1, ""), (2, "mit")]


# --- packing -----------------------------------------------------------------


def test_packing_round_trip(spark, odd, empty, small):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    extra = spark.createDataFrame(rows_of((90, "a  b \n c\t\td  <|endoftext|> x  ", "s"), (91, " lead", "s"), (92, "x² ½ don't  'll  y", "s")), DOCS)
    for docs in (odd.union(extra), spark.read.parquet(f"{small}/documents.parquet")):
        pieces = packing.pack(docs, path).collect()
        sequences = defaultdict(list)
        by = defaultdict(list)
        for p in pieces:
            sequences[p.sequence_id].append((p.offset, p.length))
            by[p.doc_id].append(p)
        for parts in sequences.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 1024
        want = defaultdict(list)
        for d, t in texts(docs):
            ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
            want[d] += [(a, min(1024, len(ids) - a), zlib.crc32(ids[a : a + 1024].tobytes()), len(ids)) for a in range(0, len(ids), 1024)]
        for d, w in want.items():
            assert sorted((p.start, p.length, p.ids_crc32, p.doc_tokens) for p in by[d]) == sorted(w)
        total = sum(p.length for p in pieces)
        assert len(sequences) * 1024 < 1.05 * total + 2048
    assert packing.pack(empty, path).count() == 0


def test_best_fit_takes_the_tightest_bin():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 65, 400).tolist()
    room = []
    want = [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [r for r in room if r >= lengths[i]]
        if fits:
            want[i] = min(fits) - lengths[i]
            room.remove(min(fits))
        else:
            want[i] = 64 - lengths[i]
        room.append(want[i])
    got = packing.best_fit(lengths, 64)
    assert [64 - at - n for (_, at), n in zip(got, lengths, strict=True)] == want


def test_queries_registered():
    names = {n.split("_")[0] for n in queries.queries()}
    assert names == {f"op{k}" for k in range(1, 14)} | {"pipeline"}
