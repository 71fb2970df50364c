"""Near-duplicate groups by the exact Jaccard similarity of shingle sets, for filtering documents.

A text is the set of its five-word shingles (64-bit hashes, each once).  Two texts are
linked when their sets' Jaccard similarity is at least ``similarity``; no estimate decides.
The whole sets of texts that may be similar are made anew from the texts, so no table
holds all of them.
Candidates come from a prefix filter, which misses no pair: in any one order of all
shingles, two sets that similar share one of their first ``n - ceil(similarity * n) + 1``.
Shingles that a sample of the texts repeats come last in that order, the more often the
later, so that what a template's pages have in common seldom makes candidates; the
sample has a say in the number of candidates only.

SimHash comes first: sets whose fingerprints (bitwise majorities of their hashes) differ by two
bits at most are found by multi-index hashing (``simhash``), checked exactly, and those linked
are one group from then on.  At a similarity of 0.8 fingerprints differ by some ten bits, so
the rest is found through shared shingles.

First through the least shingle of each set in ``MINS`` orders of all hashes (MinHash): the sets of
different groups that one of them names are compared with one of these sets, which joins most groups of
copies at a few rows a text; then through shingles of the prefixes that more than one group holds.

Crowded shingles need no cap.  While they hold many pairs of texts of different groups,
each shingle's texts are compared with one of them, another for every shingle and round,
and the links found are joined to groups; rounds end when they no longer halve that
number.  Then, in shingles that hold more than one group, all but the texts of the
largest group are compared with all texts of other groups; pairs left out are connected
already.  Two texts are paired only where enough shingles are left after the common one
in both sets, and where the parity sketches of the sets do not rule the pair out (a bound,
so no similar pair is lost).  Pairs are then held against sketches as wide as their sets are large,
which rule out nearly all dissimilar ones, and whole sets travel for what is left.

Defined cases: texts are told apart by their ASCII-lower-cased plain words; a text of up
to five words is one shingle; texts without words are alike; of the rows of a group the
one with the smallest id stays (of repeated ids, one row).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tidewell.llm import simhash
from tidewell.llm.components import components
from tidewell.llm.text import drop_caches, encode, release_memory, row_key
from tidewell.plans.scratch import broadcast_if_small, discard, materialize

#: One text of so many is sampled; up to ``COMMON`` shingles that it repeats come last.
SAMPLE, COMMON = 16, 200_000
#: Longs of a set's parity sketch, and their names.
WORDS = 4
SKETCH = [f"s{k}" for k in range(WORDS)]
#: Odd factors that put the hashes in another order each; a set's least shingles in them are its MinHash keys.
MINS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
#: Star rounds go on while shingles hold more than this many pairs of different groups for each of their texts.
CROWD = 8


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles."""
    words = encode(text).lower().split()
    if not words:
        return np.empty(0, np.int64)
    shingles = [b" ".join(words)] if len(words) <= size else map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(s, 42) for s in shingles], dtype=np.uint64).view(np.int64))


def shingle_sets(rows: DataFrame) -> DataFrame:
    """(id, n, wide, hashes) of rows (id, text); ``wide`` is a sketch of at least as many bins as the set has shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py()) for t in batch.column("text")]
            wide = [sketch(h, 1 << (max(0, len(h) - 1) // 64).bit_length()) for h in sets]
            sizes = pa.array([len(h) for h in sets], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("id"), sizes, _lists(wide), _lists(sets)], ["id", "n", "wide", "hashes"])

    return rows.select("id", "text").mapInArrow(run, "id long, n int, wide array<long>, hashes array<long>")


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(arrays) if arrays else [], pa.int64()))


def common_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample of the texts repeats, sorted, and how often."""
    part = F.xxhash64("key")
    sample = shingle_sets(texts.where(F.pmod(part, F.lit(SAMPLE)) == 0).select(part.alias("id"), "text")).select(F.explode("hashes").alias("h"))
    counts = sample.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "h").limit(COMMON).toPandas()
    counts = counts.sort_values("h")
    return counts["h"].to_numpy(np.int64), counts["n"].to_numpy(np.int64)


def sketch(hashes: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Parities of a set's hashes in ``64 * words`` bins (a power of two).

    Every bin in which two sets' parities differ holds a shingle of one of them only.
    """
    odd = np.bincount(hashes & (64 * words - 1), minlength=64 * words).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def profiles(texts: DataFrame, least: Fraction) -> DataFrame:
    """(doc, key, set, n, fp, sketch, mins, prefix) of rows (doc, key, text).

    ``set`` is a digest of the shingle set, ``n`` its size, ``fp`` its fingerprint, ``mins`` its MinHash keys, ``prefix`` its first shingles in
    the common order, as many as a similar set cannot all lack.
    """
    common = texts.sparkSession.sparkContext.broadcast(common_shingles(texts))
    num, den = least.numerator, least.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        keys, counts = common.value
        for batch in batches:
            digests, sizes, prints, sketches, mins, prefixes = [], [], [], [], [], []
            for text in batch.column("text"):
                h = shingle_set(text.as_py())
                often = np.zeros(len(h), np.int64)
                if len(keys) and len(h):
                    found = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    often = np.where(keys[found] == h, counts[found], 0)
                digests.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                sizes.append(len(h))
                prints.append(simhash.majority(h.astype(">i8").view(">u8")))
                sketches.append(sketch(h))
                mins.append(np.array([(h.view(np.uint64) * np.uint64(f)).min() for f in MINS] if len(h) else [], np.uint64).view(np.int64))
                prefixes.append(h[np.lexsort((h, often))[: len(h) - -(-len(h) * num // den) + 1]])
            words = np.array(sketches, np.int64).reshape(-1, WORDS)
            columns = [batch.column("doc"), batch.column("key"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(prints, pa.int64()), *[pa.array(words[:, k]) for k in range(WORDS)]]
            yield pa.RecordBatch.from_arrays([*columns, _lists(mins), _lists(prefixes)], ["doc", "key", "set", "n", "fp", *SKETCH, "mins", "prefix"])
        release_memory()

    kind = texts.schema["doc"].dataType.simpleString()
    words = ", ".join(f"{c} long" for c in SKETCH)
    return texts.select("doc", "key", "text").mapInArrow(run, f"doc {kind}, key binary, set binary, n int, fp long, {words}, mins array<long>, prefix array<long>")


def classes_of(wide: DataFrame) -> DataFrame:
    """One row for each distinct set, with an ``id`` of its own and its least document."""
    kept = [F.first(c).alias(c) for c in ("n", "fp", *SKETCH, "mins", "prefix")]
    sets = materialize(wide.groupBy("set").agg(F.min(F.struct("doc", "key")).alias("least"), *kept), "sets")
    salt = 0
    while True:  # until no two digests get one id
        ids = sets.select("*", F.xxhash64("set", F.lit(salt)).alias("id"))
        if ids.groupBy("id").count().where("count > 1").isEmpty():
            ids.scratch_path = sets.scratch_path
            return ids
        salt += 1


def _enough(shared: Column, n: Column, m: Column, least: Fraction) -> Column:
    """Whether sets of sizes n and m with so many common shingles are similar."""
    return shared.cast("long") * (least.numerator + least.denominator) >= (n.cast("long") + m) * least.numerator


def _room(a: str, b: str, least: Fraction) -> Column:
    """Whether cells ``a`` and ``b`` of one shingle may be the first that two similar sets share.

    What the sets share lies at or after that shingle in both, so enough must be left
    there (the prefix condition for just this pair of sizes), and the sketches may not
    show more shingles of one set only than similar sets have.
    """
    n, m = F.col(f"{a}.n").cast("long"), F.col(f"{b}.n").cast("long")
    apart = sum((F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in SKETCH), F.lit(0))
    close = apart * (least.denominator + least.numerator) <= (n + m) * (least.denominator - least.numerator)
    return close & _enough(n - F.col(f"{a}.at"), n, m, least) & _enough(m - F.col(f"{b}.at"), n, m, least)


def _ends(rows: DataFrame) -> DataFrame:
    """Distinct (u, v) with u < v of the rows' cells ``a`` and ``b``."""
    return rows.select(F.least("a.id", "b.id").alias("u"), F.greatest("a.id", "b.id").alias("v")).distinct()


def _apart(a: str, b: str) -> Column:
    """Bins in which the parities of wide sketches differ; of two sizes the larger is folded once."""
    least = F.least(F.size(a), F.size(b))
    xor = lambda x, y: x.bitwiseXOR(y)
    a, b = (F.when(F.size(c) > least, F.zip_with(F.slice(c, 1, least), F.slice(c, least + 1, least), xor)).otherwise(F.col(c)) for c in (a, b))
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0).cast("long"), lambda n, x: n + x)


def verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, repeated: bool, least: Fraction) -> DataFrame:
    """(u, v) of the pairs whose sets, made anew from the texts, are similar.

    Sketches go to the pairs first; sets are shuffled only for pairs that these leave.
    """
    ends = lambda p: p.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    needed = materialize(classes.select("id", F.col("least.key").alias("key")).join(ends(pairs), "id"), "needed")
    found = texts.join(broadcast_if_small(needed), "key").select("id", "text")
    some = materialize(shingle_sets(found.dropDuplicates(["id"]) if repeated else found), "hashes")
    a, b = (some.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("wide").alias(f"wide_{x}")) for x in "uv")
    n, m = F.col("n_u").cast("long"), F.col("n_v").cast("long")
    sized = _enough(F.least(n, m), n, m, least)  # so that sketches differ by one doubling at most
    close = sized & (_apart("wide_u", "wide_v") * (least.denominator + least.numerator) <= (n + m) * (least.denominator - least.numerator))
    close = materialize(pairs.join(a, "u").join(b, "v").where(close).select("u", "v"), "close")
    left = materialize(ends(close), "left")
    sets = some.join(broadcast_if_small(left), "id", "left_semi")
    a, b = (sets.select(F.col("id").alias(x), F.col("hashes").alias(f"hashes_{x}")) for x in "uv")
    shared = F.size(F.array_intersect("hashes_u", "hashes_v"))
    enough = _enough(shared, F.size("hashes_u"), F.size("hashes_v"), least)
    links = materialize(close.join(a, "u").join(b, "v").where(enough).select("u", "v"), "links")
    discard(needed, some, close, left)
    return links


def fingerprint_pairs(classes: DataFrame) -> DataFrame:
    """(u, v) that connect all classes whose fingerprints are linked, through one class of each fingerprint."""
    heads = materialize(classes.groupBy("fp").agg(F.min("id").alias("head")), "heads")
    same = classes.select("id", "fp").join(heads, "fp").where("id != head").select(F.col("head").alias("u"), F.col("id").alias("v"))
    a, b = (heads.select(F.col("fp").alias(x), F.col("head").alias(f"head_{x}")) for x in "uv")
    linked = simhash.links(heads.select("fp")).join(a, "u").join(b, "v").select(F.least("head_u", "head_v").alias("u"), F.greatest("head_u", "head_v").alias("v"))
    pairs = materialize(same.union(linked), "fingerprint-pairs")
    discard(heads)
    return pairs


def minhash_pairs(classes: DataFrame, groups: DataFrame, least: Fraction) -> DataFrame:
    """(u, v): for each MinHash key, one class that holds it with those of other groups that do."""
    named = classes.select("id", "n", *SKETCH, "mins").join(groups, "id", "left").withColumn("label", F.coalesce("label", "id"))
    keys = named.select("id", "label", F.posexplode("mins").alias("k", "key"))
    first = keys.groupBy("k", "key").agg(F.min_by(F.struct("id", "label"), F.xxhash64("id", "k")).alias("b"), F.min("label").alias("one"), F.max("label").alias("other"))
    first = first.where("one != other").select("k", "key", F.col("b.id").alias("centre"), F.col("b.label").alias("its"))
    pairs = materialize(keys.join(first, ["k", "key"]).where("label != its").select("id", "centre").distinct(), "minpairs")
    sized = classes.select("id", F.lit(0).alias("at"), "n", *SKETCH)
    met = pairs.join(sized.alias("a"), "id").join(sized.withColumnRenamed("id", "centre").alias("b"), "centre").where(_room("a", "b", least))
    found = materialize(met.select(F.least("id", "centre").alias("u"), F.greatest("id", "centre").alias("v")).distinct(), "minhash-pairs")
    discard(pairs)
    return found


def near_links(classes: DataFrame, texts: DataFrame, repeated: bool, least: Fraction) -> DataFrame:
    """(u, v) pairs of class ids that connect all whose sets are similar."""
    tried = fingerprint_pairs(classes)
    links = verified(tried, classes, texts, repeated, least)
    discard(tried)
    groups = components(links).withColumnRenamed("node", "id")
    tried = minhash_pairs(classes, groups, least)
    new = verified(tried, classes, texts, repeated, least)
    links, old = materialize(links.union(new), "links"), [links, new]
    discard(tried, groups, *old)
    groups = components(links).withColumnRenamed("node", "id")
    named = materialize(classes.select("id", "n", *SKETCH, "prefix").join(groups, "id", "left").withColumn("label", F.coalesce("label", "id")), "named")
    discard(groups)
    every = named.select("id", F.posexplode("prefix").alias("at", "h"))
    bare = named.select("label", F.explode("prefix").alias("h"))  # every shingle goes here, so no struct is made for it
    shared = materialize(bare.groupBy("h").agg(F.min("label").alias("one"), F.max("label").alias("other")).where("one != other").select("h"), "shared")
    held = every.join(broadcast_if_small(shared), "h", "left_semi")  # most cells go here, so all that their rows lack comes after
    prev = F.get("prefix", F.col("at") - 1).alias("prev")
    labelled = materialize(held.join(named, "id").select("h", "id", "label", "at", prev, "n", *SKETCH), "cells")
    discard(shared, named)
    before = None
    while True:
        groups = labelled.groupBy("h", "label").agg(F.count(F.lit(1)).cast("double").alias("k"))
        shingles = groups.groupBy("h").agg(
            F.max(F.struct("k", "label"))["label"].alias("largest"), F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("kk"), F.count(F.lit(1)).alias("groups")
        )
        shingles = materialize(shingles.where("groups > 1"), "crowds")
        mixed = materialize(labelled.join(shingles.select("h", "largest"), "h"), "mixed")
        held, work = shingles.agg(F.sum("k"), F.sum((F.col("k") * F.col("k") - F.col("kk")) / 2)).first()
        discard(shingles, labelled)
        if not work or work <= CROWD * held or (before and work > before / 2):
            break
        before = work
        # each shingle has a star centre of its own, so that a crowd is tried against many of its texts
        first = mixed.groupBy("h").agg(F.min_by(F.struct("id", "n", "at", "label", *SKETCH), F.xxhash64("h", "id", F.lit(before))).alias("b"))
        stars = mixed.alias("a").join(first.select("h", "b.*").alias("b"), "h").where((F.col("a.label") != F.col("b.label")) & _room("a", "b", least))
        stars = materialize(_ends(stars), "starpairs")
        new = verified(stars, classes, texts, repeated, least)
        links, old = materialize(links.union(new), "starlinks"), [links, new]
        discard(stars, *old)
        labels = components(links).withColumnRenamed("node", "id")
        labelled = materialize(mixed.drop("label", "largest").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")), "labelled")
        discard(mixed)
    others = mixed.where("label != largest").alias("a").join(mixed.alias("b"), "h")
    once = (F.col("b.label") == F.col("b.largest")) | (F.col("a.label") < F.col("b.label"))
    first = F.coalesce(F.col("a.prev") != F.col("b.prev"), F.lit(True))  # else both hold an earlier shingle in common, which pairs them
    others = others.where((F.col("a.label") != F.col("b.label")) & once & first & _room("a", "b", least))
    pairs = materialize(_ends(others), "pairs")
    discard(mixed)
    found = verified(pairs, classes, texts, repeated, least)
    discard(pairs)
    return links.union(found)


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = 0.8) -> DataFrame:
    """One row of each near-duplicate group, with the columns of ``docs``."""
    least = Fraction(str(similarity))
    texts = docs.select(F.col(id_col).alias("doc"), row_key(id_col, text).alias("key"), F.col(text).alias("text"))
    wide = materialize(profiles(texts, least), "profiles")
    classes = classes_of(wide)
    times = materialize(wide.groupBy("key").agg(F.count(F.lit(1)).alias("times")), "times")
    discard(wide)
    repeated = not times.where("times > 1").isEmpty()
    labels = components(near_links(classes, texts.select("key", "text"), repeated, least))
    named = classes.select("id", "least").join(labels.withColumnRenamed("node", "id"), "id", "left")
    kept = named.groupBy(F.coalesce("label", "id").alias("g")).agg(F.min("least")["key"].alias("key"))
    kept = materialize(kept.select("key").distinct().join(times, "key"), "kept")
    discard(classes, times, labels)
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    found = docs.select(own, row_key(id_col, text).alias("key")).join(broadcast_if_small(kept), "key")
    repeated = found.where("times > 1").groupBy("key").agg(F.first("row").alias("row")).select("row")
    return found.where("times = 1").select("row").union(repeated).select(*[F.col("row")[c].alias(c) for c in docs.columns])
