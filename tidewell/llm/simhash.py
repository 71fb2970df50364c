"""SimHash near-duplicates with multi-index hashing.

A fingerprint is the bitwise majority of the XXH64 values (seed 42) of a text's
word shingles.  Distinct fingerprints are classes; classes that differ in at most
``radius`` bits are linked and linked classes form components.

Search (radius two): a fingerprint is cut into two segments of 32 bits, so that
two classes within the radius differ by one bit at most in some segment.  Every
class probes each segment's table with the Hamming ball of radius one around its
own segment (only bits that are 0 are raised: of two segments that differ by one
bit exactly one finds the other), fetches the matches and verifies the whole
distance.  A segment value shared by more than ``bucket_cap`` classes is not
paired off: the classes in it and those that probe it are linked exactly through
shared midpoints instead, i.e. all fingerprints one flip away serve as keys, and
classes under one key (at most two bits apart) link to the smallest of them.

Defined cases: a null or empty text has fingerprint zero and is linked like any
other; fewer words than a shingle form one shingle; copies and repeated rows are
one class; a null id never is a component's id unless all its ids are null; an
empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from tidewell.llm.components import components
from tidewell.llm.text import encode
from tidewell.plans.scratch import discard, materialize


def fingerprint(text: str | None, size: int = 3) -> int:
    """Signed 64-bit SimHash of lower-cased (A-Z) plain-word shingles, repeats included."""
    words = encode(text).lower().split()
    if not words:
        return 0
    if len(words) <= size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(s, 42) for s in shingles], dtype=">u8"))


def majority(h: np.ndarray) -> int:
    """Bits set in over half of the big-endian unsigned hashes, as a signed number."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(h), 8192):
        part = h[at : at + 8192]
        votes += np.unpackbits(part.view(np.uint8)).reshape(len(part), 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h)).view(">i8")[0])


def fingerprint_udf(size: int):
    @pandas_udf(LongType())
    def simhash(text: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, size) for t in text], dtype="int64")

    return simhash


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _segments(segments: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment, low bits first."""
    cuts = [64 * k // segments for k in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _segment(fp: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def _table(fps: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    keys = [F.struct(F.lit(k).alias("seg"), _segment(F.col("fp"), *c).alias("key")) for k, c in enumerate(cuts)]
    return fps.select("fp", F.inline(F.array(*keys)))


def _ball(seg: int, shift: int, width: int) -> Column:
    own = _segment(F.col("fp"), shift, width)
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b).cast("long") for b in range(width)])
    zeros = F.filter(flips, lambda x: own.bitwiseAND(x) == 0)
    return F.transform(zeros, lambda x: F.struct(F.lit(seg).alias("seg"), own.bitwiseOR(x).alias("key")))


def _probes(fps: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """Own segment values, and those with one more bit set."""
    return fps.select("fp", F.inline(F.concat(*[_ball(k, *c) for k, c in enumerate(cuts)])))


def _midpoint_links(fps: DataFrame) -> DataFrame:
    """Exact links of distance up to two without a pair join: star edges per shared key."""
    flips = F.array(F.lit(0).cast("long"), *[F.expr(f"shiftleft(1L, {b})") for b in range(64)])
    keys = fps.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("key"))
    least = keys.groupBy("key").agg(F.min("fp").alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return keys.join(least, "key").where("fp != m").select(F.col("m").alias("u"), F.col("fp").alias("v")).distinct()


def links(fps: DataFrame, bucket_cap: int = 64) -> DataFrame:
    """(u, v) pairs of distinct fingerprints (column ``fp``) that connect all within two bits."""
    cuts = _segments(2)
    table = _table(fps, cuts)
    sizes = materialize(table.groupBy("seg", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    hot = sizes.where(F.col("n") > bucket_cap).select("seg", "key")
    probes = _probes(fps, cuts)
    if hot.isEmpty():
        cold, dense = table, None
    else:
        cold = table.join(hot, ["seg", "key"], "left_anti")
        dense = materialize(
            table.union(probes).join(hot, ["seg", "key"], "left_semi").select("fp").distinct(), "dense"
        )
    found = (
        probes.join(cold.withColumnRenamed("fp", "other"), ["seg", "key"])
        .where((F.col("fp") != F.col("other")) & (distance(F.col("fp"), F.col("other")) <= 2))
        .select(F.least("fp", "other").alias("u"), F.greatest("fp", "other").alias("v"))
    )
    return found.distinct() if dense is None else found.union(_midpoint_links(dense)).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 3, bucket_cap: int = 64) -> DataFrame:
    """(doc_id, fp, component_id) per row; component_id is the smallest id reachable."""
    marked = docs.select(F.col(id_col).alias("doc_id"), fingerprint_udf(size)(F.col(text)).alias("fp"))
    marked = materialize(marked, "simhash")
    classes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    labels = components(links(classes.select("fp"), bucket_cap))
    labelled = classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left")
    named = materialize(labelled.select("fp", "least", F.coalesce("label", "fp").alias("label")), "labels")
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    by_class = named.join(least, "label").select("fp", "component_id")
    return marked.join(by_class, "fp", "left")
