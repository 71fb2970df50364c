"""Interaction audit of document filters by direct relational replay.

Which filter removes a document depends on the order in which filters run.  Every
document's five failures are crossed with all 120 orders (a broadcast table of
fixed size), the first failing step follows from the order's masks, the five steps
are exploded, and conditional counts per part, order and step are combined on the
map side before they meet.  A filter's share over all orders (its Shapley value times
120) comes from the counts, 120 rows per part and filter.

Failures travel as one small integer per document, so texts are read once and never
shuffled.  For filter E the smallest id of each repeated text is joined back by
SHA-256.  Rows are dealt by ranges of (part, hash of the id) before they are crossed:
a task then holds few parts, so it combines well, and a part that holds most rows is
cut across tasks.

Defined cases: a null text is empty; an empty text has no words, fails A only (and E as
any repeat); a null part is the empty string; a null id has no label and is neither
smaller nor larger than another, so it never fails E nor makes others fail; rows with
one id and equal texts do not fail E by each other; repeated rows each count; labels
that repeat an id count if any of them does; empty tables give an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F

from tidewell.llm.text import UPPER, plain_words_col
from tidewell.plans.scratch import broadcast_if_small, discard, materialize

FILTERS = "ABCDE"
#: Rows that one task crosses with the orders at most, but for the accidents of sampling.
TASK_ROWS = 500_000


def failures(text: Column) -> dict[str, Column]:
    """Conditions under which a document fails filters A to D."""
    words = plain_words_col(text)
    n_upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * n_upper > 5 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def own_failures(docs: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(id, part, bits, digest) per document; bit k of ``bits`` is the failure of the k-th filter, E's left out."""
    body = F.coalesce(F.col(text), F.lit("")).alias("body")
    named = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), body)
    bits = sum(F.when(c, 1 << FILTERS.index(k)).otherwise(0) for k, c in failures(F.col("body")).items())
    return named.select("id", "part", bits.alias("bits"), F.unhex(F.sha2("body", 256)).alias("digest"))


def failure_masks(known: DataFrame, labels: DataFrame) -> DataFrame:
    """``own_failures`` with E and labels joined: (part, spread, mask, good, toxic) per document."""
    repeated = known.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # Written first, so that both sides of the join are dealt anew and a hot text can be split.
    repeated = broadcast_if_small(materialize(repeated.select("digest", "first"), "repeated"))
    marked = known.join(repeated, "digest", "left")
    later = F.when(F.col("id") > F.col("first"), 1 << FILTERS.index("E")).otherwise(0)
    labelled = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id"))
    labelled = labelled.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    joined = marked.select("id", "part", (F.col("bits") + later).alias("mask")).join(labelled, "id", "left")
    is_set = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    return joined.select("part", F.xxhash64("id").alias("spread"), "mask", *is_set)


def orders_of(docs: DataFrame) -> DataFrame:
    """(filter_order, masks): all 120 orders, with the bit of each step's filter."""
    rows = [F.struct(F.lit("".join(p)).alias("filter_order"), F.array(*[F.lit(1 << FILTERS.index(f)) for f in p]).alias("masks")) for p in permutations(FILTERS)]
    return docs.sparkSession.range(1).select(F.inline(F.array(*rows)))


def replay(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Counts per (part, filter_order, step), as the contract of op13 names them, and the step's ``filter``."""
    spark = docs.sparkSession
    known = materialize(own_failures(docs, id_col, text, part), "failures")
    masks = materialize(failure_masks(known, labels), "masks")
    discard(known)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), masks.count() // TASK_ROWS + 1)
    dealt = masks.repartitionByRange(tasks, "part", "spread")
    first = F.lit(6)
    for s in range(5, 0, -1):
        first = F.when(F.col("mask").bitwiseAND(F.col("masks")[s - 1]) != 0, s).otherwise(first)
    crossed = dealt.crossJoin(F.broadcast(orders_of(docs))).withColumn("first", first)
    steps = crossed.select("part", "filter_order", "mask", "good", "toxic", "first", F.posexplode("masks").alias("k", "own"))
    steps = steps.withColumn("step", F.col("k") + 1)
    here, fails = F.col("first") == F.col("step"), F.col("mask").bitwiseAND(F.col("own")) != 0
    counts = {
        "kept": F.col("first") > F.col("step"),
        "removed": here,
        "redundant": fails & (F.col("first") < F.col("step")),
        "unique_fails": F.col("mask") == F.col("own"),
        "good_lost": here & F.col("good"),
        "toxic_lost": here & F.col("toxic"),
    }
    counted = steps.groupBy("part", "filter_order", "step").agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    counted = materialize(counted.withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1))), "replayed")
    discard(masks)
    shares = counted.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return counted.join(shares, ["part", "filter"]).select("part", "filter_order", "step", "filter", *counts, "shapley")
