"""Extendible hashing: shards that split only where they are too large.

Every row has a 63-bit address: 32 bits of its key's MD5, then 31 bits of a row
number's hash, so that one hot key can still be split.  A directory indexed by
address prefixes starts at one bucket; a bucket above the byte limit is split on
its next bit, until each fits or holds a single row.  The directory is built from
sums per prefix, a stage of bits at a time: rows are summed once per stage, and
only the cells of oversized buckets go on to the next stage.

Defined cases: null keys share one key; null sizes count as zero bytes; repeated
rows are placed one by one; a single row above the limit is a shard of its own;
an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tidewell.plans.scratch import broadcast_if_small, materialize

BITS, KEY_BITS, STAGE_BITS = 63, 32, 8


def key_bits(key: Column) -> Column:
    """The first 32 bits of the MD5 of a key as text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")


def _prefix(address: Column, depth: int) -> Column:
    return F.shiftright(address, BITS - depth)


def _stage(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """(cell, depth): the leaf depth of each cell at ``high`` bits, null where it still is oversized."""
    levels = F.explode(F.sequence(F.lit(low), F.lit(high)))
    sums = (
        cells.select("cell", "bytes", "rows", levels.alias("level"))
        .groupBy("level", F.expr(f"shiftright(cell, {high} - level)").alias("prefix"))
        .agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    )
    large = sums.where((F.col("bytes") > limit) & (F.col("rows") > 1)).select("level", "prefix")
    paths = cells.select("cell", levels.alias("level")).withColumn("prefix", F.expr(f"shiftright(cell, {high} - level)"))
    deepest = paths.join(large, ["level", "prefix"]).groupBy("cell").agg(F.max("level").alias("large"))
    depth = F.coalesce(F.col("large") + 1, F.lit(low))
    return cells.join(deepest, "cell", "left").select("cell", F.when(depth <= high, depth).alias("depth"))


def extendible_shards(df: DataFrame, key: str, size: Column, limit: int) -> DataFrame:
    """``df`` with ``shard`` (the bucket's address bits as text) and ``shard_depth``.

    ``df`` should be narrow: it is written once, so that row numbers stay fixed.
    """
    row_bits = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), BITS - KEY_BITS + 2)
    address = F.shiftleft(key_bits(F.col(key)), BITS - KEY_BITS).bitwiseOR(row_bits)
    own = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    rows = materialize(df.select(own, F.coalesce(size.cast("long"), F.lit(0)).alias("bytes"), address.alias("address")), "shards")
    total = rows.agg(F.sum("bytes").alias("b")).first().b or 0
    low, high = 0, min(20, max(1, math.ceil(math.log2(max(1, 4 * total / limit)))))
    placed, left, depth = rows, rows, F.lit(None).cast("int")
    while True:
        cells = left.groupBy(_prefix(F.col("address"), high).alias("cell")).agg(
            F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows")
        )
        cells = materialize(cells, "cells")
        stage = materialize(_stage(cells, low, high, limit), "directory")
        if high == BITS:
            stage = stage.withColumn("depth", F.coalesce("depth", F.lit(BITS)))
        name = f"d{high}"
        table = broadcast_if_small(stage.select(F.col("cell").alias(f"c{high}"), F.col("depth").alias(name)))
        placed = placed.join(table, _prefix(F.col("address"), high) == F.col(f"c{high}"), "left").drop(f"c{high}")
        depth = F.coalesce(depth, F.col(name))
        deep = stage.where("depth IS NULL").select(F.col("cell").alias("c"))
        if high == BITS or deep.isEmpty():
            break
        left = left.join(broadcast_if_small(deep), _prefix(F.col("address"), high) == F.col("c"), "left_semi")
        low, high = high + 1, min(BITS, high + STAGE_BITS)
    bits = F.expr(f"lpad(bin(address), {BITS}, '0')")
    return placed.withColumn("shard_depth", depth).select(
        *[F.col("row")[c].alias(c) for c in df.columns],
        F.substring(bits, F.lit(1), F.col("shard_depth")).alias("shard"),
        "shard_depth",
    )
