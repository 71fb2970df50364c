"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

Windows of a benchmark item (``window`` words, a shorter item is one window) are
sets of positioned word shingles.  Documents' shingles are looked up in the
benchmark's shingles; their frequency there orders each window's shingles by
rarity, and as a window must be contained whole, its rarest shingle is the whole
necessary prefix.  Documents that hold it give a candidate start, which must leave
room for the window (length bound) and start at the matching offset (positional
bound); it is verified by the presence of shingles that cover every word.

Defined cases: null texts have no words; items without words have no windows;
repeated items and items that share windows count each; repeated documents are
judged alike (documents are told apart by the MD5 of id and text); empty tables give no hits;
other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewell.llm.text import letter_words_col, row_key
from tidewell.plans.scratch import broadcast_if_small, discard, materialize

SHINGLE = 3


def windows_of(items: DataFrame, id_col: str, text: str, window: int) -> DataFrame:
    """(item_id, win, len, words) of all windows of all items."""
    words = items.select(F.col(id_col).alias("item_id"), letter_words_col(F.col(text)).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - window))
    cut = words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i + 1, window))).alias("words"))
    return cut.select("item_id", F.array_join("words", " ").alias("win"), F.size("words").alias("len"), "words").distinct()


def _shingled(words: Column, size: int) -> Column:
    n = F.size(words) - size
    at = F.sequence(F.lit(0), F.greatest(n, F.lit(0)))
    return F.when(n >= 0, F.transform(at, lambda i: F.array_join(F.slice(words, i + 1, size), " "))).otherwise(F.array())


def _doc_shingles(words: Column, size: int) -> Column:
    """Shingles by position; the last ``size - 1`` entries are shorter and match nothing of that size."""
    if size == 1:
        return words
    return F.transform(words, lambda w, i: F.concat_ws(" ", w, *[F.get(words, i + k) for k in range(1, size)]))


def window_hits(docs: DataFrame, items: DataFrame, id_col: str, text: str, item_id: str, item_text: str, window: int) -> DataFrame:
    """(key, start, len, win) of every verified window occurrence, and the windows table."""
    wins = materialize(windows_of(items, item_id, item_text, window), "windows")
    distinct = wins.select("win", "len", "words").distinct()
    sizes = [r[0] for r in distinct.select(F.least("len", F.lit(SHINGLE)).alias("k")).distinct().collect()]
    parts = [
        distinct.where(F.least("len", F.lit(SHINGLE)) == k).select("win", "len", F.posexplode(_shingled(F.col("words"), k)).alias("off", "shingle"))
        for k in sizes
    ]
    if not parts:
        return None, wins
    tokens = parts[0]
    for p in parts[1:]:
        tokens = tokens.union(p)
    tokens = materialize(tokens, "tokens")
    vocabulary = broadcast_if_small(tokens.select("shingle").distinct())
    worded = docs.select(row_key(id_col, text).alias("key"), letter_words_col(F.col(text)).alias("w"))
    seen = None
    for k in sizes:
        one = worded.select("key", F.size("w").alias("n_words"), F.posexplode(_doc_shingles(F.col("w"), k)).alias("pos", "shingle"))
        one = one.join(vocabulary, "shingle", "left_semi")
        seen = one if seen is None else seen.union(one)
    hits = materialize(seen, "hits")
    rarity = hits.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
    ranked = tokens.join(rarity, "shingle", "left")
    rarest = ranked.groupBy("win", "len").agg(
        F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), F.col("off"), F.col("shingle"))).alias("p")
    )
    prefixes = materialize(rarest.where("p.df > 0").select("win", "len", F.col("p.off").alias("off"), F.col("p.shingle").alias("shingle")), "prefix")
    prefixes = broadcast_if_small(prefixes)
    candidates = hits.join(prefixes, "shingle").where("pos >= off AND pos - off + len <= n_words").select("key", (F.col("pos") - F.col("off")).alias("start"), "len", "win").distinct()
    k = F.least("len", F.lit(SHINGLE))
    # every third shingle and the last one cover all words of a window
    cover = tokens.where(((F.col("off") % SHINGLE) == 0) | (F.col("off") == F.col("len") - k))
    need = cover.groupBy("win").agg(F.count(F.lit(1)).alias("need"))
    cover = broadcast_if_small(cover.join(need, "win").select("win", "off", "shingle", "need"))
    wanted = candidates.join(cover, "win").select("key", "start", "len", "win", "need", (F.col("start") + F.col("off")).alias("pos"), "shingle")
    found = wanted.join(hits.select("key", "pos", "shingle").distinct(), ["key", "pos", "shingle"], "left_semi")
    verified = found.groupBy("key", "start", "len", "win").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need"))
    verified = materialize(verified.where("n = need").select("key", "start", "len", "win"), "verified")
    discard(hits)
    return verified, wins


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13) -> DataFrame:
    """(key, n_hit, item_ids) of documents with hits."""
    found, wins = window_hits(docs, items, id_col, text, item_id, item_text, window)
    if found is None:
        return docs.sparkSession.createDataFrame([], "key binary, n_hit long, item_ids array<string>")
    covered = found.select("key", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("pos")).distinct()
    counts = covered.groupBy("key").agg(F.count(F.lit(1)).alias("n_hit"))
    owners = broadcast_if_small(wins.select("win", F.col("item_id").cast("string").alias("item")))
    ids = found.select("key", "win").distinct().join(owners, "win").groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    return counts.join(ids, "key", "left")


def judged(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", **named: str) -> DataFrame:
    """All rows of ``docs`` as struct ``row``, with n_words, n_hit, item_ids and contaminated."""
    hits = contamination(docs, items, id_col, text, **named)
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    words = docs.select(own, row_key(id_col, text).alias("key"), F.size(letter_words_col(F.col(text))).cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0))
    return words.join(hits, "key", "left").select(
        "row",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, **named: str) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    kept = judged(docs, items, **named).where(~F.col("contaminated"))
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
