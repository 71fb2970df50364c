"""Prediction by partial matching over a byte-context trie, pretrained on a corpus.

The model is an order-``ORDER`` suffix trie of byte contexts (a start mark pads, an
end mark closes a text).  A symbol is coded in the longest context seen; unseen
there, the escape (method C: as many counts as distinct symbols) leads to the next
shorter context, from which the symbols of the longer one are excluded; below the
empty context all other symbols are equally likely.  Counts come from all training
texts.  The model reads a text's bytes as they are; only the words of the base score are
lower-cased.

Documents are dealt to shards of ``SHARD_BYTES`` of text.  A shard's distinct
(context, symbol) grams and words are counted, summed over all shards, turned into
log-probabilities (a group is one two-byte context's subtree, 257**3 grams and counts of
eight bytes at most, worked out in parts; the orders below are 257**2 counts) and joined back to the shards that hold
them.  No model is broadcast whole.

Defined cases: a null or empty text is its end mark; a null id counts as the empty
string and so is held out (remainder 0); repeated rows count as often as they
occur; with no training text every symbol has probability 1/257 and base scores use
N = V = 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewell.llm.text import encode
from tidewell.plans.scratch import materialize

ORDER, SHARD_BYTES, CHUNK = 4, 16 << 20, 1 << 21
#: Grams whose probabilities are worked out at once.
PART = 1 << 20
START, STOP, SYMBOLS = 256, 257, 257
#: Stands for the end token among words; white space is no word.
END_WORD = b"\n"


def grams_of(text: bytes) -> np.ndarray:
    """Each symbol with the ``ORDER`` symbols before it, nine bits each, newest lowest."""
    a = np.empty(len(text) + ORDER + 1, np.int64)
    a[:ORDER], a[-1] = START, STOP
    a[ORDER:-1] = np.frombuffer(text, np.uint8)
    n = len(text) + 1
    out = a[:n]
    for k in range(1, ORDER + 1):
        out = (out << 9) | a[k : k + n]
    return out


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def _counts(table: pa.Table) -> pa.Table:
    """Distinct grams and words of a shard with their training counts."""
    parts, words, waiting, size = [], Counter(), {True: [], False: []}, 0

    def flush() -> None:
        for train, found in waiting.items():
            if found:
                keys, n = np.unique(np.concatenate(found), return_counts=True)
                parts.append((keys, n * train))
                found.clear()
        if len(parts) > 16:
            parts[:] = [_merged(parts)]

    for text, held in zip(table.column("text"), table.column("held_out"), strict=True):
        data, train = encode(text.as_py()), not held.as_py()
        tokens = data.lower().split()
        tokens.append(END_WORD)
        if train:
            words.update(tokens)
        else:
            words.update(dict.fromkeys(tokens, 0))
        waiting[train].append(grams_of(data))
        size += len(data)
        if size > CHUNK:
            flush()
            size = 0
    flush()
    keys, n = _merged(parts)
    shard, g = table.column("shard")[0].as_py(), len(keys)
    return pa.table(
        {
            "shard": pa.array(np.full(g + len(words), shard, np.int32)),
            "gram": pa.concat_arrays([pa.array(keys), pa.nulls(len(words), pa.int64())]),
            "word": pa.concat_arrays([pa.nulls(g, pa.binary()), pa.array(list(words), pa.binary())]),
            "n": pa.concat_arrays([pa.array(n), pa.array(list(words.values()), pa.int64())]),
        }
    )


def subtree(gram: np.ndarray, n: np.ndarray, one: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """``code_lengths`` of all grams below one two-symbol context, taken some ``PART`` grams at a time.

    A part holds whole three-symbol contexts, so only the counts of the two-symbol context are shared.
    """
    two, third = np.bincount(gram & 511, n, 512), (gram >> 27) & 511
    order = np.argsort(third, kind="stable")
    ends = np.cumsum(np.bincount(third, minlength=512))
    out, at = np.empty(len(gram)), 0
    while at < len(gram):
        end = int(ends[min(np.searchsorted(ends, at + PART), 511)])
        end = end if end > at else len(gram)
        own = order[at:end]
        out[own] = code_lengths(gram[own], n[own], one, zero, two)
        at = end
    return out


def code_lengths(gram: np.ndarray, n: np.ndarray, one: np.ndarray, zero: np.ndarray, two: np.ndarray | None = None) -> np.ndarray:
    """log10 probabilities of grams below one two-symbol context.

    ``n`` are training counts, ``one`` the counts of symbols after the last symbol of
    the context, ``zero`` those of all symbols, ``two`` those after the context itself
    (of the given grams where it is not given); all have 512 places.
    """
    s = gram & 511
    levels = []  # per order: count of the symbol, context total, distinct, count left below by its symbols
    key4, i4 = np.unique(gram >> 9, return_inverse=True)
    key3, i3 = np.unique(gram & ((1 << 36) - 1), return_inverse=True)
    n3 = np.bincount(i3, n, len(key3))
    c3, j3 = np.unique(key3 >> 9, return_inverse=True)
    at3 = j3[i3]
    n2 = np.bincount(s, n, 512) if two is None else two
    seen, seen3 = n > 0, n3 > 0
    s3 = key3 & 511
    levels.append((n, np.bincount(i4, n)[i4], np.bincount(i4, seen)[i4], np.bincount(i4, n3[i3] * seen)[i4]))
    levels.append((n3[i3], np.bincount(j3, n3)[at3], np.bincount(j3, seen3)[at3], np.bincount(j3, n2[s3] * seen3)[at3]))
    for own, below in ((n2, one), (one, zero), (zero, np.zeros(512))):
        full = [np.full(len(gram), float(x)) for x in (own.sum(), (own > 0).sum(), below[own > 0].sum())]
        levels.append((own[s], *full))
    out, open_ = np.zeros(len(gram)), np.ones(len(gram), bool)
    gone_total, gone = np.zeros(len(gram)), np.zeros(len(gram))
    for count, total, distinct, below in levels:
        left, kinds = total - gone_total, distinct - gone
        live = open_ & (left > 0)
        hit = live & (count > 0)
        miss = live & ~hit
        out[hit] += np.log10(count[hit] / (left + kinds)[hit])
        out[miss] += np.log10(kinds[miss] / (left + kinds)[miss])
        open_ &= ~hit
        known = total > 0
        gone_total = np.where(known, below, gone_total)
        gone = np.where(known, distinct, gone)
    out[open_] -= np.log10(SYMBOLS - (zero > 0).sum())
    return out


def _held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def _gram_model(grams: DataFrame) -> DataFrame:
    """(gram, value): log10 probability of every gram that occurs."""
    low = np.zeros((512, 512))
    for r in grams.groupBy((F.col("gram") % (1 << 18)).alias("g")).agg(F.sum("n").alias("n")).collect():  # 257**2 rows at most
        low[r.g >> 9, r.g & 511] = r.n
    zero = low.sum(axis=0)

    def run(table: pa.Table) -> pa.Table:
        gram, n = table.column("gram").to_numpy(), table.column("n").to_numpy()
        one = low[(int(gram[0]) >> 9) & 511]
        return pa.table({"gram": pa.array(gram), "value": pa.array(subtree(gram, n, one, zero))})

    context = F.shiftright("gram", 9).bitwiseAND(F.lit((1 << 18) - 1)).alias("context")
    return grams.select("gram", "n", context).groupBy("context").applyInArrow(run, "gram long, value double")


def _scores(docs: pa.Table, model: pa.Table) -> pa.Table:
    gram, value = model.column("gram"), model.column("value").to_numpy()
    is_gram = gram.is_valid().to_numpy()
    keys, logs = gram.filter(gram.is_valid()).to_numpy(), value[is_gram]
    order = np.argsort(keys)
    keys, logs = keys[order], logs[order]
    count = dict(zip(model.column("word").filter(gram.is_null()).to_pylist(), value[~is_gram].tolist(), strict=True))
    rows = []
    for text in docs.column("text"):
        data = encode(text.as_py())
        tokens = data.lower().split()
        tokens.append(END_WORD)
        c = np.fromiter(map(count.__getitem__, tokens), float, len(tokens))
        score = sum(float(logs[np.searchsorted(keys, g)].sum()) for g in np.array_split(grams_of(data), len(data) // CHUNK + 1))
        rows.append((len(tokens), int((c > 0).sum()), float(np.log10(c + 0.1).sum()), score))
    columns = list(zip(*rows, strict=True)) if rows else [()] * 4
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base", "score"]
    return pa.table([docs.column("doc_id"), docs.column("held_out"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=names)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row."""
    kind = docs.schema[id_col].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    shard = F.pmod(F.xxhash64(F.col(id_col), F.col(text)), F.lit(size // SHARD_BYTES + 1)).cast("int")
    sharded = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), _held_out(F.col(id_col)).alias("held_out"), shard.alias("shard"))
    counts = materialize(sharded.groupBy("shard").applyInArrow(_counts, "shard int, gram long, word binary, n long"), "counts")
    grams = materialize(counts.where("gram IS NOT NULL").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    words = materialize(counts.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")), "words")
    totals = words.agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    n, v = totals.n or 0, totals.v or 0
    model = materialize(_gram_model(grams), "model")
    by_gram = counts.where("gram IS NOT NULL").select("shard", "gram").join(model, "gram")
    by_word = counts.where("word IS NOT NULL").select("shard", "word").join(words, "word")
    needed = by_gram.select("shard", "gram", F.lit(None).cast("binary").alias("word"), "value").union(
        by_word.select("shard", F.lit(None).cast("long").alias("gram"), "word", F.col("n").cast("double").alias("value"))
    )
    scored = sharded.groupBy("shard").cogroup(needed.groupBy("shard")).applyInArrow(
        _scores, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double"
    )
    norm = float(np.log10(n + 0.1 * (v + 1)))
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(norm)).alias("base_score"), "score",
    )
