"""Quality rules judged per document and per host.

Each document gets signals and rule failures.  Failures are aggregated by host,
host rates are shrunk towards all hosts with an empirical beta prior (method of
moments), and the verdict is joined back: a document of a failing host must also
pass the soft rules, while its clean documents stay.

Defined cases: a null or empty text has no words and fails; a null host is never
judged, its documents only face the base rules; repeated rows count as often as
they occur; an empty table gives an empty result; other columns pass through
untouched, whatever their names (signals live in one struct column).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType, StructField, StructType

from tidewell.llm.text import drop_caches, encode
from tidewell.plans.scratch import broadcast_if_small, materialize

SIGNALS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOL = bytes(b for b in range(256) if b not in _SYMBOLS)
#: All bytes but UTF-8 continuation bytes: without them a code point count is a length.
_LEADING = bytes(b for b in range(256) if not 0x80 <= b < 0xC0)


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more in ``words``."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    v = len(seen)
    pairs = ids[:-2] * v + ids[1:-1]
    if v >= 2_000_000:  # three ids would not fit into 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    grams = pairs * v + ids[2:]
    ordered = np.sort(grams)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(grams, np.unique(twice)))
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[at + k] = True
    return int(hit.sum())


def _signals(text: str | None) -> tuple[int, int, int, int, int]:
    data = encode(text)
    words = data.split()
    chars = sum(map(len, words)) - len(data.translate(None, _LEADING))
    lines = data.split(b"\n")
    worded = [x for x in lines if x and not x.isspace()]
    return (
        len(words),
        chars,
        len(data.translate(None, _NOT_SYMBOL)),
        len(worded) - len(set(worded)),
        repeated_words(words),
    )


def _signals_of(text: pd.Series) -> pd.DataFrame:
    drop_caches()
    return pd.DataFrame([_signals(t) for t in text], columns=SIGNALS, dtype="int64")


_TYPE = StructType([StructField(c, LongType()) for c in SIGNALS])
quality_signals = pandas_udf(_signals_of, _TYPE)
#: For rows that a filter on the signals follows: pushed below them it would have each task compute
#: them twice, by two Python workers at a time.
signals_once = pandas_udf(_signals_of, _TYPE).asNondeterministic()


def base_failed(q: Column, min_words: int = 50, max_repeat_pct: int = 50) -> Column:
    """The hard rules: too short, or mostly repeated 3-word windows."""
    return (q["n_words"] < min_words) | (100 * q["n_repeat_words"] > max_repeat_pct * q["n_words"])


def soft_failed(q: Column, max_symbol_pct: int = 25, max_dup_lines: int = 10, mean_word: tuple[int, int] = (2, 20)) -> Column:
    """The rules that only documents of a failing host must pass as well."""
    return (
        (100 * q["n_symbols"] > max_symbol_pct * q["n_words"])
        | (q["n_dup_lines"] > max_dup_lines)
        | (q["word_chars"] < mean_word[0] * q["n_words"])
        | (q["word_chars"] > mean_word[1] * q["n_words"])
    )


def host_verdicts(judged: DataFrame, host: str = "host", failed: str = "failed", max_rate: float = 0.5) -> DataFrame:
    """(host, host_docs, host_failed, host_rate, host_bad) of non-null hosts.

    The prior is Beta(m*k, (1-m)*k) with the pooled rate m and
    k = m*(1-m)/v - 1, v the document-weighted variance of host rates, k between
    1 and 1e6 (no spread between hosts: 1e6).
    """
    hosts = (
        judged.where(F.col(host).isNotNull())
        .groupBy(F.col(host).alias("host"))
        .agg(F.count(F.lit(1)).alias("host_docs"), F.count_if(failed).alias("host_failed"))
    )
    hosts = materialize(hosts, "hosts")
    n, f = F.col("host_docs").cast("double"), F.col("host_failed").cast("double")
    moments = hosts.agg(F.sum(n).alias("n"), F.sum(f).alias("f"), F.sum(f * f / n).alias("ff"))
    m, v = F.col("f") / F.col("n"), F.col("ff") / F.col("n") - (F.col("f") / F.col("n")) ** 2
    k = F.when(v <= 1e-12, 1e6).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(1e6), m * (1 - m) / v - 1)))
    prior = moments.where("n > 0").select(m.alias("m"), k.alias("k"))
    rate = (f + F.col("m") * F.col("k")) / (n + F.col("k"))
    return hosts.join(F.broadcast(prior)).select(
        "host", "host_docs", "host_failed", rate.alias("host_rate"), (rate > max_rate).alias("host_bad")
    )


def judge(signals: DataFrame, host: str, quality: str, max_rate: float = 0.5) -> DataFrame:
    """Add ``base_failed``, ``host_rate``, ``host_bad`` and ``kept`` to rows with signals."""
    q = F.col(quality)
    failed = F.coalesce(base_failed(q) | soft_failed(q), F.lit(True))
    verdicts = host_verdicts(signals.select(F.col(host).alias("host"), failed.alias("failed")), max_rate=max_rate)
    verdicts = broadcast_if_small(verdicts.select(F.col("host").alias("__host"), "host_rate", "host_bad"))
    bad = F.coalesce(F.col("host_bad"), F.lit(False))
    return (
        signals.join(verdicts, F.col(host) == F.col("__host"), "left")
        .withColumn("base_failed", base_failed(q))
        .withColumn("kept", ~base_failed(q) & ~(bad & soft_failed(q)))
        .drop("__host")
    )


def document_quality(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row per document: id, host, signals and verdicts; texts are read once."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(host).alias("host"), quality_signals(F.col(text)).alias("q"))
    return judge(materialize(narrow, "quality"), "host", "q")


def keep_good(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The documents that pass, with their own columns only.

    Signals are computed twice (host rates first, then the filter), which costs
    CPU but writes no copy of the texts.
    """
    cols = docs.columns
    own = F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row")
    rows = docs.select(own, F.col(host).alias("host"), signals_once(F.col(text)).alias("q"))
    q = F.col("q")
    failed = base_failed(q) | soft_failed(q)
    verdicts = host_verdicts(docs.select(F.col(host).alias("host"), quality_signals(F.col(text)).alias("q")).select("host", failed.alias("failed")))
    verdicts = broadcast_if_small(verdicts.select(F.col("host").alias("__host"), "host_bad"))
    bad = F.coalesce(F.col("host_bad"), F.lit(False))
    kept = rows.where(~base_failed(q)).join(verdicts, F.col("host") == F.col("__host"), "left").where(~(bad & soft_failed(q)))
    return kept.select(*[F.col("row")[c].alias(c) for c in cols])
