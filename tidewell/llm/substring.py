"""Exact substring de-duplication with repeated-phrase automata.

A *window* is ``window`` consecutive plain words.  Every window owns an anchor,
the ``ANCHOR``-word phrase in it with the least hash (leftmost on ties), so two
windows of equal words own equal anchors.

1. Anchors are counted over the whole corpus by their hash; those found twice are taken
   for recurring phrases, and each shard of documents learns one place of each that it
   holds.  Equal phrases have equal hashes, so none is missed; others that share a hash
   cost time only, since step 3 compares words.
2. Documents are put in order (id, then the row's digest), and running sums of their
   bytes give each a base: base plus word position is a *place*, one long.
3. Per shard, an Aho-Corasick automaton over words is compiled from the words at those
   places and all documents of the shard are streamed through it, which locates every
   occurrence.  Windows whose anchor was matched are candidates; neighbours that share an
   anchor travel as one run (digest of its windows' digests, place, digests of its windows).
4. Runs are aggregated to their first place, then the windows of distinct runs to
   theirs.  Later places of a run go whole; at its first place those windows go that
   another run holds earlier.

A shard is some ``SHARD_BYTES`` of text (or one longer document), and so bounds its
automaton; hot phrases are sums and minima, never collected groups.  The 64-bit word
hashes only choose and count anchors, which are matched by their words.  Windows are
compared by 96 bits, made of their words' 128-bit BLAKE2b digests by doubling: two spans
side by side are mixed into the span of both, so a window of 20 costs five mixes (among
10 ** 13 windows, 100 TB or so, the chance that any two of different words meet is about
one in a thousand).  Rows are compared by the MD5 of id and text.

Defined cases: null and empty texts hold no words; documents below ``window`` words
lose nothing; a null id sorts before all others; rows that repeat id and text are
one document, so none loses words to the other, and are merged before they meet in a
shard; rows with one id and different texts are ordered by the row's digest; an empty
table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidewell.llm.text import drop_caches, release_memory, row_key
from tidewell.plans.scratch import broadcast_if_small, discard, materialize

ANCHOR, SHARD_BYTES, BLOCK = 8, 4 << 20, 1 << 16
#: Bytes of texts whose words are hashed together.
GROUP_BYTES = 1 << 18
#: A place is a document's base plus a word's position: bases within a range
#: partition add up text bytes, and the partition's number stands above these bits.
PART_BITS = 40
_MULT, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Bytes of a window's digest; odd factors of its two lanes; runs and windows that travel in one batch.
DIGEST, _LANES, RUNS, WINDOWS = 12, (_MULT, np.uint64(0xC2B2AE3D27D4EB4F)), 1 << 16, 1 << 20
_BASE = 0xBF58476D1CE4E5B9
_POWERS, _INVERSES = (np.multiply.accumulate(np.full(BLOCK, b, np.uint64)) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def word_edges(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte of every plain word, and the byte after its last."""
    space = np.ones(len(data) + 2, bool)
    np.take(_SPACE, np.frombuffer(data, np.uint8), out=space[1:-1])
    edge = np.flatnonzero(space[1:] != space[:-1])
    return edge[::2], edge[1::2]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every plain word, a polynomial of its bytes mixed with its length, and its bytes.

    Words are taken some ``BLOCK`` bytes at a time, as differences of running sums;
    a longer word is hashed alone.
    """
    starts, ends = word_edges(data)
    return _hashes_between(np.frombuffer(data, np.uint8), starts, ends), ends - starts


def _hashes_between(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sizes = ends - starts
    out, k = np.empty(len(starts), np.uint64), 0
    while k < len(starts):
        if sizes[k] >= BLOCK:
            out[k] = xxhash.xxh64_intdigest(raw[starts[k] : ends[k]].tobytes())
            k += 1
            continue
        at = starts[k]
        end = int(np.searchsorted(ends, at + BLOCK))
        sums = np.zeros(ends[end - 1] - at + 1, np.uint64)
        np.cumsum((raw[at : ends[end - 1]] + np.uint64(1)) * _POWERS[: len(sums) - 1], out=sums[1:])
        h = (sums[ends[k:end] - at] - sums[starts[k:end] - at]) * _INVERSES[starts[k:end] - at]
        h += sizes[k:end].astype(np.uint64)
        h ^= h >> np.uint64(32)
        h *= _MIX
        out[k:end] = h ^ (h >> np.uint64(29))
        k = end
    return out


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive entries."""
    n = len(h) - k + 1
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _MULT + h[j : j + n]
    out ^= out >> np.uint64(32)
    out *= _MIX
    return out ^ (out >> np.uint64(29))


def anchors(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(phrase hashes, anchor position of each window) of a document's word hashes.

    The leftmost of equal phrases is taken, so overlapping equal windows of a
    periodic text own different places.
    """
    phrases, k = rolling(h, ANCHOR), window - ANCHOR + 1
    least, at, width = phrases, np.arange(len(phrases)), 1
    while width < k:
        step = min(width, k - width)
        right = least[step:] < least[:-step]
        least, at = np.where(right, least[step:], least[:-step]), np.where(right, at[step:], at[:-step])
        width += step
    return phrases, at


def window_digests(lanes: np.ndarray, window: int) -> np.ndarray:
    """``DIGEST`` bytes for every ``window`` consecutive words, from two 64-bit lanes a word.

    ``span`` holds the digests of 1, 2, 4, .. words from each place, and a window is put
    together from those that its length is the sum of.
    """
    n, out = lanes.shape[1] - window + 1, []
    for span, factor in zip(lanes, _LANES, strict=True):
        whole, done, width = None, 0, 1
        while True:
            if window & width:
                part = span[done : done + n]
                whole, done = part if whole is None else _mixed(whole, part, factor), done + width
            if 2 * width > window:
                break
            span, width = _mixed(span[:-width], span[width:], factor), 2 * width
        out.append(whole)
    return np.ascontiguousarray(np.stack(out, axis=1)).view(np.uint8)[:, :DIGEST]


def _mixed(a: np.ndarray, b: np.ndarray, factor: np.uint64) -> np.ndarray:
    """One 64-bit value for each pair; the order of the two counts."""
    h = a * factor
    h += b
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def _anchor_columns(group: list[tuple[int, int, bytes]], window: int) -> list[np.ndarray]:
    """(shard, anchor, row, pos) of texts that are hashed as one; windows across two texts count for neither."""
    shards, rows, texts = zip(*group, strict=True)
    data = b" ".join(texts)
    starts, ends = word_edges(data)
    begins = np.searchsorted(starts, np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]]))
    owner = np.repeat(np.arange(len(texts)), np.diff(np.r_[begins, len(starts)]))
    if len(starts) < window:
        return [np.empty(0, t) for t in (np.int32, np.int64, np.int64, np.int32)]
    phrases, at = anchors(_hashes_between(np.frombuffer(data, np.uint8), starts, ends), window)
    own = np.flatnonzero(np.bincount(at[owner[: len(at)] == owner[window - 1 :]], minlength=1))
    by = owner[own]
    return [np.array(shards, np.int32)[by], phrases[own].view(np.int64), np.array(rows, np.int64)[by], (own - begins[by]).astype(np.int32)]


def _emit_anchors(window: int):
    """(shard, row, text) to (shard, anchor, row, pos): hash and place of each text's anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        for batch in batches:
            found, group, size, last = [], [], 0, batch.num_rows - 1
            texts = batch.column(2).cast(pa.binary())
            for k, (shard, row) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                group.append((shard, row, texts[k].as_py() or b""))
                size += len(group[-1][2])
                if size >= GROUP_BYTES or k == last:
                    found.append(_anchor_columns(group, window))
                    group, size = [], 0
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["shard", "anchor", "row", "pos"])

    return run


def _bases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row_key, part, bytes) of one range partition in order to (row_key, base)."""
    total = 0
    for batch in batches:
        sizes = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
        part = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64) << PART_BITS
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(part + total + np.cumsum(sizes) - sizes)], ["row_key", "base"])
        total += int(sizes.sum())


def _symbols(ids: np.ndarray) -> str:
    """Two characters per word id, from sets that do not meet; no node of an automaton has many children."""
    pairs = np.stack([(ids >> 8) + 0x10000, (ids & 255) + 0x100], axis=1).astype("<u4")
    return pairs.tobytes().decode("utf-32-le")


class Words:
    """The words of a shard, numbered from 1 as they come."""

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = defaultdict(count(1).__next__)

    def number(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words))


class Lanes:
    """Two 64-bit halves of the digests of words, by number, made when first asked for."""

    def __init__(self, words: Words) -> None:
        self.words, self.known = list(words.ids), np.r_[True, np.zeros(len(words.ids), bool)]
        self.halves = np.zeros((2, len(words.ids) + 1), np.uint64)

    def of(self, ids: np.ndarray) -> np.ndarray:
        new = np.unique(ids[~self.known[ids]])
        if len(new):
            digests = b"".join([hashlib.blake2b(self.words[i - 1], digest_size=16).digest() for i in new.tolist()])
            self.halves[:, new] = np.frombuffer(digests, "<u8").reshape(-1, 2).T
            self.known[new] = True
        return self.halves[:, ids]


class Phrases:
    """An automaton over words, compiled from phrases of ``ANCHOR`` words each."""

    def __init__(self, phrases: list[bytes], words: Words | None = None) -> None:
        self.words = words or Words()
        ids = self.words.number(b" ".join(phrases).split())
        symbols = _symbols(ids)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for k in range(0, len(symbols), 2 * ANCHOR):
            self.automaton.add_word(symbols[k : k + 2 * ANCHOR])
        self.automaton.make_automaton()
        self.own = np.zeros(len(self.words.ids) + 1, np.int32)
        self.own[ids] = ids

    def starts(self, words: list[bytes]) -> list[int]:
        """Every place where a phrase begins."""
        return self.places(np.fromiter(map(self.words.ids.get, words, repeat(0)), np.int32, len(words))).tolist()

    def places(self, ids: np.ndarray) -> np.ndarray:
        """The same for the numbers of words.

        Words of no phrase are all alike, and of some that stand together one is read.
        """
        own = self.own[ids]
        read = np.flatnonzero((own > 0) | (np.r_[1, own[:-1]] > 0))
        ends = np.fromiter((end for end, _ in self.automaton.iter(_symbols(own[read]))), np.int64)
        return read[ends // 2] - ANCHOR + 1


def _runs(data: bytes, ids: np.ndarray, sizes: list[int], found: Phrases, lanes: Lanes, window: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, bytes]]:
    """Candidate windows of texts joined to ``data``, with so many words each, by runs that share an anchor.

    Yields (digests of runs, text, first windows, numbers of windows, all windows' digests)
    for some ``RUNS`` runs at a time.
    """
    owner, begins = np.repeat(np.arange(len(sizes)), sizes), np.cumsum([0, *sizes[:-1]])
    starts = found.places(ids) if len(ids) >= window else []
    if not len(starts):
        return
    starts = starts[owner[starts] == owner[starts + ANCHOR - 1]]
    h, _ = word_hashes(data)
    located, at = np.zeros(len(h), bool), anchors(h, window)[1]
    located[starts] = True
    cand = np.flatnonzero(located[at] & (owner[: len(at)] == owner[window - 1 :]))
    if not len(cand):
        return
    first = np.flatnonzero(np.r_[True, np.diff(at[cand]) != 0])
    edges = np.r_[first, len(cand)]
    for k in range(0, len(first), RUNS):
        own = edges[k : k + RUNS + 1]
        a, b = cand[own[0]], cand[own[-1] - 1] + 1
        here = cand[own[0] : own[-1]] - a
        need = removed_mask(b - a + window - 1, here, np.ones(len(here), np.int64), window)
        halves = lanes.of(np.where(need, ids[a : b + window - 1], 0))
        raw = window_digests(halves, window)[here].tobytes()
        cuts = ((own - own[0]) * DIGEST).tolist()
        keys = [hashlib.blake2b(raw[i:j], digest_size=DIGEST).digest() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        begin = cand[own[:-1]]
        by = owner[begin]
        yield keys, by, (begin - begins[by]).astype(np.int32), np.diff(own).astype(np.int32), raw


def _groups(order: list[tuple[int, int]], sizes: list[int]) -> Iterator[list[tuple[int, int]]]:
    """(base, text) in order, as many at a time as hold some ``GROUP_BYTES``."""
    group, held = [], 0
    for base, k in order:
        group.append((base, k))
        held += sizes[k]
        if held >= GROUP_BYTES:
            yield group
            group, held = [], 0
    if group:
        yield group


def _binaries(raw: bytes) -> pa.Array:
    """``DIGEST`` bytes each as a binary column."""
    n = len(raw) // DIGEST
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * DIGEST, DIGEST, dtype=np.int32)), pa.py_buffer(raw)])


def _run_batch(found: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """One batch of (runs' digests, base, starts, numbers, windows' digests, whether they travel) of some texts."""
    keys, bases, starts, numbers, windows, fresh = zip(*found, strict=True)
    flags, sizes = np.concatenate(fresh), np.concatenate(numbers)
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.where(flags, sizes, 0))].astype(np.int32)), _binaries(b"".join(windows)), mask=pa.array(~flags))
    columns = [_binaries(b"".join([x for k in keys for x in k])), pa.array(np.concatenate(bases)), pa.array(np.concatenate(starts)), pa.array(sizes), lists]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _locate(window: int):
    """Cogrouped (documents, places of recurring phrases and bases) of one shard to runs of candidate windows."""
    kinds = pa.schema([("run", pa.binary()), ("base", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("windows", pa.list_(pa.binary()))])

    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        based = known.column("base").is_valid()
        bases = dict(zip(*(known.filter(based).column(c).to_pylist() for c in ("key", "base")), strict=True))
        places = defaultdict(list)
        for row, pos in zip(*(known.filter(pc.invert(based)).column(c).to_pylist() for c in ("row", "pos")), strict=True):
            places[row].append(pos)
        if not places:
            return kinds.empty_table()
        texts, ids, phrases, numbers = docs.column("text").cast(pa.binary()), [], set(), Words()
        for row, text in zip(docs.column("row").to_pylist(), texts, strict=True):
            words = (text.as_py() or b"").split()
            ids.append(numbers.number(words))
            phrases.update(b" ".join(words[p : p + ANCHOR]) for p in places.get(row, ()) if p + ANCHOR <= len(words))
        if not phrases:
            return kinds.empty_table()
        found, lanes, seen, batches, made, held = Phrases(sorted(phrases), numbers), Lanes(numbers), set(), [], [], 0
        order = sorted((bases[key], k) for k, key in enumerate(docs.column("row_key").to_pylist()))
        for group in _groups(order, pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
            data, words = b" ".join([texts[k].as_py() or b"" for _, k in group]), [ids[k] for _, k in group]
            places_of = np.array([base for base, _ in group], np.int64)
            for keys, by, first, sizes, raw in _runs(data, np.concatenate(words), [len(w) for w in words], found, lanes, window):
                fresh = np.zeros(len(keys), bool)
                for i, key in enumerate(keys):
                    if key not in seen:
                        seen.add(key)
                        fresh[i] = True
                travel = np.frombuffer(raw, np.uint8).reshape(-1, DIGEST)[np.repeat(fresh, sizes)].tobytes()
                made.append((keys, places_of[by], first, sizes, travel, fresh))
                held += len(raw) // DIGEST
                if held >= WINDOWS:
                    batches.append(_run_batch(made, kinds))
                    made, held = [], 0
        if made:
            batches.append(_run_batch(made, kinds))
        out = pa.Table.from_batches(batches, kinds)
        del found, lanes, seen, ids, numbers, made, batches
        release_memory()
        return out

    return run


def removals(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 20) -> DataFrame:
    """(row_key, spans): where a document holds windows that also start earlier.

    A span is the first window's start and the number of windows from there.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text).alias("row_key"), F.col(text).alias("text"))
    # One more than its bytes, so that no two documents share a base, however empty.
    sizes = narrow.select("doc_id", "row_key", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("n"))
    sizes = materialize(sizes.groupBy("doc_id", "row_key").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("times")), "sizes")
    total, most = sizes.agg(F.sum("n"), F.max("times")).first()
    shards = (total or 0) // SHARD_BYTES + 1
    shard = F.pmod(F.xxhash64("row_key"), F.lit(shards)).cast("int").alias("shard")
    ordered = sizes.repartitionByRange("doc_id", "row_key").sortWithinPartitions("doc_id", "row_key")
    bases = ordered.select("row_key", F.spark_partition_id().alias("part"), "n").mapInArrow(_bases, "row_key binary, base long")
    bases = materialize(bases, "bases")
    narrow = narrow.select("row_key", F.xxhash64("row_key").alias("row"), "text")
    if (most or 0) > 1:  # merge the repeats
        repeats = broadcast_if_small(sizes.where("times > 1").select("row_key"))
        once = narrow.join(repeats, "row_key", "left_semi").groupBy("row_key", "row").agg(F.first("text").alias("text"))
        narrow = narrow.join(repeats, "row_key", "left_anti").union(once)
    sharded = narrow.select(shard, "row_key", "row", "text")
    emitted = sharded.select("shard", "row", "text").mapInArrow(_emit_anchors(window), "shard int, anchor long, row long, pos int")
    counted = emitted.groupBy("shard", "anchor").agg(F.count(F.lit(1)).alias("n"), F.first("row").alias("row"), F.first("pos").alias("pos"))
    counted = materialize(counted, "anchors")
    recurring = counted.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    recurring = counted.select("shard", "anchor", "row", "pos").join(recurring.hint("shuffle_hash"), "anchor", "left_semi")
    recurring = recurring.select("shard", F.lit(None).cast("binary").alias("key"), F.lit(None).cast("long").alias("base"), "row", "pos")
    bases_of = bases.select(shard, F.col("row_key").alias("key"), "base", F.lit(None).cast("long").alias("row"), F.lit(None).cast("int").alias("pos"))
    known = materialize(recurring.union(bases_of), "recurring")
    discard(counted)
    schema = "run binary, base long, start int, n int, windows array<binary>"
    runs = materialize(sharded.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(_locate(window), schema), "runs")
    discard(known, sizes)
    # Within its shard the first place of a run carries the windows, so the first of all does.
    place = (F.col("base") + F.col("start")).alias("place")
    firsts = materialize(runs.groupBy("run").agg(F.min(place).alias("p"), F.count(F.lit(1)).alias("times")), "firsts")
    carried = runs.where("windows IS NOT NULL").select("run", place, "windows").join(firsts.select("p").hint("shuffle_hash"), F.col("place") == F.col("p"))
    wins = carried.select("run", "p", F.posexplode("windows").alias("i", "win"))
    wins = materialize(wins.select("run", "i", "win", (F.col("p") + F.col("i")).alias("at")), "windows")
    earliest = wins.groupBy("win").agg(F.min("at").alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").select("win", "f")
    late = wins.join(earliest.hint("shuffle_hash"), "win").where("f < at").groupBy("run").agg(F.collect_list("i").alias("late"))
    marks = firsts.join(late, "run", "left").where("times > 1 OR late IS NOT NULL").select("run", "p", "late")
    marks = materialize(marks, "marks")
    discard(wins, firsts)
    here = F.transform("late", lambda i: F.struct((F.col("start") + i).alias("a"), F.lit(1).alias("n")))
    spans = F.when(place == F.col("p"), here).otherwise(F.array(F.struct(F.col("start").alias("a"), F.col("n"))))
    lost = runs.drop("windows").join(marks, "run").select("base", spans.alias("spans")).where("spans IS NOT NULL")
    lost = lost.groupBy("base").agg(F.flatten(F.collect_list("spans")).alias("spans")).join(bases, "base").select("row_key", "spans")
    lost = materialize(lost, "removals")
    discard(runs, marks, bases)
    return lost


def removed_mask(n: int, starts: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + counts + window - 1, -1)
    return np.cumsum(step)[:n] > 0


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 20) -> DataFrame:
    """Rows of ``docs`` as struct ``row``, without the text, with n_words, n_removed, kept_sha256 and kept_text.

    ``kept_text`` is the text itself where nothing was removed, else the kept words
    with the white space after them.
    """
    lost = removals(docs, id_col, text, window).withColumnRenamed("row_key", "lost_key")
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row")
    joined = docs.select(own, row_key(id_col, text).alias("key"), F.col(text).alias("body")).join(lost, F.col("key") == F.col("lost_key"), "left")
    names = ["row", "n_words", "n_removed", "kept_sha256", "kept_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for body, spans in zip(batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
                body = body.as_py()
                words = (body or b"").split()
                kept, kept_text, n = words, body, 0
                if spans.is_valid:
                    gone = removed_mask(len(words), *(spans.values.field(k).to_numpy() for k in ("a", "n")), window)
                    n, at = int(gone.sum()), np.r_[word_edges(body)[0], len(body)].tolist()
                    turns = np.flatnonzero(np.diff(np.r_[True, gone, True])).tolist()
                    stays = list(zip(turns[::2], turns[1::2], strict=True))
                    kept, kept_text = [w for a, b in stays for w in words[a:b]], b"".join([body[at[a] : at[b]] for a, b in stays])
                rows.append((len(words), n, hashlib.sha256(b" ".join(kept)).hexdigest(), kept_text))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary()]
            made = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made[:3], made[3].cast(pa.string())], names)

    row_type = joined.schema["row"].dataType.simpleString()
    return joined.select("row", "body", "spans").mapInArrow(run, f"row {row_type}, n_words long, n_removed long, kept_sha256 string, kept_text string")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 20, n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with repeated passages cut from the text (and its length kept in step)."""
    done = deduplicated(docs, id_col, text, window)
    fresh = {text: F.col("kept_text")}
    if n_chars in docs.columns:
        fresh[n_chars] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("row")[n_chars])
    return done.select(*[fresh.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
