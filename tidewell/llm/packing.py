"""Packing of tokenised documents by best-fit decreasing.

A document's ids (and a closing id 0) are first cut into full windows, each a
sequence of its own; what is left goes into the open window with the least room
that still takes it.  Open windows lie in stacks by remaining capacity, and a
segment tree over the capacities finds the tightest non-empty stack.  Documents
are dealt evenly to groups of some ``GROUP`` documents, packed independently, so a
group fits one task at any corpus size.

Ids of a text are those of its chunks, as the byte-level pattern always starts anew
at a space that a non-space follows, after a run of Latin letters that another ASCII
character follows, and after a lone line break; short chunks are encoded once and cached.
Texts that hold a special token's string are encoded whole.

Defined cases: a null or empty text is the closing id alone; repeated rows are
packed each; a null id stays null; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from tidewell.llm.text import CACHES, release_memory
from tidewell.plans.scratch import materialize

#: Documents of a packing group; cached chunks of a worker and their characters.
GROUP, CACHE, CACHED_CHARS = 20_000, 600_000, 48
#: A Latin word; a mark with a lone line break; all up to a space that a non-space follows.
_CHUNK = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+(?=[\x00-\x40\x5B-\x60\x7B-\x7F]|\Z)|[.,;:!?]\n(?=[A-Za-z])|(?s:.)[^ ]*(?: (?!\S)[^ ]*)*")
_ENCODERS: dict[str, "Encoder"] = {}
CACHES.append(_ENCODERS)


class Encoder:
    """Token ids as little-endian 32-bit bytes, by cached chunks."""

    def __init__(self, path: str, cache: int = CACHE) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task owns one core
        from tokenizers import Tokenizer

        self.tokenizer, self.chunks, self.cache = Tokenizer.from_file(path), {}, cache
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _encode_whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk from one call: a special token, which ends any other, parts them."""
        if not self.specials:
            return [self._encode_whole(x).tobytes() for x in chunks]
        ids = self._encode_whole("".join([x + self.specials[0] for x in chunks]))
        ends = np.flatnonzero(ids == self.tokenizer.token_to_id(self.specials[0])).tolist()
        flat = ids.tobytes()
        return [flat[4 * a : 4 * b] for a, b in zip([0, *[e + 1 for e in ends[:-1]]], ends, strict=True)]

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.specials):
            return self._encode_whole(text).tobytes()
        known = self.chunks
        parts = _CHUNK.findall(text)
        new = list(set(parts).difference(known))
        if not new:
            return b"".join(map(known.__getitem__, parts))
        fresh = dict(zip(new, self._encode_chunks(new), strict=True))
        ids = b"".join([known[x] if x in known else fresh[x] for x in parts])
        if len(known) > self.cache:
            known.clear()
        known.update((x, i) for x, i in fresh.items() if len(x) <= CACHED_CHARS)
        return ids


def encoder(path: str, cache: int = CACHE) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    _ENCODERS[path].cache = cache
    return _ENCODERS[path]


def cut(ids: bytes, limit: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of the full windows and the rest of a document's ids."""
    n = len(ids) // 4
    return [(a, min(limit, n - a), zlib.crc32(ids[4 * a : 4 * (a + limit)])) for a in range(0, n, limit)]


def best_fit(lengths: list[int], limit: int) -> list[tuple[int, int]]:
    """(bin, offset) of each length, taken longest first, ties in order."""
    size = 1 << limit.bit_length()
    tree = [0] * (2 * size)  # open bins below each node; leaf c: bins with c left
    stacks: list[list[int]] = [[] for _ in range(limit + 1)]
    placed, bins = [(0, 0)] * len(lengths), 0

    def count(capacity: int, by: int) -> None:
        k = capacity + size
        while k:
            tree[k] += by
            k >>= 1

    def tightest(need: int) -> int:
        k = need + size
        if tree[k]:
            return need
        while k > 1 and (k & 1 or not tree[k + 1]):
            k >>= 1
        if k <= 1:
            return -1
        k += 1
        while k < size:
            k = 2 * k if tree[2 * k] else 2 * k + 1
        return k - size

    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        room = tightest(n)
        if room < 0:
            b, room, bins = bins, limit, bins + 1
        else:
            b = stacks[room].pop()
            count(room, -1)
        placed[i] = (b, limit - room)
        if room > n:
            stacks[room - n].append(b)
            count(room - n, 1)
    return placed


def tokenised_pieces(docs: DataFrame, tokenizer: str, limit: int, id_col: str, text: str, cache: int = CACHE) -> DataFrame:
    """(doc_id, slot, start, length, ids_crc32, doc_tokens); ``slot`` spreads documents evenly."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        release_memory()
        task, at, enc = TaskContext.get().partitionId(), 0, encoder(tokenizer, cache)
        for batch in batches:
            index, rows, slots, sizes = [], [], [], []
            for k, t in enumerate(batch.column(1)):
                ids = enc.encode(t.as_py() or "") + b"\0\0\0\0"
                pieces = cut(ids, limit)
                rows += pieces
                index += [k] * len(pieces)
                slots += [(task << 33) + at] * len(pieces)
                sizes += [len(ids) // 4] * len(pieces)
                at += 1
            start, length, crc = zip(*rows, strict=True) if rows else ((), (), ())
            columns = [batch.column(0).take(pa.array(index, pa.int64()))]
            columns += [pa.array(x, pa.int64()) for x in (slots, start, length, crc, sizes)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "slot", "start", "length", "ids_crc32", "doc_tokens"])

    narrow = docs.select(F.col(id_col), F.col(text))
    return narrow.mapInArrow(run, f"doc_id {kind}, slot long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text: str = "text", cache: int = CACHE) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) per piece.

    ``cache`` chunks are kept in each worker: fewer take less memory and more time.
    ``sequence_id`` is the packing group (high 32 bits) and the sequence in it.
    """
    pieces = materialize(tokenised_pieces(docs, tokenizer, limit, id_col, text, cache), "pieces")
    groups = max(1, -(-pieces.where("start = 0").count() // GROUP))
    kind = pieces.schema["doc_id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        order = pa.compute.sort_indices(table, sort_keys=[("slot", "ascending"), ("start", "ascending")])
        table = table.take(order)
        lengths = table.column("length").to_pylist()
        base = table.column("group")[0].as_py() << 32
        rest = [i for i, n in enumerate(lengths) if n < limit]
        bins = best_fit([lengths[i] for i in rest], limit)
        used = 1 + max((b for b, _ in bins), default=-1)
        sequence, offset = [0] * len(lengths), [0] * len(lengths)
        for i, (b, at) in zip(rest, bins, strict=True):
            sequence[i], offset[i] = base + b, at
        for i, n in enumerate(lengths):
            if n == limit:
                sequence[i], used = base + used, used + 1
        table = table.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        return table.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("slot"), F.lit(groups)))
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return dealt.groupBy("group").applyInArrow(run, schema)
