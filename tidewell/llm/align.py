"""Alignment of two tokenizers' tokens by the bytes that they cover.

Both tokenizers encode every text, tokens become byte lengths, and places where tokens
of both sides end cut the text into groups.  All tokens of one group are linked with all
of the other side.  A Spark aggregation counts in how many documents each pair of ids
is linked, maxima per id are joined to the counts, and both are joined back to documents.

The merge runs inside ``mapInPandas``: both sides' cumulative ends are two sorted runs,
merged by a stable sort as two pointers would, and neighbours that are equal end a group.
Groups, their text and their links follow from array operations over a document.  A long
text is worked through in slices of some ``SLICE`` characters, which begin at a space that
follows anything but a space and precedes a non-space: side A's pattern starts anew there,
and no piece of side B holds a space after another character, so a slice's tokens do not
depend on its neighbours.  A document's links travel as two arrays (pairs, and how often
each is linked), never pair by pair.

Ids fit 31 bits; a pair is one long, A's id above B's.

Defined cases: a null or empty text, or one that a tokenizer does not give back byte by
byte, has no tokens: zeros and an empty digest; rows that repeat an id, and null ids, are
documents of their own; ties for a maximum are all best; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidewell.llm.text import CACHES, encode, release_memory
from tidewell.plans.scratch import broadcast_if_small, discard, materialize

#: Characters worked through at once; links of a group up to which they are listed singly.
SLICE, LISTED = 1 << 20, 256
#: Bytes of a run that the rank encoder, which takes the square of a run's length, still gets.
RUN, _GAP = 1000, re.compile(r"\s{1000}")
#: Fixed: the public pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where a slice may begin.
_CUT = re.compile(r"(?<=[^ ]) (?=\S)")
_ALIGNERS: dict[tuple[str, str], "Aligner"] = {}
CACHES.append(_ALIGNERS)
_SPACE, _LOW = "▁", 31


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones as they are, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(c): b for c, b in [*zip(plain, plain, strict=True), *((256 + k, b) for k, b in enumerate(other))]}


def slices(text: str) -> Iterator[str]:
    """Parts of a text that no token of either side crosses."""
    at = 0
    while at < len(text):
        cut = _CUT.search(text, at + SLICE)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of A and of B end by the end of each group."""
    merged = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
    common = merged[1:][merged[1:] == merged[:-1]]
    return np.searchsorted(ends_a, common) + 1, np.searchsorted(ends_b, common) + 1


def count_pairs(a: np.ndarray, b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, times): every pair of linked ids once, and by how many links."""
    size_a, size_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
    n = size_a * size_b
    small = n <= LISTED
    n, wide = n[small], size_b[small]
    first_a, first_b = (to_a - size_a)[small], (to_b - size_b)[small]
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)  # which link of its group
    wide = np.repeat(wide, n)
    pairs = a[np.repeat(first_a, n) + k // wide] << _LOW | b[np.repeat(first_b, n) + k % wide]
    found = [np.unique(pairs, return_counts=True)]
    for g in np.flatnonzero(~small).tolist():  # distinct ids first, however long the group
        x, nx = np.unique(a[to_a[g] - size_a[g] : to_a[g]], return_counts=True)
        y, ny = np.unique(b[to_b[g] - size_b[g] : to_b[g]], return_counts=True)
        found.append(((x[:, None] << _LOW | y).ravel(), (nx[:, None] * ny).ravel()))
    return added(found)


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by pair."""
    if len(parts) == 1:
        return parts[0]
    pairs, at = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
    times = np.zeros(len(pairs), np.int64)
    np.add.at(times, at, np.concatenate([n for _, n in parts]))
    return pairs, times


class Aligner:
    """Both tokenizers of a worker, with the bytes and the written form of every id."""

    def __init__(self, path_a: str, path_b: str) -> None:
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task owns one core
        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True  # their strings are plain text here
        alphabet, specials = byte_alphabet(), self.a.get_added_tokens_decoder()
        entries = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size(with_added_tokens=True))]
        self.bytes_a = [t.encode() if i in specials else bytes(alphabet[c] for c in t) for i, t in enumerate(entries)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(_SPACE in p.lstrip(_SPACE) for p in pieces):
            raise ValueError("a piece of side B holds a space after another character: slices would change its tokens")
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.ranks = self._rank_encoder()
        self.size_a, self.size_b = (np.array(list(map(len, t)), np.int64) for t in (self.bytes_a, self.bytes_b))
        # A's ids with "," and "|", then B's with "," and ";"
        marks = [(len(self.bytes_a), ","), (len(self.bytes_a), "|"), (len(self.bytes_b), ","), (len(self.bytes_b), ";")]
        self.written = np.array([f"{i}{mark}".encode() for n, mark in marks for i in range(n)])

    def _rank_encoder(self):
        """The same encoder by ranks, several times as fast, where the merges stand in the order of ids; else None."""
        import tiktoken

        spec = json.loads(self.a.to_str())
        kind, model = spec["pre_tokenizer"] or {}, spec["model"]
        usual = kind.get("type") == "ByteLevel" and not kind.get("add_prefix_space") and kind.get("use_regex", True) and not spec["normalizer"]
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model.get("merges", ())]
        made = [model["vocab"].get(m, -1) for m in merges]
        if model["type"] != "BPE" or not usual or model.get("ignore_merges") or any(x >= y for x, y in zip(made, made[1:])):
            return None
        ranks = {self.bytes_a[i]: i for i in model["vocab"].values() if i not in self.a.get_added_tokens_decoder()}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids_a(self, part: str, data: bytes) -> np.ndarray:
        if self.ranks and len(max(data.split(), key=len, default=b"")) < RUN and not _GAP.search(part):
            return np.array(self.ranks.encode_ordinary(part), np.int64)
        return np.array(self.a.encode_batch_fast([part], add_special_tokens=False)[0].ids, np.int64)

    def text_of(self, a: np.ndarray, b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray) -> bytes:
        """``a1,a2|b1;a3|b2,b3;``"""
        at_a = np.arange(len(a)) + np.repeat(np.r_[0, to_b[:-1]], np.diff(to_a, prepend=0))
        at_b = np.arange(len(b)) + np.repeat(to_a, np.diff(to_b, prepend=0))
        marked_a, marked_b = a.copy(), b + 2 * len(self.bytes_a)
        marked_a[to_a - 1] += len(self.bytes_a)
        marked_b[to_b - 1] += len(self.bytes_b)
        every = np.empty(len(a) + len(b), np.int64)
        every[at_a], every[at_b] = marked_a, marked_b
        return self.written[every].tobytes().translate(None, b"\0")

    def document(self, text: str | None) -> tuple:
        """(n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of a text."""
        nothing = 0, 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64)
        if not text or _SPACE in text:  # side B would give the mark of a space back as a space
            return nothing
        totals, digest, found, tail = np.zeros(4, np.int64), hashlib.sha256(), [], b""
        for part in slices(" " + text):
            data = encode(part)
            a, b = self.ids_a(part, data), np.array(self.b.encode(part[1:], num_threads=1), np.int64)
            if any(b"".join(map(t.__getitem__, x.tolist())) != data for t, x in ((self.bytes_a, a), (self.bytes_b, b))):
                return nothing
            to_a, to_b = groups(np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]))
            found.append(count_pairs(a, b, to_a, to_b))
            written = tail + self.text_of(a, b, to_a, to_b)
            digest.update(written[:-1])
            tail = written[-1:]
            totals += len(a), len(b), len(to_a), found[-1][1].sum()
        return *map(int, totals), digest.hexdigest(), *added(found)


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def linked(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: row (unique), doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs and times.

    The caller writes it before it is read twice: ``row`` follows the task that made it.
    """
    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        release_memory()
        task, at, work = TaskContext.get().partitionId() << 33, 0, aligner(tokenizer_a, tokenizer_b)
        for batch in batches:
            rows = pd.DataFrame([work.document(t) for t in batch["text"]], columns=names)
            rows.insert(0, "doc_id", batch["doc_id"].array)
            rows.insert(0, "row", np.arange(task + at, task + at + len(rows)))
            at += len(rows)
            yield rows

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, schema)


def pair_counts(each: DataFrame) -> DataFrame:
    """(pair, n_docs, best_a, best_b): documents that hold the pair linked, and whether no pair of its A or B id has more."""
    counts = materialize(each.groupBy("pair").agg(F.count(F.lit(1)).alias("n_docs")), "pairs")
    sides = {"a": F.shiftright("pair", 31), "b": F.col("pair").bitwiseAND((1 << 31) - 1)}
    found = counts
    for side, own in sides.items():
        most = counts.groupBy(own.alias(side)).agg(F.max("n_docs").alias(f"most_{side}"))
        found = found.withColumn(side, own).join(most, side)
    found = found.select("pair", "n_docs", *[(F.col("n_docs") == F.col(f"most_{s}")).alias(f"best_{s}") for s in sides])
    found = materialize(found, "pair-counts")
    discard(counts)
    return found


def align(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, n_best_b, count_sum, groups_sha256.

    ``n_best`` and ``n_best_b`` count links whose pair no other pair of its A or B id
    exceeds in documents; ``count_sum`` adds up the documents of every link's pair.
    """
    table = materialize(linked(docs, tokenizer_a, tokenizer_b, id_col, text), "linked")
    each = table.select("row", F.inline(F.arrays_zip("pairs", "times"))).withColumnsRenamed({"pairs": "pair"})
    counts = broadcast_if_small(pair_counts(each))
    sums = {"n_best": F.when(F.col("best_a"), F.col("times")), "n_best_b": F.when(F.col("best_b"), F.col("times")), "count_sum": F.col("times") * F.col("n_docs")}
    back = each.join(counts, "pair").groupBy("row").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    kept = table.drop("pairs", "times").join(back, "row", "left")
    filled = [F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in sums]
    return kept.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *filled, "groups_sha256")
