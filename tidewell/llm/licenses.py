"""License scans over a positional rare-token index.

Templates (whole licence texts and notices) are indexed by the positions of their words.
Document frequencies of the template vocabulary, counted over all documents, give each
word's IDF.  Of every stretch of ``STRETCH`` words (they overlap by half) the ``RARE`` licence words of
highest IDF are looked up among the templates that a document may hold at all: each place proposes alignments (document position minus
template position).  Proposals of a template that lie close together are intersected;
where enough different words agree, the template is scored by the IDF share of its words
that stand within some words of their relative positions, and counts where its key
phrases stand there.  Base phrases are found wherever their words stand consecutively.

Defined cases: null and empty texts hold no words, no labels and score 0; equal
IDF is ordered by the word; alignments of equal support are taken by position; repeated
rows, null ids too, are judged alike; an empty table gives an empty result; other columns
pass by.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewell.llm.license_texts import TEMPLATES
from tidewell.llm.text import letter_words

#: Base phrases and their labels; fixed values.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Words of a stretch and how many of its licence words are looked up there; different words
#: that must agree on an alignment (half of a shorter template's); least share.
STRETCH, RARE, AGREE, MIN_SHARE = 64, 8, 3, 0.6
_PHRASES = [(p.encode(), label) for p, label in BASE.items()]
Template = tuple[str, str, list[str]]


def document_frequencies(docs: DataFrame, vocabulary: set[bytes], text: str = "text") -> tuple[int, dict[bytes, int]]:
    """Documents, and how many hold each word of the template vocabulary (a bounded answer)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = Counter()
        for batch in batches:
            df[b""] += batch.num_rows
            for t in batch.column(0):
                df.update(vocabulary.intersection(letter_words(t.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array([k.decode() for k in df], pa.string()), pa.array(list(df.values()), pa.int64())], ["word", "n"])

    rows = docs.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r.word.encode(): r.n for r in rows}
    return counts.pop(b"", 0), counts


class Index:
    """Template words with their postings and IDF weights."""

    def __init__(self, templates: list[Template], n_docs: int = 0, df: dict[bytes, int] | None = None) -> None:
        self.labels = [label for label, _, _ in templates]
        self.words = [letter_words(text) for _, text, _ in templates]
        self.keys = [[b" " + b" ".join(letter_words(k)) + b" " for k in keys] for _, _, keys in templates]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, words in enumerate(self.words):
            for i, w in enumerate(words):
                self.postings[w].append((t, i))
        self.idf = {w: math.log((n_docs + 1) / ((df or {}).get(w, 0) + 0.5)) + 1e-9 for w in self.postings}
        self.total = [sum(self.idf[w] for w in words) for words in self.words]
        self.slack = [4 + len(words) // 10 for words in self.words]
        self.agree = [min(AGREE, (len(set(words)) + 1) // 2) for words in self.words]

    def likely(self, present: set[bytes]) -> set[int]:
        """Templates enough of whose words, by weight, occur at all."""
        held: dict[int, float] = defaultdict(float)
        for w in present:
            for t, _ in self.postings[w]:
                held[t] += self.idf[w]
        return {t for t, x in held.items() if x >= MIN_SHARE * self.total[t]}

    def proposals(self, part: list[bytes], first: int, likely: set[int]) -> dict[int, list[tuple[int, bytes]]]:
        """By template, the (start, word) that the rare words of a stretch propose."""
        out: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
        rare = set(sorted(self.postings.keys() & set(part), key=lambda w: (-self.idf[w], w))[:RARE])
        for at, w in enumerate(part, first) if len(rare) > 1 else ():
            if w in rare:
                for t, i in self.postings[w]:
                    if t in likely:
                        out[t].append((at - i, w))
        return out

    def starts(self, t: int, proposed: list[tuple[int, bytes]]) -> list[int]:
        """Starts on which enough different words agree, the best one of each cluster."""
        out, proposed = [], sorted(proposed)
        first = 0
        for k in range(1, len(proposed) + 1):
            if k == len(proposed) or proposed[k][0] - proposed[k - 1][0] > self.slack[t] or proposed[k][0] - proposed[first][0] > 2 * self.slack[t]:
                cluster = proposed[first:k]
                if len({w for _, w in cluster}) >= self.agree[t]:
                    counts = Counter(start for start, _ in cluster)
                    out.append(min(counts, key=lambda s: (-counts[s], s)))
                first = k
        return out

    def share(self, t: int, start: int, at: dict[bytes, list[int]]) -> float:
        """IDF share of the template's words that stand about where they should."""
        slack, found = self.slack[t], 0.0
        for i, w in enumerate(self.words[t]):
            held = at.get(w)
            if held:
                k = bisect_left(held, start + i - slack)
                if k < len(held) and held[k] <= start + i + slack:
                    found += self.idf[w]
        return min(1.0, found / self.total[t])

    def stands(self, t: int, start: int, words: list[bytes]) -> bool:
        """Whether the key phrases stand in the words around the alignment."""
        a, b = max(0, start - self.slack[t]), max(0, start + len(self.words[t]) + self.slack[t])
        region = b" " + b" ".join(words[a:b]) + b" "
        return all(k in region for k in self.keys[t])

    def best(self, words: list[bytes]) -> tuple[set[str], float]:
        """Labels of templates that align with their key phrases, and the best share."""
        present = self.postings.keys() & set(words)
        likely = self.likely(present) if len(present) > 1 else set()
        if not likely:
            return set(), 0.0
        at: dict[bytes, list[int]] = defaultdict(list)
        for p, w in enumerate(words):
            if w in present:
                at[w].append(p)
        labels, score, seen = set(), 0.0, set()
        for a in range(0, len(words), STRETCH // 2):
            for t, found in self.proposals(words[a : a + STRETCH], a, likely).items():
                for start in self.starts(t, found):
                    if (t, start) in seen:
                        continue
                    seen.add((t, start))
                    share = self.share(t, start, at)
                    score = max(score, share)
                    if share >= MIN_SHARE and self.labels[t] not in labels and self.stands(t, start, words):
                        labels.add(self.labels[t])
        return labels, score


def places(words: list[bytes]) -> list[tuple[int, str]]:
    """(first word, label) of every base phrase occurrence."""
    joined, out = b" " + b" ".join(words) + b" ", []
    for phrase, label in _PHRASES:
        at = joined.find(b" " + phrase + b" ")
        while at >= 0:
            out.append((joined.count(b" ", 0, at), label))
            at = joined.find(b" " + phrase + b" ", at + 1)
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", templates: list[Template] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) per row."""
    vocabulary = set(Index(templates).postings)
    index = Index(templates, *document_frequencies(docs, vocabulary, text))
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1):
                words = letter_words(t.as_py())
                found = places(words)
                starts, base = [a for a, _ in found], {x for _, x in found}
                labels, score = index.best(words)
                rows.append((len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), max(score, 0.0)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names)

    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(id_col, text).mapInArrow(run, schema)
