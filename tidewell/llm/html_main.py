"""Main text of web pages by consensus of host paths.

A page is cut into blocks of text inside containers; boilerplate (by tag, or by the
words of class and id) is left out.  Containers score by the unlinked text below
them, half for each level up.  Each page votes once with the generalised tag-class path
(numbers in classes become ``#``) of each container, by its best score; Spark sums the
votes per host, and pages are extracted again from the host's winning path, taking all
of the innermost article (or else main) element around it.  A page without text on that
path falls back to its own best container.  Pages are parsed twice, for the votes and for
the text; keeping what was parsed would write all texts once more.

Parsing takes time and memory in proportion to the page, however deep or broken: paths
are chained digests, open elements are found by tag, scores are summed up the tree.

Defined cases: a ``<`` that no ``>`` follows is text; of a tag with an unclosed quote, and
of tags before that quote, the first ``>`` is the end; a page of which boilerplate words of class and id leave nothing is read
without them; an svg, math or select element that is not closed ends at the next block, and
an object, canvas, template or noscript element that is never closed is empty; null or empty html gives an empty text; a null or unparsable url
belongs to the host ''; equal votes go to the greater path digest; repeated rows vote as
often as they occur; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from tidewell.plans.scratch import broadcast_if_small, materialize

#: Tags by role; fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe".split())
#: Dropped elements: of the first kind a block ends one that was not closed; of the second, one that is never closed counts as empty.
_FOREIGN, _FALLBACK = frozenset("svg math select".split()), frozenset("noscript template object canvas".split())
CONTAINERS = frozenset("body article main section div td center".split())
BLOCKS = CONTAINERS | frozenset(
    "address blockquote dd details dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header html head hr li nav aside ol p pre "
    "summary table tbody tfoot th thead tr ul menu dialog button label legend option".split()
)
DROPPED = frozenset("nav footer aside form menu dialog button head label legend option".split()) | _FOREIGN | _FALLBACK
#: Words of classes and ids that mark boilerplate; fixed values.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsored sponsor promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead footer sidebar side aside comment comments disqus reply replies cookie cookies consent notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations pagination pager widget toolbar skip".split()
)
#: Of an article only names that say nothing else count ("comment", "related", not "comments-open"), and those that begin so.
_OWN = ("comment", "reply")
#: Inside an article or main element a header is its title, unless it is named the site's.
_TITLES, _SITE = frozenset("header masthead".split()), frozenset("site global top".split())
_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[>\"']")
_NAMES = re.compile(r"""(?:^|\s)(class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Elements that such an end never reaches beyond.
_LIMITS = {"ul", "ol", "dl", "table", "body"} | (CONTAINERS - {"td"})
#: Start tags that end an open element of the same kind.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _label(tag: str, attrs: str, inside: bool) -> tuple[str, bool]:
    """(generalised tag-class label, whether class or id names boilerplate); ``inside`` an article or main element."""
    names = [(k.lower(), a or b or c) for k, a, b, c in _NAMES.findall(attrs)] if attrs else []
    label = ".".join([tag, *sorted(re.sub(r"\d+", "#", c) for k, v in names if k == "class" for c in v.split())])
    for _, value in names:
        for name in value.lower().split():
            marks = [w for w in re.split(r"[^a-z]+", name) if w]
            if tag == "article":
                if marks and (marks[0] in _OWN or len(marks) == 1 and marks[0] in BOILERPLATE):
                    return label, True
            elif BOILERPLATE.intersection(marks) - (_TITLES if inside and not _SITE.intersection(marks) else frozenset()):
                return label, True
    return label, False


def path_id(labels: list[str]) -> int:
    """The digest of a path of labels, outermost first."""
    out = 0
    for x in labels:
        out = _chained(out, x)
    return out


def _chained(parent: int, label: str) -> int:
    made = hashlib.blake2b(parent.to_bytes(8, "little", signed=True) + label.encode("utf-8", "surrogatepass"), digest_size=8).digest()
    return int.from_bytes(made, "little", signed=True)


class Page:
    """Blocks of a page with the containers around them."""

    def __init__(self, source: str) -> None:
        self._marks = True
        self._scan(source)
        if not self.blocks and self._marked:
            self._marks = False
            self._scan(source)

    def _scan(self, source: str) -> None:
        # containers, each after its parent: path, parent, innermost article and main (or -1)
        self.paths: list[int] = []
        self._parents: list[int] = []
        self._inner: list[tuple[int, int]] = []
        self._marked = False
        self.blocks: list[tuple[int, str, int]] = []  # innermost container, text, linked characters
        self._open: list[tuple[str, bool, int]] = []  # tag, dropped, innermost container
        self._at: dict[str, list[int]] = defaultdict(list)  # places of open tags
        self._text: list[str] = []
        self._linked = 0
        self._read(source)

    def _dropped(self) -> bool:
        return bool(self._open) and self._open[-1][1]

    def _container(self) -> int:
        return self._open[-1][2] if self._open else -1

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.blocks.append((self._container(), text, self._linked))
            self._text, self._linked = [], 0

    def _add(self, raw: str) -> None:
        if raw and not self._dropped():
            text = html.unescape(raw)
            self._text.append(text)
            if self._at["a"]:
                self._linked += len(text.strip())

    def _start(self, tag: str, attrs: str) -> None:
        if tag in BLOCKS:
            self._flush()
            foreign = self._last(_FOREIGN) if tag not in ("option", "label", "legend", "button") else -1
            if foreign > self._last({"foreignobject"}):
                self._close(foreign)
            self._end_open({"p"}, BLOCKS - {"p"})
            if tag in _CLOSES:
                self._end_open(_CLOSES[tag], _LIMITS)
        if tag in VOID:
            if tag == "br":
                self._add(" ")
            return
        inside = bool(self._at["article"] or self._at["main"])
        label, marked = _label(tag, attrs, inside)
        self._marked |= marked
        marked &= self._marks
        bad = tag in DROPPED or (tag == "header" and not inside) or (marked and tag not in ("html", "body", "main"))
        container = self._container()
        if tag in CONTAINERS and not bad and not self._dropped():
            parent, container = container, len(self.paths)
            self.paths.append(_chained(self.paths[parent] if parent >= 0 else 0, label))
            self._parents.append(parent)
            article, main = self._inner[parent] if parent >= 0 else (-1, -1)
            self._inner.append((container if tag == "article" else article, container if tag == "main" else main))
        self._at[tag].append(len(self._open))
        self._open.append((tag, bad or self._dropped(), container))

    def _last(self, tags: set[str] | frozenset[str]) -> int:
        return max((self._at[t][-1] for t in tags if self._at.get(t)), default=-1)

    def _close(self, place: int) -> None:
        while len(self._open) > place:
            self._at[self._open.pop()[0]].pop()

    def _end_open(self, tags: set[str], barrier: frozenset[str] | set[str]) -> None:
        place = self._last(tags)
        if place >= 0 and place > self._last(barrier - tags):
            self._close(place)

    def _end(self, tag: str) -> None:
        if tag in BLOCKS:
            self._flush()
        if self._at.get(tag):
            self._close(self._at[tag][-1])

    def _tag_end(self, source: str, at: int) -> int:
        """Where the tag whose name ends at ``at`` ends, or -1 if nowhere."""
        p = at
        while at >= self._lenient:
            m = _STOP.search(source, p)
            if m is None:
                return -1
            if m[0] == ">":
                return m.start()
            p = source.find(m[0], m.end()) + 1
            if not p:  # this quote is the last of its kind
                self._lenient = m.end()
                break
        return source.find(">", at)

    def _read(self, source: str) -> None:
        at, low, self._lenient, last = 0, None, 0, source.rfind(">")
        self._ends: dict[str, int] = {}
        while True:
            lt = source.find("<", at)
            if lt < 0 or (lt > last and not source.startswith("<!--", lt)):
                break
            if source.startswith("<!--", lt):
                self._add(source[at:lt])
                end = source.find("-->", lt + 4)
                at = end + 3 if end >= 0 else len(source)
                continue
            if source.startswith(("<!", "<?"), lt):
                self._add(source[at:lt])
                at = source.find(">", lt) + 1
                continue
            m = _TAG.match(source, lt)
            end = self._tag_end(source, m.end()) if m else -1
            if end < 0:
                self._add(source[at : lt + 1])
                at = lt + 1
                continue
            self._add(source[at:lt])
            at = end + 1
            tag, attrs = m[1].lower(), source[m.end() : end]
            if source.startswith("/", lt + 1):
                self._end(tag)
            elif tag in RAW:
                if not attrs.endswith("/"):
                    low = low or source.lower()
                    close = low.find(f"</{tag}", at)
                    end = source.find(">", close) if close >= 0 else -1
                    at = end + 1 if end >= 0 else len(source)
            elif tag not in _FALLBACK or self._is_closed(tag, source, at):
                self._start(tag, attrs)
        self._add(source[at:])
        self._flush()

    def _is_closed(self, tag: str, source: str, at: int) -> bool:
        """Whether an end tag of this name follows; each name's last one is looked for once."""
        if tag not in self._ends:
            self._ends[tag] = max((m.start() for m in re.finditer(f"</{tag}", source, re.I)), default=-1)
        return self._ends[tag] >= at

    def scores(self) -> list[float]:
        """Each container's unlinked characters, those of each level below at half."""
        out = [0.0] * len(self.paths)
        for c, text, linked in self.blocks:
            if c >= 0:
                out[c] += max(0, len(text) - 2 * linked)
        for c in range(len(out) - 1, -1, -1):
            if self._parents[c] >= 0:
                out[self._parents[c]] += out[c] / 2
        return out

    def best(self) -> list[tuple[int, float]]:
        """Each container path with its best container's share of the best score."""
        best: dict[int, float] = {}
        for path, s in zip(self.paths, self.scores(), strict=True):
            if s > best.get(path, 0.0):
                best[path] = s
        top = max(best.values(), default=0.0)
        return [(p, s / top) for p, s in best.items()]

    def _whole(self, c: int) -> int:
        article, main = self._inner[c]
        return article if article >= 0 else main if main >= 0 else c

    def _below(self, wanted: set[int]) -> list[str]:
        """Texts of the blocks in the containers, in page order."""
        inside = [False] * len(self.paths)
        for c, parent in enumerate(self._parents):
            inside[c] = c in wanted or (parent >= 0 and inside[parent])
        return [t for c, t, _ in self.blocks if c >= 0 and inside[c]]

    def text(self, path: int | None) -> str:
        held = [False] * len(self.paths)
        for c, _, _ in self.blocks:
            if c >= 0:
                held[c] = True
        for c in range(len(held) - 1, -1, -1):
            if held[c] and self._parents[c] >= 0:
                held[self._parents[c]] = True
        found = self._below({self._whole(c) for c, p in enumerate(self.paths) if p == path and held[c]})
        if not found:
            scores = self.scores()
            if any(held):
                found = self._below({self._whole(max((c for c in range(len(held)) if held[c]), key=lambda c: (scores[c], -c)))})
            else:
                found = [t for _, t, _ in self.blocks]
        return " ".join(found)


@pandas_udf(ArrayType(StructType([StructField("path", LongType()), StructField("score", DoubleType())])))
def best_paths(source: pd.Series) -> pd.Series:
    return pd.Series([Page(x or "").best() for x in source], dtype=object)


@pandas_udf(StringType())
def text_of(source: pd.Series, path: pd.Series) -> pd.Series:
    return pd.Series([Page(x or "").text(None if pd.isna(p) else int(p)) for x, p in zip(source, path.astype("Int64"), strict=True)], dtype=object)


def host_paths(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """(host, path): the container path with most votes on each host."""
    host = F.coalesce(F.lower(F.try_parse_url(F.col(url), F.lit("HOST"))), F.lit(""))
    votes = pages.select(host.alias("host"), F.inline(best_paths(F.col(source))))
    sums = votes.groupBy("host", "path").agg(F.round(F.sum("score"), 6).alias("votes"))
    return sums.groupBy("host").agg(F.max(F.struct("votes", "path"))["path"].alias("path"))


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(page_id, url, text) of every page."""
    winners = materialize(host_paths(pages, url, source), "hostpaths")
    winners = broadcast_if_small(winners.withColumnRenamed("host", "won"))
    host = F.coalesce(F.lower(F.try_parse_url(F.col(url), F.lit("HOST"))), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url"), F.col(source).alias("html"), host.alias("host"))
    return rows.join(winners, F.col("host") == F.col("won"), "left").select("page_id", "url", text_of("html", "path").alias("text"))
