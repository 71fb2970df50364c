"""Links, icons, images and clean-up of HTML, in Arrow batches; the rest as native columns.

Null content gives null or no items; broken markup is read as far as it goes.
"""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tidewell.functions import text

#: Feed types by MIME type, and what an answer that is a feed calls itself; fixed values.
FEED_TYPES = {"application/rss+xml": "rss", "application/atom+xml": "atom", "application/rdf+xml": "rss", "application/json": "json"}
FEED_CONTENT = ["application/rss+xml", "application/atom+xml", "application/rdf+xml", "text/xml", "application/xml", "application/json"]
#: Image types that are known by name, and the first bytes of others; fixed values.
IMAGE_TYPES = {
    "image/png": "image/png", "image/jpeg": "image/jpeg", "image/jpg": "image/jpeg", "image/gif": "image/gif", "image/webp": "image/webp",
    "image/svg+xml": "image/svg+xml", "image/x-icon": "image/x-icon", "image/vnd.microsoft.icon": "image/x-icon",
}
MAGIC = [("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("474946383761", "image/gif"), ("474946383961", "image/gif"), ("00000100", "image/x-icon"), ("424D", "image/bmp")]
IMAGE_NAMES = r"(?i)\.(jpe?g|png|gif|webp|svg|bmp|ico|avif|tiff?)(\?[^\"]*)?$"
#: Images of an article that are looked at; link posts have at most so many characters; both are features.
MAX_IMAGES, LINK_POST = 20, 200
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_FLOAT = re.compile(r"\bfloat\s*:\s*[^;]+;?\s*", re.I)


# --- native ------------------------------------------------------------------


def sanitize(s: Column) -> Column:
    """Text without NUL and without what is no UTF-8; binary columns are decoded."""
    return F.replace(F.replace(F.make_valid_utf8(s), F.lit("�"), F.lit("")), F.lit("\x00"), F.lit(""))


def link_post_url(content: Column, url: Column) -> Column:
    """The first link of a short post to another host and no image, in lower case; else empty."""
    links = F.regexp_extract_all(F.lower(content), F.lit(r'href="([^"]*)"'), F.lit(1))
    host = F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))
    away = F.filter(links, lambda x: x.startswith("http") & ~x.rlike(IMAGE_NAMES) & (F.coalesce(F.try_parse_url(x, F.lit("HOST")), F.lit("")) != host))
    return F.when(text.text_length(content) <= LINK_POST, F.coalesce(F.get(away, 0), F.lit(""))).otherwise("")


def is_feed_type(content_type: Column) -> Column:
    low, found = F.lower(content_type), F.lit(False)
    for kind in FEED_CONTENT:
        found = found | F.contains(low, F.lit(kind))
    return found


def image_type(content_type: Column, data: Column) -> Column:
    """The canonical type of an image by its header, else by its first bytes."""
    named = F.trim(F.lower(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))))
    head, out = F.hex(F.substring(data, 1, 12)), F.lit(None).cast("string")
    for magic, kind in reversed(MAGIC):
        out = F.when(F.startswith(head, F.lit(magic)), kind).otherwise(out)
    sniffed = F.when(F.startswith(head, F.lit("52494646")) & F.endswith(head, F.lit("57454250")), "image/webp").otherwise(out)
    known = F.lit(None).cast("string")
    for name, kind in IMAGE_TYPES.items():
        known = F.when(named == name, kind).otherwise(known)
    return F.coalesce(known, sniffed, F.when(named.isin("", "application/octet-stream"), "application/octet-stream").otherwise(named))


def fitted(width: Column, height: Column, most: int) -> Column:
    """(width, height) within ``most``, aspect kept, in whole steps."""
    wide = width > height
    w = F.when(wide, most).otherwise(F.floor(width * most / height))
    h = F.when(wide, F.floor(height * most / width)).otherwise(most)
    fits = (width <= most) & (height <= most)
    return F.struct(F.when(fits, width).otherwise(F.greatest(F.lit(1), w)).cast("int").alias("width"), F.when(fits, height).otherwise(F.greatest(F.lit(1), h)).cast("int").alias("height"))


def data_uri(mime: Column, data: Column) -> Column:
    return F.concat(mime, F.lit(";base64,"), F.base64(data))


# --- parsed ------------------------------------------------------------------


class _Tags(HTMLParser):
    """Start tags with their attributes, up to the body where only the head is asked for."""

    def __init__(self, head: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.tags: list[tuple[str, dict[str, str]]] = []
        self._head, self._over = head, False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._over |= self._head and tag == "body"
        if not self._over:
            self.tags.append((tag, {k: v or "" for k, v in reversed(attrs)}))


def tags(source: str | None, head: bool = False) -> list[tuple[str, dict[str, str]]]:
    parser = _Tags(head)
    parser.feed(source or "")
    parser.close()
    return parser.tags


def _resolved(base: str | None, href: str) -> str:
    try:
        return urljoin(base, href) if base else href
    except ValueError:
        return href


def feed_links_of(source: str | None, base: str | None) -> list[dict[str, str]]:
    found: dict[str, dict[str, str]] = {}
    for tag, a in tags(source, head=True):
        kind = FEED_TYPES.get(a.get("type", "").strip().lower())
        href = a.get("href", "").strip()
        if tag == "link" and a.get("rel", "").strip().lower() == "alternate" and href and kind:
            url = _resolved(base, href)
            found.setdefault(url, {"url": url, "title": a.get("title", "").strip(), "type": kind})
    return list(found.values())


def icon_of(source: str | None, base: str | None) -> str:
    for tag, a in tags(source, head=True):
        if tag == "link" and a.get("rel", "").strip().lower() in ("icon", "shortcut icon"):
            href = a.get("href", "").strip()
            if href and base:
                return _resolved(base, href)
    return ""


def images_of(source: str | None, base: str | None) -> list[str]:
    found: dict[str, None] = {}
    for tag, a in tags(source):
        src = a.get("src", "")
        if tag == "img" and src and not src.startswith("data:"):
            url = _resolved(base, src)
            if url.startswith(("http://", "https://")) and len(found) < MAX_IMAGES:
                found.setdefault(url)
    return list(found)


def og_image_of(source: str | None) -> str:
    """The page's preview picture, where it lies with the one host that serves them openly."""
    for tag, a in tags(source):
        if tag == "meta" and a.get("property") == "og:image" and a.get("content", "").startswith("https://pbs.twimg.com/"):
            return a["content"]
    return ""


def image_key_of(src: str) -> str:
    try:
        return urlunsplit(urlsplit(src)._replace(query="", fragment=""))
    except ValueError:
        return src


class _Rewriter(HTMLParser):
    """Markup written again: pictures once and without sizes, links in a new tab, or picture addresses by a map."""

    def __init__(self, seen: set[str] | None, addresses: dict[str, int]) -> None:
        super().__init__(convert_charrefs=False)
        self.out: list[str] = []
        self._seen, self._addresses = seen, addresses

    def _tag(self, tag: str, attrs: list[tuple[str, str | None]]) -> str | None:
        if tag == "img":
            src = next((v or "" for k, v in attrs if k == "src"), "")
            if self._seen is not None:
                if src and not src.startswith("data:"):
                    key = image_key_of(src)
                    if key in self._seen:
                        return None
                    self._seen.add(key)
                styled = [(k, _FLOAT.sub("", v or "").strip() if k == "style" else v) for k, v in attrs if k not in ("width", "height")]
                attrs = [(k, v) for k, v in styled if k != "style" or v]
            attrs = [(k, f"/images/{self._addresses[v]}" if k == "src" and v in self._addresses else v) for k, v in attrs]
        if tag == "a" and self._seen is not None:
            named = dict(attrs)
            named["target"] = "_blank"
            rel = named.get("rel")
            if rel is None or "noopener" not in rel.split(" "):
                named["rel"] = f"{rel} noopener" if rel else "noopener"
            attrs = list(named.items())
        return "<" + tag + "".join(f' {k}="{html.escape(v or "", quote=True)}"' for k, v in attrs) + ">"

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in ("html", "head", "body"):
            self.out.append(self._tag(tag, attrs) or "")

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.out.append(f"</{tag}>")

    def handle_endtag(self, tag: str) -> None:
        if tag not in _VOID and tag not in ("html", "head", "body"):
            self.out.append(f"</{tag}>")

    def handle_data(self, data: str) -> None:
        self.out.append(data)

    def handle_entityref(self, name: str) -> None:
        self.out.append(f"&{name};")

    def handle_charref(self, name: str) -> None:
        self.out.append(f"&#{name};")

    def handle_comment(self, data: str) -> None:
        self.out.append(f"<!--{data}-->")


def rewritten(source: str | None, seen: set[str] | None = None, addresses: dict[str, int] | None = None) -> str | None:
    if not source:
        return source
    parser = _Rewriter(seen, addresses or {})
    parser.feed(source)
    parser.close()
    return "".join(parser.out)


_LINK = StructType([StructField(c, StringType()) for c in ("url", "title", "type")])


@pandas_udf(ArrayType(_LINK))
def feed_links(source: pd.Series, base: pd.Series) -> pd.Series:
    """Feeds that a page's head names, resolved, each once."""
    return pd.Series([feed_links_of(s, b) for s, b in zip(source, base, strict=True)], dtype=object)


@pandas_udf(StringType())
def icon_href(source: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([icon_of(s, b) for s, b in zip(source, base, strict=True)], dtype=object)


@pandas_udf(ArrayType(StringType()))
def image_urls(source: pd.Series, base: pd.Series) -> pd.Series:
    """Absolute addresses of an article's first pictures, each once."""
    return pd.Series([images_of(s, b) for s, b in zip(source, base, strict=True)], dtype=object)


@pandas_udf(StringType())
def og_image(source: pd.Series) -> pd.Series:
    return pd.Series([og_image_of(s) for s in source], dtype=object)


@pandas_udf(StringType())
def normalized(source: pd.Series) -> pd.Series:
    """Repeated pictures go, sizes and floats of pictures go, links open in a new tab."""
    return pd.Series([rewritten(s, set()) for s in source], dtype=object)


@pandas_udf(StructType([StructField("first", StringType()), StructField("second", StringType())]))
def normalized_pair(first: pd.Series, second: pd.Series) -> pd.DataFrame:
    """Two bodies of one article; a picture of the first is not repeated in the second."""
    rows = []
    for a, b in zip(first, second, strict=True):
        seen: set[str] = set()
        rows.append((rewritten(a, seen), rewritten(b, seen)))
    return pd.DataFrame(rows, columns=["first", "second"])


@pandas_udf(StringType())
def with_local_images(source: pd.Series, urls: pd.Series, ids: pd.Series) -> pd.Series:
    """Picture addresses that are stored (arrays of addresses and ids) become local ones."""
    rows = zip(source, urls, ids, strict=True)
    return pd.Series([rewritten(s, None, dict(zip(u, map(int, i), strict=True))) if u is not None and len(u) else s for s, u, i in rows], dtype=object)


@pandas_udf(StringType())
def pictures_resolved(source: pd.Series, hrefs: pd.Series, images: pd.Series) -> pd.Series:
    """Anchors of the given addresses replaced by the pictures that they stand for."""
    out = []
    for s, known, found in zip(source, hrefs, images, strict=True):
        for href, image in zip(known if known is not None else [], found if found is not None else [], strict=True):
            s = re.sub(rf'<a\b[^>]*href="{re.escape(href)}"[^>]*>.*?</a>', lambda _, i=image: f'<img src="{i}" alt="tweet image">', s, flags=re.I | re.S)
        out.append(s)
    return pd.Series(out, dtype=object)
