"""Items of RSS, Atom and JSON feed files.

A file that cannot be read has no items; nothing is fetched from the network.
"""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType, TimestampNTZType

_AUTHOR = StructType([StructField("name", StringType()), StructField("email", StringType())])
#: An item as it stands in a feed; fixed format.
ITEM = StructType(
    [
        StructField("guid", StringType()), StructField("title", StringType()), StructField("link", StringType()), StructField("description", StringType()), StructField("content", StringType()),
        StructField("authors", ArrayType(_AUTHOR)), StructField("categories", ArrayType(StringType())), StructField("published", TimestampNTZType()), StructField("updated", TimestampNTZType()),
        StructField("thumbnail", StringType()), StructField("media_description", StringType()),
    ]
)
_NAMES = ITEM.names


def _date(s: str | None) -> datetime | None:
    for read in (parsedate_to_datetime, datetime.fromisoformat):
        try:
            at = read((s or "").strip().replace("Z", "+00:00") if read is datetime.fromisoformat else (s or "").strip())
        except (ValueError, TypeError):
            continue
        return at.astimezone(timezone.utc).replace(tzinfo=None) if at.tzinfo else at
    return None


def _local(node: ET.Element) -> str:
    return node.tag.rpartition("}")[2].lower() if isinstance(node.tag, str) else ""


def _is_media(node: ET.Element) -> bool:
    return isinstance(node.tag, str) and "search.yahoo.com/mrss" in node.tag


def _item(node: ET.Element) -> dict:
    out: dict = dict.fromkeys(_NAMES)
    out |= {"authors": [], "categories": []}
    media: list[ET.Element] = []
    for x in node:
        name, value = _local(x), "".join(x.itertext()).strip()
        if _is_media(x):
            media.append(x)
        elif name in ("guid", "id"):
            out["guid"] = value
        elif name == "title":
            out["title"] = value
        elif name == "link":
            if out["link"] is None or x.get("rel", "alternate") == "alternate":
                out["link"] = x.get("href") or value
        elif name in ("description", "summary"):
            out["description"] = value
        elif name in ("encoded", "content"):
            out["content"] = value
        elif name in ("author", "creator"):
            parts = {_local(c): (c.text or "").strip() for c in x}
            out["authors"].append({"name": parts.get("name") or value, "email": parts.get("email")})
        elif name == "category":
            out["categories"].append(x.get("term") or value)
        elif name in ("pubdate", "published", "date"):
            out["published"] = _date(value)
        elif name in ("updated", "modified"):
            out["updated"] = _date(value)
    for x in [*media, *[c for m in media if _local(m) == "group" for c in m]]:
        if _local(x) == "thumbnail":
            out["thumbnail"] = out["thumbnail"] or x.get("url")
        elif _local(x) == "description":
            out["media_description"] = out["media_description"] or (x.text or "").strip()
    out["guid"] = out["guid"] or out["link"]
    return out


def _json_item(x: dict) -> dict:
    authors = x.get("authors") or ([x["author"]] if x.get("author") else [])
    return dict.fromkeys(_NAMES) | {
        "guid": str(x.get("id") or x.get("url") or ""), "title": x.get("title"), "link": x.get("url"), "description": x.get("summary"),
        "content": x.get("content_html") or x.get("content_text"), "authors": [{"name": a.get("name"), "email": None} for a in authors],
        "categories": list(x.get("tags") or []), "published": _date(x.get("date_published")), "updated": _date(x.get("date_modified")),
    }


def items_of(body: str | None) -> list[dict]:
    start = (body or "").lstrip()
    try:
        if start.startswith("{"):
            return [_json_item(x) for x in json.loads(start).get("items") or []]
        return [_item(x) for x in ET.fromstring(start).iter() if _local(x) in ("item", "entry")]
    except (ET.ParseError, ValueError, AttributeError, TypeError):
        return []


@pandas_udf(ArrayType(ITEM))
def feed_items(body: pd.Series) -> pd.Series:
    return pd.Series([items_of(x) for x in body], dtype=object)


def items(files: DataFrame, feed: str = "feed_id", body: str = "body") -> DataFrame:
    """One row for each item of each file (feed_id, body), with its place in the file."""
    rows = files.select(F.col(feed).alias("feed_id"), F.posexplode(feed_items(F.col(body))).alias("place", "item"))
    return rows.select("feed_id", "place", "item.*")
