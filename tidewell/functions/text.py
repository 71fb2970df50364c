"""Text heuristics over feed content as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Markers of cut-off content and of useless summaries; fixed values.
CUT_MARKERS = ["...", "…", "[…]", "[ ... ]", "[read more]", "[continue reading]"]
GARBAGE = [
    "### user:", "### assistant:", "### instruction:", "### promotee", "rgb-gpt", "beating_json", "followeddit.com",
    "your assistant to solve", "write an extensive researcher",
]


def strip_tags(s: Column) -> Column:
    """Text outside tags; every ``>`` is dropped."""
    return F.replace(F.regexp_replace(s, "<[^>]*>?", ""), F.lit(">"), F.lit(""))


def text_length(s: Column) -> Column:
    """Code points outside tags that are not blank, tab or line end."""
    return F.length(F.regexp_replace(strip_tags(s), r"[ \t\n\r]", ""))


def ends_sentence(s: Column) -> Column:
    return F.rtrim(s).rlike("[.!?\"'’”]$")


def is_truncated(s: Column, min_chars: int = 500) -> Column:
    """Content that is empty, ends in a cut marker, or is short and stops mid-sentence."""
    text = F.lower(F.regexp_replace(strip_tags(s), r"[ \t\n\r]+$", ""))
    marked = F.lit(False)
    for m in CUT_MARKERS:
        marked = marked | F.endswith(text, F.lit(m))
    return marked | ((text_length(s) < min_chars) & ~ends_sentence(text))


#: E-mail addresses, plain or written out; fixed pattern.
ADDRESS = (
    r"(?i)\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b"
    r"|\b\S+\s+at\s+\S+\s+dot\s+\S+\b"
    r"|\b\S+\s+at\s+[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b"
)


def looks_like_contacts(s: Column, least: int = 3) -> Column:
    """At least ``least`` e-mail addresses outside tags."""
    return F.regexp_count(strip_tags(s), F.lit(ADDRESS)) >= least


def clean_title(s: Column) -> Column:
    """A title without a link at its end."""
    return F.trim(F.regexp_replace(s, r"[:\s]+(https?://\S+)\s*$", ""))


def extract_json(s: Column) -> Column:
    """From the first ``{`` to the last ``}``, else the whole text."""
    found = F.regexp_extract(s, r"(?s)\{.*\}", 0)
    return F.when(found == "", s).otherwise(found)


def is_garbage(s: Column) -> Column:
    low = F.lower(s)
    found = F.lit(False)
    for g in GARBAGE:
        found = found | F.contains(low, F.lit(g))
    return found


def image_key(url: Column) -> Column:
    return F.regexp_replace(url, r"[?#].*$", "")


def cut_bytes(s: Column, n: int) -> Column:
    """The characters that lie wholly in the first ``n`` bytes."""
    raw = F.substring(s.cast("binary"), 1, n)
    return F.when(F.octet_length(s) <= n, s).otherwise(F.regexp_replace(F.make_valid_utf8(raw.cast("string")), "\ufffd+$", ""))


def truncate_bytes(s: Column, n: int) -> Column:
    """Cut to ``n`` bytes, with a mark where something was cut."""
    return F.when(F.octet_length(s) <= n, s).otherwise(F.concat(cut_bytes(s, n), F.lit("...")))


def truncate(s: Column, n: int) -> Column:
    """Trimmed, and cut to ``n`` bytes with a mark."""
    return truncate_bytes(F.trim(s), n)


def rfc3339(at: Column) -> Column:
    """A UTC time as text; empty where there is none."""
    return F.coalesce(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))


def shingle_overlap(a: Column, b: Column, size: int = 3) -> Column:
    """Whether any ``size`` consecutive words of ``a`` occur in ``b``; true for shorter texts.

    Both texts are split and lower-cased once and handed on, not again for every word.
    """

    def overlaps(x: Column) -> Column:
        w, n = x["words"], F.size(x["words"]) - size
        places = F.sequence(F.lit(1), F.greatest(n + 1, F.lit(1)))
        return F.when(n < 0, True).otherwise(F.exists(places, lambda i: F.contains(x["other"], F.array_join(F.slice(w, i, size), " "))))

    words = F.filter(F.split(F.lower(a), r"\s+"), lambda x: x != "")
    return F.get(F.transform(F.array(F.struct(words.alias("words"), F.lower(b).alias("other"))), overlaps), F.lit(0))


def best_date(published: Column, fetched: Column) -> Column:
    """The fetch time where a date has no time of day and was fetched later."""
    midnight = F.date_trunc("day", published) == published
    return F.when(published.isNull(), fetched).when(midnight & (fetched > published), fetched).otherwise(published)


def relative_date(seconds: Column, day: Column) -> Column:
    """'5m ago', '3h ago', '2d ago', then the date."""
    return (
        F.when(seconds < 3600, F.concat((seconds / 60).cast("long").cast("string"), F.lit("m ago")))
        .when(seconds < 86400, F.concat((seconds / 3600).cast("long").cast("string"), F.lit("h ago")))
        .when(seconds < 7 * 86400, F.concat((seconds / 86400).cast("long").cast("string"), F.lit("d ago")))
        .otherwise(F.date_format(day, "MMM d, yyyy"))
    )


def api_key(email: Column, password: Column) -> Column:
    return F.md5(F.concat_ws(":", email, password).cast("binary"))
