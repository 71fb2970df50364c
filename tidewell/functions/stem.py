"""Words of full-text search: folded, split and stemmed as Porter's algorithm says.

``stem_sql`` is the same algorithm as a chain of SQL views, so that a twin can stem too.
"""

from __future__ import annotations

import re
import unicodedata

#: Fixed values of Porter's algorithm (1980, with the author's later "bli" and "logi"): endings and what they become.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
#: Letters of the longest word that is stemmed.
LONGEST = 64

# A word's form: consonant runs and vowel runs; a first y is a consonant and written Y meanwhile.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
MEASURE_1, MEASURE_2 = f"^(?:{_C})?{_V}{_C}", f"^(?:{_C})?{_V}{_C}{_V}{_C}"
MEASURE_IS_1 = f"^(?:{_C})?{_V}{_C}(?:{_V})?$"
HAS_VOWEL, SHORT_END = f"^(?:{_C})?[aeiouy]", f"^{_C}[aeiouy][^aeiouwxyY]$"
_m1, _m2, _is1, _vowel, _short = map(re.compile, (MEASURE_1, MEASURE_2, MEASURE_IS_1, HAS_VOWEL, SHORT_END))


def longest_first(endings) -> str:
    return "|".join(sorted(endings, key=lambda e: (-len(e), e)))


_END2, _END3, _END4 = (re.compile(f"^(.+?)({longest_first(s)})$") for s in (STEP2, STEP3, STEP4))
_CACHE: dict[str, str] = {}
_WORD = re.compile(r"[^\W_]+")


def stem(word: str) -> str:
    """Porter's stem of a folded word; words of fewer than three letters stay."""
    w = word
    if not 3 <= len(w) <= LONGEST:
        return w
    if w[0] == "y":
        w = "Y" + w[1:]
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss") and len(w) > 1:
        w = w[:-1]
    w = _past(w)
    if w.endswith("y") and _vowel.search(w[:-1]):
        w = w[:-1] + "i"
    for pattern, become in ((_END2, STEP2), (_END3, STEP3)):
        m = pattern.match(w)
        if m and _m1.search(m[1]):
            w = m[1] + become[m[2]]
    m = _END4.match(w)
    if m and _m2.search(m[1]) and (m[2] != "ion" or m[1][-1] in "st"):
        w = m[1]
    if w.endswith("e") and (_m2.search(w[:-1]) or _is1.search(w[:-1]) and not _short.search(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _m2.search(w):
        w = w[:-1]
    return w.replace("Y", "y", 1) if w[0] == "Y" else w


def _past(w: str) -> str:
    """Step 1b: eed, ed, ing."""
    if w.endswith("eed"):
        return w[:-1] if _m1.search(w[:-3]) else w
    cut = w[:-2] if w.endswith("ed") else w[:-3] if w.endswith("ing") else ""
    if not cut or not _vowel.search(cut):
        return w
    if cut.endswith(("at", "bl", "iz")):
        return cut + "e"
    if re.search(r"([bcdfghjkmnpqrtvwx])\1$", cut):
        return cut[:-1]
    return cut + "e" if _short.search(cut) else cut


#: The first character that only marks others is U+0300.
_MAYBE_MARKS = re.compile("[\u0300-\U0010ffff]+")


def _unmarked(found: re.Match) -> str:
    return "".join(c for c in found[0] if unicodedata.category(c) != "Mn")


def fold(text: str) -> str:
    """Lower case without accents."""
    lower = text.lower()
    if lower.isascii():
        return lower
    return _MAYBE_MARKS.sub(_unmarked, unicodedata.normalize("NFD", lower))


def terms(text: str | None) -> list[str]:
    """Stems of a text's words, in order."""
    words = _WORD.findall(fold(text)) if text else []
    if len(_CACHE) > 500_000:
        _CACHE.clear()
    for w in set(words).difference(_CACHE):
        _CACHE[w] = stem(w)
    return list(map(_CACHE.__getitem__, words))


def stem_sql(words: str) -> str:
    """SQL views (to stand in a WITH list) that end in ``stems(w, stem)`` of the distinct words ``w`` of a view."""

    def has(x: str, pattern: str) -> str:
        return f"regexp_matches({x}, '{pattern}')"

    def become(x: str, table: dict[str, str]) -> str:
        return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"

    def ending(name: str, before: str, endings) -> str:
        pattern = f"^(.+?)({longest_first(endings)})$"
        return f"{name} AS (SELECT w, x, regexp_extract(x, '{pattern}', 1) AS a, regexp_extract(x, '{pattern}', 2) AS b FROM {before})"

    doubled = " OR ".join(f"a LIKE '%{c}{c}'" for c in "bcdfghjkmnpqrtvwx")
    return f"""
st0 AS (SELECT DISTINCT w FROM {words}),
st1 AS (SELECT w, regexp_replace(w, '^y', 'Y') AS x FROM st0 WHERE length(w) BETWEEN 3 AND {LONGEST}),
st2 AS (SELECT w, CASE WHEN x LIKE '%sses' OR x LIKE '%ies' THEN x[:-3] WHEN x LIKE '%s' AND x NOT LIKE '%ss' THEN x[:-2] ELSE x END AS x FROM st1),
st3 AS (SELECT w, x, CASE WHEN x LIKE '%eed' THEN '' WHEN x LIKE '%ed' THEN x[:-3] WHEN x LIKE '%ing' THEN x[:-4] ELSE '' END AS a FROM st2),
st4 AS (
  SELECT w, CASE WHEN x LIKE '%eed' THEN CASE WHEN {has('x[:-4]', MEASURE_1)} THEN x[:-2] ELSE x END
    WHEN a = '' OR NOT {has('a', HAS_VOWEL)} THEN x WHEN a LIKE '%at' OR a LIKE '%bl' OR a LIKE '%iz' THEN a || 'e'
    WHEN {doubled} THEN a[:-2] WHEN {has('a', SHORT_END)} THEN a || 'e' ELSE a END AS x FROM st3),
st5 AS (SELECT w, CASE WHEN x LIKE '%y' AND {has('x[:-2]', HAS_VOWEL)} THEN x[:-2] || 'i' ELSE x END AS x FROM st4),
{ending('st6', 'st5', STEP2)},
st7 AS (SELECT w, CASE WHEN b <> '' AND {has('a', MEASURE_1)} THEN a || {become('b', STEP2)} ELSE x END AS x FROM st6),
{ending('st8', 'st7', STEP3)},
st9 AS (SELECT w, CASE WHEN b <> '' AND {has('a', MEASURE_1)} THEN a || {become('b', STEP3)} ELSE x END AS x FROM st8),
{ending('st10', 'st9', STEP4)},
st11 AS (SELECT w, CASE WHEN b <> '' AND {has('a', MEASURE_2)} AND (b <> 'ion' OR {has('a', '[st]$')}) THEN a ELSE x END AS x FROM st10),
st12 AS (
  SELECT w, CASE WHEN x LIKE '%e' AND ({has('x[:-2]', MEASURE_2)} OR {has('x[:-2]', MEASURE_IS_1)} AND NOT {has('x[:-2]', SHORT_END)})
    THEN x[:-2] ELSE x END AS x FROM st11),
st13 AS (SELECT w, CASE WHEN x LIKE '%ll' AND {has('x', MEASURE_2)} THEN x[:-2] ELSE x END AS x FROM st12),
stems AS (
  SELECT w, regexp_replace(x, '^Y', 'y') AS stem FROM st13
  UNION ALL SELECT w, w FROM st0 WHERE NOT length(w) BETWEEN 3 AND {LONGEST})"""
