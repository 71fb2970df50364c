"""Word rules shared by the operators.

Two kinds of words occur.  *Plain* words are runs of anything but ASCII white
space (``[^\\x20\\x09-\\x0D]+``); ``bytes.split()`` splits on just that set.
*Letter* words are runs of ASCII letters, digits and non-ASCII characters after
A-Z were lower-cased (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``).
"""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, functions as F

#: Byte table: A-Z to a-z, every other ASCII character outside [0-9a-z] to a space.
_LETTERS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)

#: What a Python worker keeps between tasks; workers outlive the jobs they serve.
CACHES: list[dict] = []


def drop_caches() -> None:
    """Free what another operator's tasks left in this worker."""
    if any(CACHES):
        for cache in CACHES:
            cache.clear()
        release_memory()


def release_memory() -> None:
    """Give what a task has freed back to the machine; executors count their workers' memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def encode(text: str | None) -> bytes:
    """UTF-8 of a text; null counts as empty, lone surrogates are kept as bytes."""
    return (text or "").encode("utf-8", "surrogatepass")


def plain_words(text: str | None) -> list[bytes]:
    return encode(text).split()


def letter_words(text: str | None) -> list[bytes]:
    return encode(text).translate(_LETTERS).split()


def letter_words_col(text: Column) -> Column:
    """Array of letter words of a string column; null gives an empty array."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    words = F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.filter(words, lambda w: w != "")


def plain_words_col(text: Column) -> Column:
    """Array of plain words of a string column; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def row_key(id_col: str, text: str) -> Column:
    """MD5 of a row's id and text, which tells rows apart; null texts are empty."""
    row_id = F.coalesce(F.col(id_col).cast("string"), F.lit("\x01"))
    return F.unhex(F.md5(F.concat(row_id, F.lit("\x00"), F.coalesce(F.col(text), F.lit(""))).cast("binary")))
