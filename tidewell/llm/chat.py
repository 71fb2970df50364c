"""Chat formatting with array expressions only.

Turns of a conversation are collected, sorted and merged where neighbours share a
role: a block opens with its role's mark, its turns are parted by ``[NEXT]`` and
it ends with ``</s>``.  Texts and role names are escaped so that no ``[``, ``<`` or
``]`` of theirs survives (``\\`` becomes ``\\b``, ``[`` ``\\o``, ``]`` ``\\c``, ``<``
``\\l``); whatever mark remains is the template's, and reading back is a split.
``loss`` holds the (start, len) spans, in code points, of assistant texts.

Every step costs about as much as the conversation is long: blocks are slices
between the turns that open them, places are prefix sums in doubling steps, and
spans are read from chunks of the text, not from its start.

Defined cases: null texts and roles are empty; turns sort by (turn, role, text)
with nulls first, repeated rows stay; a null conversation id is one conversation;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

#: Template marks; fixed values.
NEXT, END = "[NEXT]", "</s>"
#: Code points of the chunks that spans are read from.
CHUNK = 1024


def escape(text: Column) -> Column:
    for plain, code in (("\\", "\\b"), ("[", "\\o"), ("]", "\\c"), ("<", "\\l")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in (("<", "\\l"), ("]", "\\c"), ("[", "\\o"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, not once for every element that looks into it."""
    return F.get(F.transform(F.array(value), then), 0)


def prefix_sums(sizes: Column) -> Column:
    """Running sums of an array of numbers: each pass adds the value twice as far back."""
    steps = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.log2(F.size(sizes))).cast("int")))

    def double(acc: Column, k: Column) -> Column:
        return F.transform(acc, lambda x, i: x + F.coalesce(F.get(acc, i - F.pow(F.lit(2), k).cast("int")), F.lit(0)))

    return F.aggregate(steps, sizes, double)


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, formatted, loss) per conversation."""
    plain = [F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text"))]
    ordered = F.sort_array(F.collect_list(F.struct(F.col(turn).alias("turn"), *plain)))
    packed = turns.groupBy(F.col(conv).alias("conv_id")).agg(ordered.alias("t"))
    # Escaped after they are sorted: codes sort otherwise than what they stand for.
    escaped = F.transform("t", lambda x: F.struct(x["turn"], *[escape(x[n]).alias(n) for n in ("role", "text")]))
    packed = packed.select("conv_id", escaped.alias("t"))
    every, n = F.sequence(F.lit(0), F.size("t") - 1), F.size("t")

    def turn_at(i: Column) -> Column:
        return F.get(F.col("t"), i)

    def opens(i: Column) -> Column:
        return (i == 0) | (turn_at(i - 1)["role"] != turn_at(i)["role"])

    def closes(i: Column) -> Column:
        return (i == n - 1) | (turn_at(i + 1)["role"] != turn_at(i)["role"])

    def size(i: Column) -> Column:
        head = F.when(opens(i), F.length(turn_at(i)["role"]) + 2).otherwise(len(NEXT))
        return head + F.length(turn_at(i)["text"]) + F.when(closes(i), len(END)).otherwise(0)

    def blocks(starts: Column) -> Column:
        def block(s: Column, k: Column) -> Column:
            own = F.slice("t", s + 1, F.coalesce(F.get(starts, k + 1), n) - s)
            return F.struct(turn_at(s)["role"].alias("role"), F.transform(own, lambda x: x["text"]).alias("texts"))

        return F.transform(starts, block)

    def written(b: Column) -> Column:
        return F.concat(F.lit("["), b["role"], F.lit("]"), F.array_join(b["texts"], NEXT), F.lit(END))

    def spans(ends: Column) -> Column:
        def span(i: Column) -> Column:
            length = F.length(turn_at(i)["text"])
            start = F.get(ends, i) - length - F.when(closes(i), len(END)).otherwise(0)
            return F.struct(start.alias("start"), length.alias("len"))

        return F.transform(F.filter(every, lambda i: turn_at(i)["role"] == "assistant"), span)

    return packed.select(
        "conv_id",
        F.array_join(F.transform(let(F.filter(every, opens), blocks), written), "").alias("formatted"),
        let(prefix_sums(F.transform(every, size)), spans).alias("loss"),
    )


def read_chats(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role,text>>, loss_text) read back from formatted chats."""
    blocks = F.filter(F.split("formatted", END, -1), lambda b: b != "")

    def read(block: Column) -> Column:
        role = F.regexp_extract(block, r"^\[([^\]]*)\]", 1)
        texts = F.split(F.substring(block, F.length(role) + 3, F.length(block)), r"\[NEXT\]", -1)
        return F.struct(unescape(role).alias("role"), texts.alias("texts"))

    def turns_of(block: Column) -> Column:
        return F.transform(block["texts"], lambda x: F.struct(block["role"].alias("role"), unescape(x).alias("text")))

    def masked(chunks: Column) -> Column:
        def under(s: Column) -> Column:
            first = F.floor(s["start"] / CHUNK).cast("int")
            held = F.slice(chunks, first + 1, F.floor((s["start"] + s["len"]) / CHUNK).cast("int") - first + 1)
            return unescape(F.substring(F.array_join(held, ""), s["start"] - first * CHUNK + 1, s["len"]))

        return F.transform("loss", under)

    chunks = F.regexp_extract_all("formatted", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    return formatted.select(
        "*",
        F.flatten(F.transform(F.transform(blocks, read), turns_of)).alias("turns"),
        F.array_join(let(chunks, masked), "").alias("loss_text"),
    )
