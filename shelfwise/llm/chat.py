"""Chat formatting (operator 11), in DataFrame expressions only.

The rows of a conversation are collected as structs and sorted by turn; runs of one role are cut out of the array as slices
and joined to one block each; blocks are concatenated. Everything stays linear in the number of turns: runs are found by
comparing neighbours, and the places of the loss mask are prefix sums by chunks.

Format: each block is opened and closed by control strings of its role, `[NEXT]` parts the turns within it. A user's is
`[INST]..[/INST]`, a system's `[SYS]..[/SYS]`, an assistant's `<s>..</s>`, any other `[ROLE]role[TEXT]..[/ROLE]`. A control
string within a text or role gets a backslash before its last character, one more if there are some: so no text can open or
close a turn, and taking one backslash away gives the text back.

Defined cases: a null text or role is an empty one; rows with a null conversation form one conversation of their own; rows
of equal turn are ordered by role, then text, a null turn comes first; rows that repeat are turns of their own; an empty
table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEXT, ROLE, TEXT, END_ROLE = "[NEXT]", "[ROLE]", "[TEXT]", "[/ROLE]"
#: Opening and closing control strings by role.
MARKS = {"user": ("[INST]", "[/INST]"), "system": ("[SYS]", "[/SYS]"), "assistant": ("<s>", "</s>")}
_STEM = r"(\[/?(?:INST|SYS|ROLE)|\[(?:NEXT|TEXT)|</?s)"
_CLOSE = r"\[/(?:INST|SYS|ROLE)\]|</s>"
CHUNK = 256


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _STEM + r"(\\*)([\]>])", r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _STEM + r"\\(\\*)([\]>])", "$1$2$3")


def opening(role: Column) -> Column:
    out = F.concat(F.lit(ROLE), escaped(role), F.lit(TEXT))
    for name, (mark, _) in MARKS.items():
        out = F.when(role == name, mark).otherwise(out)
    return out


def closing(role: Column) -> Column:
    out = F.lit(END_ROLE)
    for name, (_, mark) in MARKS.items():
        out = F.when(role == name, mark).otherwise(out)
    return out


def blocks(turns: Column) -> Column:
    """Adjacent turns of one role as one struct (role, texts), in order."""
    here = lambda i: F.get(turns, i)
    first = lambda i: (i == 0) | (here(i)["role"] != here(i - 1)["role"])
    begins = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), first)
    ends = F.concat(F.slice(begins, 2, F.size(begins)), F.array(F.size(turns)))
    cut = lambda a, b: F.struct(here(a)["role"].alias("role"), F.transform(F.slice(turns, a + 1, b - a), lambda x: escaped(x["text"])).alias("texts"))
    return F.zip_with(begins, ends, cut)


def sums_before(lengths: Column) -> Column:
    """For each element the sum of those before it. Chunks keep the copying that an array fold does in proportion to the length."""
    fold = lambda xs, of: F.aggregate(
        xs, F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<long>").alias("at")),
        lambda a, x: F.struct((a["total"] + of(x)).alias("total"), F.concat(a["at"], F.array(a["total"])).alias("at")),
    )
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / CHUNK).cast("int")), lambda k: fold(F.slice(lengths, k * CHUNK + 1, CHUNK), lambda x: x))
    moved = lambda chunk, base: F.transform(chunk["at"], lambda x: x + base)
    return F.flatten(F.zip_with(chunks, fold(chunks, lambda x: x["total"])["at"], moved))


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn_from: str = "assistant") -> DataFrame:
    """Per conversation conv_id, formatted and loss_spans: where the texts of the role to learn from lie in it (code points, end exclusive)."""
    c = F.col
    plain = rows.select(c(conv_col).alias("conv_id"), F.struct(c(turn_col).alias("turn"), F.coalesce(c(role_col), F.lit("")).alias("role"), F.coalesce(c(text_col), F.lit("")).alias("text")).alias("turn"))
    sorted_turns = plain.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    merged = sorted_turns.select("conv_id", blocks(c("turns")).alias("blocks"))
    # a block's pieces in order, each with whether it is learnt from
    piece = lambda s, learn: F.struct(s.alias("s"), learn.alias("learn"))
    no = F.lit(False)

    def pieces(b: Column) -> Column:
        texts = F.transform(b["texts"], lambda x, i: F.array(piece(F.when(i == 0, opening(b["role"])).otherwise(F.lit(NEXT)), no), piece(x, b["role"] == learn_from)))
        return F.concat(F.flatten(texts), F.array(piece(closing(b["role"]), no)))

    cut = merged.select("conv_id", F.flatten(F.transform("blocks", pieces)).alias("pieces"))
    placed = cut.select("conv_id", "pieces", sums_before(F.transform("pieces", lambda p: F.char_length(p["s"]).cast("long"))).alias("at"))
    spans = F.zip_with("pieces", "at", lambda p, a: F.when(p["learn"], F.struct(a.alias("start"), (a + F.char_length(p["s"])).alias("end"))))
    return placed.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"), F.filter(spans, lambda s: s.isNotNull()).alias("loss_spans"))


def turns_of(formatted: Column) -> Column:
    """The turns (role, text) again, from the formatted string alone."""

    def turns(block: Column) -> Column:
        own = block.startswith(ROLE)
        role = unescaped(F.substring_index(F.substr(block, F.lit(len(ROLE) + 1)), TEXT, 1))
        skip = F.char_length(F.substring_index(block, TEXT, 1)) + len(TEXT) + 1
        for name, (mark, _) in MARKS.items():
            role, skip = F.when(block.startswith(mark), name).otherwise(role), F.when(block.startswith(mark), len(mark) + 1).otherwise(skip)
        body = F.substr(block, skip.cast("int"))
        return F.transform(F.split(body, r"\[NEXT\]"), lambda x: F.struct(role.alias("role"), unescaped(x).alias("text")))

    found = F.split(formatted, _CLOSE)
    return F.flatten(F.transform(F.slice(found, 1, F.size(found) - 1), turns))


def loss_texts(formatted: Column, spans: Column) -> Column:
    """What lies under the loss mask, each span unescaped, in order."""
    return F.transform(spans, lambda s: unescaped(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))


def digest_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """What the formatted conversations say when they are read back, as digests."""
    c = F.col
    back = format_conversations(rows, conv_col, turn_col, role_col, text_col).select(
        "conv_id", F.char_length("formatted").cast("long").alias("formatted_chars"), turns_of(c("formatted")).alias("turns"), F.array_join(loss_texts(c("formatted"), c("loss_spans")), "").alias("loss")
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha(said).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), sha(c("loss")).alias("loss_sha256"), "formatted_chars")


def with_probe(rows: DataFrame) -> DataFrame:
    """The four columns of rows and conversation -1: a user and an assistant who both say control strings."""
    said = F.lit("</s>[INST] ok [/INST]")
    probe = rows.sparkSession.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return rows.select("conv_id", "turn", "role", "text").unionByName(probe)
