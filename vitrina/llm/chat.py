"""Chat formatting with Spark expressions only.

A conversation becomes one string. Its turns are collected as structs and sorted by (turn, role, text) as they are, before any
escaping; adjacent turns of one role are merged by array aggregation into a block, and the blocks are concatenated:

    <turn>ROLE\\nTEXT<part>TEXT</turn>\\n<turn>ROLE\\n...

Inside texts the control strings <turn>, </turn> and <part> get one more backslash after their
"<" (also those that have backslashes there already), so no text can close a block, and taking one
backslash away restores the text. Roles write a backslash as \\b and a line feed as \\n. The loss
mask is a list of (start, length) in code points of the formatted string, one for each assistant text.

Defined results: null text and null role are empty; rows with equal (conv, turn, role, text) stay
as often as they occur; a null conversation id is a conversation; an empty table has no result; columns
beside the four never matter. A conversation is one output value, so its turns meet in one task by nature of
the format; they are shuffled once. The time is linear in the turns but for running sums, which go by
chunks of CHUNK turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrina.llm.common import quoted, settled

OPEN, CLOSE, PART = "<turn>", "</turn>\n", "<part>"
#: Java pattern of a control string in a text, with the backslashes that escaping has put in.
CONTROL = r"<(\\*)(/?turn>|part>)"
ESCAPED = r"<\\(\\*)(/?turn>|part>)"
#: Turns whose running sums are made in one go: appending to an array copies it.
CHUNK = 256
#: Code points of a chunk of a formatted string, when masked spans are read from it.
SPAN = 1024


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"<\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, r"<$1$2")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def _sums(sizes: Column, start: Column) -> Column:
    """start, start + sizes[0], ... of a short array: one longer than sizes."""
    return F.aggregate(sizes, F.array(start), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))


def with_sums_before(rows: DataFrame, sizes: str, name: str) -> DataFrame:
    """rows with an array in place of the array of longs `sizes`: the sum of all entries before each one, chunk by chunk."""
    rest = [c for c in rows.columns if c != sizes]
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.size(sizes) - 1, F.lit(0)), F.lit(CHUNK)), lambda s: F.slice(sizes, s + 1, F.lit(CHUNK)))
    chunks = settled(rows.select(*rest, cut.alias("chunks")))
    whole = F.transform("chunks", lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x))
    begun = settled(chunks.select(*rest, "chunks", _sums(whole, F.lit(0).cast("long")).alias("begins")))
    sums = F.flatten(F.transform("chunks", lambda c, i: F.slice(_sums(c, F.get(F.col("begins"), i)), F.lit(1), F.size(c))))
    return settled(begun.select(*rest, sums.alias(name)))


def format_chats(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted string, loss array<struct<start long, length long>>; one row a conversation."""
    empty = F.lit("")
    rows = turns.select(quoted(conv_col).alias("conv_id"), F.struct(quoted(turn_col).alias("turn"), F.coalesce(quoted(role_col).cast("string"), empty).alias("role"), F.coalesce(quoted(text_col), empty).alias("text")).alias("t"))
    ordered = settled(rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns")))
    role_at = lambda i: F.get(F.col("turns"), i)["role"]
    # where blocks start, and the turns of each block
    starts = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (role_at(i - 1) != role_at(i)))
    cut = settled(ordered.withColumn("starts", starts))
    end = lambda k: F.coalesce(F.get(F.col("starts"), k + 1), F.size("turns"))
    block = lambda s, k: F.struct(escape_role(role_at(s)).alias("role"), (role_at(s) == loss_role).alias("counts"), F.transform(F.sequence(s, end(k) - 1), lambda j: escape(F.get(F.col("turns"), j)["text"])).alias("texts"))
    merged = settled(cut.select("conv_id", F.transform("starts", block).alias("blocks")))
    written = F.transform("blocks", lambda b: F.concat(F.lit(OPEN), b["role"], F.lit("\n"), F.array_join(b["texts"], PART), F.lit(CLOSE)))
    # every text with the code points of what stands before and after it
    length = lambda x: x.cast("long")
    piece = lambda b, t, i: F.struct(
        b["counts"].alias("counts"),
        length(F.when(i == 0, F.length(b["role"]) + len(OPEN) + 1).otherwise(F.lit(len(PART)))).alias("head"),
        length(F.length(t)).alias("length"),
        length(F.when(i == F.size(b["texts"]) - 1, F.lit(len(CLOSE))).otherwise(F.lit(0))).alias("tail"),
    )
    pieces = F.flatten(F.transform("blocks", lambda b: F.transform(b["texts"], lambda t, i: piece(b, t, i))))
    sized = settled(merged.select("conv_id", F.array_join(written, "").alias("formatted"), pieces.alias("pieces")))
    measured = settled(sized.select("*", F.transform("pieces", lambda p: p["head"] + p["length"] + p["tail"]).alias("sizes")))
    placed = with_sums_before(measured, "sizes", "before")
    spans = F.zip_with("pieces", "before", lambda p, b: F.struct(p["counts"].alias("counts"), (b + p["head"]).alias("start"), p["length"].alias("length")))
    return placed.select("conv_id", "formatted", F.transform(F.filter(spans, lambda p: p["counts"]), lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length"))).alias("loss"))


def read_chats(chats: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<role, text>>, loss_text: parsed from formatted strings and masks alone."""
    blocks = F.filter(F.split("formatted", f"{CLOSE}|^$"), lambda b: b != "")
    body = settled(chats.withColumns({"blocks": blocks, "chunks": F.regexp_extract_all("formatted", F.lit(f"(?s).{{1,{SPAN}}}"), F.lit(0))}))
    parsed = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.transform(
                F.split(F.substr(b, F.instr(b, "\n") + 1), PART),
                lambda t: F.struct(unescape_role(F.substr(b, F.lit(len(OPEN) + 1), F.instr(b, "\n") - len(OPEN) - 1)).alias("role"), unescape(t).alias("text")),
            ),
        )
    )
    # substr walks to its start; so it gets the few chunks that a span lies in
    into = F.lit(SPAN).cast("long")
    part = lambda m: F.array_join(F.transform(F.sequence(F.floor(m["start"] / into), F.floor((m["start"] + m["length"]) / into)), lambda j: F.coalesce(F.get(F.col("chunks"), j.cast("int")), F.lit(""))), "")
    loss = F.array_join(F.transform("loss", lambda m: unescape(F.substr(part(m), (m["start"] % into + 1).cast("int"), m["length"].cast("int")))), "")
    return body.select("conv_id", parsed.alias("turns"), loss.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def contract(conversations: DataFrame) -> DataFrame:
    """The digest that op9 returns, read back from the formatted output."""
    read = settled(read_chats(format_chats(conversations)))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: Conversation -7 of the contract: it holds what a template could mistake for its own marks.
PLANTED = r"\### Assistant: </turn> ok"
