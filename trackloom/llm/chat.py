"""Chat formatting with typed content parts, in DataFrame functions only.

A turn is `<|im_start|>role\\ncontent<|im_end|>\\n`. visit() flattens the parts of a message, in their order: text is
escaped, other parts become a placeholder `<|kind:k|>` (k counts the attachments of the message from 0), and each
attachment is recorded with its reference and the number of tokens that its placeholder stands for.

Escaping is reversible: in any text, `<`, backslashes, `|` gets one backslash more, so no text can hold a control
string, and read_back() takes one away. In a role, `\\` and line feeds are escaped too, as `\\\\` and `\\n`.

Nulls: a null text is an empty one, a null role an empty one, null parts are none, a part of an unknown or null kind is
an attachment of kind `part`, a null token count is 0. Turns are taken by turn number, nulls first, then by role and
content; repeated rows are turns of their own. A null conv_id is a conversation of its own. An empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Kinds of parts that become placeholders, and the tokens of one unless the part tells its own number.
ATTACHMENTS = {"image": 256, "audio": 128, "document": 512}
PART = "struct<kind:string,text:string,ref:string,tokens:bigint>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    """Undoes escape_role: after the text escape, each backslash pair or backslash n stands for one character."""
    parts = F.split(unescape(role), r"\\\\", -1)  # at pairs of backslashes, from the left
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def text_part(text: Column) -> Column:
    """Content of one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.cast("string").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("tokens"))).cast(f"array<{PART}>")


def visit(parts: Column) -> tuple[Column, Column]:
    """Content string and attachments (position, kind, ref, tokens) of an array of parts."""
    parts = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    is_text = lambda p: F.coalesce(p["kind"] == "text", F.lit(False))
    kind = lambda p: F.when(p["kind"].isin(*ATTACHMENTS), p["kind"]).otherwise("part")
    usual = F.create_map(*(F.lit(x) for pair in ATTACHMENTS.items() for x in pair))
    attached = F.transform(F.filter(parts, lambda p: ~is_text(p)), lambda p, k: F.struct(k.alias("position"), kind(p).alias("kind"), p["ref"].alias("ref"), F.coalesce(p["tokens"], F.try_element_at(usual, kind(p)).cast("bigint"), F.lit(0)).cast("bigint").alias("tokens")))
    before = lambda i: F.size(F.filter(F.slice(parts, F.lit(1), i), lambda p: ~is_text(p)))
    shown = F.transform(parts, lambda p, i: F.when(is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), kind(p), F.lit(":"), before(i).cast("string"), F.lit("|>"))))
    return F.array_join(shown, ""), attached


def format_chats(messages: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """messages: conv_id, turn, role, parts. Per conversation: formatted (string), loss (spans of code points under the
    loss mask: content of trained roles), attachments (turn number, position, kind, ref, tokens) and expanded_tokens
    (tokens of all attachments)."""
    content, attached = visit(F.col("parts"))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    turns = messages.select("conv_id", "turn", role.alias("role"), content.alias("content"), attached.alias("attached"))
    turns = turns.withColumn("opening", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))).withColumn("shown", F.concat("opening", "content", F.lit(f"{END}\n")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content")
    turns = turns.withColumn("nth", F.row_number().over(order)).withColumn("at", F.coalesce(F.sum(F.length("shown")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("opening"))
    is_trained = F.col("role").isin(*trained)
    row = F.struct("nth", "shown", "attached", F.when(is_trained, F.struct(F.col("at").cast("bigint").alias("start"), (F.col("at") + F.length("content")).cast("bigint").alias("end"))).alias("span"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("turns"))
    attachments = F.flatten(F.transform("turns", lambda t: F.transform(t["attached"], lambda a: F.struct(t["nth"].alias("turn"), a["position"].alias("position"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["shown"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss"),
        attachments.alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda total, a: total + a["tokens"]))


def read_back(chats: DataFrame) -> DataFrame:
    """Adds what the formatted string says: turns (role, text) and learnt (text under the loss mask, unescaped, joined)."""
    split = F.filter(F.split("formatted", r"<\|im_end\|>\n", -1), lambda x: x != "")
    body = lambda x: F.substr(x, F.lit(len(START) + 1))
    turns = F.transform(split, lambda x: F.struct(unescape_role(F.substring_index(body(x), "\n", 1)).alias("role"), unescape(F.substr(body(x), F.instr(body(x), "\n") + 1)).alias("text")))
    learnt = F.array_join(F.transform("loss", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    return chats.withColumn("turns", turns).withColumn("learnt", learnt)


def digests(chats: DataFrame) -> DataFrame:
    """conv_id and the figures of what read_back() finds."""
    found = read_back(chats)
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return found.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(all_turns, 256).alias("turns_sha256"),
        F.length("learnt").cast("bigint").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        "expanded_tokens",
        F.size("attachments").cast("bigint").alias("n_attachments"),
    )
