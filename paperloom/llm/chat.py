"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is a list of parts (type, text, ref, units). A visitor flattens it: text is escaped, an image, audio or
document becomes a numbered placeholder whose reference and expanded token count are recorded. Turns are laid out between
markers; a loss mask names, turn by turn, the code points of assistant text.

Inside texts the strings that could steer a model are escaped reversibly (``&``, ``<``, ``[INST]``, ``[/INST]``), so no
text can make or end a turn.

Null text, role or parts count as empty. Turns are ordered by turn (nulls first), ties by role and content; repeated rows
are repeated turns. Rows without conversation id form one conversation. An empty table gives no conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: Reversible escapes, in the order in which they are applied.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[INST]", "&lb;INST]"), ("[/INST]", "&lb;/INST]"))
UNESCAPES = (("&lb;", "["), ("&lt;", "<"), ("&amp;", "&"))
#: Tokens that one unit of an attachment stands for: an image, a second of audio, a page.
TOKENS_PER_UNIT = {"image": 576, "audio": 25, "document": 1024}
LEARNED_ROLE = "assistant"

PART = "struct<type:string,text:string,ref:string,units:double>"


def escape(text: Column) -> Column:
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for safe, plain in UNESCAPES:
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def text_part(text: Column) -> Column:
    """Content of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("units"))).cast(f"array<{PART}>")


def visit(parts: Column) -> tuple[Column, Column]:
    """(body, attachments): parts in order; placeholders are numbered within the turn. Unknown types are kept as text."""
    parts = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    kinds = list(TOKENS_PER_UNIT)
    attached = F.filter(F.transform(parts, lambda p, k: F.struct(p.alias("part"), k.alias("place"))), lambda x: x["part"]["type"].isin(kinds))
    tokens = F.create_map(*[F.lit(x) for kv in TOKENS_PER_UNIT.items() for x in kv])
    attachments = F.transform(
        attached,
        lambda x, k: F.struct(
            (k + 1).alias("number"),
            x["part"]["type"].alias("type"),
            x["part"]["ref"].alias("ref"),
            F.ceil(F.greatest(F.nanvl(F.coalesce(x["part"]["units"], F.lit(1.0)), F.lit(1.0)), F.lit(0.0)) * F.element_at(tokens, x["part"]["type"])).alias("tokens"),
            x["place"].alias("place"),
        ),
    )
    number = lambda k: F.element_at(F.filter(attachments, lambda x: x["place"] == k), 1)["number"].cast("string")
    body = F.array_join(
        F.transform(
            parts,
            lambda p, k: F.when(p["type"].isin(kinds), F.concat(F.lit("<|"), p["type"], F.lit(":"), number(k), F.lit("|>"))).otherwise(escape(F.coalesce(p["text"], F.lit("")))),
        ),
        "",
    )
    return body, attachments


def format_turns(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, parts: Column) -> DataFrame:
    """conv_id, formatted, mask (one entry for each turn, null where nothing is learned), attachments, n_tokens_attached.

    ``<|image:2|>`` in a turn stands for the attachment of that turn with the number 2. Units that are null or not a number
    count as one, negative ones as none.
    """
    body, attachments = visit(parts)
    turns = rows.select(
        rows[conv_col].cast("long").alias("conv_id"),
        rows[turn_col].cast("long").alias("turn"),
        F.coalesce(rows[role_col].cast("string"), F.lit("")).alias("role"),
        body.alias("body"),
        attachments.alias("attachments"),
    )
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    turns = turns.withColumn("head_chars", F.length(head)).withColumn("piece", F.concat(head, "body", F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "piece")
    so_far = F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    turns = turns.select(
        "conv_id",
        F.row_number().over(order).alias("place"),
        "piece",
        "attachments",
        F.when(F.col("role") == LEARNED_ROLE, so_far - F.length("piece") + F.col("head_chars")).alias("start"),
        F.when(F.col("role") == LEARNED_ROLE, so_far - len(END)).alias("end"),
    )
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "piece", "start", "end", "attachments"))).alias("turns"))
    return whole.select(
        "conv_id",
        F.array_join("turns.piece", "").alias("formatted"),
        F.transform("turns", lambda t: F.when(t["start"].isNotNull(), F.struct(t["start"].alias("start"), t["end"].alias("end")))).alias("mask"),
        F.flatten(F.transform("turns", lambda t: F.transform(t["attachments"], lambda a: F.struct(t["place"].alias("turn"), a["number"].alias("number"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens"), a["place"].alias("place"))))).alias("attachments"),
    ).withColumn("n_tokens_attached", F.aggregate("attachments", F.lit(0).cast("long"), lambda total, a: total + a["tokens"]))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns and digests of what the formatted text and its mask hold; linear in the text's length."""
    parts = F.split("formatted", r"<\|turn\|>")
    turns = formatted.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), F.posexplode(F.arrays_zip(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))).alias("part"), F.col("mask").alias("mask"))).alias("place", "z"))
    order = Window.partitionBy("conv_id").orderBy("place")
    turns = turns.select(
        "conv_id",
        "formatted_chars",
        "place",
        F.col("z.part").alias("part"),
        F.col("z.mask").alias("mask"),
        # where the part starts in the whole text: behind its marker
        (F.sum(F.length("z.part") + len(TURN)).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.length("z.part")).alias("at"),
    )
    body = F.substring_index("part", TEXT, -1)
    turns = turns.select(
        "conv_id",
        "formatted_chars",
        "place",
        unescape(F.substring_index("part", TEXT, 1)).alias("role"),
        unescape(F.left(body, F.length(body) - len(END))).alias("text"),
        unescape(F.coalesce(F.substring(F.col("part"), (F.col("mask.start") - F.col("at") + 1).cast("int"), (F.col("mask.end") - F.col("mask.start")).cast("int")), F.lit(""))).alias("learned"),
    )
    whole = turns.groupBy("conv_id").agg(F.max("formatted_chars").alias("formatted_chars"), F.array_sort(F.collect_list(F.struct("place", "role", "text", "learned"))).alias("turns"))
    learned = F.array_join("turns.learned", "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return whole.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
