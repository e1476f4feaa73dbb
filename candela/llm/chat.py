"""Chat formatting: typed content parts flattened into one marked, reversible text per conversation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from candela.llm.common import let

PART = "struct<type: string, text: string, ref: string, units: double>"
START, END = "<|im_start|>", "<|im_end|>\n"


@dataclass(frozen=True)
class TokenCosts:
    """Tokens that a placeholder stands for, per unit of its attachment."""

    image: float = 256.0      # per tile
    audio: float = 25.0       # per second
    document: float = 800.0   # per page


def escape(text: Column) -> Column:
    """``&`` and ``<|`` as character references: the result never holds a control string."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def text_parts(text: Column) -> Column:
    """A plain turn as its one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"),
                            F.lit(None).cast("double").alias("units")))


def visit(parts: Column, costs: TokenCosts = TokenCosts()) -> Column:
    """Visit every part in order: its flat form, its reference and its token count (0 for text).

    A ``<`` that ends a part before another one is escaped too, so no control string can arise where parts meet.
    """
    def one(p: Column, i: Column, last: Column) -> Column:
        kind, units = p["type"], F.coalesce(p["units"], F.lit(1.0))
        cost = (F.when(kind == "image", costs.image).when(kind == "audio", costs.audio)
                .when(kind == "document", costs.document).otherwise(0.0))
        known = kind.isin("image", "audio", "document")
        return F.struct(
            F.when(kind == "text", let(escape(F.coalesce(p["text"], F.lit(""))), lambda t: F.when(
                (i < last) & t.endswith("<"), F.regexp_replace(t, r"<\z", "&lt;")).otherwise(t))).when(known, F.concat(F.lit("<|"), kind, F.lit("|>")))
            .otherwise(F.lit("<|unknown|>")).alias("flat"),
            F.coalesce(kind == "text", F.lit(False)).alias("is_text"), kind.alias("type"), p["ref"].alias("ref"), F.ceil(units * cost).cast("long").alias("tokens"))
    given = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    return let(given, lambda ps: F.transform(ps, lambda p, i: one(p, i, F.size(ps) - 1)))


def format_chats(turns: DataFrame, costs: TokenCosts = TokenCosts(), loss_role: str = "assistant") -> DataFrame:
    """One row per conversation from rows ``conv_id, turn, role, parts`` (``parts``: array of typed parts).

    Result: ``conv_id, formatted, loss_spans`` (code points, end exclusive, one per turn of ``loss_role``),
    ``attachments`` (turn number, order in the turn, type, ref, tokens) and ``expanded_tokens``. Turns are ordered by
    (turn, role, flat text), nulls first; repeated rows stay; a null role or text is empty; null ids are one conversation;
    an unknown part type leaves a placeholder of no tokens. One shuffle by conversation: a conversation is one output
    row, so its size is bounded by what a row can hold.
    """
    rows = (turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), visit(F.col("parts"), costs).alias("visited"))
            .withColumn("flat", F.array_join(F.transform("visited", lambda v: v["flat"]), "")))
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    rows = rows.withColumn("head", head).withColumn("n", F.length("head") + F.length("flat") + len(END))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "flat")
    rows = (rows.withColumn("no", F.row_number().over(order))
            .withColumn("at", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    start = F.col("at") + F.length("head")
    attached = F.transform(F.filter("visited", lambda v: ~v["is_text"]), lambda v, i: F.struct(
        F.col("no").alias("turn_no"), i.alias("place"), v["type"].alias("type"), v["ref"].alias("ref"), v["tokens"].alias("tokens")))
    one = F.struct(F.col("no"), F.concat("head", "flat", F.lit(END)).alias("s"), attached.alias("attached"),
                   F.when(F.col("role") == loss_role, F.struct(start.cast("long").alias("start"), (start + F.length("flat")).cast("long").alias("end"))).alias("span"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"),
                                          F.sum(F.aggregate("visited", F.lit(0).cast("long"), lambda s, v: s + v["tokens"])).alias("expanded_tokens"))
    return grouped.select("conv_id", F.array_join(F.transform("turns", lambda t: t["s"]), "").alias("formatted"),
                          F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
                          F.flatten(F.transform("turns", lambda t: t["attached"])).alias("attachments"), "expanded_tokens")


def read_back(formatted: Column) -> Column:
    """Role and text of every turn of a formatted text; placeholders stay as they are. Linear in the text."""
    def turn(s: Column) -> Column:
        cut = F.instr(s, "\n")
        return F.struct(unescape_role(s.substr(F.lit(len(START) + 1), cut - len(START) - 1)).alias("role"),
                        unescape(s.substr(cut + 1, F.length(s))).alias("text"))
    return F.transform(F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda s: s.startswith(START)), turn)


def under_mask(formatted: Column, spans: Column, together: int = 64) -> Column:
    """All text under the spans, unescaped, in order with nothing between.

    Spans are cut from pieces of ``together`` spans each, so that the places are not counted from the start for every one.
    """
    def piece(some: Column) -> Column:
        low, high = F.get(some, F.lit(0))["start"], F.element_at(some, -1)["end"]
        part = F.substring(formatted, (low + 1).cast("int"), (high - low).cast("int"))
        return let(part, lambda s: F.array_join(F.transform(some, lambda x: unescape(
            F.substring(s, (x["start"] - low + 1).cast("int"), (x["end"] - x["start"]).cast("int")))), ""))

    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / together).cast("int")),
                         lambda k: let(F.slice(spans, k * together + 1, F.lit(together)), piece))
    return F.when(F.size(spans) > 0, F.array_join(pieces, "")).otherwise("")
