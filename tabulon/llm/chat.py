"""Chat formatting by event-sourced reconstruction.

A log of events is folded into the final messages of each conversation, and these are rendered by a template that marks turns, escapes its
own control strings inside texts, and says which characters are trained on.  All of it is DataFrame functions: deltas of a message are
joined in one grouping by message, what regenerations drop is a running maximum over a conversation's messages, and a conversation, whose
rendered text is one value of the result, is put together once.

Events have conv_id, seq (their order in the conversation), message (what they are about), kind, role and text:

- ``message`` begins a message, with its role and, if there is one, the first part of its text;
- ``delta`` appends to it;
- ``edit`` replaces the text so far;
- ``regenerate`` empties it, and drops the messages that were begun after it and before this event, as they answered what is replaced;
- ``delete`` drops it.

Null roles and texts count as empty.  An event that the log holds twice counts once.  A message whose beginning is not in the log begins with its
first event; messages that begin at the same place go by their ids.  Rows without a conv_id or a message are one of their own.  An empty log gives
no conversations, and columns of other names are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """Control strings all begin with ``lead`` (two different characters); inside texts a backslash parts the two, and a backslash is doubled."""

    lead: str = "<|"
    start: str = "<|start|>"
    middle: str = "<|text|>"
    end: str = "<|end|>\n"
    trained: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        if len(self.lead) != 2 or self.lead[0] == self.lead[1] or ESCAPE in self.lead or not all(c.startswith(self.lead) for c in (self.start, self.middle, self.end)):
            raise ValueError("control strings have to begin with a lead of two different characters")

    def escaped(self, text: Column) -> Column:
        return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2)), F.lit(self.lead), F.lit(self.lead[0] + ESCAPE + self.lead[1]))

    @staticmethod
    def unescaped(text: Column) -> Column:
        return F.regexp_replace(text, r"(?s)\\(.)", "$1")


PLAIN = Template()


def log_of(conversations: DataFrame, *, delta: int = 1024) -> DataFrame:
    """The events that stream finished rows (conv_id, turn, role, text): each begins a message, and its text comes in deltas of ``delta`` code
    points.  Rows of the same turn go by role and text, and repeated rows are messages of their own."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    begin = F.struct(F.lit("message").alias("kind"), F.col("role"), F.lit(None).cast("string").alias("text"))
    deltas = F.transform(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{delta}}}"), F.lit(0)), lambda t: F.struct(F.lit("delta").alias("kind"), F.lit(None).cast("string").alias("role"), t.alias("text")))
    events = rows.withColumn("message", n.cast("long")).select("conv_id", "message", F.posexplode(F.concat(F.array(begin), deltas)).alias("k", "e"))
    return events.select("conv_id", (F.shiftleft("message", 32) + F.col("k")).alias("seq"), "message", "e.kind", "e.role", "e.text")


def reconstruct(log: DataFrame) -> DataFrame:
    """conv_id, place (the order of a conversation's messages), role, text: the final messages."""
    kind, seq = F.col("kind"), F.col("seq")
    own = log.groupBy("conv_id", "message").agg(
        F.coalesce(F.min(F.when(kind == "message", seq)), F.min(seq)).alias("begun"),
        F.max(F.when(kind.isin("message", "edit", "regenerate"), seq)).alias("reset"),
        F.max(F.when(kind == "regenerate", seq)).alias("again"),
        F.coalesce(F.bool_or(kind == "delete"), F.lit(False)).alias("gone"),
        F.min_by("role", F.when(F.col("role").isNotNull(), seq)).alias("role"),
        F.collect_set(F.when(F.col("text").isNotNull() & (kind != "delete"), F.struct("seq", "text"))).alias("parts"),
    )
    earlier = Window.partitionBy("conv_id").orderBy("begun", "message").rowsBetween(Window.unboundedPreceding, -1)
    kept = own.withColumn("dropped", F.coalesce(F.max("again").over(earlier) > F.col("begun"), F.lit(False))).where("not gone and not dropped")
    valid = F.filter(F.array_sort("parts"), lambda p: F.col("reset").isNull() | (p["seq"] >= F.col("reset")))
    return kept.select("conv_id", F.struct("begun", "message").alias("place"), F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.transform(valid, lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame, template: Template = PLAIN) -> DataFrame:
    """conv_id, formatted, spans: for each turn the code point at which it begins, at which its (escaped) text starts and stops, and whether the
    loss counts it.  What ``reconstruct`` returns goes in."""
    head = F.concat(F.lit(template.start), template.escaped(F.col("role")), F.lit(template.middle))
    piece = F.concat(F.col("head"), F.col("body"), F.lit(template.end))
    turns = messages.select("conv_id", "place", "role", head.alias("head"), template.escaped(F.col("text")).alias("body"))
    before = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.char_length(piece)).over(before), F.lit(0)).cast("long")
    start = F.col("begin") + F.char_length("head")
    turns = turns.withColumn("begin", begin).select(
        "conv_id", "place", piece.alias("piece"), F.struct("begin", start.alias("start"), (start + F.char_length("body")).alias("stop"), F.col("role").isin(*template.trained).alias("loss")).alias("span")
    )
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "piece", "span"))).alias("t"))
    return whole.select("conv_id", F.array_join(F.transform("t", lambda t: t["piece"]), "").alias("formatted"), F.transform("t", lambda t: t["span"]).alias("spans"))


def read_back(rendered: DataFrame, template: Template = PLAIN) -> DataFrame:
    """conv_id, turns (role, text) and learned (the texts under the loss mask), from the formatted texts alone."""
    cut = F.split("formatted", rf"\Q{template.end}\E")
    rows = rendered.select("conv_id", "formatted", "spans", F.slice(cut, 1, F.size(cut) - 1).alias("p"))

    def turn(p: Column) -> Column:
        two = F.split(p, rf"\Q{template.middle}\E", 2)
        return F.struct(template.unescaped(F.substr(two[0], F.lit(len(template.start) + 1))).alias("role"), template.unescaped(two[1]).alias("text"))

    # A turn is looked up in its own piece, so that a long conversation isn't scanned for each of its turns.
    masked = F.zip_with("p", "spans", lambda p, s: F.when(s["loss"], template.unescaped(F.substr(p, (s["start"] - s["begin"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))))
    return rows.select("conv_id", "formatted", F.transform("p", turn).alias("turns"), F.filter(masked, lambda t: t.isNotNull()).alias("learned"))


def digest(rendered: DataFrame, template: Template = PLAIN) -> DataFrame:
    """A row per conversation of what can be read back from its formatted text."""
    rows = read_back(rendered, template).withColumn("loss", F.array_join("learned", ""))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
