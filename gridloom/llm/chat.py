"""Chat formatting with Spark expressions only.

Turns are collected as structs and sorted, neighbours of the same role are merged by array aggregation, and
the template is concatenated. A turn block looks like ``<|im_start|>role``, a new line, the texts of
the block with ``<|im_sep|>`` between them, ``<|im_end|>`` and a new line. Control strings inside roles and
texts are escaped reversibly, so that the turns can be read back exactly.

Turns sort by turn, then role, then text, null turns first; repeated rows are turns of their own. Null
roles and texts count as empty. Rows with a null conversation id form one conversation. The result is a
table of segments of which each is under the loss mask or not: the texts of assistant turns are, what marks
turns is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
#: Turns are sorted and merged in chunks of so many turn numbers before a conversation is put together.
CHUNK_TURNS = 256


def _escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def _escape_role(role: Column) -> Column:
    return F.replace(_escape(role), F.lit("\n"), F.lit("&#10;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&#10;"), F.lit("\n")), F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def _merge(turns: Column) -> Column:
    """Sorted turns as runs: array<struct<role, texts>>, neighbours of the same role in one run."""
    alone = lambda t: F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts"))

    def add(runs: Column, t: Column) -> Column:
        last = F.try_element_at(runs, F.lit(-1))
        longer = F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(t["text"])).alias("texts"))
        return F.when(last["role"] == t["role"], F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(longer))).otherwise(F.concat(runs, F.array(alone(t))))

    empty = F.lit(None).cast("array<struct<role:string,texts:array<string>>>")
    return F.aggregate(turns, F.coalesce(empty, F.array().cast("array<struct<role:string,texts:array<string>>>")), add)


def format_conversations(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv``, segments (array<struct<text, loss>>) and formatted (their concatenation)."""
    rows = turns.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.floor(F.col(turn) / CHUNK_TURNS).alias("chunk"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    chunks = rows.groupBy("conv", "chunk").agg(_merge(F.sort_array(F.collect_list(F.struct("turn", "role", "text")))).alias("runs"))
    whole = chunks.groupBy("conv").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "runs"))), lambda c: c["runs"])).alias("runs"))

    def segments(run: Column, i: Column) -> Column:
        """A run at the start of a chunk may go on with the role before it."""
        goes_on = (i > 0) & (F.get(F.col("runs"), i - 1)["role"] == run["role"])
        ends = (i == F.size("runs") - 1) | (F.get(F.col("runs"), i + 1)["role"] != run["role"])
        mark = lambda s: F.struct(s.alias("text"), F.lit(False).alias("loss"))
        head = mark(F.when(goes_on, F.lit(SEPARATOR)).otherwise(F.concat(F.lit(START), _escape_role(run["role"]), F.lit("\n"))))
        loss = run["role"] == "assistant"
        body = F.flatten(F.transform(run["texts"], lambda t, k: F.array(mark(F.when(k > 0, F.lit(SEPARATOR)).otherwise(F.lit(""))), F.struct(_escape(t).alias("text"), loss.alias("loss")))))
        return F.concat(F.array(head), body, F.when(ends, F.array(mark(F.lit(END)))).otherwise(F.slice(F.array(mark(F.lit(""))), 1, 0)))

    marked = whole.select("conv", F.flatten(F.transform("runs", segments)).alias("segments"))
    return marked.select(F.col("conv").alias(conv), "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def parse_formatted(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>, as they went in."""
    blocks = F.split(formatted, r"<\|im_end\|>\n", -1)

    def turns(block: Column) -> Column:
        head = F.substring_index(block, "\n", 1)
        body = F.substr(block, F.length(head) + 2)
        role = unescape(F.substr(head, F.lit(len(START) + 1)))
        return F.transform(F.split(body, r"<\|im_sep\|>", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
