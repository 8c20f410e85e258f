"""Chat formatting: conversations as rows of turns become one training string with a loss mask.

Everything here is built from Spark expressions. A conversation's turns are collected as structs and sorted, adjacent
turns of one role are merged into a block, and blocks are concatenated::

    <|im_start|>role<|im_sep|>text<|im_next|>text<|im_end|>

``<|im_next|>`` parts the turns merged into a block, so the rows can be read back. A control string inside a text or a
role gets a backslash after its first character (``</s>`` becomes ``<\\/s>``); one that already has backslashes there
gets one more, so the change can be undone whatever the text holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Runs of a mask whose places are summed up together.
CHUNK = 256
START, SEP, NEXT, END = "<|im_start|>", "<|im_sep|>", "<|im_next|>", "<|im_end|>"
#: Strings that no formatted text may hold, besides the template's own marks.
CONTROL = r"([<\[])(\\*)(/?s>|/?INST\]|</?SYS>>|\|im_(?:start|sep|next|end)\|>)"
ESCAPED = r"([<\[])(\\*)\\(/?s>|/?INST\]|</?SYS>>|\|im_(?:start|sep|next|end)\|>)"


def escape(text: Column) -> Column:
    """Put one more backslash into each control string."""
    return F.regexp_replace(text, CONTROL, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    """Undo :func:`escape`."""
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _cut(text: Column, mark: str) -> Column:
    return F.split(text, r"\Q" + mark + r"\E", -1)


def format_conversations(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: tuple[str, ...] = ("assistant",)
) -> DataFrame:
    """One row per conversation: ``conv``, ``n_blocks``, ``formatted``, ``mask``.

    ``mask`` is an array of runs (``length`` in code points, ``bytes`` in UTF-8, ``loss``) that cover ``formatted`` from its
    start to its end; only the texts of ``trained`` roles are under the loss, without marks.

    Null roles and texts count as empty. Rows of one turn number (ties, repeated rows) are ordered by role, then text;
    a null turn number comes first. Rows without a conversation id form one conversation of their own. Further columns
    are ignored. An empty table gives an empty table.

    A conversation has to become one string, so its turns meet in one row; the conversations themselves are spread by
    their id, and the partial aggregation sends one array per conversation and map task.
    """
    rows = turns.select(
        F.col(conv).alias("_conv"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("_turn"),
    )
    sorted_turns = rows.groupBy("_conv").agg(F.array_sort(F.collect_list("_turn")).alias("_turns"))
    heads = sorted_turns.withColumn(
        "_heads",
        F.filter(
            F.sequence(F.lit(1), F.size("_turns")),
            lambda i: (i == 1) | (F.element_at("_turns", i)["role"] != F.element_at("_turns", F.greatest(i - 1, F.lit(1)))["role"]),
        ),
    )
    size = F.size("_turns")
    blocks = heads.withColumn(
        "_blocks",
        F.transform(
            "_heads",
            lambda h, k: F.struct(
                F.element_at("_turns", h)["role"].alias("role"),
                F.transform(
                    F.slice("_turns", h, F.coalesce(F.get("_heads", k + 1), size + 1) - h), lambda t: escape(t["text"])
                ).alias("texts"),
            ),
        ),
    )
    lead = lambda b: F.concat(F.lit(START), escape(b["role"]), F.lit(SEP))
    run = lambda text, loss: F.struct(F.length(text).cast("long").alias("length"), F.octet_length(text).cast("long").alias("bytes"), loss.alias("loss"))
    formatted = F.array_join(F.transform("_blocks", lambda b: F.concat(lead(b), F.array_join(b["texts"], NEXT), F.lit(END))), "")
    mask = F.flatten(
        F.transform(
            "_blocks",
            lambda b: F.concat(
                F.flatten(
                    F.transform(
                        b["texts"],
                        lambda t, i: F.array(
                            run(F.when(i == 0, lead(b)).otherwise(F.lit(NEXT)), F.lit(False)),
                            run(t, b["role"].isin(*trained)),
                        ),
                    )
                ),
                F.array(run(F.lit(END), F.lit(False))),
            ),
        )
    )
    return blocks.select(F.col("_conv").alias(conv), F.size("_blocks").alias("n_blocks"), formatted.alias("formatted"), mask.alias("mask"))


def read_turns(formatted: Column) -> Column:
    """The rows that a formatted string was made from: an array of (``role``, ``text``). Each block is cut once."""
    blocks = F.filter(_cut(formatted, END), lambda b: b != "")
    return F.flatten(F.flatten(F.transform(blocks, lambda b: F.transform(F.array(_cut(b, SEP)), _block_turns))))


def _block_turns(parts: Column) -> Column:
    """The turns of a block that is cut into its head and its texts."""
    roles = F.array(unescape(F.substring(parts[0], len(START) + 1, 2**31 - 1)))
    return F.flatten(F.transform(roles, lambda role: F.transform(_cut(parts[1], NEXT), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))))


def _running(values: Column) -> Column:
    """Sums of all numbers up to each, a 0 in front. An array that grows is copied with each step, so it never outgrows a
    chunk."""
    return F.aggregate(values, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def read_loss(formatted: DataFrame) -> DataFrame:
    """``formatted`` with ``_loss``: all text under the loss mask, unescaped, in order.

    Runs are found by their bytes, as a place in bytes is reached at once. Where they start is summed up in chunks, then
    over the chunks' sums, so a conversation of any number of turns takes time in proportion to its length.
    """
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.size("mask") - 1, F.lit(0)), F.lit(CHUNK)), lambda at: F.slice("mask", at + 1, CHUNK))
    inner = formatted.withColumn("_inner", F.transform(chunks, lambda c: _running(F.transform(c, lambda m: m["bytes"]))))
    outer = inner.withColumn("_outer", _running(F.transform("_inner", lambda s: F.element_at(s, -1))))
    starts = F.flatten(F.transform("_inner", lambda s, k: F.transform(F.slice(s, 1, F.size(s) - 1), lambda x: x + F.get("_outer", k))))
    runs = F.filter(F.zip_with("mask", starts, lambda m, at: F.struct(m["loss"].alias("loss"), m["bytes"].alias("bytes"), at.alias("at"))), lambda r: r["loss"])
    raw = outer.select("*", F.col("formatted").cast("binary").alias("_raw"), runs.alias("_runs"))
    texts = F.transform("_runs", lambda r: unescape(F.substr("_raw", (r["at"] + 1).cast("int"), r["bytes"].cast("int")).cast("string")))
    return raw.withColumn("_loss", F.array_join(texts, "")).drop("_inner", "_outer", "_raw", "_runs")


def digests(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What the formatted strings hold, read back from them: counts and digests of turns and of the text under the loss."""
    read = read_loss(formatted).select(conv, "n_blocks", F.length("formatted").cast("long").alias("formatted_chars"), read_turns(F.col("formatted")).alias("_t"), "_loss")
    return read.select(
        conv,
        F.size("_t").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("_t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss"), 256).alias("loss_sha256"),
        "formatted_chars",
        F.col("n_blocks").cast("long").alias("n_blocks"),
    )
