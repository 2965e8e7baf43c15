"""Chat formatting: turns to one training string with a loss mask, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, SPLIT = "<|im_start|>", "<|im_end|>\n", "<|im_sep|>"

#: One backslash more between "<" and "|": no text can then hold a control string, and one less restores it.
_ESCAPE = (r"<(\\*)\|", r"<\\$1|")
_UNESCAPE = (r"<\\(\\*)\|", r"<$1|")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, *_ESCAPE)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, *_UNESCAPE)


def _role_out(role: Column) -> Column:
    """A role stays on its line: line feeds and backslashes are written as two characters."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_in(role: Column) -> Column:
    spelt = F.split(unescape(role), r"\\\\", -1)  # pieces between doubled backslashes hold only line feeds
    return F.array_join(F.transform(spelt, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def format_conversations(turns: DataFrame) -> DataFrame:
    """One formatted string per conversation, from rows (conv_id, turn, role, text).

    Turns go in the order of (turn, role, text). A run of turns of one role is one block
    `<|im_start|>role\\n...<|im_end|>\\n`, its turns parted by `<|im_sep|>`, so that blocks hold what the model
    sees as one message and parse_conversations still finds every turn.

    Returns conv_id, formatted. A null role or text is empty; a null turn sorts first; a null conv_id is a
    conversation of its own; repeated rows are repeated turns; an empty table gives no rows. Other columns are
    not read. A conversation's turns meet in one row, as its string must.
    """
    rows = turns.select(
        "conv_id",
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    gathered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    last_roles = F.concat(
        F.array(F.lit(None).cast("string")),
        F.transform(F.slice("turns", F.lit(1), F.size("turns") - 1), lambda t: t["role"]),
    )
    opened = lambda t: F.concat(F.lit(START), _role_out(t["role"]), F.lit("\n"))
    pieces = F.zip_with(
        "turns",
        last_roles,
        lambda t, last: F.concat(
            F.when(last.isNull(), opened(t))
            .when(last != t["role"], F.concat(F.lit(END), opened(t)))
            .otherwise(F.lit(SPLIT)),
            escape(t["text"]),
        ),
    )
    return gathered.select("conv_id", F.concat(F.array_join(pieces, ""), F.lit(END)).alias("formatted"))


def parse_conversations(formatted: DataFrame) -> DataFrame:
    """Read formatted strings back: conv_id, formatted, turns array<struct<role,text>>, one per original turn."""
    blocks = F.filter(F.split("formatted", r"<\|im_end\|>\n", -1), lambda b: b != "")

    def turns_of(block: Column) -> Column:
        line = F.substring_index(block, "\n", 1)
        role = _role_in(F.substring(line, F.lit(len(START) + 1), F.length(line)))
        body = F.substring(block, F.length(line) + 2, F.length(block))
        texts = F.split(body, r"<\|im_sep\|>", -1)
        return F.transform(texts, lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return formatted.select("conv_id", "formatted", F.flatten(F.transform(blocks, turns_of)).alias("turns"))


def loss_texts(turns: Column, role: str = "assistant") -> Column:
    """Texts under the loss mask: those of one role, in order."""
    return F.transform(F.filter(turns, lambda t: t["role"] == role), lambda t: t["text"])
