"""Chat formatting by prefix-target expansion, in built-in functions only.

Every assistant turn becomes an example of its own: all preceding turns as context, then
the reply, and a span that says which characters are trained on.  The template is::

    <|im_start|>role
    text<|im_end|>

Control strings inside roles and texts are made harmless by a backslash after their ``<``
(``<|`` becomes ``<\\|``; where backslashes already stand between ``<`` and ``|`` one more is
added), which ``unescape`` takes back exactly.  A line break inside a role is written
``\\n`` and a backslash there ``\\\\``.  A conversation that does not end with an assistant
turn gives one more row that ends with its last turn and trains nothing, so that no turn
is lost.

Defined cases: turns go by turn number (null first), equal ones by role and text; null
texts and roles are empty; a null conversation id is a conversation of its own; repeated
rows are turns of their own.  One conversation is one example and so one row, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    # Pairs of backslashes are set aside first, so that "\\n" and "\n" stay apart.
    parts = F.split(unescape(role), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def format_chats(turns: DataFrame) -> DataFrame:
    """``conv_id, example, target, formatted, loss_start, loss_end, closing`` for ``turns (conv_id, turn, role, text)``.

    ``target`` is the position of the trained turn, null in a row that trains nothing;
    the loss span counts characters from 0, its end is exclusive; ``closing`` marks the
    row that has the whole conversation.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    talks = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    piece = lambda t: F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END))
    places = F.sequence(F.lit(0), F.size("turns") - 1)
    wanted = F.filter(places, lambda i: (F.get("turns", i)["role"] == "assistant") | (i == F.size("turns") - 1))
    parts = talks.select("conv_id", "turns", F.transform("turns", piece).alias("pieces"), wanted.alias("wanted"))
    each = parts.select(
        "conv_id", F.posexplode("wanted").alias("example", "last"), "turns", "pieces", (F.size("wanted") - 1).alias("n")
    )
    own = F.get("turns", F.col("last"))
    formatted = F.array_join(F.slice("pieces", F.lit(1), F.col("last") + 1), "")
    trained = own["role"] == "assistant"
    each = each.select(
        "conv_id",
        "example",
        F.when(trained, F.col("last")).alias("target"),
        formatted.alias("formatted"),
        F.when(trained, F.length(escape(own["text"]))).otherwise(0).alias("reply"),
        (F.col("example") == F.col("n")).alias("closing"),
        trained.alias("trained"),
    )
    end = F.length("formatted") - F.when(F.col("trained"), len(END)).otherwise(0)
    start = (end - F.col("reply")).alias("loss_start")
    return each.select("conv_id", "example", "target", "formatted", start, end.alias("loss_end"), "closing")


def loss_text(formatted: str = "formatted") -> Column:
    """The trained text of an example, as it was before it was escaped."""
    return unescape(F.substring(F.col(formatted), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))


def read_turns(formatted: str = "formatted") -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    parts = F.split(F.col(formatted), r"<\|im_end\|>\n", -1)
    bodies = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(body: Column) -> Column:
        rest = F.substring(body, F.lit(len(START) + 1), F.length(body))
        cut = F.locate("\n", rest)
        return F.struct(
            _unescape_role(F.substring(rest, F.lit(1), cut - 1)).alias("role"),
            unescape(F.substring(rest, cut + 1, F.length(rest))).alias("text"),
        )

    return F.transform(bodies, turn)
