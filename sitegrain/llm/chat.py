"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are its context, only the reply is trainable. The
template is prefix-stable, so that the formatted text of an example is a prefix of its conversation's. ``pieces`` gives that text, a row a turn;
``expand`` explodes each assistant turn into its piece and its example. An example names its context by the place of its target and holds its length and the
span of its reply, so that a long conversation takes no more room than its turns. ``render`` writes examples out.

Turns are ordered by turn, role and text, null turns first. Null text or role: empty. Turns that are equal in all three stay, one after the other. No assistant turn:
pieces, but no example. A null conv_id is a conversation. Other columns are left out.
A role or text is escaped: ``&`` to ``&amp;``, ``<`` to ``&lt;``, ``>`` to ``&gt;``, ``[`` to ``&#91;``, so that no control string stays in it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PIECE = re.compile(r"<turn=([^>]*)>(.*)</turn>\n", re.S)


def escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("[", "&#91;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: str) -> str:
    return text.replace("&#91;", "[").replace("&gt;", ">").replace("&lt;", "<").replace("&amp;", "&")


def pieces(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, piece, begin, head, body, target): the formatted text of each conversation by turns; ``begin`` is a piece's place in it, ``head`` and ``body`` are the lengths of its tag and text."""
    role, text = escape(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit("<turn="), role, F.lit(">"))
    made = conversations.select("conv_id", "turn", "role", "text", F.concat(head, text, F.lit("</turn>\n")).alias("piece"), F.length(head).alias("head"), F.length(text).alias("body"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("piece").cast("long")
    target = F.coalesce(F.col("role") == "assistant", F.lit(False))
    return made.select("conv_id", F.count("*").over(order).alias("at"), "piece", (F.sum(size).over(order) - size).alias("begin"), "head", "body", target.alias("target"))


def expand(made: DataFrame) -> DataFrame:
    """(conv_id, at, piece, begin, context, loss_begin, loss_end, example_end): every piece, and after an assistant's piece the example that it is the target of.

    An example's row has no piece; its text is that of the pieces up to ``at``, of which the first ``context`` characters are context.
    """
    begin = F.col("begin")
    loss = begin + F.col("head")
    number = lambda column, name: column.cast("long").alias(name)
    none = F.lit(None)
    piece = F.struct(F.col("piece").alias("piece"), number(begin, "begin"), *[number(none, n) for n in ("context", "loss_begin", "loss_end", "example_end")])
    example = F.struct(none.cast("string").alias("piece"), number(none, "begin"), number(begin, "context"), number(loss, "loss_begin"), number(loss + F.col("body"), "loss_end"), number(begin + F.length("piece"), "example_end"))
    return made.select("conv_id", "at", F.explode(F.when(F.col("target"), F.array(piece, example)).otherwise(F.array(piece))).alias("_e")).select("conv_id", "at", "_e.*")


def examples(expanded: DataFrame) -> DataFrame:
    """One row an assistant turn, without the shared text."""
    return expanded.filter("piece is null").select("conv_id", F.col("at").alias("target"), "context", "loss_begin", "loss_end", "example_end")


def render(expanded: DataFrame, chosen: DataFrame) -> DataFrame:
    """The full text of the chosen examples."""
    own = expanded.filter("piece is not null").select(F.col("conv_id").alias("_conv"), "at", "piece")
    own = chosen.join(own, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("at") <= F.col("target")))
    return own.groupBy("conv_id", "target", "context", "loss_begin", "loss_end").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), "").alias("text"))


def read_back(expanded: DataFrame) -> DataFrame:
    """A row a conversation, from its pieces and examples alone, as a stream of sorted rows: turns from the pieces, losses and lengths from the examples."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, tail, tail_begin = None, "", 0  # the text of the last piece read, and its place

        def done(states: list) -> pd.DataFrame:
            rows = [(s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]) for s in states]
            return pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})

        for b in batches:
            ended = []
            for conv, piece, begin, lo, hi, end in zip(b["conv_id"], b["piece"], b["begin"], b["loss_begin"], b["loss_end"], b["example_end"]):
                conv = None if pd.isna(conv) else int(conv)
                if state is None or state[0] != conv:
                    if state:
                        ended.append(state)
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                if piece is not None:
                    tail, tail_begin = piece, int(begin)
                    role, text = map(unescape, _PIECE.fullmatch(piece).groups())
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                else:
                    loss = unescape(tail[int(lo) - tail_begin : int(hi) - tail_begin])
                    state[3] += len(loss)
                    state[4].update(loss.encode("utf-8", "surrogatepass"))
                    state[5] += int(end)
            if ended:
                yield done(ended)
        if state:
            yield done([state])

    example = F.col("piece").isNull()
    ordered = expanded.withColumn("_example", example).repartition("conv_id").sortWithinPartitions("conv_id", "at", "_example").drop("_example")
    return ordered.mapInPandas(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
