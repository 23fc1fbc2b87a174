"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are
context, and only its text is trainable. Turns after the last assistant turn
follow in an example without a trainable part, so no turn is lost.

A turn reads ``<s>role``, a line break, ``[INST]text[/INST]</s>`` and a line break; an
assistant's text stands without the INST marks. Control strings inside roles
and texts get a backslash after their first character, and a backslash is
doubled, so the marks are unambiguous and reading back restores every text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causal_panel.llm.text import as_text, spread

TRAINED = "assistant"
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")

_control = re.compile(r"\\|<(?=/?s>)|\[(?=/?INST\])")
_escaped = re.compile(r"\\(.)", re.S)
_turn = re.compile(r"<s>((?:[^\\\n]|\\.)*)\n(?:\[INST\])?(.*?)(?:\[/INST\])?</s>\n", re.S)


def escape(text: str) -> str:
    """Make a text free of control strings: ``\\`` becomes ``\\\\``, ``<s>`` becomes ``<\\s>``."""
    return _control.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _escaped.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its text begins and ends."""
    head = f"<s>{escape(role).replace(chr(10), chr(92) + chr(10))}\n"
    body = escape(text)
    if role == TRAINED:
        return f"{head}{body}</s>\n", len(head), len(head) + len(body)
    return f"{head}[INST]{body}[/INST]</s>\n", len(head) + 6, len(head) + 6 + len(body)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted example."""
    return [(unescape(role), unescape(text)) for role, text in _turn.findall(formatted)]


EXAMPLES = "conv_id string, example int, n_turns int, last boolean, formatted string, loss_start long, loss_end long"


def prefix_examples(turns: DataFrame) -> DataFrame:
    """(conv_id, example, n_turns, last, formatted, loss_start, loss_end) from rows (conv_id, turn, role, text).

    Characters loss_start to loss_end of ``formatted`` are trained; they are -1
    where nothing is. ``n_turns`` counts the turns in the example, ``last`` marks the
    example that holds all turns of its conversation. Turns are ordered by turn,
    role and text, nulls first; a null role or text is empty; rows of a null
    conv_id form one conversation; repeated rows are turns of their own. Rows of
    a conversation are streamed in order, and what a task holds is one prefix.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = spread(rows, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").withColumn("conv_id", as_text("conv_id"))
    return ordered.mapInPandas(_expand, EXAMPLES).withColumn("conv_id", F.col("conv_id").cast("long"))


def _conversations(frames: Iterator[pd.DataFrame]):
    """(conv_id, role, text, whether it ends the conversation) over frames whose rows are in order."""
    held = None
    for frame in frames:
        for conv, role, text in zip(frame["conv_id"], frame["role"], frame["text"]):
            if held is not None:
                yield *held, held[0] != conv
            held = (conv, role, text)
    if held is not None:
        yield *held, True


def _expand(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    out, room = [], 0
    parts, length, example = [], 0, 0
    for conv, role, text, ends in _conversations(frames):
        turn, start, end = render(role, text)
        trained = role == TRAINED
        parts.append(turn)
        if trained or ends:
            formatted = "".join(parts)
            span = (length + start, length + end) if trained else (-1, -1)
            out.append((conv, example, len(parts), ends, formatted, *span))
            example, room = example + 1, room + len(formatted)
        length += len(turn)
        if ends:
            parts, length, example = [], 0, 0
        if room > 8_000_000:
            yield _frame(out)
            out, room = [], 0
    if out:
        yield _frame(out)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["conv_id", "example", "n_turns", "last", "formatted", "loss_start", "loss_end"])


DIGEST = "conv_id string, example int, n_turns long, turns_sha256 string, loss string, chars long"


def read_examples(examples: DataFrame) -> DataFrame:
    """Per example what its text says: n_turns and turns_sha256 (of the last example only), the trained text, its length.

    ``turns_sha256`` digests role, line break, text, line break of every turn.
    """
    rows = examples.select(as_text("conv_id"), "example", "last", "formatted", "loss_start", "loss_end")
    return rows.mapInPandas(_digest, DIGEST).withColumn("conv_id", F.col("conv_id").cast("long"))


def _digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for conv, example, last, formatted, start, end in frame.itertuples(index=False, name=None):
            count = sha = None
            if last:
                turns = read_back(formatted)
                count, sha = len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
            rows.append((conv, example, count, sha, unescape(formatted[start:end]) if start >= 0 else "", len(formatted)))
        out = pd.DataFrame(rows, columns=["conv_id", "example", "n_turns", "turns_sha256", "loss", "chars"])
        yield out.astype({"n_turns": "Int64"})


def conversation_digests(examples: DataFrame) -> DataFrame:
    """One row per conversation, read back from its examples."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "")
    return (
        read_examples(examples).groupBy("conv_id")
        .agg(F.max("n_turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"), joined.alias("_loss"), F.sum("chars").alias("formatted_chars"))
        .select("conv_id", "n_turns", "turns_sha256", F.length("_loss").cast("long").alias("loss_chars"),
                F.sha2(F.col("_loss"), 256).alias("loss_sha256"), "formatted_chars")
    )
