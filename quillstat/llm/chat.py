"""Chat formatting: typed content parts flattened into one marked text per turn, with a loss mask."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strings with a meaning to this template or to other common ones; each has one opening character, its first.
CONTROLS = r"([<\[])(\\*)(\|(?:turn|end|image:[0-9]+|audio:[0-9]+|document:[0-9]+|im_start|im_end|endoftext|startoftext|eot_id|start_header_id|end_header_id|system|user|assistant)\|>|/?s>|/?unk>|/?pad>|/?INST\]|/?SYS\])"
PART = "type string, text string, ref string, width long, height long, seconds double, pages long"


def escape(text: Column) -> Column:
    """One more backslash after the opening character of each control string, so none is left as it was; ``unescape`` takes it out."""
    return F.regexp_replace(text, CONTROLS, r"$1\\$2$3")


def unescape(text: str) -> str:
    return re.sub(CONTROLS, lambda m: m[1] + m[2][1:] + m[3], text)


def _tokens(p: Column, patch: int, tokens_per_second: int, tokens_per_page: int) -> Column:
    """Tokens that an attachment expands to; unknown sizes count as one unit."""
    side = lambda c: F.ceil(F.greatest(F.coalesce(c, F.lit(1)), F.lit(1)) / patch)
    return (
        F.when(p["type"] == "image", side(p["width"]) * side(p["height"]))
        .when(p["type"] == "audio", F.ceil(F.greatest(F.coalesce(p["seconds"], F.lit(1.0)), F.lit(0.0)) * tokens_per_second))
        .otherwise(F.greatest(F.coalesce(p["pages"], F.lit(1)), F.lit(1)) * tokens_per_page).cast("long"))


def format_turns(messages: DataFrame, patch: int = 28, tokens_per_second: int = 25, tokens_per_page: int = 600) -> DataFrame:
    """One row per message: ``conv_id, turn, role, formatted, loss_start, loss_length, attachments, attachment_tokens``.

    ``messages`` has ``conv_id, turn, role, content``; ``content`` is an array of parts (``PART``). The parts are visited in order: a text
    part gives its escaped text, an image, audio or document part gives a placeholder with its number in the turn and an entry of
    ``attachments`` (number, kind, ref, tokens it expands to). Parts of an unknown type count as text. Null parts, texts and contents are
    empty; a null role is ''. The loss mask covers an assistant's content, between its marks. A conversation is its rows in the order of
    ``turn``; turns of a hot conversation are formatted apart, so no task ever holds a conversation.
    """
    other = lambda p: p["type"].isin("image", "audio", "document")
    d = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                        F.filter(F.coalesce("content", F.array().cast(f"array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in PART.split(','))}>>")), lambda p: p.isNotNull()).alias("parts"))
    files = F.filter("parts", lambda p: F.coalesce(other(p), F.lit(False)))
    attachments = F.transform(files, lambda p, i: F.struct(i.alias("number"), p["type"].alias("kind"), p["ref"].alias("ref"), _tokens(p, patch, tokens_per_second, tokens_per_page).alias("tokens")))
    number = lambda i: F.size(F.filter(F.slice("parts", F.lit(1), i), lambda q: F.coalesce(other(q), F.lit(False))))
    visit = lambda p, i: F.when(other(p), F.concat(F.lit("<|"), p["type"], F.lit(":"), number(i).cast("string"), F.lit("|>"))).otherwise(escape(F.coalesce(p["text"], F.lit(""))))
    d = d.select("conv_id", "turn", "role", attachments.alias("attachments"), F.array_join(F.transform("parts", visit), "").alias("body"))
    name = F.replace(F.replace(escape(F.col("role")), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    head = F.concat(F.lit("<|turn|>"), name, F.lit("\n"))
    assistant = F.col("role") == "assistant"
    return d.select(
        "conv_id", "turn", "role", F.concat(head, "body", F.lit("<|end|>\n")).alias("formatted"),
        F.when(assistant, F.length(head)).alias("loss_start"), F.when(assistant, F.length("body")).alias("loss_length"),
        "attachments", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("attachment_tokens"))


def text_messages(conversations: DataFrame) -> DataFrame:
    """Rows with a plain ``text`` as messages of one text part."""
    part = F.struct(F.lit("text").alias("type"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in (x.strip().split() for x in PART.split(",")[2:])])
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.array(part).alias("content"))


_TURN = re.compile(r"<\|turn\|>([^\n]*)\n(.*)<\|end\|>\n", re.S)


def _role(name: str) -> str:
    return unescape(re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", name))


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn without attachments."""
    name, body = _TURN.fullmatch(formatted).groups()
    return _role(name), unescape(body)


def conversation_digests(turns: DataFrame) -> DataFrame:
    """Per conversation what is read back from its formatted turns: counts and digests of turns and of the text under the loss mask.

    Turns stream through in order with one running hash per conversation, so memory doesn't grow with a conversation.
    Equal turn numbers follow in the order of role and formatted text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, done = None, None, []

        def close():
            if state is not None:
                done.append((current[0], state["n"], state["all"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"]))

        columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        frame = lambda: pd.DataFrame(done, columns=columns).astype({"conv_id": "Int64"})
        for batch in batches:
            done = []
            for conv, text, start, length in zip(batch["conv_id"], batch["formatted"], batch["loss_start"], batch["loss_length"]):
                conv = (None if pd.isna(conv) else int(conv),)
                if conv != current:
                    close()
                    current, state = conv, {"n": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}
                role, body = read_turn(text)
                state["n"] += 1
                state["all"].update(f"{role}\n{body}\n".encode())
                state["chars"] += len(text)
                if not pd.isna(start):
                    masked = unescape(text[int(start) : int(start) + int(length)])
                    state["loss"].update(masked.encode())
                    state["loss_chars"] += len(masked)
            yield frame()
        done = []
        close()
        yield frame()

    ordered = turns.select("conv_id", "turn", "role", "formatted", "loss_start", "loss_length").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted")
    return ordered.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
