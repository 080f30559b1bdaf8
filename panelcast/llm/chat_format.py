"""Chat formatting with a loss mask aligned by offsets.

Whole conversations are rendered with a template that marks every turn, encoded once, and the
sorted byte spans of the assistant texts are intersected with the token spans by binary search.

The template is ``<|im_start|>role<|im_sep|>text<|im_end|>`` and a line feed per turn. The three
marks are control tokens of their own, so no token crosses the edge of a text. Inside roles and
texts every ``<``, backslashes, ``|`` gets one more backslash, which takes away any mark and is
undone by removing one.

A conversation is rendered in segments: one for each ``TURNS`` turn numbers, cut further at
``CHARS`` characters. As marks separate turns, the segments' ids in order are the ids of the whole
conversation, and one conversation that holds a large part of all rows is spread over tasks.

Turns are ordered by turn (null first), then role, then text. A null role or text counts as
empty; rows without a conversation id form one conversation. Repeated rows are repeated turns. An
empty table gives no conversation. Columns other than the four named are not read.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import bpe

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
MARKS = (START, SEP, END)
TURNS = 64
CHARS = 1 << 20

_TURN = re.compile(r"<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


@functools.lru_cache(maxsize=2)
def chat_encoding(rank_file: str, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The rank file's encoder with the marks as control tokens, and each id's byte length."""
    plain = bpe.encoding(rank_file, pattern)
    first = plain.max_token_value + 2  # one id stays free for an end-of-text token
    marks = {m: first + i for i, m in enumerate(MARKS)}
    enc = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=plain._mergeable_ranks, special_tokens=marks)
    lengths = np.zeros(first + len(marks), np.int64)
    for token, rank in plain._mergeable_ranks.items():
        lengths[rank] = len(token)
    for mark, rank in marks.items():
        lengths[rank] = len(mark)
    return enc, lengths


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the sorted byte spans of the assistant texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        begin = at + len(head.encode())
        end = begin + len(body.encode())
        if role == "assistant":
            spans.append((begin, end))
        parts += [head, body, END, "\n"]
        at = end + len(END) + 1
    return "".join(parts), spans


def align(ids: np.ndarray, lengths: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """True for each token that lies inside a span."""
    ends = np.cumsum(lengths[ids])
    starts = ends - lengths[ids]
    if not spans:
        return np.zeros(len(ids), bool)
    left, right = np.array(spans).T
    at = np.searchsorted(left, starts, "right") - 1
    return (at >= 0) & (ends <= right[at])


SEGMENT = "conv_id long, block long, part long, n_turns long, formatted string, ids array<int>, loss array<boolean>"


def format_chats(
    chats: DataFrame,
    rank_file: str,
    pattern: str,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per segment: formatted text, token ids and loss mask, keyed by conversation, block
    and part in reading order."""

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, lengths = chat_encoding(rank_file, pattern)
        key, part, turns, size = None, 0, [], 0

        def flush() -> pa.RecordBatch:
            whole, spans = render(turns)
            parts = [
                enc.encode_to_numpy(p, allowed_special="all", disallowed_special=())
                for p in bpe.pieces(whole)
            ]
            ids = np.concatenate(parts).astype(np.int32)
            mask = align(ids, lengths, spans)
            values = [[key[0]], [key[1]], [part], [len(turns)], [whole]]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            arrays = [pa.array(v, k) for v, k in zip(values, kinds, strict=True)]
            ends = pa.array([0, len(ids)], pa.int32())
            arrays += [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (ids, mask)]
            return pa.RecordBatch.from_arrays(
                arrays, ["conv_id", "block", "part", "n_turns", "formatted", "ids", "loss"]
            )

        for batch in batches:
            for c, b, r, t in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if turns and ((c, b) != key or size >= CHARS):
                    yield flush()
                    part = part + 1 if (c, b) == key else 0
                    turns, size = [], 0
                key = (c, b)
                turns.append((r, t))
                size += len(t)
        if turns:
            yield flush()

    rows = chats.select(
        F.col(conv).cast("long").alias("conv_id"),
        F.coalesce(F.floor(F.col(turn) / TURNS), F.lit(-(2**62))).cast("long").alias("block"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    placed = rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "role", "text")
    return placed.drop("turn").mapInArrow(rendered, SEGMENT)


def read_back(segments: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Each segment's turns (role, line feed, text, line feed) and loss text, from its output alone."""

    @F.arrow_udf("turns string, loss_text string")
    def parsed(formatted: pa.Array, ids: pa.Array, loss: pa.Array) -> pa.Array:
        enc, _ = chat_encoding(rank_file, pattern)
        turns, kept = [], []
        for whole, tokens, mask in zip(formatted, ids, loss, strict=True):
            found = _TURN.findall(whole.as_py())
            turns.append("".join(f"{unescape(r)}\n{unescape(t)}\n" for r, t in found))
            tokens = tokens.values.to_numpy(zero_copy_only=False)
            mask = mask.values.to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]])))
            spans = zip(edges[::2], edges[1::2], strict=True)
            texts = [enc.decode_bytes(tokens[a:b].tolist()).decode() for a, b in spans]
            kept.append("".join(map(unescape, texts)))
        return pa.StructArray.from_arrays([pa.array(turns, pa.string()), pa.array(kept, pa.string())], ["turns", "loss_text"])

    back = parsed("formatted", "ids", "loss")
    return segments.withColumn("back", back).select(
        "conv_id",
        "block",
        "part",
        "n_turns",
        F.length("formatted").cast("long").alias("formatted_chars"),
        "back.turns",
        "back.loss_text",
    )


DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def digests(read: DataFrame) -> DataFrame:
    """One row per conversation: running digests over its segments in order, in bounded memory."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None

        def row(s: list) -> dict:
            return {
                "conv_id": s[0],
                "n_turns": s[1],
                "turns_sha256": s[3].hexdigest(),
                "loss_chars": s[5],
                "loss_sha256": s[4].hexdigest(),
                "formatted_chars": s[2],
            }

        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if state is None or state[0] != r["conv_id"]:
                    if state is not None:
                        done.append(row(state))
                    state = [r["conv_id"], 0, 0, hashlib.sha256(), hashlib.sha256(), 0]
                state[1] += r["n_turns"]
                state[2] += r["formatted_chars"]
                state[3].update(r["turns"].encode())
                state[4].update(r["loss_text"].encode())
                state[5] += len(r["loss_text"])
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if state is not None:
            yield pa.RecordBatch.from_pylist([row(state)], schema)

    long, text = pa.int64(), pa.string()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = pa.schema(list(zip(names, [long, long, text, long, text, long], strict=True)))
    ordered = read.repartition("conv_id").sortWithinPartitions("conv_id", "block", "part")
    return ordered.mapInArrow(summed, DIGEST)
