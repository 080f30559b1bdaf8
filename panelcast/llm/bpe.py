"""Byte-level BPE encoding and decoding with a local rank file.

Each worker loads the rank file once and encodes Arrow batches. Texts are cut first at places
that no match of the split pattern can cross, so the ids equal those of the whole text while the
encoder only sees bounded pieces. Decoding joins the raw bytes of the ids, so an id
list that ends inside a character still decodes to its exact bytes.

Null text encodes like the empty text, to an empty id list; null ids decode to empty bytes.
Other columns pass through; an output name that is already taken is replaced.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters given to the encoder at once (a piece ends at the first safe place after them).
PIECE = 1 << 16
#: Rows encoded before their ids are handed on.
ROWS = 128


@functools.lru_cache(maxsize=2)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    """The encoder of a rank file (lines of base64 token and rank), without special tokens."""
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _safe(left: str, right: str) -> bool:
    """True if no match of the pattern holds both of these neighbours.

    Matches take white space only as their first character or throughout, and never mix letters
    with digits.
    """
    if right.isspace():
        return not left.isspace()
    return (left.isalpha() and right.isdecimal()) or (left.isdecimal() and right.isalpha())


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in order, cut only at safe places. A run without any stays whole."""
    at = 0
    while len(text) - at > size:
        end = at + size
        while end < len(text) and not _safe(text[end - 1], text[end]):
            end += 1
        yield text[at:end]
        at = end
    if at < len(text):
        yield text[at:]


def encode_text(enc: tiktoken.Encoding, text: str) -> np.ndarray:
    """The ids of one text as 32-bit integers."""
    parts = [text] if len(text) <= PIECE else pieces(text)
    ids = [enc.encode_to_numpy(p, allowed_special=set(), disallowed_special=()) for p in parts]
    return ids[0].view(np.int32) if len(ids) == 1 else np.concatenate(ids).view(np.int32)


def _id_lists(enc: tiktoken.Encoding, texts: pa.Array) -> tuple[pa.Array, list[np.ndarray]]:
    done = [encode_text(enc, t.as_py() or "") for t in texts]
    ends = np.cumsum([0, *map(len, done)], dtype=np.int32)
    flat = np.concatenate(done) if done else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), done


def _raw_bytes(enc: tiktoken.Encoding, lists: list[np.ndarray]) -> pa.Array:
    return pa.array([enc.decode_bytes(x.tolist()) for x in lists], pa.binary())


def _mapped(
    df: DataFrame,
    column: str,
    kept: Sequence[str] | None,
    fields: dict[str, str],
    make: Callable[[pa.Array], list[pa.Array]],
) -> DataFrame:
    """``kept`` columns with new ones made from one, in slices of few rows: a task holds one
    Arrow batch and one slice's ids, and needs one Python worker."""
    names = [c for c in (df.columns if kept is None else kept) if c not in fields]
    schema = T.StructType([df.schema[c] for c in names])
    for name, kind in fields.items():
        schema = schema.add(name, T.DataType.fromDDL(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                arrays = [part.column(c) for c in names] + make(part.column(column))
                yield pa.RecordBatch.from_arrays(arrays, [*names, *fields])

    return df.select(*dict.fromkeys([*names, column])).mapInArrow(run, schema)


def encode(
    df: DataFrame, rank_file: str, pattern: str, text: str = "text", out: str = "ids", keep: Sequence[str] | None = None
) -> DataFrame:
    """Add the ids of each text as ``array<int>`` to the kept columns (default: all)."""
    return _mapped(df, text, keep, {out: "array<int>"}, lambda t: [_id_lists(encoding(rank_file, pattern), t)[0]])


def decode(
    df: DataFrame, rank_file: str, pattern: str, ids: str = "ids", out: str = "decoded", keep: Sequence[str] | None = None
) -> DataFrame:
    """Add the raw bytes of each id list as ``binary``."""

    def raw(lists: pa.Array) -> list[pa.Array]:  # a null list is an empty span
        flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        parts = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return [_raw_bytes(encoding(rank_file, pattern), parts)]

    return _mapped(df, ids, keep, {out: "binary"}, raw)


def encode_and_decode(
    df: DataFrame,
    rank_file: str,
    pattern: str,
    text: str = "text",
    ids: str = "ids",
    decoded: str = "decoded",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add the ids and what they decode to, in one pass."""

    def both(texts: pa.Array) -> list[pa.Array]:
        enc = encoding(rank_file, pattern)
        lists, done = _id_lists(enc, texts)
        return [lists, _raw_bytes(enc, done)]

    return _mapped(df, text, keep, {ids: "array<int>", decoded: "binary"}, both)


def ids_digest(ids: Column) -> Column:
    """SHA-256 of the decimal ids joined by one space."""
    return F.sha2(F.concat_ws(" ", ids.cast("array<string>")).cast("binary"), 256)
