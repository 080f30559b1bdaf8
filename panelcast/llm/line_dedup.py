"""Line dedup: lines that many documents share stay in one of them only.

A line's key is the line without the white space ``[\\x20\\x09-\\x0D]`` at its ends, A-Z
lower-cased. Lines are exploded and hashed (128 bits), the distinct documents of each hash are
counted, and where a hash is found in ``min_documents`` or more, all its lines go except those of
its smallest document. The lines left are put together again by position.

Only slim rows (hashes, document, position) are shuffled by key; a text moves once, to meet the
positions that it loses. A line that a third of all documents hold is no hot key: counting combines
before its shuffle, and its verdict goes to each of the ``BUCKETS`` parts that its documents fall
into, as a bit mask names them.

Null and empty texts have one empty line. Rows that share a document id are one document; rows
without one are together one document, last in order. Repeated rows lose the same lines, and ties
cannot arise: a document either is the smallest or not. An empty table stays empty. Columns named
``kept_text``, ``n_lines`` or ``n_dropped`` are replaced.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.session import stage

#: Parts that the documents of one key are dealt over; 64 bits to a mask.
BUCKETS = 256

_MASKS = [f"mask{i}" for i in range(BUCKETS // 64)]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))
    return F.translate(bare, string.ascii_uppercase, string.ascii_lowercase)


def _keyed_lines(rows: DataFrame, min_chars: int) -> DataFrame:
    """One slim row per line that may be dropped: ``doc``, ``row``, ``pos``, ``h1``, ``h2``, ``bucket``."""
    lines = rows.select("doc", "row", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keyed = lines.select("doc", "row", "pos", line_key(F.col("line")).alias("key"))
    return keyed.where(F.length("key") >= min_chars).select(
        "doc",
        "row",
        "pos",
        F.xxhash64("key").alias("h1"),
        F.xxhash64(F.lit(1), "key").alias("h2"),
        F.pmod(F.xxhash64("doc", "row"), F.lit(BUCKETS)).cast("int").alias("bucket"),
    )


def _shared(lines: DataFrame, min_documents: int) -> DataFrame:
    """The hashes of enough documents, with the document that keeps them, once per bucket in use."""
    bit = F.expr("shiftleft(1L, bucket % 64)")
    masks = [
        F.bit_or(F.when(F.floor(F.col("bucket") / 64) == i, bit).otherwise(0)).alias(m) for i, m in enumerate(_MASKS)
    ]
    held = lines.groupBy("h1", "h2", "doc").agg(*masks)
    counted = held.groupBy("h1", "h2").agg(
        F.count("*").alias("documents"), F.min("doc").alias("first"), *[F.bit_or(m).alias(m) for m in _MASKS]
    )
    used = F.filter(
        F.sequence(F.lit(0), F.lit(BUCKETS - 1)),
        lambda b: F.getbit(F.element_at(F.array(*_MASKS), (F.floor(b / 64) + 1).cast("int")), b % 64) == 1,
    )
    return counted.where(F.col("documents") >= min_documents).select("h1", "h2", "first", F.explode(used).alias("bucket"))


def _without(lines: Column, gone: Column) -> Column:
    """The lines between the sorted positions ``gone``, in one pass over both."""
    before = F.transform(
        gone, lambda p, i: F.slice(lines, F.coalesce(F.get(gone, i - 1), F.lit(-1)) + 2, p - F.coalesce(F.get(gone, i - 1), F.lit(-1)) - 1)
    )
    return F.concat(F.flatten(before), F.slice(lines, F.element_at(gone, -1) + 2, F.size(lines)))


def drop_shared_lines(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_chars: int = 10,
    min_documents: int = 2,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """``keep`` of the input's columns (default: all) with ``kept_text`` and the numbers of lines
    before dropping, ``n_lines``, and dropped, ``n_dropped``."""
    kept = [c for c in (keep or df.columns) if c not in ("kept_text", "n_lines", "n_dropped")]
    rows = df.select(
        F.struct(*kept).alias("kept"),
        F.col(doc_id).cast("long").alias("doc"),
        F.col(text).alias("text"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("row"),
    )
    lines = stage(_keyed_lines(rows, min_chars), "line-keys")
    shared = _shared(lines, min_documents)
    met = lines.join(shared, ["h1", "h2", "bucket"]).where(~F.col("doc").eqNullSafe(F.col("first")))
    lost = met.groupBy("doc", "row").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    lost = lost.withColumnsRenamed({"doc": "lost_doc", "row": "lost_row"})
    both = rows.join(lost, F.col("doc").eqNullSafe(F.col("lost_doc")) & (F.col("row") == F.col("lost_row")), "left")
    # The array of one binds the split text, so that it isn't split again for every position.
    left = F.transform(F.array(lines_of(F.col("text"))), lambda ls: F.array_join(_without(ls, F.col("gone")), "\n"))[0]
    made = both.select(
        "kept",
        F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(left).alias("kept_text"),
        F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
    return made.select("kept.*", "kept_text", "n_lines", "n_dropped")
