"""I-Match document fingerprints with randomised lexicons.

The lexicon holds the terms (lower-cased words) whose inverse document frequency lies in a band.
A document keeps its distinct lexicon terms in sorted order; their hash is the first part of the
fingerprint. ``LEXICONS`` random sub-lexicons give the other parts. Each is thinned in nested
halves, and a document takes the finest half that still holds a term of it, so that the part stays
comparable for documents of any length: it changes only if one of the few terms in that half does.

The band bounds the document frequency from below by a share of all documents, so the lexicon has
at most (mean distinct terms per document) / ``RAREST`` terms however many documents there are.
That is what is broadcast; ``most_terms`` checks it.

A document without lexicon terms is fingerprinted by all its terms, one without words (null and
empty texts too) gets the fixed fingerprint ``EMPTY``. Equal texts have equal fingerprints.
Repeated rows count as documents of their own. An empty table gives an empty lexicon.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.words import mix, word_blocks

#: Document frequencies as shares of all documents: the band's ends.
RAREST, COMMONEST = 2e-4, 1e-2
LEXICONS = 24
MOST_TERMS = 8_000_000
#: Term counts gathered in a task before they are handed on.
GATHER = 1 << 21
EMPTY = "-"

_U = np.uint64
_SEEDS = mix(np.arange(1, LEXICONS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
_HEAD, _PART = 17, 8


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial document frequencies of hashed terms."""

    def emit(parts: list[np.ndarray]) -> pa.RecordBatch:
        term, df = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(df)], ["term", "df"])

    parts, size = [], 0
    for batch in batches:
        for _, words, bounds in word_blocks(batch.column(0)):
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                parts.append(np.unique(words[a:b]))
                size += len(parts[-1])
            if size >= GATHER:
                yield emit(parts)
                parts, size = [], 0
    if size:
        yield emit(parts)


def lexicon(
    docs: DataFrame,
    text: str = "text",
    rarest: float = RAREST,
    commonest: float = COMMONEST,
    most_terms: int = MOST_TERMS,
) -> np.ndarray:
    """The sorted hashes of the terms in the band, counted over all documents."""
    total = docs.count()
    counts = docs.select(text).mapInArrow(_frequencies, "term long, df long")
    counts = counts.groupBy("term").agg(F.sum("df").alias("df"))
    inside = counts.where((F.col("df") >= rarest * total) & (F.col("df") <= max(1.0, commonest * total)))
    kept = inside.select("term").limit(most_terms + 1).toArrow().column(0).to_numpy()
    if len(kept) > most_terms:
        raise ValueError(f"over {most_terms} terms in the band: raise its lower end or most_terms")
    return np.sort(kept.view(_U))


def fingerprint(terms: np.ndarray, kept: np.ndarray) -> str:
    """The fingerprint of one document's sorted distinct terms."""
    if not len(terms):
        return EMPTY
    at = np.searchsorted(kept, terms)
    inside = terms[(at < len(kept)) & (kept[np.minimum(at, len(kept) - 1)] == terms)] if len(kept) else terms[:0]
    mark, used = ("l", inside) if len(inside) else ("a", terms)
    scores = mix(used[:, None] ^ _SEEDS[None, :])
    least = scores.min(axis=0)
    levels = 64 - np.frexp(least.astype(np.float64))[1]
    fine = scores >> (_U(64) - np.clip(levels, 1, 63).astype(_U)) == 0
    hashed = mix(used ^ _SEEDS[0])
    parts = mix((fine * hashed[:, None]).sum(axis=0, dtype=_U) + levels.astype(_U)) >> _U(32)
    whole = int(mix(hashed.sum(keepdims=True) + _U(len(used)))[0])
    return f"{mark}{whole:016x}{parts.astype('>u4').tobytes().hex()}"


def fingerprint_batch(texts: pa.Array, kept: np.ndarray) -> list[str]:
    out = []
    for _, words, bounds in word_blocks(texts):
        out += [fingerprint(np.unique(words[a:b]), kept) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


def fingerprints(df: DataFrame, kept: Broadcast, columns: dict[str, str]) -> DataFrame:
    """Add one fingerprint column for each text column (text name to output name)."""

    @F.arrow_udf("string")
    def made(texts: pa.Array) -> pa.Array:
        return pa.array(fingerprint_batch(texts, kept.value), pa.string())

    return df.withColumns({out: made(F.col(text)) for text, out in columns.items()})


def likeness(a: Column, b: Column) -> Column:
    """The share of equal sub-lexicon parts, 0 to 1; equal fingerprints give 1."""
    same = [
        (F.substring(a, _HEAD + 1 + _PART * k, _PART) == F.substring(b, _HEAD + 1 + _PART * k, _PART)).cast("int")
        for k in range(LEXICONS)
    ]
    share = sum(same[1:], same[0]) / F.lit(float(LEXICONS))
    return F.when(a == b, F.lit(1.0)).when((a == EMPTY) | (b == EMPTY), F.lit(0.0)).otherwise(share)
