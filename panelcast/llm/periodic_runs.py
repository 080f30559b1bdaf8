"""Periodic runs of words, by uniting suffix classes in order of descending LCP.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends,
at least ``min_length`` words and ``min_exponent`` periods long. Per document:

1. *Suffixes* of the words are sorted by prefix doubling; the ranks of all doublings give the
   longest common prefix (LCP) of neighbours in that order.
2. *Kruskal.* Neighbours are united in order of descending LCP, by union-find over the classes'
   ordered position sets, the smaller set put into the larger. Two positions i < j that become
   neighbours in a set seed a run with period j - i if this is at most the LCP: nothing between
   them repeats as far, so no smaller period fits, and the stretch ends at j + LCP.
3. *Runs.* The seeds of one run share period and end, and its first position is one of them, since
   it has the greatest LCP of all. So a run is the smallest seed of its period and end.

Such a run's first pair has an LCP of at least min over q of max(min_length, min_exponent * q) - q.
Uniting stops there, and documents in which no stretch of that many words occurs twice are not
sorted at all. That prunes nothing that could be a run.

The work is per document, so it is a plain map without a shuffle. Documents are taken in blocks of
about 1 MB; a longer one is a block of its own (about 200 bytes a word if it repeats itself).
Words are the maximal runs outside ``[\\x20\\x09-\\x0D]``, compared by a 64-bit hash of their bytes.

Null and empty texts have no words, no runs and an empty collapsed text. Repeated rows give repeated
results. An empty table stays empty. Columns named ``runs`` or ``collapsed`` are replaced.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator, Sequence
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.llm.words import mix, pieces, word_blocks

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def least_lcp(min_length: int, min_exponent: int) -> int:
    """The least LCP that the first pair of a wanted run can have."""
    return min(max(min_length, min_exponent * q) - q for q in range(1, min_length + 1))


def _repeating(hashes: np.ndarray, doc: np.ndarray, left: np.ndarray, lcp: int) -> np.ndarray:
    """The documents in which some stretch of up to ``lcp`` words occurs twice; ``left`` are the
    words from each position to the end of its document."""
    x, span = hashes, 1
    while 2 * span <= lcp and span < len(x):
        x = mix(x[:-span] * _STEP + x[span:])
        span *= 2
    whole = np.flatnonzero(left[: len(x)] >= span)
    keys = mix(x[whole] + mix(doc[whole].astype(_U) * _STEP))
    order = np.argsort(keys)
    twice = keys[order[1:]] == keys[order[:-1]]
    return np.unique(doc[whole[order[1:][twice]]])


def _doubled_ranks(symbols: np.ndarray, left: np.ndarray) -> list[np.ndarray]:
    """For windows of 1, 2, 4, ... words, equal ranks for equal windows, in order, until all differ.

    A window that passes the end of its document is smaller than any that goes on, and unique. The
    rank is the number of smaller windows, so only positions of equal windows are sorted again.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    keys, old = symbols[order], np.zeros(n, np.int64)
    rank = np.empty(n, np.int64)
    ranks: list[np.ndarray] = []
    span = 1
    while True:
        at = np.arange(len(order))
        fresh = np.concatenate([[True], keys[1:] != keys[:-1]])
        group = np.maximum.accumulate(np.where(fresh, at, 0))
        fresh_old = np.concatenate([[True], old[1:] != old[:-1]])
        group_old = np.maximum.accumulate(np.where(fresh_old, at, 0))
        rank[order] = old + group - group_old
        ranks.append(rank.astype(np.int32 if n < 1 << 31 else np.int64))
        alone = fresh & np.concatenate([fresh[1:], [True]])
        order = order[~alone]
        if not len(order):
            return ranks
        following = np.minimum(order + span, n - 1)
        second = np.where(left[order] > span, rank[following] + 1, 0)
        keys = rank[order] * (n + 1) + second
        again = np.argsort(keys, kind="stable")
        order, keys = order[again], keys[again]
        old = rank[order]
        span *= 2


def _common(ranks: list[np.ndarray], left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The LCP of the suffixes at ``a`` and ``b``."""
    off, last = np.zeros(len(a), np.int64), len(left) - 1
    for k in range(len(ranks) - 1, -1, -1):
        i, j = np.minimum(a + off, last), np.minimum(b + off, last)
        same = (off < left[a]) & (off < left[b]) & (ranks[k][i] == ranks[k][j])
        off[same] += 1 << k
    return off


def _seeds(low: np.ndarray, high: np.ndarray, lcps: np.ndarray, positions: np.ndarray) -> list[tuple[int, int, int]]:
    """(first position, distance, LCP) of positions that become neighbours at a distance of at most
    the LCP. Edges join nodes ``low`` and ``high`` in order of descending LCP."""
    parent = list(range(len(positions)))
    members: list[list[int] | None] = [[p] for p in positions.tolist()]
    found: list[tuple[int, int, int]] = []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x, y, lcp in zip(low.tolist(), high.tolist(), lcps.tolist(), strict=True):
        x, y = find(x), find(y)
        if len(members[x]) < len(members[y]):
            x, y = y, x
        large, small = members[x], members[y]
        parent[y], members[y] = x, None
        i, n = len(small), len(large)
        # From the back, so that places in the larger set stay valid: each gap of the larger set
        # takes a stretch small[first:i], whose two ends are new neighbours of the gap's ends.
        while i:
            gap = bisect(large, small[i - 1], 0, n)
            first = bisect(small, large[gap - 1], 0, i) if gap else 0
            if gap < n and large[gap] - small[i - 1] <= lcp:
                found.append((small[i - 1], large[gap] - small[i - 1], lcp))
            if gap and small[first] - large[gap - 1] <= lcp:
                found.append((large[gap - 1], small[first] - large[gap - 1], lcp))
            large[gap:gap] = small[first:i]
            i, n = first, gap
    return found


def find_runs(hashes: np.ndarray, bounds: np.ndarray, min_length: int, min_exponent: int) -> tuple[np.ndarray, ...]:
    """Document, start, length and period of the runs of a block of documents, in this order."""
    counts = np.diff(bounds)
    doc = np.repeat(np.arange(len(counts)), counts)
    left = bounds[1:][doc] - np.arange(bounds[0], bounds[-1])
    none = (np.empty(0, np.int64),) * 4
    least = least_lcp(min_length, min_exponent)
    wanted = _repeating(hashes, doc, left, least) if len(hashes) else none[0]
    if not len(wanted):
        return none
    inside = np.zeros(len(counts), bool)
    inside[wanted] = True
    chosen = inside[doc]
    hashes, doc, left = hashes[chosen], doc[chosen], left[chosen]
    ranks = _doubled_ranks(mix(hashes + mix(doc.astype(_U) * _STEP)), left)

    order = np.empty(len(doc), np.int64)
    order[ranks[-1]] = np.arange(len(doc))
    near = ranks[min(least.bit_length(), len(ranks)) - 1]
    edge = np.flatnonzero(near[order[:-1]] == near[order[1:]])
    lcp = _common(ranks, left, order[edge], order[edge + 1])
    edge, lcp = edge[lcp >= least], lcp[lcp >= least]
    nodes = np.unique(np.concatenate([edge, edge + 1]))
    falling = np.argsort(-lcp, kind="stable")
    edge, lcp = edge[falling], lcp[falling]
    seeds = _seeds(np.searchsorted(nodes, edge), np.searchsorted(nodes, edge + 1), lcp, order[nodes])
    if not seeds:
        return none
    start, period, lcp = np.array(seeds, np.int64).T
    end = start + period + lcp
    by_run = np.lexsort((start, end, period))
    start, period, end = start[by_run], period[by_run], end[by_run]
    first = np.concatenate([[True], (period[1:] != period[:-1]) | (end[1:] != end[:-1])])
    length = end - start
    first &= length >= np.maximum(min_length, min_exponent * period)
    start, period, length = start[first], period[first], length[first]
    by_place = np.lexsort((period, start))
    start, period, length = start[by_place], period[by_place], length[by_place]
    local = counts[doc[start]] - left[start]
    return doc[start], local, length, period


def _collapsed(text: bytes, gone: np.ndarray | None) -> bytes:
    """The words that are not ``gone``, joined by one space, a piece of a long text at a time."""
    if gone is None and len(text) < 1 << 20:
        return b" ".join(text.split())
    parts, at = [], 0
    for piece in pieces(np.frombuffer(text, np.uint8)):
        words = piece.tobytes().split()
        kept = words if gone is None else list(compress(words, ~gone[at : at + len(words)]))
        at += len(words)
        if kept:
            parts.append(b" ".join(kept))
    return b" ".join(parts)


def _detect(batches: Iterator[pa.RecordBatch], min_length: int, min_exponent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        for at, hashes, bounds in word_blocks(batch.column("text"), fold=False):
            n = len(bounds) - 1
            doc, start, length, period = find_runs(hashes, bounds, min_length, min_exponent)
            ends = np.searchsorted(doc, np.arange(n + 1))
            left = []
            for i in range(n):
                gone = None
                if ends[i] < ends[i + 1]:
                    mine = slice(ends[i], ends[i + 1])
                    steps = np.zeros(bounds[i + 1] - bounds[i] + 1, np.int64)
                    np.add.at(steps, start[mine] + period[mine], 1)
                    np.add.at(steps, start[mine] + length[mine], -1)
                    gone = np.cumsum(steps[:-1]) > 0
                left.append(_collapsed(texts[at + i].as_py() or b"", gone))
            runs = pa.StructArray.from_arrays([pa.array(c) for c in (start, length, period)], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("kept").slice(at, n),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs),
                    pa.array(left, pa.binary()).cast(pa.string()),
                ],
                ["kept", "runs", "collapsed"],
            )


def detect(
    df: DataFrame,
    text: str = "text",
    min_length: int = 24,
    min_exponent: int = 3,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """``keep`` of the input's columns (default: all) with ``runs``, ordered by start and period,
    and ``collapsed``, the words without those that any run repeats after its first period."""
    if min_length < 1 or min_exponent < 2:
        raise ValueError("a run needs at least one word and two periods")
    kept = [c for c in (keep or df.columns) if c not in ("runs", "collapsed")]
    rows = df.select(F.struct(*kept).alias("kept"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["kept"], *T._parse_datatype_string(f"runs {RUNS}, collapsed string").fields])
    made = rows.mapInArrow(lambda it: _detect(it, min_length, min_exponent), schema)
    return made.select("kept.*", "runs", "collapsed")
