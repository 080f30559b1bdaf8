"""Vectorised word hashing over Arrow string columns, shared by the operators on words.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; A-Z are lower-cased on demand. Each
word becomes one 64-bit hash, computed for a whole block of documents at a time, so that a task's
working memory is a few times ``BLOCK`` bytes whatever the batch or document size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at once.
BLOCK = 1 << 17

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the public splitmix64 finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _byte_table(fold: bool) -> np.ndarray:
    table = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))
    if fold:
        table[ord("A") : ord("Z") + 1] = table[ord("a") : ord("z") + 1]
    table[~_WORD] = 0
    return table


_TABLES = {fold: _byte_table(fold) for fold in (False, True)}


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, _U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, BLOCK + 1)
            steps = np.full(size, _BASE, _U)
            steps[0] = 1
            self.up = np.multiply.accumulate(steps)
            steps[1:] = pow(_BASE, -1, 1 << 64)
            self.down = np.multiply.accumulate(steps)
        return self.up, self.down


_POWERS = _Powers()


def _hash_block(data: np.ndarray, doc_starts: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words of one block."""
    inside = _WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = doc_starts[doc_starts < len(data)]
    first[cuts] = inside[cuts]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, _U), starts
    up, down = _POWERS.upto(len(data))
    sums = np.add.reduceat(_TABLES[fold][data] * up[: len(data)], starts)
    return mix(sums * down[starts]), starts


def pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """One long text in pieces that end before white space, so that no word is cut."""
    at = 0
    while at < len(data):
        end = min(at + BLOCK, len(data))
        while end < len(data):
            gap = np.flatnonzero(~_WORD[data[end : end + BLOCK]])
            end = end + int(gap[0]) if len(gap) else min(end + BLOCK, len(data))
            if len(gap):
                break
        yield data[at:end]
        at = end


def word_blocks(texts: pa.Array, fold: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (first document, word hashes, bounds): document i of a block has the words
    ``hashes[bounds[i]:bounds[i + 1]]``. A null text has no words; ``fold`` lower-cases A-Z."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1)
        block = data[offsets[at] : offsets[to]]
        if to == at + 1 and len(block) > BLOCK:
            parts = [_hash_block(p, np.zeros(1, np.int64), fold)[0] for p in pieces(block)]
            hashes = np.concatenate(parts)
            yield at, hashes, np.array([0, len(hashes)])
        else:
            local = offsets[at : to + 1] - offsets[at]
            hashes, starts = _hash_block(block, local, fold)
            yield at, hashes, np.searchsorted(starts, local)
        at = to
