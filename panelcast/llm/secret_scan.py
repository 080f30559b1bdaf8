"""Secret scans: fixed formats, and random strings told from identifiers by Markov models.

Two first-order character models are trained from labelled samples: random strings (the secrets
that the fixed formats find in a bounded sample of documents, and seeded draws from the usual
key alphabets) and ordinary identifiers (all other words of that sample). A token that is not all
digits is a secret if its log-likelihood ratio reaches ``MIN_RATIO``, the log odds that an arbitrary
token is none. Tokens below ``MIN_TOKEN`` characters are not judged: a random one of them reaches
that ratio too seldom. A token that goes beyond a fixed format's span gets a span of its own beside it.

The fixed formats are assign (a credential name, ``:`` or ``=``, a value of 8 or more
characters), access (AKIA and 12 or more capitals or digits) and hex (32 or more lower-case hex
digits), each leftmost and non-overlapping. Spans count code points, end exclusive, and are
sorted by start, then kind. A null or empty text has none. Repeated rows get equal spans.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("assign", "access", "hex")
RANDOM_KIND = "random"
KINDS = (*BASE_KINDS, RANDOM_KIND)

#: Distinct documents in the training sample, in expectation: those in one of so many hash classes.
SAMPLE_DOCUMENTS = 2000
#: Seeded random strings per alphabet in the training sample.
SAMPLE_STRINGS = 400
#: Natural log of the odds against an ordinary token being random.
MIN_RATIO = 14.0
#: From this length on, 99 % of random strings of letters and digits reach MIN_RATIO.
MIN_TOKEN = 12

SPANS = "array<struct<kind:string,start:int,end:int>>"

# The three formats.
_ASSIGN = re.compile(
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
    r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")

_TOKEN = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_TOKEN},}}")
_WORD = re.compile(r"[A-Za-z0-9+/_=-]{4,}")
#: Whatever holds a span matches this; it runs over whole Arrow batches.
_MAYBE = (
    r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"
    rf"|[A-Za-z0-9+/_=-]{{{MIN_TOKEN}}}"
)

_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_START = len(_ALPHABET)
_CODE = np.zeros(128, np.int64)
_CODE[[ord(c) for c in _ALPHABET]] = np.arange(len(_ALPHABET))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed formats' spans, sorted by start, then kind."""
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], BASE_KINDS.index(s[0])))


def _codes(token: str) -> np.ndarray:
    return _CODE[np.frombuffer(token.encode("ascii"), np.uint8)]


def _count(counts: np.ndarray, token: str) -> None:
    codes = _codes(token)
    np.add.at(counts, (np.concatenate([[_START], codes[:-1]]), codes), 1)


def _transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Transition counts of both classes over one partition of the sample."""
    counts = np.zeros((2, _START + 1, _START), np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            spans = base_spans(text)
            for kind, start, end in spans:
                value = _ASSIGN.match(text, start)[1] if kind == "assign" else text[start:end]
                for token in _WORD.findall(value):
                    _count(counts[1], token)
            at = 0
            for _, start, end in [*spans, ("", len(text), len(text))]:
                for token in _WORD.findall(text, at, max(at, start)):
                    _count(counts[0], token)
                at = max(at, end)
    label, left, right = np.nonzero(counts)
    columns = [label, left, right, counts[label, left, right]]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["label", "a", "b", "n"])


def train(docs: DataFrame, text: str = "text", documents: int = SAMPLE_DOCUMENTS) -> np.ndarray:
    """The log-ratio of each transition, random against ordinary: a small fixed-size matrix."""
    texts = docs.select(F.col(text).alias("text")).where(F.length("text") > 0)
    classes = max(1, texts.count() // documents)
    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(classes)) == 0).distinct()
    parts = sample.mapInArrow(_transitions, "label long, a long, b long, n long")
    counts = np.zeros((2, _START + 1, _START))
    for row in parts.groupBy("label", "a", "b").agg(F.sum("n").alias("n")).collect():
        counts[row["label"], row["a"], row["b"]] = row["n"]
    draw = random.Random(20)
    for alphabet in ("0123456789abcdef", _ALPHABET[:62], _ALPHABET[26:62], _ALPHABET[:64]):
        for _ in range(SAMPLE_STRINGS):
            _count(counts[1], "".join(draw.choices(alphabet, k=40)))
    chance = np.log((counts + 0.5) / (counts + 0.5).sum(axis=2, keepdims=True))
    return chance[1] - chance[0]


def ratio(model: np.ndarray, token: str) -> float:
    codes = _codes(token)
    return float(model[np.concatenate([[_START], codes[:-1]]), codes].sum())


def all_spans(model: np.ndarray, text: str) -> list[tuple[str, int, int]]:
    """The fixed formats' spans, and random tokens that lie inside none of them."""
    spans = base_spans(text)
    added = []
    for m in _TOKEN.finditer(text):
        token = m[0].rstrip("=")
        if len(token) < MIN_TOKEN or token.isdigit():
            continue
        start, end = m.span()
        if any(s <= start and end <= e for _, s, e in spans):
            continue
        if ratio(model, token) >= MIN_RATIO:
            added.append((RANDOM_KIND, start, end))
    return sorted(spans + added, key=lambda s: (s[1], KINDS.index(s[0])))


def scan(df: DataFrame, model: np.ndarray, text: str = "text", out: str = "spans") -> DataFrame:
    """Add the spans of each text."""

    @F.arrow_udf(SPANS)
    def spans(texts: pa.Array) -> pa.Array:
        maybe = pc.fill_null(pc.match_substring_regex(texts, _MAYBE), False)
        rows = [[] for _ in range(len(texts))]
        for i in np.flatnonzero(maybe.to_numpy(zero_copy_only=False)):
            found = all_spans(model, texts[int(i)].as_py())
            rows[i] = [{"kind": k, "start": s, "end": e} for k, s, e in found]
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        return pa.array(rows, pa.list_(kind))

    return df.withColumn(out, spans(F.col(text)))


def redact(df: DataFrame, text: str = "text", spans: str = "spans", mark: str = "[SECRET]") -> DataFrame:
    """Replace each maximal covered stretch of the text by a mark."""

    @F.arrow_udf("string")
    def clean(texts: pa.Array, found: pa.Array) -> pa.Array:
        rows = texts.to_pylist()
        hit = pc.greater(pc.fill_null(pc.list_value_length(found), 0), 0)
        for i in np.flatnonzero(hit.to_numpy(zero_copy_only=False)):
            whole, kept, at = rows[i], [], 0
            for s in found[int(i)].as_py():
                if s["start"] >= at:
                    kept += [whole[at : s["start"]], mark]
                at = max(at, s["end"])
            rows[i] = "".join([*kept, whole[at:]])
        return pa.array(rows, pa.string())

    return df.withColumn(text, clean(F.col(text), F.col(spans)))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return F.array_join(parts, ",")
