"""The query on document fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import imatch
from panelcast.llm.ordering import in_order
from panelcast.llm.tables import table

#: Rows edited at once.
_ROWS = 256


def _edits(kept: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Fingerprints of each row and of its edited text, and its successor's fingerprint.

    The rows of a block are followed by its context row, which only serves as a successor. All of
    it happens in one pass, so a task needs one Python worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                docs, texts, context = (part.column(c).to_pylist() for c in ("doc_id", "text", "context"))
                prints = imatch.fingerprint_batch(part.column("text"), kept.value)
                rows = held + list(zip(docs, [t or "" for t in texts], context, prints, strict=True))
                held = rows[-1:]
                pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[2]]
                if not pairs:
                    continue
                edited = [a[1][: len(a[1]) - len(a[1]) // 3] + b[1][: len(a[1]) // 3] for a, b in pairs]
                columns = [
                    pa.array([a[0] for a, _ in pairs], pa.int64()),
                    pa.array([len(a[1]) for a, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                    pa.array([a[3] for a, _ in pairs]),
                    pa.array(imatch.fingerprint_batch(pa.array(edited, pa.string()), kept.value)),
                    pa.array([b[3] for _, b in pairs]),
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _EDITS.split(", ")])

    return run


_EDITS = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string,"
    " edited_fingerprint string, next_fingerprint string"
)


def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = spark.sparkContext.broadcast(imatch.lexicon(docs))
    ordered = in_order(docs, "doc_id", ["doc_id", "text"]).select("doc_id", "text", "context")
    ahead = ordered.mapInArrow(_edits(kept), _EDITS)
    own = F.col("fingerprint")
    return ahead.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        imatch.likeness(own, F.col("edited_fingerprint")).alias("near_edited"),
        imatch.likeness(own, F.col("next_fingerprint")).alias("near_next"),
    )
