import hashlib

import numpy as np
from pyspark.sql import functions as F

from panelcast.llm import imatch
from panelcast.llm.ordering import in_order
from panelcast.llm.queries_fingerprints import op1_imatch

SF = "/root/testdata/sf0.001"


def test_query_equals_plain_edits_and_tells_edits_from_strangers(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy(F.desc("doc_id")).collect()
    out = {r["doc_id"]: r for r in op1_imatch(spark, SF).collect()}
    assert len(out) == len(docs)
    for i, doc in enumerate(docs):
        text, following = doc["text"] or "", docs[(i + 1) % len(docs)]["text"] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        row = out[doc["doc_id"]]
        assert (row["n_chars"], row["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        if edited == text:
            assert row["near_edited"] == 1.0
    near = np.array([(r["near_edited"], r["near_next"]) for r in out.values()])
    assert near[:, 0].mean() > 0.3 > 0.05 > near[:, 1].mean()
    prints = {}
    for doc in docs:
        assert prints.setdefault(doc["text"], out[doc["doc_id"]]["fingerprint"]) == out[doc["doc_id"]]["fingerprint"]


def test_lexicon_is_the_band_and_edge_cases(spark):
    texts = ["common alpha beta", "common alpha gamma", "Common delta", None, "", "common common", "common alpha beta"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, fp string")
    kept = imatch.lexicon(df, rarest=2 / 7, commonest=3 / 7)
    assert len(kept) == 2  # alpha (3 documents) and beta (2)
    sent = spark.sparkContext.broadcast(kept)
    out = [r["fp"] for r in imatch.fingerprints(df, sent, {"text": "fp"}).orderBy("doc_id").collect()]
    assert out[0] == out[6] and out[3] == out[4] == imatch.EMPTY
    assert [p[0] for p in out] == ["l", "l", "a", "-", "-", "a", "l"]
    pair = spark.createDataFrame([(out[0], out[6]), (out[3], out[4]), (out[3], out[0]), (out[0], out[1])], "a string, b string")
    likeness = [r[0] for r in pair.select(imatch.likeness(F.col("a"), F.col("b"))).collect()]
    assert likeness[:3] == [1.0, 1.0, 0.0] and 0 <= likeness[3] < 1
    assert len(imatch.lexicon(df.limit(0))) == 0


def test_order_reaches_every_successor(spark):
    rows = [(i * i % 97, f"t{i}") for i in range(60)] + [(None, "n"), (5, "same"), (5, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    placed = in_order(df, "doc_id", ["doc_id", "text"])
    parts = placed.rdd.glom().map(lambda part: [tuple(r) for r in part]).collect()
    pairs = set()
    for part in parts:
        for a, b in zip(part, part[1:], strict=False):
            if not a[4]:
                pairs.add((a[0], b[0]))
    ids = sorted((-1 if r[0] is None else r[0] for r in rows), reverse=True)
    want = {(a, b) for a, b in zip(ids, ids[1:] + ids[:1], strict=True)}
    assert {tuple(-1 if x is None else x for x in p) for p in pairs} == want
    assert in_order(df.limit(0), "doc_id", ["doc_id", "text"]).count() == 0
