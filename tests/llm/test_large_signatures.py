"""Alike texts that all link with the first of them are not joined by their single n-grams."""

import os

from panelcast import session
from panelcast.llm import ngram_join


def test_alike_texts_are_not_crowded(spark, monkeypatch):
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join([*base[: 4 * k], f"x{k}", *base[4 * k + 1 :]]) for k in range(40)]
    docs = spark.createDataFrame([*enumerate(texts), (99, "some other words " * 9)], "doc_id long, text string")
    rows = {}

    def kept(frame, label, write=ngram_join.stage):
        out = write(frame, label)
        rows[label] = rows.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(ngram_join, "stage", kept)
    before = set(os.listdir(session.shared_dir(spark).removeprefix("file:")))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.groups(docs, tidy=True).collect()}
    assert got == {**dict.fromkeys(range(40), 0), 99: 99}
    assert rows["ngram-postings"] == 0
    left = {n.rsplit("-", 1)[0] for n in set(os.listdir(session.shared_dir(spark).removeprefix("file:"))) - before}
    assert not left & {"ngram-met", "ngram-candidates", "ngram-overlaps", "ngram-pairs", "ngram-segments", "ngram-needed"}
