import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from panelcast.llm import ngram_join, words
from panelcast.llm.components import components


FIVE = ngram_join.Rule(words=5, num=8, den=10)


def shingle_set(text, size=3):
    w = (text or "").encode().lower().split()
    many = zip(*(w[k:] for k in range(size)), strict=False)
    return frozenset(many) if len(w) >= size else frozenset([tuple(w)]) if w else frozenset()


def brute_force(rows, size=3, share=90):
    sets = {i: shingle_set(t, size) for i, t in rows if i is not None}
    low = {i: i for i in sets}
    changed = True
    links = [
        (a, b)
        for a in sets
        for b in sets
        if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]) > 0
    ]
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return {i: (len(s), low[i]) for i, s in sets.items()}


def corpus(seed=5):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(draw.choices(vocabulary, k=50))
    rows = []
    for n in (1, 2, 3, 8, 11, 12, 25, 60, 200, 900):
        base = draw.choices(vocabulary, k=n)
        for edits in (0, 0, 1, 1, 1, 2, 3, 5, 9, 20, 40):
            w = list(base)
            for _ in range(min(edits, n // 9)):
                w[draw.randrange(n)] = f"x{draw.randrange(10**6)}"
            rows.append(" ".join(w))
    rows += [passage + " " + " ".join(draw.choices(vocabulary, k=40)) for _ in range(30)]
    rows += ["", None, "  \n", "One two", "one TWO", "É one"]
    draw.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("small", [32, 2])
def test_components_equal_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    rows = corpus()
    extra = [(None, rows[0][1]), (3, rows[3][1])]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows + extra], "doc_id long, text string, n string")
    out = ngram_join.groups(df).collect()
    assert len(out) == len(rows) + 2
    want = brute_force(rows)
    for row in out:
        if row["doc_id"] is None:
            assert row["component_id"] is None
        else:
            assert (row["n_shingles"], row["component_id"]) == want[row["doc_id"]]
    assert ngram_join.groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("small", [32, 2])
def test_five_words_equal_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    rows = corpus(6)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.groups(df, rule=FIVE).collect()}
    want = brute_force(rows, 5, 80)
    assert got == want
    assert len({c for _, c in want.values()}) < len({c for _, c in brute_force(rows, 5, 90).values()})


@pytest.mark.parametrize("rule", [ngram_join.Rule(), FIVE, ngram_join.Rule(4, 1, 2)])
def test_partners_share_a_signature(rule):
    draw = np.random.default_rng(1)
    for n in (2, 4, 5, 7, 9, 10, 30, 100, 900):
        for _ in range(60):
            base = np.unique(draw.integers(0, 2**64, n * 11 // 10, dtype=np.uint64))
            drop = int(draw.integers(0, max(1, len(base) * (rule.den - rule.num) // (rule.den + rule.num)) + 1))
            a = np.sort(draw.choice(base, len(base) - drop, replace=False))
            b = np.sort(draw.choice(base, len(base) - drop, replace=False))
            alike = rule.den * len(np.intersect1d(a, b)) >= rule.num * len(np.union1d(a, b))
            if alike and not np.array_equal(a, b):  # equal sets are one class and need none
                assert len(np.intersect1d(ngram_join.signatures(a, rule), ngram_join.signatures(b, rule)))


def test_word_hashes_follow_the_words(monkeypatch):
    monkeypatch.setattr(words, "BLOCK", 64)
    texts = ["A b\tc", None, "", "a B c", " " * 200 + "a\x0bb c" + "\n" * 70, "x" * 300, "é ü   　"]
    found = {}
    for at, hashes, bounds in words.word_blocks(pa.array(texts)):
        for i in range(len(bounds) - 1):
            found[at + i] = hashes[bounds[i] : bounds[i + 1]].tolist()
    assert found[0] == found[3] == found[4] and len(found[0]) == 3
    assert [len(found[i]) for i in range(7)] == [len((t or "").encode().split()) for t in texts]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20, 40)] + [(2, 1)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(20, 41), 20), 1: 1, 2: 1}


def test_signatures_in_passes(spark, monkeypatch):
    """Every signature is exchanged in exactly one pass, and the groups are those of one pass."""
    rows = corpus()
    batch = pa.RecordBatch.from_pydict({"text": [t for _, t in rows]})

    def members(rule, some=0):
        found = [b.to_pydict() for b in ngram_join._signed(iter([batch]), rule, some)]
        return [m for f in found for m in zip(f["sig"], f["cls"], f["n"], strict=True) if m[2] > 0]

    monkeypatch.setattr(ngram_join, "SMALL", 10**6)
    thirds = ngram_join.Rule(words=5, num=8, den=10, passes=3)
    parts = [members(thirds, some) for some in range(3)]
    whole = members(FIVE)
    assert sorted(m for part in parts for m in part) == sorted(whole)
    assert all(0 < len(part) < len(whole) / 2 for part in parts)
    monkeypatch.undo()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.groups(df, rule=thirds).collect() if r.doc_id is not None}
    assert got == brute_force(rows, 5, 80)


def test_texts_to_verify_are_exchanged_in_parts(spark, monkeypatch):
    rows = corpus(8)
    df = spark.createDataFrame([*rows, (3, rows[3][1]), (None, rows[0][1])], "doc_id long, text string")
    rule = ngram_join.Rule(words=5, num=8, den=10, passes=3)
    staged = {}

    def kept(frame, label, write=ngram_join.stage):
        staged.setdefault(label, []).append(write(frame, label))
        return staged[label][-1]

    monkeypatch.setattr(ngram_join, "stage", kept)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.groups(df, rule=rule).collect()}
    got.pop(None)
    assert got == brute_force(rows, 5, 80)
    parts = [{r["doc_id"] for r in t.select("doc_id").distinct().collect()} for t in staged["ngram-segments"]]
    needed = {r["doc_id"] for r in staged["ngram-needed"][0].collect()}
    assert len(parts) == rule.passes and all(parts) and sum(map(len, parts)) == len(set().union(*parts))
    assert set().union(*parts) == needed


def test_hashing_a_batch_takes_little_memory():
    """Two workers share an executor's memory with its heap: temporaries follow the block, not the batch."""
    text = " ".join(f"word{i % 977}" for i in range(400))
    texts = pa.array([text] * 4000)
    list(words.word_blocks(texts.slice(0, 10)))
    tracemalloc.start()
    for _ in words.word_blocks(texts):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20
