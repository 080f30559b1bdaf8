import hashlib
import random
import zlib

import numpy as np
import pytest

from panelcast.llm import periodic_runs, queries_runs, words

SF = "/root/testdata/sf0.001"


def brute_force(w, min_length=24, min_exponent=3):
    """All runs by comparing the words of every distance."""
    found = {}
    for q in range(1, len(w) // min_exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and (i, j + q) not in found and j + q - i >= 2 * q:
                found[i, j + q] = q
            i = max(j, i + 1) if j == i else j + 1
    return sorted(
        (s, e - s, q) for (s, e), q in found.items() if e - s >= max(min_length, min_exponent * q)
    )


def collapse(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def corpus():
    draw = random.Random(11)
    texts = [fibonacci(400), ["a"] * 300, ["a", "b"] * 12, ["a", "b"] * 11 + ["a"], list("aab" * 8 + "aac" * 9), ["x"]]
    nested = (list("aaaaaaaaab" * 4) + ["c"]) * 5
    texts += [nested, nested[7:] + nested[:90] * 2, list("ab" * 30 + "ba" * 30), list("abcabcab" * 20)]
    for _ in range(60):
        w = [draw.choice("abc"[: draw.randrange(1, 4)]) for _ in range(draw.randrange(0, 120))]
        for _ in range(draw.randrange(3)):
            at, p = draw.randrange(len(w) + 1), draw.randrange(1, 40)
            unit = [draw.choice("abAB") for _ in range(p)]
            w[at:at] = (unit * 9)[: draw.randrange(p, 6 * p + 1)]
        texts.append(w)
    return texts


@pytest.mark.parametrize(("least", "times"), [(24, 3), (5, 2), (7, 4), (1, 2)])
def test_runs_equal_brute_force(least, times):
    texts = corpus()
    hashes, bounds = [], [0]
    table = {}
    for w in texts:
        hashes += [table.setdefault(x, len(table) + 1) for x in w]
        bounds.append(len(hashes))
    got = periodic_runs.find_runs(words.mix(np.array(hashes, np.uint64)), np.array(bounds), least, times)
    by_doc = [[] for _ in texts]
    for d, *run in zip(*(c.tolist() for c in got), strict=True):
        by_doc[d].append(tuple(run))
    assert by_doc == [brute_force(w, least, times) for w in texts]
    assert sum(map(len, by_doc)) > 40


def test_detect_rows(spark, monkeypatch):
    monkeypatch.setattr(words, "BLOCK", 512)
    draw = random.Random(2)
    texts = [draw.choice([" ", "\n", " \t"]).join(w) for w in corpus()] + [None, "", " \n ", "é È é È " * 9, "Aa aa " * 15]
    texts.append("lead " * 3 + " ".join(f"w{i % 700}" for i in range(30_000)) + " tail")
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] * 2, "id long, text string, runs string, kept int")
    out = periodic_runs.detect(df).collect()
    assert len(out) == 2 * len(texts) and out[0].asDict().keys() == {"id", "text", "kept", "runs", "collapsed"}
    for r in out:
        w = (texts[r["id"]] or "").encode().split()
        w = [x.decode() for x in w]
        runs = [tuple(x) for x in r["runs"]]
        if len(w) < 1000:
            assert runs == brute_force(w)
        else:
            assert runs == [(3, 30_000, 700)]
        assert r["collapsed"] == collapse(w, runs)
    assert periodic_runs.detect(df.limit(0)).count() == 0


def test_query_digests(spark):
    out = {r["doc_id"]: r for r in queries_runs.op12_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(out) == len(docs)
    with_runs = 0
    for doc in docs:
        w = [x.decode() for x in (doc["text"] or "").encode().split()]
        h = zlib.crc32(str(doc["doc_id"]).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        r = out[doc["doc_id"]]
        if len(w) > 1500:
            continue
        runs = brute_force(w)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
        with_runs += bool(runs)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        digest = hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        assert r["runs_sha256"] == digest
        assert r["collapsed_sha256"] == hashlib.sha256(collapse(w, runs).encode()).hexdigest()
    assert with_runs > 5
