from collections import defaultdict

import pytest

from panelcast.llm import source_mix


def water_fill(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, left, free = {}, share * sum(sizes.values()), set(names)
    while free:
        level = left / sum(w[s] for s in free)
        full = [s for s in free if level * w[s] > most * sizes[s]]
        if not full:
            return out | {s: level * w[s] for s in free}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


@pytest.mark.parametrize(("chunk", "few"), [(4096, 100), (7, 100), (7, 2)])
def test_mix_meets_targets(spark, monkeypatch, chunk, few):
    monkeypatch.setattr(source_mix, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(source_mix, "MOST_BROADCAST", few)
    names = ["a", "b", "c", "d", None, "É", "Z"]
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 23)), names[i * i % 7] if i % 3 else "a", i) for i in range(400)]
    rows += [(400, None, "b", 1), (401, "", "b", 1), (402, " \n", None, 1), (5, rows[5][1], rows[5][2], 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    out = source_mix.mix(df, columns=["doc_id", "source"]).collect()
    again = source_mix.mix(df.repartition(3), columns=["doc_id", "source"]).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again)) and len(out) == len(rows)
    sizes, taken, targets = defaultdict(int), defaultdict(int), {}
    for r in out:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        targets[r["source"]] = r["target"]
        assert 0 <= r["copies"] <= 2
    assert all(r["source_size"] == sizes[r["source"]] for r in out)
    want = water_fill(sizes)
    for s in sizes:
        assert targets[s] == pytest.approx(want[s])
        assert abs(taken[s] - targets[s]) <= 23


def test_mix_of_nothing_and_repeats(spark):
    schema = "doc_id long, text string, source string"
    assert source_mix.mix(spark.createDataFrame([], schema)).count() == 0
    only_empty = source_mix.mix(spark.createDataFrame([(1, None, None), (2, "", None)], schema)).collect()
    assert [r["size"] * r["copies"] for r in only_empty] == [0, 0]
    df = spark.createDataFrame([(i, "a b c", "s") for i in range(10)], schema)
    mixed = source_mix.mix(df)
    assert mixed.columns == ["doc_id", "text", "source", "size", "source_size", "target", "copies"]
    assert source_mix.repeat(mixed, ["doc_id"]).count() == 15
