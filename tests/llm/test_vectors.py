import math

import numpy as np
import pytest

from panelcast.llm import queries_vectors, whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, n string, kept int"


def matrix(spectrum, seed=1):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(spectrum),) * 2))
    return (q * np.array(spectrum, float)) @ q.T


@pytest.mark.parametrize(
    "spectrum",
    [
        np.geomspace(1e6, 1e-3, 200),
        np.linspace(2, 1, 150),
        [5.0] * 20 + [1.0] * 40,
        [3.0, 2.0] + [0.0] * 60,
        np.concatenate([[1e8] * 3, np.linspace(1.01, 1.0, 97)]),
        [1.0] * 10,
        [0.0] * 30,
        [2.0],
    ],
)
def test_pairs_reach_double_precision(spectrum):
    a = matrix(spectrum)
    values, vectors = whitening.leading_pairs(lambda v: a @ v, len(a), 16)
    want = np.sort(np.linalg.eigvalsh(a))[::-1][:16]
    scale = max(want[0], 1e-300)
    assert np.abs(values - want).max() <= 1e-12 * scale + 1e-300
    assert np.linalg.norm(a @ vectors - vectors * values, axis=0).max() <= 1e-12 * scale + 1e-300
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12


def reference(rows):
    """Rows, fit list and pairs by exact integers and a dense solver."""
    used = {}
    for i, (vec_id, e) in enumerate(rows):
        if e and all(c is not None and math.isfinite(c) for c in e):
            used[i] = tuple(math.floor(64 * float(np.float32(c))) + 1000000 for c in e)
    distinct = np.array(sorted(set(used.values())), dtype=object)
    n, sums = len(distinct), distinct.sum(axis=0)
    y = np.array((n * distinct - sums).tolist(), float) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    return used, n, sums, values[::-1], vectors[:, ::-1]


def compare(out, rows, components=16):
    used, n, sums, values, vectors = reference(rows)
    k = min(components, len(sums))
    assert len(out) == k * len(used)
    want = {}
    for i, x in used.items():
        y = np.array([n * a - s for a, s in zip(x, sums, strict=True)], dtype=object)
        z = (y.astype(float) / n) @ vectors[:, :k] / np.sqrt(values[:k])
        want[rows[i][0]] = (sum(int(v) ** 2 for v in y), z)
    signs = {}
    for r in out:
        deviation, z = want[r["vec_id"]]
        j = r["component"] - 1
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert r["explained"] == pytest.approx(values[j] / values.sum(), rel=1e-9)
        assert r["identity_error"] < 1e-9
        if abs(z[j]) > 1e-3:
            sign = signs.setdefault(j, np.sign(z[j]) * np.sign(r["whitened"]))
            assert r["whitened"] * sign == pytest.approx(z[j], rel=1e-6, abs=1e-8)


def test_query_equals_dense_solver(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    out = queries_vectors.op13_whiten(spark, SF)
    assert out.dtypes == [
        ("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"),
        ("whitened", "double"), ("explained", "double"), ("identity_error", "double"),
    ]
    compare(out.collect(), rows)


def test_odd_rows(spark, tmp_path):
    draw = np.random.default_rng(4)
    rows = [(i, [float(c) for c in draw.standard_normal(5) * [9, 5, 3, 2, 1]]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(900)]  # one vector held by most rows
    rows += [(2000, None), (2001, []), (2002, [1.0, None, 0.0, 0.0, 0.0])]
    rows += [(2003 + i, [1.0, bad, 0.0, 0.0, 0.0]) for i, bad in enumerate((math.nan, math.inf, -math.inf))]
    df = spark.createDataFrame([(i, e, "x", 2) for i, e in rows + [(3000, [1.0, 2.0]), (3001, [1e30] * 5)]], SCHEMA)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    compare(queries_vectors.op13_whiten(spark, str(tmp_path)).collect(), rows)
    white = whitening.whiten(df, whitening.fit(df, components=2))
    assert white.columns == ["vec_id", "embedding", "kept", *whitening.RESULTS]
    assert {len(r["whitened"]) for r in white.collect()} == {2}


def test_no_rows_and_no_spread(spark, tmp_path):
    same = spark.createDataFrame([(i, [1.0, 2.0], "x", 1) for i in range(3)], SCHEMA)
    for name, df in (("none", same.limit(0)), ("same", same), ("null", same.selectExpr("vec_id", "CAST(NULL AS array<float>) embedding"))):
        df.write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        assert queries_vectors.op13_whiten(spark, f"{tmp_path}/{name}").count() == 0
    assert [r["deviation"] for r in whitening.whiten(same, whitening.fit(same)).collect()] == [0, 0, 0]


def test_deviation_beyond_a_long(spark):
    far = [(i, [(-1.0) ** i * 16e6, float(i), 1.0], "x", 1) for i in range(200)]
    df = spark.createDataFrame(far, SCHEMA)
    used, n, sums, _, _ = reference([(i, e) for i, e, _, _ in far])
    for r in whitening.whiten(df, whitening.fit(df)).collect():
        x = used[r["vec_id"]]
        assert int(r["deviation"]) == sum((n * a - int(s)) ** 2 for a, s in zip(x, sums, strict=True))
