import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    places = defaultdict(list)
    for i in range(len(w) - 7):
        places[tuple(w[i : i + 8])].append(i)
    covered = {j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "a b c d e f g h " * 2,
    "a b c d e f g h a",
    "x " * 40,
    "é 𝒳 # * $ % & | < > \n\n q \n q \n q",
    " lead" + " w" * 9 + " mid " + "w " * 9 + "\x0b tail\x0c",
    "\n".join(["same line of words here"] * 5 + ["", " ", "other"]),
    " ".join(f"w{i}" for i in range(3000)) + " " + " ".join(f"w{i}" for i in range(1000, 1100)),
]


def test_statistics_equal_a_plain_count(spark):
    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate(TEXTS)], "doc_id int, text string, n_words int")
    for r in quality.statistics(df).collect():
        want = plain(TEXTS[r["doc_id"]])
        assert tuple(r[c] for c in quality.STATISTICS) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])


def test_whitening_equals_numpy(spark):
    x = np.random.default_rng(3).normal(size=(300, quality.DIM)) @ np.diag([1, 2, 0.1, 0, 3])
    v = F.struct(*[F.col("x")[i].alias(n) for i, n in enumerate(quality.FLOORS)])
    rows = spark.createDataFrame([("g", "l", r.tolist()) for r in x], "grp string, lang_key string, x array<double>")
    rows = rows.select("grp", "lang_key", v.alias("v"))
    fitted = quality._whitener(quality._moments(rows), 1.3)
    got = sorted(r[0] for r in rows.join(fitted, "grp").select(quality._distance()).collect())
    cov = np.cov(x.T, bias=True) * 1.3 + np.diag(np.square(list(quality.FLOORS.values())))
    z = x - x.mean(axis=0)
    assert got == pytest.approx(sorted(np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z)))


def test_outliers_go_and_clean_documents_stay(spark):
    draw = np.random.default_rng(4)

    def text(n):
        return " ".join("abcdefghij"[: draw.integers(3, 8)] + str(i) for i in range(n))

    rows = [(i, text(int(draw.integers(30, 300))), "en", "s" if i % 3 else "t") for i in range(240)]
    rows += [(1000 + i, " ".join(f"w{j}***" for j in range(60)), "en", "s") for i in range(12)]
    rows += [(2000, None, None, None), (2001, text(50), None, None), (2002, text(50), "fr", None), (0, *rows[0][1:])]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string, source string").withColumn("kept", F.lit(1))
    out = quality.judge(df)
    found = out.collect()
    assert len(found) == len(rows)
    for r in found:
        assert r["kept"] == (r["doc_id"] < 1000 or r["doc_id"] in (2001, 2002)), r
    assert quality.judge(df.limit(0)).count() == 0


def _plain_estimate(groups, languages):
    """Minimum-covariance-determinant estimates by numpy, with the same bins and priors."""
    floors = np.array(list(quality.FLOORS.values()))
    names = list(groups)

    def distances(x, estimate):
        mean, cov = estimate
        return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)

    def nearest(x, estimate):
        bins = np.floor(np.log(distances(x, estimate) + 1e-12) * 32)
        levels, counts = np.unique(bins, return_counts=True)
        before = np.cumsum(counts) - counts
        return x[bins <= levels[before < quality.HALF * len(x)].max()]

    def shrunk(chosen, factor):
        def sums(x):
            return np.array([len(x)], float), x.sum(axis=0), x.T @ x

        own = {g: sums(x) for g, x in chosen.items()}
        every = [sum(parts) for parts in zip(*own.values(), strict=True)]
        out = {}
        for g in names:
            lang = [sum(parts) for parts in zip(*(own[h] for h in names if languages[h] == languages[g]), strict=True)]
            k = quality.PRIOR
            prior = [(a + k * b / every[0]) / (lang[0] + k) for a, b in zip(lang, every, strict=True)]
            n, s, q = (a + k * p for a, p in zip(own[g], prior, strict=True))
            mean = s / n
            out[g] = mean, (q / n - np.outer(mean, mean)) * factor + np.diag(floors**2)
        return out

    def size(fitted):
        return np.linalg.slogdet(fitted[1])[1] / 2

    estimate = {}
    for g, x in groups.items():
        middle = np.median(x, axis=0)
        spread = 1.4826 * np.median(np.abs(x - middle), axis=0)
        estimate[g] = middle, np.diag(spread**2 + floors**2)
    for step in range(quality.MOST_STEPS):
        new = shrunk({g: nearest(x, estimate[g]) for g, x in groups.items()}, 1.0)
        better = [g for g in names if step == 0 or size(new[g]) < size(estimate[g]) - quality.TOLERANCE]
        estimate = {g: new[g] if g in better else estimate[g] for g in names}
        if not better:
            break
    chosen = {g: nearest(x, estimate[g]) for g, x in groups.items()}
    estimate = shrunk(chosen, quality.FACTOR_HALF)
    inner = {g: x[distances(x, estimate[g]) <= quality.INNER] for g, x in groups.items()}
    estimate = shrunk(inner, quality.FACTOR_MOST)
    return {g: distances(x, estimate[g]) for g, x in groups.items()}


def test_estimates_equal_a_plain_loop(spark):
    draw = np.random.default_rng(9)
    scale = np.array([0.9, 0.6, 0.0, 0.05, 0.02])
    turn = np.linalg.qr(draw.normal(size=(5, 5)))[0] * 0.2 + np.eye(5)
    groups = {
        "a": draw.normal(size=(401, 5)) * scale,
        "b": draw.normal(size=(301, 5)) * scale @ turn + 2,
        "c": draw.normal(size=(7, 5)) * scale,
        "d": draw.normal(size=(1, 5)) * scale + 9,
    }
    groups["a"][:30] += 6
    languages = {"a": "x", "b": "y", "c": "x", "d": "y"}
    want = _plain_estimate(groups, languages)
    v = F.struct(*[F.col("x")[i].alias(n) for i, n in enumerate(quality.FLOORS)])
    rows = [(g, languages[g], i, i % quality.SALTS, r.tolist()) for g, x in groups.items() for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "grp string, lang_key string, i int, salt int, x array<double>")
    df = df.select("grp", "lang_key", "i", "salt", v.alias("v"))
    got = quality._joined(df, quality.estimates(df.drop("i")), "grp").select("grp", "i", quality._distance().alias("d"))
    for r in got.collect():
        assert r["d"] == pytest.approx(want[r["grp"]][r["i"]], rel=1e-6, abs=1e-6)
    # One vector, judged by two groups' own covariances.
    assert (want["a"] > quality.CUTOFF)[:30].all() and not (want["a"] > quality.CUTOFF)[30:].any()


def test_the_group_decides_about_a_vector(spark):
    draw = np.random.default_rng(2)

    def text(n, letters):
        return " ".join("abcdefghijklmnop"[: int(draw.integers(*letters))] + str(i) for i in range(n))

    even = [(i, text(100, (5, 6)), "en", "even") for i in range(200)]
    mixed = [(1000 + i, text(100, (3 + i % 9, 4 + i % 9)), "en", "mixed") for i in range(200)]
    odd = text(100, (10, 11))
    rows = [*even, *mixed, (5000, odd, "en", "even"), (5001, odd, "en", "mixed")]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(df, keep=["doc_id"]).collect()}
    assert not kept.pop(5000) and kept.pop(5001)
    assert all(kept.values())
