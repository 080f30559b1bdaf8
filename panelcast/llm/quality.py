"""Quality rules: fixed statistics, and robust multivariate outliers per language and source.

All of it is built-in column expressions and aggregates. The statistics of a text come from one
scan. A minimum-covariance-determinant estimate is then fitted per group: starting from the
coordinate medians, each concentration step keeps the ``HALF`` of a group with the smallest
Mahalanobis distances and takes their mean and covariance. Steps are one aggregation with
map-side sums each, so a group of any size costs no more than its rows; only one row per group is
joined back. The share kept is cut at a bin of the distance's logarithm, the same for all sizes.
Steps go on, each lowering the covariance's determinant, until no group has one left.

Statistics that are zero in most of a group's rows (symbols, repeats) make the covariance singular.
Each variance therefore gets the square of ``FLOORS`` added: far below the spread of the numbers of
words and characters, and about what one symbol or repeated line does to a text of common length.

Every estimate is also given ``PRIOR`` rows of its language's, and that as many of all rows', so an
estimate of few rows leans on its language and one of many rows hardly does; there is no size at
which it changes. A null language or source is a group value of its own.
A null or empty text has zero words and fails the fixed rule; failed rows are not used in the
fit. Repeated rows get equal verdicts. An empty table gives an empty result. Output columns that
clash with input columns replace them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.session import stage

_GAP = r"[\x20\x09-\x0D]+"
WINDOW = 8
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: The transformed statistics, and spreads below which a covariance counts as singular.
FLOORS = {"x_words": 0.1, "x_length": 0.05, "x_symbols": 0.02, "x_lines": 0.08, "x_repeats": 0.05}
DIM = len(FLOORS)
HALF = 0.75
#: A step that lowers the logarithm of a determinant's root by no more than this is none, and a group
#: without one keeps its estimate. Steps end when no group has one; a few suffice.
TOLERANCE, MOST_STEPS = 1e-3, 30
PRIOR = 20.0
# Fixed values for five dimensions: the consistency factors of covariances over the inner 75 %
# and 97.5 % of a normal sample, the 97.5 % quantile, and the quantile at 1 - 1e-7.
FACTOR_HALF, FACTOR_MOST = 1.41, 1.06
INNER, CUTOFF = 12.83, 41.0

_BINS_PER_E = 32
#: Parts that the rows of one group are spread over when a row per group is joined to them.
SALTS = 32


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside windows of eight words that occur twice or more in the text."""

    def covered(places: Column) -> Column:
        def add(total: Column, i: Column) -> Column:
            following = F.coalesce(F.get(places, i + 1), F.lit(2**31 - 1))
            return total + F.least(F.lit(WINDOW), following - F.get(places, i))

        return F.aggregate(F.sequence(F.lit(0), F.size(places) - 1), F.lit(0), add)

    def repeated(ordered: Column) -> Column:
        def twice(i: Column) -> Column:
            own = F.get(ordered, i)["h"]
            before, after = F.get(ordered, i - 1)["h"], F.get(ordered, i + 1)["h"]
            return F.coalesce(own == before, F.lit(False)) | F.coalesce(own == after, F.lit(False))

        hits = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), twice)
        return let(F.array_sort(F.transform(hits, lambda i: F.get(ordered, i)["i"])), covered)

    def over_windows(windows: Column) -> Column:
        numbered = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        some = F.size(F.array_distinct(windows)) < F.size(windows)
        return F.when(some, let(F.array_sort(numbered), repeated)).otherwise(0)

    def over_hashes(hashes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(hashes) - WINDOW)
        windows = F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))
        return let(windows, over_windows)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) > WINDOW, let(hashes, over_hashes)).otherwise(0).cast("long")


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the five statistics and ``base_failed``."""
    whole = F.coalesce(F.col(text), F.lit(""))

    def over_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            _repeat_words(words).alias("n_repeat_words"),
        )

    lines = F.filter(F.split(whole, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    found = df.withColumn("found", let(F.array_remove(F.split(whole, _GAP, -1), ""), over_words))
    made = {
        "n_words": F.col("found.n_words"),
        "word_chars": F.col("found.word_chars"),
        "n_symbols": F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": F.col("found.n_repeat_words"),
    }
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return found.withColumns(made).drop("found").withColumn("base_failed", failed)


def _vector() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "x_words": F.log1p("n_words"),
        "x_length": F.col("word_chars") / words,
        "x_symbols": F.log1p(F.col("n_symbols") / words),
        "x_lines": F.log1p(F.col("n_dup_lines")) / F.lit(4.0),
        "x_repeats": F.col("n_repeat_words") / words,
    }


def _whitener(moments: DataFrame, factor: float) -> DataFrame:
    """Per group, the mean and the inverse Cholesky factor of the covariance with the floors."""
    names = list(FLOORS)
    means = {f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(DIM)}
    out = moments.withColumns(means)
    covariances = {}
    for i, name in enumerate(names):
        for j in range(i + 1):
            spread = (F.col(f"q{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) * factor
            covariances[f"c{i}{j}"] = F.greatest(spread, F.lit(0.0)) + FLOORS[name] ** 2 if i == j else spread
    out = out.withColumns(covariances)
    for j in range(DIM):
        done = [F.col(f"l{j}{k}") * F.col(f"l{j}{k}") for k in range(j)]
        left = sum(done, F.lit(0.0))
        out = out.withColumn(f"l{j}{j}", F.sqrt(F.greatest(F.col(f"c{j}{j}") - left, F.lit(FLOORS[names[j]] ** 2 / 4))))
        below = {}
        for i in range(j + 1, DIM):
            shared = sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            below[f"l{i}{j}"] = (F.col(f"c{i}{j}") - shared) / F.col(f"l{j}{j}")
        out = out.withColumns(below) if below else out
    for i in range(DIM):
        row = {f"w{i}{i}": 1.0 / F.col(f"l{i}{i}")}
        for j in range(i):
            inner = sum((F.col(f"l{i}{k}") * F.col(f"w{k}{j}") for k in range(j, i)), F.lit(0.0))
            row[f"w{i}{j}"] = -inner / F.col(f"l{i}{i}")
        out = out.withColumns(row)
    means_out = F.array(*[F.col(f"m{i}") for i in range(DIM)])
    rows = F.array(*[F.col(f"w{i}{j}") for i in range(DIM) for j in range(i + 1)])
    return out.select("grp", means_out.alias("mean"), rows.alias("whiten"))


def _distance() -> Column:
    """The squared Mahalanobis distance of a row from its group's estimate."""
    total, at = F.lit(0.0), 0
    centred = [F.col(f"v.{name}") - F.col("mean")[i] for i, name in enumerate(FLOORS)]
    for i in range(DIM):
        z = sum((F.col("whiten")[at + j] * centred[j] for j in range(i + 1)), F.lit(0.0))
        total, at = total + z * z, at + i + 1
    return total


def _joined(rows: DataFrame, few: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join one row per key to ``rows``. It is repeated for every ``salt``, so that without a
    broadcast a key of a third of all rows still spreads over ``SALTS`` tasks."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return rows.join(few.withColumn("salt", salts), [key, "salt"], how)


def _moments(rows: DataFrame) -> DataFrame:
    x = [F.col(f"v.{name}") for name in FLOORS]
    sums = [F.sum(x[i]).alias(f"s{i}") for i in range(DIM)]
    products = [F.sum(x[i] * x[j]).alias(f"q{i}{j}") for i in range(DIM) for j in range(i + 1)]
    return rows.groupBy("grp", "lang_key").agg(F.count("*").cast("double").alias("n"), *sums, *products)


def _shrunk(moments: DataFrame) -> DataFrame:
    """The moments with ``PRIOR`` mean rows of the language's added, which had as many of all rows'.
    The windows run over one row per group."""
    names = [c for c in moments.columns if c not in ("grp", "lang_key")]
    language, every = Window.partitionBy("lang_key"), Window.partitionBy(F.lit(1))
    totals = {c: (F.sum(c).over(language), F.sum(c).over(every)) for c in names}
    n_language, n_every = totals["n"]
    out = [
        (F.col(c) + PRIOR * (own + PRIOR * whole / n_every) / (n_language + PRIOR)).alias(c)
        for c, (own, whole) in totals.items()
    ]
    return moments.select("grp", *out)


def _nearest(rows: DataFrame, estimate: DataFrame, share: float) -> DataFrame:
    """The rows of each group whose distances are in the bins that hold the smallest ``share``."""
    far = _joined(rows, estimate, "grp").withColumn("bin", F.floor(F.log(_distance() + 1e-12) * _BINS_PER_E))
    counts = far.groupBy("grp", "bin").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("grp").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(upto), F.lit(0))
    total = F.sum("n").over(Window.partitionBy("grp"))
    inside = counts.select("grp", "bin", (before < share * total).alias("inside")).where("inside")
    last = inside.groupBy("grp").agg(F.max("bin").alias("last"))
    return _joined(far.drop("mean", "whiten"), last, "grp").where(F.col("bin") <= F.col("last"))


def _start(rows: DataFrame) -> DataFrame:
    """Coordinate medians, and absolute deviations from them, as a first diagonal estimate."""
    names = list(FLOORS)
    middle = rows.groupBy("grp").agg(*[F.percentile_approx(f"v.{n}", 0.5).alias(n) for n in names])
    middle = middle.select("grp", F.array(*names).alias("mean"))
    apart = [F.abs(F.col(f"v.{n}") - F.col("mean")[i]) for i, n in enumerate(names)]
    spread = _joined(rows, middle, "grp").groupBy("grp", "mean")
    spread = spread.agg(*[F.percentile_approx(a, 0.5).alias(n) for a, n in zip(apart, names, strict=True)])
    scale = {n: 1.0 / F.sqrt((1.4826 * F.col(n)) ** 2 + FLOORS[n] ** 2) for n in names}
    whiten = [scale[names[i]] if i == j else F.lit(0.0) for i in range(DIM) for j in range(i + 1)]
    return spread.select("grp", "mean", F.array(*whiten).alias("whiten"))


def _tighter(last: DataFrame, new: DataFrame, first: bool) -> DataFrame:
    """Per group the new estimate, with ``better``, if its determinant is smaller by ``TOLERANCE``; else
    the last one, which then stays. One row per group."""
    own = F.lit(0.0)
    for i in range(DIM):
        own = own + F.log(F.col("whiten")[i * (i + 1) // 2 + i])
    named = [F.col(c).alias(f"old_{c}") for c in ("mean", "whiten", "tight")] if not first else []
    scored = new.withColumn("tight", own)
    if first:
        return scored.withColumn("better", F.lit(True))
    both = scored.join(last.select("grp", *named), "grp")
    better = F.col("tight") > F.col("old_tight") + TOLERANCE
    kept = [F.when(better, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in ("mean", "whiten", "tight")]
    return both.select("grp", *kept, better.alias("better"))


def estimates(rows: DataFrame) -> DataFrame:
    """One row per group (``grp``, in ``lang_key``) of vectors (``v``, ``salt``): mean and whitening matrix."""
    estimate = stage(_start(rows), "mcd")
    for step in range(MOST_STEPS):
        closest = _nearest(rows, estimate.select("grp", "mean", "whiten"), HALF)
        new = _whitener(_shrunk(_moments(closest)), 1.0)
        estimate = stage(_tighter(estimate, new, step == 0), "mcd")
        if estimate.where("better").isEmpty():
            break
    core = _nearest(rows, estimate.select("grp", "mean", "whiten"), HALF)
    estimate = stage(_whitener(_shrunk(_moments(core)), FACTOR_HALF), "mcd")
    most = _joined(rows, estimate, "grp").where(_distance() <= INNER)
    return stage(_whitener(_shrunk(_moments(most)), FACTOR_MOST), "mcd")


def _groups(rows: DataFrame, lang: str, source: str) -> DataFrame:
    """Add the group of language and source, ``grp``, and the language's, ``lang_key``."""
    return rows.withColumns({"grp": F.to_json(F.struct(lang, source)), "lang_key": F.to_json(F.struct(lang))})


def judge(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep: list[str] | None = None) -> DataFrame:
    """``keep`` of the input's columns (default: all) with the statistics, ``base_failed`` and
    ``kept``: false for failed rows and for outliers of their group."""
    made = (*STATISTICS, "base_failed", "kept")
    kept = [c for c in (keep or df.columns) if c not in made]
    found = statistics(df.select(F.struct(*kept).alias("row"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text")))
    vector = F.struct(*[c.alias(n) for n, c in _vector().items()])
    salt = (F.monotonically_increasing_id() % SALTS).cast("int")
    slim = found.select("row", "lang", "source", *STATISTICS, "base_failed", vector.alias("v"), salt.alias("salt"))
    rows = stage(slim, "quality")
    grouped = _groups(rows, "lang", "source")
    fitted = estimates(grouped.where(~F.col("base_failed")).select("grp", "lang_key", "v", "salt"))
    judged = _joined(grouped, fitted, "grp", "left")
    near = F.coalesce(_distance() <= CUTOFF, F.lit(True))
    return judged.select("row.*", *STATISTICS, "base_failed", (~F.col("base_failed") & near).alias("kept"))
