"""URL filters from association rules.

Every URL is a set of tokens (host labels, path words, query names; numbers become ``#``). Spark's
FP-growth mines the token combinations of labelled URLs together with their label. Rules that
predict a bad page are kept if support, confidence and lift reach their bounds, and if no rule
with fewer tokens says the same. A URL is matched through an inverted index: each rule is posted
under its rarest token, and the few rules met there are tested for containment.

All of it is built-in expressions, joins and the JVM's FP-growth. Distinct URLs are matched, so
a URL that fills a third of the rows is matched once; rules are bounded by their support.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from
there up to ``?``, ``#`` or the end. A null URL, or one without ``://``, has neither, and no
tokens, and is allowed. Without labelled rows, or with none that is bad, there are no rules.
Repeated rows get equal verdicts. Input columns named ``host``, ``path``, ``rule`` or ``verdict`` are
replaced; any other name may be in use.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.session import stage

#: Least share and number of labelled URLs with a combination, and least confidence and lift.
MIN_SUPPORT, MIN_COUNT = 0.002, 20
MIN_CONFIDENCE, MIN_LIFT = 0.75, 1.5
BAD = "label:bad"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^?#]*\?([^#]*)", 1)

    def words(part: Column, gap: str, mark: str) -> Column:
        found = F.filter(F.split(part, gap, -1), lambda w: w != "")
        return F.transform(found, lambda w: F.concat(F.lit(mark), F.regexp_replace(w, "[0-9]+", "#")))

    names = F.transform(F.split(query, "&", -1), lambda p: F.substring_index(p, "=", 1))
    parts = [
        words(host(url), r"[.:@]", "host:"),
        words(F.lower(path(url)), r"[/._-]", "path:"),
        F.transform(F.filter(names, lambda n: n != ""), lambda n: F.concat(F.lit("query:"), n)),
    ]
    return F.array_distinct(F.concat(*parts))


def mine(labelled: DataFrame, url: str = "url", bad: str = "bad") -> DataFrame:
    """Rules (``items``, ``confidence``, ``support``, ``post``: the rarest item) for bad URLs."""
    items = F.concat(tokens(F.col(url)), F.when(F.col(bad), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>")))
    rows = labelled.where(F.col(bad).isNotNull()).select(items.alias("items")).where(F.size("items") > 0)
    rows = stage(rows, "url-items")
    total = rows.count()
    empty = rows.limit(0).select("items", F.lit(0.0).alias("confidence"), F.lit(0.0).alias("support"), F.lit("").alias("post"))
    if not total:
        return empty
    share = min(1.0, max(MIN_SUPPORT, MIN_COUNT / total))
    model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=MIN_CONFIDENCE).fit(rows)
    found = model.associationRules.where((F.col("consequent")[0] == BAD) & (F.col("lift") >= MIN_LIFT))
    rules = found.select(F.array_sort("antecedent").alias("items"), "confidence", "support")
    smaller = rules.select(F.col("items").alias("fewer"), F.col("items")[0].alias("item"))
    every = rules.select("items", F.explode("items").alias("item"))
    covered = every.join(smaller, "item").where((F.size("fewer") < F.size("items")) & (F.size(F.array_except("fewer", "items")) == 0))
    rules = rules.join(covered.select("items").distinct(), "items", "left_anti")
    counts = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("item"), "freq")
    rarest = rules.select("items", F.explode("items").alias("item")).join(counts, "item")
    rarest = rarest.groupBy("items").agg(F.min(F.struct("freq", "item"))["item"].alias("post"))
    return stage(rules.join(rarest, "items"), "url-rules")


def matches(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """The distinct URLs that a rule fits, with the highest confidence."""
    distinct = urls.select(F.col(url).alias("url")).where("url IS NOT NULL").distinct()
    listed = distinct.select("url", tokens(F.col("url")).alias("tokens"))
    met = listed.select("url", "tokens", F.explode("tokens").alias("post")).join(rules, "post")
    fits = met.where(F.size(F.array_except("items", "tokens")) == 0)
    return fits.groupBy("url").agg(F.max("confidence").alias("confidence"))


def fixed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest fixed rule (host and path, as ``(verdict, rule)``) that fits, as a struct."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        own = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        chosen = F.when(fits, own).otherwise(chosen)
    return chosen


def judge(pages: DataFrame, rules: DataFrame, fixed: Sequence[tuple[str, str]] = (), url: str = "url") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict``: the fixed rule's, else the mined rules'."""
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rows = pages.select(F.struct(*kept).alias("page"), F.col(url).alias("own_url"))
    joined = rows.join(matches(pages, rules, url), F.col("own_url") == F.col("url"), "left")
    named = joined.select("page", host(F.col("own_url")).alias("h"), path(F.col("own_url")).alias("p"), F.col("url").isNotNull().alias("hit"))
    own = fixed_rule(F.col("h"), F.col("p"), fixed)
    mined = F.when(F.col("hit"), "block").otherwise("allow")
    judged = named.select("page", "h", "p", own["rule"].alias("r"), F.coalesce(own["verdict"], mined).alias("v"))
    return judged.select("page.*", F.col("h").alias("host"), F.col("p").alias("path"), F.col("r").alias("rule"), F.col("v").alias("verdict"))


def precision(labelled: DataFrame, rules: DataFrame, url: str = "url", bad: str = "bad") -> tuple[int, float | None]:
    """The labelled rows that a rule fits, and the share of them that are bad."""
    hit = labelled.select(F.col(url).alias("url"), F.col(bad).alias("bad")).join(matches(labelled, rules, url), "url")
    row = hit.agg(F.count("*").alias("n"), F.avg(F.col("bad").cast("double")).alias("share")).first()
    return row["n"], row["share"]
