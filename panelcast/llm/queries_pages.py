"""The queries on pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import html_cut, url_rules
from panelcast.llm.tables import table


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html_cut.extract(pages, html_cut.train(pages)).select("page_id", "url", "text")
    return found.withColumn("n_chars", F.length("text").cast("long"))


# The rules of the contract.
URL_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


def labelled_urls(pages: DataFrame) -> DataFrame:
    """``url``, ``bad`` and whether the URL is ``held_out``, by its hash."""
    fixed = url_rules.fixed_rule(url_rules.host(F.col("url")), url_rules.path(F.col("url")), URL_RULES)
    bad = F.coalesce(fixed["verdict"] == "block", F.lit(False))
    return pages.where("url IS NOT NULL").select("url", bad.alias("bad"), (F.pmod(F.xxhash64("url"), F.lit(5)) == 0).alias("held_out"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL. The labels of URLs are the fixed rules' own verdicts (bad if
    one blocks): rules are mined from four fifths of the URLs and decide where no fixed one fits."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = url_rules.mine(labelled_urls(pages).where("NOT held_out"))
    return url_rules.judge(pages, rules, URL_RULES).select("page_id", "host", "path", "rule", "verdict")
