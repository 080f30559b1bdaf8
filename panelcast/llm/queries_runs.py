"""The query on periodic runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import periodic_runs
from panelcast.llm.tables import table


def periodic_tail(doc_id: Column, text: Column) -> Column:
    """The text, in a tenth of the documents with all words from some place on repeated from there
    with some period; a document without an id stays."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        a = g % F.size(words)
        p = F.floor((F.size(words) - a) / (g % 8 + 3)) + 1
        moved = F.transform(words, lambda w, i: F.when(i >= a, F.get(words, (a + (i - a) % p).cast("int"))).otherwise(w))
        return F.array_join(moved, " ")

    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    # The array of one binds the words, so that they are not found again for every word.
    changed = F.transform(F.array(words), lambda ws: F.when(F.size(ws) > 0, repeated(ws)).otherwise(""))[0]
    return F.when(h % 10 == 0, changed).otherwise(text)


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, greatest exponent and digest of every document's runs, and a digest without them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.select("doc_id", periodic_tail(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs.detect(docs, keep=["doc_id"])
    runs = F.col("runs")
    more = lambda r, best: r["length"] * best["period"] > best["length"] * r["period"]
    best = F.aggregate(runs, F.get(runs, 0), lambda b, r: F.when(more(r, b), r).otherwise(b))
    line = F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    rows = found.select("doc_id", "runs", "collapsed", best.alias("best"), line.alias("line"))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("line", lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
