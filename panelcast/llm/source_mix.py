"""Mixing sources to target weights by pivotal dependent rounding.

Sources get target sizes in proportion to their weights, none above twice its own size (the
excess is shared again by weight). Every row of a source then has the same fractional number of
copies. Its whole part is certain; the rest is a copy probability that pairs of rows settle: one
gives mass to the other, at random but with unchanged expectations and an unchanged expected
size, until one of the two is integral. What is left of each pairing goes on.

Rows are dealt over chunks by a hash of all their values, each chunk settles its rows in one
streaming pass and leaves at most one open row, and the open rows go through further rounds of
chunks until a source has one, which a last draw settles. So a source's taken size is within two
of its row sizes of its target, and a source with a large part of all rows is spread over tasks.

Draws are hashes of the seed and the rows' own order, so reruns agree. Rows of size 0 get the
whole part only. A null text has size 0; null is a source of its
own, last in order. Repeated rows are separate rows. An empty table stays empty. Columns named
``size``, ``source_size``, ``target`` or ``copies`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.words import mix as scramble
from panelcast.session import stage

#: Mean rows per chunk in the first round, and open rows per chunk in later ones.
CHUNK_ROWS = 4096

#: Sources whose plan (six numbers and a name each) is broadcast, and parts of a source beyond that.
MOST_BROADCAST, SALTS = 10_000, 32

_OPEN = -1


def word_count(text: str) -> F.Column:
    """Maximal runs of characters outside space and \\x09-\\x0D."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Add ``target`` to one row per source (``src``, ``source_size``).

    With sources sorted by their size per weight, those up to some place are full (``most``
    times their size) and the others share the rest by weight; the right place is the first whose
    next source isn't full. All windows run over one row per source.
    """
    w_all = Window.partitionBy(F.lit(1))
    by_name = w_all.orderBy(F.col("src").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    place = (F.row_number().over(by_name) - 1) % len(weights)
    with_weight = sizes.withColumn("w", F.element_at(cycle, (place + 1).cast("int")))
    limit = F.col("source_size") * F.lit(float(most))
    ranked = with_weight.withColumn("per_weight", limit / F.col("w"))
    by_fill = w_all.orderBy("per_weight", F.col("src").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(w_all) * F.lit(float(share))
    left = total - F.coalesce(F.sum(limit).over(before), F.lit(0.0))
    weight_left = F.sum("w").over(w_all) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    level = F.greatest(left, F.lit(0.0)) / weight_left
    # The level at the first source that it doesn't fill holds for all sources after it.
    marked = ranked.withColumn("level", level).withColumn("open", F.col("per_weight") > F.col("level"))
    final = F.min(F.when(F.col("open"), F.struct("per_weight", "src", "level"))).over(w_all)["level"]
    filled = F.least(limit, F.coalesce(final * F.col("w"), limit))
    return marked.withColumn("target", filled).select("src", "source_size", "target")


def _uniform(order: np.ndarray, seed: int) -> np.ndarray:
    """Numbers in [0, 1) from the rows' order values."""
    mixed = scramble(order.view(np.uint64) ^ scramble(np.array([seed], np.uint64)))
    return (mixed >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def _integral(p: float) -> bool:
    return p <= 1e-12 or p >= 1.0 - 1e-12


def _settle(batches: Iterator[pa.RecordBatch], keys: Sequence[str], seed: int) -> Iterator[pa.RecordBatch]:
    """Settle the rows of each run of equal keys; ``picked`` becomes 0, 1 or, for the row still
    open at the end of its run, -1 with its chance.

    The open row is held back as a batch of one row while later rows are paired with it.
    """
    held: pa.RecordBatch | None = None
    key, p, s = None, 0.0, 0.0

    def with_result(batch: pa.RecordBatch, picked: np.ndarray, chance: np.ndarray) -> pa.RecordBatch:
        for name, values in (("picked", pa.array(picked, pa.int32())), ("chance", pa.array(chance))):
            batch = batch.set_column(batch.schema.get_field_index(name), name, values)
        return batch

    def one(batch: pa.RecordBatch, picked: int, chance: float) -> pa.RecordBatch:
        return with_result(batch, np.array([picked]), np.array([chance]))

    for batch in batches:
        runs = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        chance = batch.column("chance").to_numpy().copy()
        size = batch.column("size").to_numpy().astype(np.float64)
        draws = _uniform(batch.column("row_order").to_numpy(), seed)
        picked = np.zeros(len(runs), np.int32)
        at = -1  # the open row, if it is in this batch
        for i, run in enumerate(runs):
            if run != key:
                if held is not None:
                    yield one(held, _OPEN, p)
                elif at >= 0:
                    picked[at], chance[at] = _OPEN, p
                held, at, key = None, -1, run
            q, t = chance[i], size[i]
            if t <= 0.0 or _integral(q):
                picked[i] = int(q > 0.5 and t > 0.0)
                continue
            if held is None and at < 0:
                at, p, s = i, q, t
                continue
            up, down = min((1.0 - p) * s, q * t), min(p * s, (1.0 - q) * t)
            if draws[i] * (up + down) < down:
                p, q = p + up / s, q - up / t
            else:
                p, q = p - down / s, q + down / t
            if _integral(p):
                if held is not None:
                    yield one(held, int(p > 0.5), 0.0)
                else:
                    picked[at] = int(p > 0.5)
                held, at = None, -1
                if not _integral(q):
                    at, p, s = i, q, t
                    continue
            picked[i] = int(q > 0.5)
        if at >= 0:
            rest = np.arange(len(runs)) != at
            held = batch.slice(at, 1)
            batch, picked, chance = batch.filter(pa.array(rest)), picked[rest], chance[rest]
        if batch.num_rows:
            yield with_result(batch, picked, chance)
    if held is not None:
        yield one(held, _OPEN, p)


def _round(rows: DataFrame, keys: Sequence[str], seed: int) -> DataFrame:
    placed = rows.repartition(*keys).sortWithinPartitions(*keys, "row_order")
    return placed.mapInArrow(lambda it: _settle(it, keys, seed), rows.schema)


def _planned(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Give every row its source's plan. Few sources are broadcast; many are joined in parts, so that
    a source with a large part of all rows is spread over tasks."""
    same = F.col("src").eqNullSafe(F.col("name"))
    if plan.count() <= MOST_BROADCAST:
        return rows.join(F.broadcast(plan), same).drop("name")
    parts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part")
    dealt = rows.withColumn("salt", F.pmod("row_order", F.lit(SALTS)).cast("int"))
    return dealt.join(plan.select("*", parts), same & (F.col("salt") == F.col("part"))).drop("name", "salt", "part")


def mix(
    df: DataFrame,
    source: str = "source",
    text: str | None = "text",
    weights: Sequence[float] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 7,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """``columns`` of the input (default: all) with ``size``, ``source_size``, ``target`` and
    ``copies``. With ``text`` None, the input's own ``size`` column is taken."""
    kept = [c for c in (columns or df.columns) if c not in ("size", "source_size", "target", "copies")]
    size = word_count(text) if text else F.col("size").cast("long")
    rows = df.select(
        F.struct(*kept).alias("kept"), F.col(source).alias("src"), F.xxhash64(*kept).alias("row_order"), size.alias("size")
    )
    if text and text not in kept:
        rows = stage(rows, "mix-sizes")  # the texts are read once
    per_source = rows.groupBy("src").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    goals = targets(per_source.drop("n_rows"), weights, share, most)
    both = per_source.withColumnRenamed("src", "name").drop("source_size").join(
        goals, F.col("name").eqNullSafe(F.col("src"))
    )
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    near = F.round(ratio)
    ratio = F.when(F.abs(ratio - near) < 1e-12, near).otherwise(ratio)
    plan = both.select(
        "name",
        "source_size",
        "target",
        F.floor(ratio).cast("int").alias("whole"),
        (ratio - F.floor(ratio)).alias("chance"),
        F.ceil(F.col("n_rows") / CHUNK_ROWS).alias("chunks"),
    )
    keyed = _planned(rows, stage(plan, "mix-plan"))
    keyed = keyed.withColumn("chunk", F.pmod(F.xxhash64("row_order", F.lit(seed)), F.col("chunks")))
    keyed = keyed.drop("chunks").withColumn("picked", F.lit(_OPEN))
    first = stage(_round(keyed, ["src", "chunk"], seed), "mix-rows")

    settled, step = [], 0
    open_rows = first.where(F.col("picked") == _OPEN)
    open_rows = open_rows.select("src", "chunk", "chance", "size", "row_order", F.col("chunk").alias("group"), "picked")
    while True:
        step += 1
        most_open = open_rows.groupBy("src").count().agg(F.max("count")).first()[0] or 0
        if most_open <= 1:
            draw = F.pmod(F.xxhash64("row_order", F.lit(seed + step)), F.lit(1 << 30)) / F.lit(float(1 << 30))
            settled.append(open_rows.select("src", "chunk", (draw < F.col("chance")).cast("int").alias("drawn")))
            break
        grouped = open_rows.withColumn("group", F.floor(F.col("group") / CHUNK_ROWS).cast("long"))
        done = stage(_round(grouped, ["src", "group"], seed + step), "mix-open")
        settled.append(done.where(F.col("picked") != _OPEN).select("src", "chunk", F.col("picked").alias("drawn")))
        open_rows = done.where(F.col("picked") == _OPEN)
    drawn = settled[0]
    for more in settled[1:]:
        drawn = drawn.unionByName(more)
    drawn = drawn.select(F.col("src").alias("src2"), F.col("chunk").alias("chunk2"), "drawn")
    late = first.where(F.col("picked") == _OPEN).join(
        drawn, F.col("src").eqNullSafe(F.col("src2")) & (F.col("chunk") == F.col("chunk2"))
    )
    result = ["size", "source_size", "target"]
    early = first.where(F.col("picked") != _OPEN).select(
        "kept.*", *result, (F.col("whole") + F.col("picked")).alias("copies")
    )
    return early.unionByName(late.select("kept.*", *result, (F.col("whole") + F.col("drawn")).alias("copies")))


def repeat(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each row as often as its copies say."""
    times = F.explode(F.array_repeat(F.lit(0), F.col("copies")))
    return mixed.select(*columns, times.alias("copy")).drop("copy")
