"""Whitening of embeddings: leading eigenvectors of their covariance by Jacobi-Davidson.

Entries become integers, ``x = floor(64 * c) + 1000000``, so counts and sums are exact. The fit list
is each distinct vector once. Its covariance matrix is never built: the solver only asks for
products of it with a few vectors at once, and each product is one distributed pass over the fit
list, which centres every vector before it multiplies and adds the parts up in Spark.

The solver keeps an orthonormal search space of at most ``SPACE`` vectors per wanted pair. Each
round takes Ritz pairs of that space, locks the leading ones whose residual has reached double
precision, and extends the space, for all others at once, by the solutions of the correction
equations projected off the locked and the own Ritz vector, found by a few steps of MINRES. It ends
when all wanted pairs are locked and no Ritz value outside is greater than the smallest of them.

The driver holds the sums and the search space (dimension times ``SPACE`` times components), no rows.

Rows whose vector is null or empty, or holds a null, non-finite or too large entry (``LIMIT``, beyond
which a product with the count may leave a long) are dropped, and so are those of another length than
most (of equally frequent lengths, the greatest counts). Repeated rows give repeated results, and
count once in the fit list. Components whose share of the variance is only rounding (``NOISE``) are
left out, so equal vectors have none; components of equal variance come in any rotation. An empty
table gives an empty result. Columns with the names of results are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.session import stage

#: Entries of this size or more can't be counted exactly: 64 * LIMIT is 2 ** 30.
LIMIT = float(1 << 24)
#: Bytes of a block of the fit list.
BLOCK = 1 << 21
#: Greatest size of the search space, per wanted pair, and MINRES steps per correction.
SPACE, INNER = 3, 6
#: Residuals count as double precision below this share of the greatest eigenvalue, times the root
#: of the dimension.
PRECISION = 8 * float(np.finfo(float).eps)
#: A component with less than this share of the greatest one's variance is rounding.
NOISE = 1e-12
#: Rounds after which the solver gives up; it takes a few.
ROUNDS = 500

RESULTS = ("n", "deviation", "whitened", "explained", "identity_error")

Product = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Whitening:
    """What the fit found; ``vectors`` has a unit eigenvector per column."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float


def _orthonormal(new: np.ndarray, *others: np.ndarray) -> np.ndarray:
    """The columns of ``new``, made orthonormal and orthogonal to ``others``; dependent ones go."""
    against = np.hstack([np.empty((len(new), 0)), *others])
    out: list[np.ndarray] = []
    for v in new.T:
        size = np.linalg.norm(v)
        if not size > 0.0:
            continue
        v = v / size
        for _ in range(3):  # the later times only mend rounding
            space = np.column_stack([against, *out])
            v = v - space @ (space.T @ v)
            left = np.linalg.norm(v)
            if left < 1e-10:
                break
            v = v / left
        else:
            out.append(v)
    return np.column_stack(out) if out else np.empty((len(new), 0))


def _corrections(product: Product, locked: np.ndarray, ritz: np.ndarray, theta: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """MINRES on the projected correction equations of all columns of ``ritz``, in lockstep."""

    def projected(x: np.ndarray) -> np.ndarray:
        x = x - locked @ (locked.T @ x)
        return x - ritz * np.sum(ritz * x, axis=0)

    def safe(x: np.ndarray) -> np.ndarray:
        return np.where(x > 0.0, x, 1.0)

    rest = projected(-residual)
    beta = np.linalg.norm(rest, axis=0)
    start, v = beta, rest / safe(beta)
    v_old = w = w_old = np.zeros_like(v)
    c = c_old = np.ones_like(beta)
    s = s_old = np.zeros_like(beta)
    eta, x = beta, np.zeros_like(v)
    for _ in range(INNER):
        image = projected(product(v) - v * theta)
        alpha = np.sum(v * image, axis=0)
        image = image - v * alpha - v_old * beta
        following = np.linalg.norm(image, axis=0)
        delta = c * alpha - c_old * s * beta
        rho1 = safe(np.hypot(delta, following))
        rho2, rho3 = s * alpha + c_old * c * beta, s_old * beta
        c_old, s_old, c, s = c, s, delta / rho1, following / rho1
        w, w_old = (v - w_old * rho3 - w * rho2) / rho1, w
        x = x + w * (c * eta)
        eta = -s * eta
        v_old, v, beta = v, image / safe(following), following
        if np.all(np.abs(eta) <= 1e-3 * start):
            break
    return x


def leading_pairs(product: Product, dim: int, wanted: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The greatest eigenvalues of a symmetric positive matrix, falling, and their unit vectors."""
    wanted = min(wanted, dim)
    most = min(dim, max(SPACE * wanted, wanted + 8))
    space = _orthonormal(np.random.default_rng(seed).standard_normal((dim, min(dim, wanted + 4))))
    image = product(space)
    locked, values = np.empty((dim, 0)), np.empty(0)
    for _ in range(ROUNDS):
        inner = space.T @ image
        theta, turn = np.linalg.eigh((inner + inner.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        ritz, image = space @ turn, image @ turn
        residual = image - ritz * theta
        far = np.linalg.norm(residual, axis=0)
        enough = PRECISION * np.sqrt(dim) * max([*values[:1], *theta[:1], 0.0])
        whole = locked.shape[1] + ritz.shape[1] >= dim  # the space is complete, so the pairs are exact
        done = 0
        while done < len(theta) and (far[done] <= enough or whole) and len(values) < wanted:
            locked, values = np.column_stack([locked, ritz[:, done]]), np.append(values, theta[done])
            done += 1
        space, image, theta, residual, far = ritz[:, done:], image[:, done:], theta[done:], residual[:, done:], far[done:]
        if len(values) >= wanted:
            least = np.sort(values)[-wanted]
            if not len(theta) or whole or theta[0] + far[0] <= least + enough or far[0] <= enough:
                if len(theta) and theta[0] > least + enough:  # a greater one had been missed
                    locked, values = np.column_stack([locked, space[:, 0]]), np.append(values, theta[0])
                    space, image = space[:, 1:], image[:, 1:]
                    continue
                order = np.argsort(-values, kind="stable")[:wanted]
                return values[order], locked[:, order]
        asked = np.flatnonzero(far[: max(1, wanted - len(values))] > enough)
        new = _corrections(product, locked, space[:, asked], theta[asked], residual[:, asked])
        room = most - locked.shape[1] - len(asked)
        if space.shape[1] > room:  # restart from the leading Ritz vectors
            left = max(1, min(space.shape[1], wanted - len(values) + 4, max(room, 1)))
            space, image = space[:, :left], image[:, :left]
        new = _orthonormal(new, locked, space)
        if not new.shape[1]:
            new = _orthonormal(np.random.default_rng(seed + len(values) + 1).standard_normal((dim, 1)), locked, space)
        space, image = np.column_stack([space, new]), np.column_stack([image, product(new)])
    raise RuntimeError(f"no convergence to double precision: residuals {far[:wanted]}")


def _integers(embedding: str) -> tuple[Column, Column]:
    """Whether a vector can be used, and its integers."""
    entries = F.col(embedding).cast("array<double>")
    fine = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LIMIT))
    usable = F.coalesce(fine & (F.size(entries) > 0), F.lit(False))
    return usable, F.transform(entries, lambda c: (F.floor(c * 64) + 1000000).cast("int"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _pack(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    rows = max(1, BLOCK // (4 * dim))
    for batch in batches:
        x = _matrix(batch.column("x"), dim).astype("<i4")
        for at in range(0, len(x), rows):
            yield pa.RecordBatch.from_arrays([pa.array([x[at : at + rows].tobytes()], pa.binary())], ["block"])


def _total(blocks: DataFrame, part: Callable[[np.ndarray], np.ndarray], dim: int, kind: str = "double") -> np.ndarray:
    """The sum over all blocks of what ``part`` makes of a block's integers, flat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for block in batch.column("block"):
                x = np.frombuffer(block.as_buffer(), "<i4").reshape(-1, dim).astype(np.int64)
                made = part(x)
                total = made if total is None else total + made
        if total is not None:
            arrays = [pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)]
            yield pa.RecordBatch.from_arrays(arrays, ["place", "part"])

    sums = blocks.mapInArrow(run, f"place int, part {kind}").groupBy("place").agg(F.sum("part").alias("total"))
    rows = sums.collect()
    out = np.zeros(len(rows), np.float64 if kind == "double" else np.int64)
    for r in rows:
        out[r["place"]] = r["total"]
    return out


def fit(df: DataFrame, embedding: str = "embedding", components: int = 16) -> Whitening | None:
    """The whitening of a table's distinct vectors; None if it has no usable one."""
    usable, integers = _integers(embedding)
    vectors = df.where(usable).select(integers.alias("x"))
    lengths = vectors.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if lengths is None:
        return None
    dim = lengths["dim"]
    distinct = vectors.where(F.size("x") == dim).distinct()
    blocks = stage(distinct.mapInArrow(lambda it: _pack(it, dim), "block binary"), "whitening-blocks")

    counted = _total(blocks, lambda x: np.append(x.sum(axis=0), len(x)), dim, "long")
    n, sums = int(counted[-1]), counted[:-1]

    def centred(x: np.ndarray) -> np.ndarray:
        return (n * x - sums) / n

    def product(v: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            y = centred(x)
            return (y.T @ (y @ v)).ravel()

        return _total(blocks, part, dim).reshape(v.shape) / n

    values, found = leading_pairs(product, dim, components)
    real = values > NOISE * max(values[0], 0.0)
    values, found = values[real], found[:, real]
    if not len(values):
        return Whitening(n, sums, found, values, values, 0.0)
    found = found * np.sign(found[np.argmax(np.abs(found), axis=0), np.arange(len(values))])
    k = len(values)

    def check(x: np.ndarray) -> np.ndarray:
        y = centred(x)
        z = y @ found / np.sqrt(values)
        return np.concatenate([(z.T @ z).ravel(), z.sum(axis=0), [np.sum(y * y)]])

    checked = _total(blocks, check, dim) / n
    mean = checked[k * k : -1]
    covariance = checked[: k * k].reshape(k, k) - np.outer(mean, mean)
    return Whitening(n, sums, found, values, values / checked[-1], float(np.abs(covariance - np.eye(k)).max()))


def _whiten(batches: Iterator[pa.RecordBatch], model: Whitening) -> Iterator[pa.RecordBatch]:
    dim, k = model.vectors.shape
    for batch in batches:
        y = model.n * _matrix(batch.column("x"), dim).astype(np.int64) - model.sums
        if np.abs(y).max(initial=0) ** 2.0 * dim < float(1 << 62):
            deviation = (y * y).sum(axis=1).tolist()
        else:
            deviation = [sum(v * v for v in row.tolist()) for row in y]
        z = (y / model.n) @ model.vectors / np.sqrt(model.values)
        ends = pa.array(np.arange(len(y) + 1) * k, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("kept"),
                pa.array([Decimal(d) for d in deviation], pa.decimal128(38, 0)),
                pa.ListArray.from_arrays(ends, pa.array(z.ravel())),
            ],
            ["kept", "deviation", "whitened"],
        )


def whiten(df: DataFrame, model: Whitening | None, embedding: str = "embedding", keep: Sequence[str] | None = None) -> DataFrame:
    """``keep`` of the input's columns (default: all) of every usable row, with the fit's size ``n``,
    ``deviation`` (the sum of ``(n * x - sums) ** 2``, exact), the arrays ``whitened`` and
    ``explained``, an entry per component, and ``identity_error``."""
    kept = [c for c in (keep or df.columns) if c not in RESULTS]
    usable, integers = _integers(embedding)
    rows = df.where(usable).select(F.struct(*kept).alias("kept"), integers.alias("x"))
    rows = rows.where(F.size("x") == len(model.sums)) if model else rows.limit(0)
    more = T._parse_datatype_string("deviation decimal(38, 0), whitened array<double>").fields
    schema = T.StructType([rows.schema["kept"], *more])
    made = rows.mapInArrow(lambda it: _whiten(it, model), schema)
    explained = model.explained.tolist() if model else []
    made = made.select(
        "kept",
        F.lit(model.n if model else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.array(*map(F.lit, explained)).cast("array<double>").alias("explained"),
        F.lit(model.identity_error if model else 0.0).alias("identity_error"),
    )
    return made.select("kept.*", *RESULTS)
