"""Whitening of embeddings by matrix-free block subspace iteration.

The covariance V is never formed: a pass over the rows multiplies it with a block of directions, one task's share being
X'(XQ) on centred rows, and adds the shares up row by row of the result. QR makes the block orthonormal again, a
Rayleigh-Ritz step turns it into the best eigenvectors within it, and their residuals |Vu - eu| tell when all components
are certain. The block is wider than the number of components, which sets the speed; where residuals fall slowly it is
doubled, and a block as wide as the vectors is exact, so the iteration always ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolume.storage import Scratch

from .common import releasing

#: Directions of a block, before it grows; a step of the driver holds as many times the dimension.
BLOCK = 32
#: Passes after which a block that is not done is doubled.
PATIENCE = 16
#: A residual is small enough at this part of the largest eigenvalue, times the root of the dimension: rounding's size.
NEAR = 4 * np.finfo(np.float64).eps
#: An eigenvalue of less than this part of the largest one is none.
NOTHING = 1e-13
#: Units that one step of a component has; entries are floor(UNITS * c).
UNITS = 256
#: Rows that a task multiplies at a time.
HELD = 4096


@dataclass
class Whitening:
    """Of n different quantised vectors: their sums S by dimension, and for each component, by falling eigenvalue, the
    unit eigenvector (a column of vectors), the eigenvalue and its share of the trace; the residuals that certify them,
    the passes that it took, and the largest absolute entry of (covariance of the whitened rows - identity)."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    residuals: np.ndarray
    passes: int
    identity_error: float


def _packed(x: np.ndarray) -> bytes:
    """A vector of whole numbers in the fewest bytes an entry that hold it; equal vectors give equal bytes."""
    top = int(np.abs(x).max(initial=0)) if x.min(initial=0) > -(1 << 62) else 1 << 62
    width = 1 if top < 1 << 7 else 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
    return bytes([width]) + x.astype(f"<i{width}").tobytes()


def _quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, vector) as (id, x, size) of the rows that take part."""
    for batch in batches:
        ids, out, sizes = [], [], []
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if not v.is_valid or v.values.null_count:
                continue
            x = np.floor(v.values.to_numpy(zero_copy_only=False).astype(np.float64) * UNITS)
            if np.isfinite(x).all() and (np.abs(x) < 2.0**62).all():
                ids.append(i), out.append(_packed(x.astype(np.int64))), sizes.append(len(x))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary()), pa.array(sizes, pa.int32())], ["id", "x", "size"])


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of whole numbers; a shorter vector ends in zeros."""
    out = np.zeros((len(column), d), np.int64)
    for i, b in enumerate(column.to_pylist()):
        x = np.frombuffer(b, f"<i{b[0]}", offset=1)
        out[i, : len(x)] = x
    return out


def _padded(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([_packed(x) for x in _matrix(batch.column(0), d)], pa.binary())], ["x"])


def _sums(d: int):
    """Sums of a task's rows by dimension, exact, as text, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * d, 0
        for batch in batches:
            n += batch.num_rows
            for lo in range(0, batch.num_rows, HELD):
                x = _matrix(batch.column(0).slice(lo, HELD), d)
                high, low = x >> 32, x & 0xFFFFFFFF  # sums of halves stay within 64 bits
                total = [t + (int(a) << 32) + int(b) for t, a, b in zip(total, high.sum(axis=0), low.sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array([str(v) for v in (n, *total)])], ["i", "s"])

    return run


def _shares(mean: np.ndarray, q: np.ndarray, whole: bool):
    """A task's X'(XQ) on centred rows, by row; whole: (XQ)'(XQ) and, last, the sums of XQ instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = q.shape[1]
        out = np.zeros((b + 1 if whole else len(mean) + 1, b))
        for batch in batches:
            for lo in range(0, batch.num_rows, HELD):
                x = _matrix(batch.column(0).slice(lo, HELD), len(mean)).astype(np.float64) - mean
                y = x @ q
                out[:-1] += (y if whole else x).T @ y
                if whole:
                    out[-1] += y.sum(axis=0)
                else:
                    out[-1, 0] += float(np.einsum("ij,ij->", x, x))
        flat = pa.array(out.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), pa.ListArray.from_arrays(np.arange(0, out.size + 1, b, dtype=np.int32), flat)], ["i", "y"])

    return run


def _pass(rows: DataFrame, mean: np.ndarray, q: np.ndarray, n: int, whole: bool = False) -> np.ndarray:
    """The tasks' shares added up by row, over n. What comes back has the size of the block, not of the data."""
    shares = rows.mapInArrow(_shares(mean, q, whole), "i int, y array<double>")
    total = shares.select("i", F.posexplode("y").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((q.shape[1] + 1 if whole else len(mean) + 1, q.shape[1]))
    out[total["i"].to_numpy(), total["j"].to_numpy()] = total["v"].to_numpy()
    return out / n


def distinct_rows(vectors: DataFrame, key: str, vector: str, store: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """((id, x) of the rows that take part, the fit list (x), the dimension): each different x once. Tasks drop repeats
    before the shuffle, so a vector that many rows share is few rows there."""
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v")).mapInArrow(releasing(_quantised), "id long, x binary, size int")
    rows = store.put(rows)
    least, d = rows.agg(F.min("size"), F.max("size")).first()
    x = rows.select("x")
    if least != d and d:
        x = x.mapInArrow(lambda batches: _padded(batches, d), "x binary")
    return rows, store.put(x.distinct()), d or 0


def fit(fit_list: DataFrame, d: int, k: int = 4, block: int = BLOCK, near: float = NEAR, seed: int = 1) -> Whitening:
    """The k leading components of the fit list, fewer if fewer have a positive eigenvalue. See whiten()."""
    total = {r["i"]: r["s"] for r in fit_list.mapInArrow(_sums(d), "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    n, sums = int(total.get(-1) or 0), [int(total.get(j) or 0) for j in range(d)]
    if not n or not d:
        return Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), np.zeros(0), np.zeros(0), 0, 0.0)
    mean = np.array([float(s // n) + float(s % n) / n for s in sums])
    random, k = np.random.default_rng(seed), min(k, d)
    q = np.linalg.qr(random.standard_normal((d, min(d, max(block, k)))))[0]
    passes, since = 0, 0
    while True:
        got = _pass(fit_list, mean, q, n)
        y, trace = got[:-1], float(got[-1, 0])
        passes, since = passes + 1, since + 1
        ritz = q.T @ y
        values, s = np.linalg.eigh((ritz + ritz.T) / 2)
        values, s = values[::-1], s[:, ::-1]
        u, vu = q @ s, y @ s
        residuals = np.linalg.norm(vu[:, :k] - u[:, :k] * values[:k], axis=0)
        if values[0] <= 0 or (residuals <= near * np.sqrt(d) * values[0]).all() or (q.shape[1] == d and since > 2):
            break
        q = np.linalg.qr(vu)[0]
        if since >= PATIENCE and q.shape[1] < d:
            more = random.standard_normal((d, min(q.shape[1], d - q.shape[1])))
            q, since = np.linalg.qr(np.hstack([q, more]))[0], 0
    real = values[:k] > NOTHING * max(trace, 0.0)
    u, values = u[:, :k][:, real], values[:k][real]
    u = u / np.linalg.norm(u, axis=0)
    white = _pass(fit_list, mean, u / np.sqrt(values), n, whole=True) if len(values) else np.zeros((1, 0))
    spread = white[:-1] - np.outer(white[-1], white[-1]) - np.eye(len(values))
    return Whitening(n, sums, u, values, values / trace if len(values) else values, residuals[real], passes, float(np.abs(spread).max(initial=0.0)))


def _projected(model: Whitening):
    d, k = model.vectors.shape
    mean = np.array([float(s // model.n) + float(s % model.n) / model.n for s in model.sums])
    scaled = model.vectors / np.sqrt(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = np.array(model.sums, object)
        for batch in batches:
            for lo in range(0, batch.num_rows, HELD):
                own = batch.slice(lo, HELD)
                x = _matrix(own.column(1), d)
                far = float(np.abs(x).max(initial=0)) * model.n + max(abs(s) for s in model.sums)
                if d * far * far < 2.0**62:
                    off = x * model.n - np.array(model.sums, np.int64)
                    deviation = np.einsum("ij,ij->i", off, off).tolist()
                else:  # beyond 64 bits in steps: whole numbers of any size; a sum beyond them is null
                    off = x.astype(object) * model.n - exact
                    deviation = [s if s < 1 << 63 else None for s in (off * off).sum(axis=1)]
                white = (x - mean) @ scaled
                rows = np.repeat(np.arange(own.num_rows), k)
                yield pa.RecordBatch.from_arrays([own.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), own.num_rows)), pa.array([deviation[r] for r in rows], pa.int64()), pa.array(white.ravel())], ["id", "component", "deviation", "whitened"])

    return run


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 4, block: int = BLOCK) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of each row and component up to k.

    Vectors that are null, hold null or non-finite entries, or entries of 2^54 or more, take no part and have no rows.
    Shorter vectors count as ending in zeros. Components are those of the different quantised vectors; what repeats counts
    once, but every row is returned, null and repeated keys too. Eigenvalues that agree leave their components open:
    any orthonormal ones. Components with an eigenvalue of zero are not returned, so that a table of a single vector, or
    of none, gives no rows, and vectors of d entries have at most d components. deviation is null beyond 2^63 - 1. Other
    columns are ignored. Driver and tasks hold the block, dimension times `block` numbers, doubled at most up to
    dimension times dimension.
    """
    store = Scratch(vectors.sparkSession, "whitening")
    rows, fit_list, d = distinct_rows(vectors, key, vector, store)
    model = fit(fit_list, d, k, block)
    store.drop(fit_list)
    if not len(model.values):
        return vectors.sparkSession.createDataFrame([], f"`{key}` long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    out = rows.select("id", "x").mapInArrow(releasing(_projected(model)), "id long, component int, deviation long, whitened double")
    share = F.element_at(F.array(*[F.lit(float(v)) for v in model.explained]), F.col("component"))
    return out.select(F.col("id").alias(key), "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(model.identity_error).alias("identity_error"))
