"""Exact top-k search by pivot-table elimination.

Vectors are integers, so scores are exact. Distances of every vector to a few pivots are computed once, into a table
that is sorted by nearest pivot; for a query, |d(q, p) - d(x, p)| bounds the distance of x from below, hence its inner
product from above by (|q|^2 + |x|^2 - bound^2) / 2. That skips whole runs of the table by the range of their distances,
then vectors: candidates are evaluated in the order of their bound until the k-th score found exceeds every bound left.
A query starts from the k-th score that a bounded sample of the vectors reaches. Queries are taken in blocks, each sent
to all tasks; a task returns its k best per query only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxolume.storage import Scratch

#: Pivots; queries in a block, which bounds what is sent to every task; blocks of a job; candidates held at a time.
PIVOTS, BLOCK, JOINT, HELD = 24, 8192, 8, 4096
#: Vectors that pivots and first scores are taken from, at most.
SAMPLE = 4_000
#: Candidates evaluated between two looks at the bound.
STEP = 64


def quantised(vector: Column) -> Column:
    """floor(1024 * x) of each component, as doubles; null where the vector or a component is null or not finite."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    usable = vector.isNotNull() & F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(usable, F.transform(wide, lambda x: F.floor(x * 1024).cast("double")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _far_apart(x: np.ndarray, n: int) -> np.ndarray:
    """n rows of x, each the farthest from those before it."""
    at = [int((x * x).sum(axis=1).argmax())]
    least = ((x - x[at[0]]) ** 2).sum(axis=1)
    while len(at) < min(n, len(x)):
        at.append(int(least.argmax()))
        least = np.minimum(least, ((x - x[at[-1]]) ** 2).sum(axis=1))
    return x[at]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T), 0))


def best_of(q: np.ndarray, q_ids: np.ndarray, dq: np.ndarray, x: np.ndarray, ids: np.ndarray, dx: np.ndarray, k: int, floor: np.ndarray, counter: list[int] | None = None) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(query's place, ids, scores) of up to k candidates, best first, ties to the smaller id, itself excluded; queries
    that the whole run's bound rules out are left out.

    dq, dx: distances to the pivots. floor: for each query a score that k vectors are known to reach; candidates below
    it need no look. counter gets the number of candidates that were evaluated.
    """
    nq, nx = (q * q).sum(axis=1), (x * x).sum(axis=1)
    # One part in a million and one unit of slack cover what rounding does to the distances.
    high = lambda n, m, low: (n + m - low * low) / 2 + 1e-6 * (n + m) + 1
    apart = np.maximum(0, np.maximum(dq - dx.max(axis=0), dx.min(axis=0) - dq)).max(axis=1)
    found = []
    for i in np.flatnonzero(high(nq, nx.max(), apart) >= floor).tolist():
        bound = high(nq[i], nx, np.abs(dx - dq[i]).max(axis=1))
        ok = np.flatnonzero((bound >= floor[i]) & (ids != q_ids[i]))
        order = ok[np.argsort(-bound[ok], kind="stable")]
        best_s, best_i, at = np.zeros(0), np.zeros(0, ids.dtype), 0
        step = STEP
        while at < len(order):
            if len(best_s) >= k and bound[order[at]] < best_s[k - 1]:
                break
            own = order[at : at + step]
            at += step
            step *= 2
            s = np.concatenate([best_s, x[own] @ q[i]])
            n = np.concatenate([best_i, ids[own]])
            top = np.lexsort((n, -s))[:k]
            best_s, best_i = s[top], n[top]
        if counter is not None:
            counter.append(min(at, len(order)))
        if len(best_s):
            found.append((i, best_i, best_s))
    return found


def _place(pivots: np.ndarray):
    """The pivot table: id, v, its distances to the pivots, and the nearest of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d = _distances(_matrix(batch.column(1), pivots.shape[1]), pivots)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * d.shape[1]), len(d), [None, pa.py_buffer(np.ascontiguousarray(d))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed, pa.array(d.argmin(axis=1).astype(np.int32))], ["id", "v", "d", "near"])

    return run


def _search(q: np.ndarray, q_ids: np.ndarray, pivots: np.ndarray, k: int, floor: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0))] * len(q)
        known, dq = floor.copy(), _distances(q, pivots)
        looked: list[int] = []
        rows = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, HELD):
                own = batch.slice(lo, HELD)
                rows += own.num_rows
                dx = np.frombuffer(b"".join(own.column(2).to_pylist()), np.float64).reshape(own.num_rows, -1)
                ids = own.column(0).to_numpy(zero_copy_only=False)
                for i, n, s in best_of(q, q_ids, dq, _matrix(own.column(1), q.shape[1]), ids, dx, k, known, looked):
                    n, s = np.concatenate([best[i][0], n]), np.concatenate([best[i][1], s])
                    top = np.lexsort((n, -s))[:k]
                    best[i] = (n[top], s[top])
                    if len(top) == k:
                        known[i] = max(known[i], s[top[-1]])
        of = np.repeat(q_ids, [len(n) for n, _ in best])
        n, s = (np.concatenate([b[j] for b in best]) for j in (0, 1))
        # A row without ids tells how many pairs there were and how many of them were evaluated.
        yield pa.RecordBatch.from_arrays([pa.array([*of.tolist(), None], pa.int64()), pa.array([*n.tolist(), rows * len(q)], pa.int64()), pa.array([*s.astype(np.int64).tolist(), sum(looked)], pa.int64())], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10, pivots: int = PIVOTS, block: int = BLOCK, evaluated: list[float] | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where `queries` holds, its k best others by integer inner product.

    rank counts from 1; equal scores go to the smaller id; fewer than k others give all of them. Rows whose key is
    null, or whose vector is null or has null or non-finite components, take no part. Vectors are compared with those of
    their own length, each length in turn. Rows that share a key are candidates each on their own, except for queries
    of that key; of several query rows of one key and length, the one whose vector comes first in order asks. Queries
    run in blocks of about `block`, several blocks in a job; a block is all that is broadcast. An empty table gives no
    rows; other columns are ignored. evaluated gets, for each length, the share of pairs whose score was computed.
    """
    spark, store = vectors.sparkSession, Scratch(vectors.sparkSession, "top-k")
    usable = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), quantised(F.col(f"`{vector}`")).alias("v"), queries.alias("q")).filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    usable = store.put(usable.withColumn("width", F.size("v")).withColumn("v", F.when(F.col("width") > 0, F.col("v")).otherwise(F.array(F.lit(0.0)))))
    counts = usable.groupBy("width").agg(F.count("*").alias("n"), F.count_if("q").alias("asked")).filter("asked > 0").orderBy("width")
    parts = []
    for r in counts.toLocalIterator():
        rows = usable.filter(F.col("width") == r["width"])
        share = min(1.0, SAMPLE / r["n"])
        sample = rows.filter(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 20)) < int((1 << 20) * share)).select("id", "v").limit(2 * SAMPLE).toPandas()
        seen = np.array(sample["v"].tolist(), np.float64) if len(sample) else np.zeros((1, max(1, r["width"])))
        chosen = _far_apart(np.unique(seen, axis=0), pivots)
        table = store.put(rows.select("id", "v").mapInArrow(_place(chosen), "id long, v array<double>, d binary, near int").repartitionByRange("near", "id").sortWithinPartitions("near", "id"))
        blocks = max(1, -(-r["asked"] // block))
        asked = rows.filter("q").groupBy("id").agg(F.min("v").alias("v")).withColumn("b", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(blocks)))
        asked = store.put(asked)
        joint = []
        for b in range(blocks):
            own = asked.filter(F.col("b") == b).select("id", "v").toPandas().sort_values("id")
            if len(own):
                q, ids = np.array(own["v"].tolist(), np.float64), own["id"].to_numpy(np.int64)
                joint.append(table.select("id", "v", "d").mapInArrow(_search(q, ids, chosen, k, _first_scores(q, ids, seen, sample["id"].to_numpy(np.int64), k)), "query_id long, vec_id long, score long"))
            if joint and (len(joint) == JOINT or b == blocks - 1):
                every = joint[0]
                for x in joint[1:]:
                    every = every.union(x)
                parts.append(store.put(every))
                joint = []
        if evaluated is not None:
            pairs, looked = parts[-1].filter("query_id is null").agg(F.sum("vec_id"), F.sum("score")).first()
            evaluated.append(looked / pairs)
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    ranked = out.filter("query_id is not null").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    result = store.put(ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
    store.clear(result)
    return result


def _first_scores(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """For each query the k-th score among others of x, or minus infinity if there are fewer."""
    out = np.full(len(q), -np.inf)
    for lo in range(0, len(q), 256):
        s = q[lo : lo + 256] @ x.T if len(ids) else np.zeros((len(q[lo : lo + 256]), 0))
        s[q_ids[lo : lo + 256, None] == ids] = -np.inf
        if s.shape[1] >= k:
            out[lo : lo + 256] = np.partition(s, -k, axis=1)[:, -k]
    return out


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
