"""Ranks of a few rows among all, by counting what comes before them instead of sorting everything.

Only the rows whose rank is asked for get a threshold, their own score. Thresholds are sorted by query and sent to the
tasks; each task finds the place of every candidate among its query's thresholds by binary search and counts. The counts
of all tasks add up, and running sums over the thresholds are the ranks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxolume.functions import vector as V
from taxolume.storage import Scratch, numbered

from .retrieve import stated

#: Thresholds of one query that stand together, and that are sent to the tasks at a time.
CHUNK, THRESHOLDS = 1 << 14, 1 << 18


def _key(scores: pa.Array, ascending: bool) -> np.ndarray:
    """Scores as numbers that sort as Spark sorts them: nulls before all others upwards and after them downwards, NaN
    beyond all numbers; -0.0 is 0.0."""
    s = scores.cast(pa.float64())
    missing = s.is_null().to_numpy(zero_copy_only=False)
    x = s.fill_null(0.0).to_numpy(zero_copy_only=False)
    key = np.where(np.isnan(x), np.inf, x) if ascending else np.where(np.isnan(x), -np.inf, -x)
    return np.where(missing, -np.inf if ascending else np.inf, key) + 0.0


def _count(starts: np.ndarray, keys: np.ndarray, ids: np.ndarray, at: dict, ascending: bool):
    """How many of a task's candidates fall behind how many thresholds of each chunk. keys and ids: all thresholds, chunk
    by chunk, sorted; at: the chunks of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(keys) + len(starts), np.int64)  # a place more than thresholds for each chunk
        for batch in batches:
            n = batch.num_rows
            score, own = _key(batch.column(2), ascending), batch.column(1).to_numpy(zero_copy_only=False)
            chunks = [at.get(q, ()) for q in batch.column(0).to_pylist()]
            row = np.repeat(np.arange(n), [len(c) for c in chunks])
            chunk = np.fromiter((c for own_ in chunks for c in own_), np.int64, len(row))
            s, i = score[row], own[row]
            first = starts[chunk]
            lo, hi = first.copy(), np.append(starts, len(keys))[chunk + 1]
            while (open_ := lo < hi).any():
                mid = np.minimum((lo + hi) // 2, max(0, len(keys) - 1))
                before = (keys[mid] < s) | ((keys[mid] == s) & (ids[mid] <= i))  # the threshold is not behind the candidate
                lo, hi = np.where(open_ & before, mid + 1, lo), np.where(open_ & ~before, mid, hi)
            total += np.bincount(lo + chunk, minlength=len(total))
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total[place])], ["place", "n"])

    return run


def ranks_of(scores_of, wanted: DataFrame, queries: DataFrame, table: DataFrame, ascending: bool = True, exclude_self: bool = True) -> DataFrame:
    """(query_id, id, rank, length) of the wanted (query_id, id) among all rows of table (id, vec) for each of queries
    (query_id, q), ties by id; length is the number of rows that were ranked.

    scores_of(q, vec) is a Column. Wanted rows that the table does not have, and queries that are not there, have no
    rank; repeats count once. Candidates are read once for every THRESHOLDS wanted rows and each block of the stated
    queries, and are never sorted or shuffled. Ids are whole numbers or texts, different in table and in queries.
    """
    store = Scratch(table.sparkSession, "ranks")
    asked = wanted.select("query_id", "id").dropna().distinct()
    if exclude_self:
        asked = asked.filter("query_id <> id")
    own = asked.join(queries.select("query_id", "q"), "query_id").join(table.select("id", F.col("vec").alias("_v")), "id")
    own = store.put(own.select("query_id", "id", scores_of(F.col("q"), F.col("_v")).alias("score")))
    place = F.row_number().over(Window.partitionBy("query_id", "_part").orderBy(F.col("id")))
    sizes = own.groupBy("query_id").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("_parts"))
    parts = store.put(own.join(sizes, "query_id").withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_parts"))).drop("_parts"))
    blocks = max(1, -(-parts.count() // THRESHOLDS))
    out = None
    for b in range(blocks):
        mine = parts.filter(F.pmod(F.xxhash64("query_id", "_part"), F.lit(blocks)) == b)
        found = _ranked_block(mine, scores_of, queries, table, ascending, exclude_self, store)
        out = found if out is None else out.unionByName(found)
    return out


def _ranked_block(mine: DataFrame, scores_of, queries: DataFrame, table: DataFrame, ascending: bool, exclude_self: bool, store: Scratch) -> DataFrame:
    rows = mine.toArrow()  # THRESHOLDS rows, about
    spark = table.sparkSession
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {table.schema['id'].dataType.simpleString()}, rank long, length long"
    if not rows.num_rows:
        return spark.createDataFrame([], schema)
    key = _key(rows.column("score").combine_chunks(), ascending)
    q, ids, part = (np.array(rows.column(c).to_pylist()) for c in ("query_id", "id", "_part"))
    order = np.lexsort((ids, key, part, q))
    q, ids, part, key = q[order], ids[order], part[order], key[order]
    new = np.append(True, (q[1:] != q[:-1]) | (part[1:] != part[:-1]))
    starts, chunk = np.flatnonzero(new), np.cumsum(new) - 1
    at: dict = {}
    for c, first in enumerate(starts):
        at.setdefault(q[first].item(), []).append(c)
    names = spark.createDataFrame([(x,) for x in at], f"query_id {queries.schema['query_id'].dataType.simpleString()}")
    asked = queries.select("query_id", "q").join(F.broadcast(names), "query_id", "left_semi")
    every = stated(asked, table.select("id", "vec"))
    if exclude_self:
        every = every.filter("query_id <> id")
    every = every.select("query_id", "id", scores_of(F.col("q"), F.col("vec")).cast("double").alias("score"))
    counted = every.mapInArrow(_count(starts, key, ids, at, ascending), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(len(key) + len(starts), np.int64)
    for r in counted:
        total[r["place"]] = r["n"]
    run = np.cumsum(total)
    edge = starts + np.arange(len(starts))  # where a chunk's counts begin
    ahead = np.where(edge > 0, run[edge - 1], 0)
    last = np.append(edge[1:], len(total)) - 1
    rank = 1 + run[np.arange(len(key)) + chunk] - ahead[chunk]
    length = (run[last] - ahead)[chunk]
    return store.put(spark.createDataFrame(list(zip(q.tolist(), ids.tolist(), rank.tolist(), length.tolist(), strict=True)), schema))


def relevant_ranks(queries: DataFrame, table: DataFrame, relevant: DataFrame, score: str = "poincare", curvature: float | Column = 1.0, weight: float = 0.35, exclude_self: bool = True) -> DataFrame:
    """ranks_of the relevant (query_id, id) by a score function, for metrics over whole rankings."""
    build, ascending = V.SCORES[score]
    return ranks_of(lambda q, v: build(q, v, curvature, weight), relevant, queries, table, ascending, exclude_self)


def full_ranks(scores: DataFrame, ascending: bool) -> DataFrame:
    """scores (query_id, id, score) with rank from 1, best first, ties by id: all ranks of all rows. Rows are sorted in
    ranges over all queries, so that no task sorts all rows of one."""
    store = Scratch(scores.sparkSession, "ranking")
    order = F.col("score").asc() if ascending else F.col("score").desc()
    run = store.put(numbered(scores, [F.col("query_id"), order, F.col("id")], "_at", store))
    first = run.groupBy("query_id").agg(F.min("_at").alias("_first"))
    return run.join(F.broadcast(first), "query_id").withColumn("rank", (F.col("_at") - F.col("_first") + 1).cast("int")).drop("_at", "_first")
