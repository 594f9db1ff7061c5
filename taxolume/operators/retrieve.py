"""Dense retrieval: exact scans, top-k, metadata lookup, product-space fusion, entity selection."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxolume.functions import vector as V

from . import pairs as P

#: Query rows up to which they are sent to every task; more are taken in blocks. Table rows scored with a block at a time.
QUERY_BLOCK, ROWS = 4096, 512


def stated(queries: DataFrame, table: DataFrame, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """Every row of table beside every one of the stated queries (query_id, ...), which are broadcast: all at once if
    they are at most QUERY_BLOCK, else in blocks of about that size by a hash of `by`, a scan of table each."""
    n = queries.count()
    blocks = -(-n // QUERY_BLOCK)
    if blocks <= 1:
        return table.crossJoin(F.broadcast(queries))
    parts = [table.crossJoin(F.broadcast(queries.filter(F.pmod(F.xxhash64(*by), F.lit(blocks)) == b))) for b in range(blocks)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def scan(queries: DataFrame, table: DataFrame, score: str = "poincare", k: float | Column = 1.0, weight: float = 0.35) -> DataFrame:
    """(query_id, id, score) of every query against every row. queries: (query_id, q), table: (id, vec)."""
    build, _ = V.SCORES[score]
    return stated(queries, table).select("query_id", "id", build(F.col("q"), F.col("vec"), k, weight).alias("score"))


def top_k(scores: DataFrame, k: int | None, ascending: bool, by: str = "query_id", id_: str = "id", score: str = "score") -> DataFrame:
    """scores with rank from 1, best first, ties by id; all ranks if k is None. The window limits each group early."""
    order = F.col(score).asc() if ascending else F.col(score).desc()
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(order, F.col(id_).asc())))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def retrieve(queries: DataFrame, table: DataFrame, score: str = "poincare", k: int | None = 10, curvature: float | Column = 1.0, weight: float = 0.35, exclude_self: bool = True) -> DataFrame:
    """(query_id, rank, id, score) of the k best rows for each query, of all rows if k is None."""
    own = P.score(score, curvature, weight) if isinstance(curvature, (int, float)) and score in V.SCORES and V.SCORES[score] is V.OWN.get(score) else None
    if own is not None and (made := P.ready(queries.select("query_id", "q"), table.select("id", "vec"), own)):
        if k is None:
            return P.rankings(*made, own, exclude_self)
        return top_k(P.best(*made, own, k, exclude_self), k, own.ascending).select("query_id", "rank", "id", "score")
    found = scan(queries, table, score, curvature, weight)
    if exclude_self:
        found = found.filter("query_id <> id")
    if k is None:
        from .ranks import full_ranks

        return full_ranks(found, V.SCORES[score][1]).select("query_id", "rank", "id", "score")
    return top_k(found, k, V.SCORES[score][1]).select("query_id", "rank", "id", "score")


def with_metadata(results: DataFrame, entities: DataFrame) -> DataFrame:
    """results with iri and verbalisation of entities (mapping_id, iri, verbalisation), joined after the cut."""
    return results.join(entities.withColumnRenamed("mapping_id", "id"), "id").select("query_id", "rank", "iri", "score", "verbalisation")


def mixed(tables: list[DataFrame], sigmas: list[float], kernel: str = "exp", k: int | None = 10) -> DataFrame:
    """Fusion of several distance tables (query_id, id, score) in a product space; exp and inv are best when large."""
    joined = tables[0].withColumnRenamed("score", "d0")
    for i, t in enumerate(tables[1:], 1):
        joined = joined.join(t.withColumnRenamed("score", f"d{i}"), ["query_id", "id"])
    score = V.mixed_distance([F.col(f"d{i}") for i in range(len(tables))], sigmas, kernel)
    return top_k(joined.select("query_id", "id", score.alias("score")), k, ascending=kernel == "dist").select("query_id", "rank", "id", "score")


def mixed_scan(queries: DataFrame, table: DataFrame, parts: list[tuple[str, str, Callable[[Column, Column], Column]]], sigmas: list[float], kernel: str = "exp", k: int | None = 10, exclude_self: bool = True) -> DataFrame:
    """As mixed, over spaces whose vectors stand side by side in one table: parts are (query column, table column,
    distance). The table is read once, all distances of a pair are taken together, and nothing but the best rows is
    shuffled. queries: (query_id, ...), stated."""
    pairs = stated(queries.select("query_id", *[F.col(c).alias(f"_q{i}") for i, (c, _, _) in enumerate(parts)]), table)
    if exclude_self:
        pairs = pairs.filter("query_id <> id")
    score = V.mixed_distance([distance(F.col(f"_q{i}"), F.col(c)) for i, (_, c, distance) in enumerate(parts)], sigmas, kernel)
    return top_k(pairs.select("query_id", "id", score.alias("score")), k, ascending=kernel == "dist").select("query_id", "rank", "id", "score")


def mixed_top(queries: DataFrame, table: DataFrame, spaces: Sequence[str], sigmas: list[float], kernel: str = "exp", k: int = 10, curvature: float = 1.0, exclude_self: bool = True) -> DataFrame:
    """As mixed_scan, of distances (poincare, l2, cosine) between the vectors of queries (query_id, q) and table (id, vec)."""
    own = P.mixed(list(spaces), curvature, sigmas, kernel)
    if made := P.ready(queries.select("query_id", "q"), table.select("id", "vec"), own):
        return top_k(P.best(*made, own, k, exclude_self), k, own.ascending).select("query_id", "rank", "id", "score")
    distance = {"poincare": lambda q, v: V.poincare(q, v, curvature), "l2": V.l2, "cosine": lambda q, v: F.lit(1.0) - V.cosine(q, v, normalised=False)}
    return mixed_scan(queries, table, [("q", "vec", distance[space]) for space in spaces], sigmas, kernel, k, exclude_self)


def assert_aligned(*tables: DataFrame) -> None:
    """An error unless all tables have as many rows."""
    counts = {t.count() for t in tables}
    if len(counts) > 1:
        raise ValueError(f"tables of different sizes: {sorted(counts)}")


def bulk_top_k(queries: DataFrame, table: DataFrame, k: int = 10, curvature: float = 1.0, kind: str = "poincare", block: int = QUERY_BLOCK) -> DataFrame:
    """As retrieve, by matrix products over Arrow batches: each task returns its k best per query of a block only.

    Blocks of the stated query set run one after the other; a block is all that is sent to the tasks.
    """
    schema = "query_id long, id long, score double"
    n = max(1, -(-queries.count() // block))
    found: DataFrame | None = None
    for b in range(n):
        own = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b).toPandas().sort_values("query_id")
        if not len(own):
            continue
        q, ids = np.array(own["q"].tolist(), np.float64), own["query_id"].to_numpy(np.int64)
        part = table.select("id", "vec").mapInArrow(_block_scan(q, ids, k, curvature, kind), schema)
        found = part if found is None else found.union(part)
    if found is None:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, id long, score double")
    return top_k(found, k, kind != "inner").select("query_id", "rank", "id", "score")


def _block_scan(q: np.ndarray, q_ids: np.ndarray, k: int, c: float, kind: str):
    """A task's k best rows for each query; queries by ROWS rows are scored at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nq = (q * q).sum(axis=1)
        best_key, best_id, best_s = np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max), np.zeros((len(q), k))
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                own = batch.slice(lo, ROWS)
                ids = own.column(0).to_numpy(zero_copy_only=False)
                x = own.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                s = q @ x.T
                if kind != "inner":
                    nx = (x * x).sum(axis=1)
                    s = np.maximum(nq[:, None] + nx - 2 * s, 0)
                    s = np.sqrt(s) if kind == "l2" else np.arccosh(np.maximum(1, 1 + 2 * c * s / ((1 - (c * nq + 1e-7))[:, None] * (1 - (c * nx + 1e-7))))) / np.sqrt(c)
                key = -s if kind == "inner" else s.copy()
                key[q_ids[:, None] == ids] = np.inf
                at = np.flatnonzero((key <= best_key[:, -1:]).any(axis=1) & (key.min(axis=1) < np.inf))  # the others keep what they have
                every = np.concatenate([best_id[at], np.broadcast_to(ids, (len(at), len(ids)))], axis=1)
                key, s = np.concatenate([best_key[at], key[at]], axis=1), np.concatenate([best_s[at], s[at]], axis=1)
                order = np.lexsort((every, key), axis=1)[:, :k]  # ties by id
                best_key[at], best_s[at], best_id[at] = (np.take_along_axis(a, order, axis=1) for a in (key, s, every))
        rows, cols = np.nonzero(np.isfinite(best_key))
        yield pa.RecordBatch.from_arrays([pa.array(q_ids[rows]), pa.array(best_id[rows, cols]), pa.array(best_s[rows, cols])], ["query_id", "id", "score"])

    return run


def drop_stop_mentions(mentions: DataFrame, vocabulary: DataFrame, mention: str = "mention") -> DataFrame:
    """mentions whose normalised text is neither empty nor in vocabulary (word)."""
    from taxolume.functions.text import normalise_mention

    m = mentions.withColumn("_m", normalise_mention(F.col(mention))).filter("_m <> ''")
    return m.join(vocabulary.select(F.col("word").alias("_m")), "_m", "left_anti").drop("_m")


def select_entities(ranked: DataFrame, append_k: int, retrieve_k: int, ascending: bool, top: int | None = None) -> DataFrame:
    """Candidates of each question: the first append_k of each mention's ranking (question_id, mention_id, rank, id,
    score), best first; with top, each id once and the first `top` of them."""
    if append_k > retrieve_k:
        raise ValueError("append_k must not exceed retrieve_k")
    kept = ranked.filter(F.col("rank") <= append_k)
    order = [F.col("score").asc() if ascending else F.col("score").desc(), F.col("id").asc(), F.col("mention_id").asc()]
    if top is None:
        return kept.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy(*order)))
    first = kept.withColumn("_n", F.row_number().over(Window.partitionBy("question_id", "id").orderBy(*order))).filter("_n = 1").drop("_n")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy(*order))).filter(F.col("place") <= top)


def best_entity(candidates: DataFrame, ascending: bool, gate: float | None = None) -> DataFrame:
    """The single best candidate of each question, ties by id; with a gate, its id is null below that score."""
    key = F.struct(F.col("score") if ascending else -F.col("score"), F.col("id"))
    best = candidates.groupBy("question_id").agg(F.min_by("id", key).alias("id"), F.min_by("score", key).alias("score"))
    return best if gate is None else best.withColumn("id", F.when(F.col("score") >= gate, F.col("id")))


@dataclass(frozen=True)
class Retriever:
    """A model's table with the score that ranks it; norms are kept beside the vectors if the score uses them."""

    model: str
    score: str
    table: DataFrame
    entities: DataFrame | None = None
    curvature: float = 1.0
    weight: float = 0.35

    def top(self, queries: DataFrame, k: int | None = 10) -> DataFrame:
        """(query_id, rank, id, score), or with entities (query_id, rank, iri, score, verbalisation)."""
        if self.score == "poincare" and "norm" in self.table.columns:
            found = top_k(scan_with_norms(queries, self.table, self.curvature), k, True).select("query_id", "rank", "id", "score")
        else:
            found = retrieve(queries, self.table.select("id", "vec"), self.score, k, self.curvature, self.weight, exclude_self=False)
        return found if self.entities is None else with_metadata(found, self.entities)

    def bulk(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """As top for Euclidean and Poincare distances and inner products, by matrix products over blocks of queries."""
        kind = {"l2": "l2", "poincare": "poincare", "inner": "inner"}.get(self.score)
        if kind is None:
            raise ValueError(f"no bulk form of {self.score}")
        return bulk_top_k(queries, self.table.select("id", "vec"), k, self.curvature, kind)


class Retrievers:
    """Makes retrievers by model over one folder of vectors (mapping_id, model, vec) and one table of entities."""

    #: The score of each model unless another is asked for.
    SCORES = {"sbert": "cosine", "hit": "poincare", "ont": "poincare"}

    def __init__(self, vectors: DataFrame, entities: DataFrame, curvature: float = 1.0) -> None:
        self.vectors, self.entities, self.curvature = vectors, entities, curvature

    def make(self, model: str, score: str | None = None, weight: float | None = None) -> Retriever:
        """A weight that is not given, or is 0, is 0.35. An unknown model is an error."""
        if model not in self.SCORES:
            raise ValueError(f"no such model: {model}")
        own = self.vectors.filter(F.col("model") == model).select(F.col("mapping_id").alias("id"), "vec")
        score = score or self.SCORES[model]
        if score == "poincare":
            own = with_norms(own)
        return Retriever(model, score, own, self.entities, self.curvature, weight or 0.35)


def with_norms(table: DataFrame, vec: str = "vec") -> DataFrame:
    """table with norm, the squared norm of each vector, so that scans need not take it anew for each query."""
    return table.withColumn("norm", V.squared_norm(F.col(vec)))


def scan_with_norms(queries: DataFrame, table: DataFrame, k: float | Column = 1.0) -> DataFrame:
    """As scan by Poincare distance, from the norms that table has and those of the stated queries."""
    q = with_norms(queries, "q").withColumnRenamed("norm", "q_norm")
    return stated(q, table).select("query_id", "id", V.poincare_from_norms(F.col("q_norm"), F.col("norm"), V.dot(F.col("q"), F.col("vec")), k).alias("score"))
