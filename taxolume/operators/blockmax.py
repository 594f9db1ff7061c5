"""Lexical search over blocks of documents with the largest weight of each term, and exact skipping.

Documents stand in order of their most frequent term, so that neighbours share words, and are cut into blocks of BLOCK;
a block is a row with its postings by term and the largest one of each. No score of a block can exceed the sum of its
terms' largest weights, times the query's. A first scan reads terms and largest weights only and finds, for each query,
the blocks of highest bound; their documents give the query's k-th best score so far, a threshold that all tasks share.
The second scan scores only those blocks whose bound reaches it. A term of all documents lies in all blocks, never in one
task, and what leaves a task is k rows a query.

Postings hold the part of a weight that depends on the document; idf belongs to the term and is multiplied into the
query, so that postings never meet the vocabulary.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxolume.functions.text import STOPWORDS, tokenise
from taxolume.storage import Scratch

from .lexical import bm25_raw, tfidf_idf, words
from .retrieve import QUERY_BLOCK, top_k

#: Documents of a block; queries that are multiplied at a time; blocks of highest bound that set a query's threshold.
BLOCK, QUERIES, FIRST = 64, 256, 2
#: Scores that agree to so many digits are ties, by id.
DIGITS = 9


@dataclass
class Blocks:
    """blocks (block, ids, terms, most, starts, docs, parts): term number t has the places docs[starts[t]:starts[t+1]]
    of ids, with parts, and `most` is the largest part. vocabulary (term, df, idf). weight: how a query's count and a
    term's idf become the query's weight; tokens: how a query is split."""

    blocks: DataFrame
    vocabulary: DataFrame
    weight: Callable[[Column, Column], Column]
    tokens: Callable[[Column], Column]


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, tokens) as (id, dl, terms, tfs, top): a document's terms in order, their counts, and the most frequent one."""
    for batch in batches:
        dl, terms, tfs, tops = [], [], [], []
        for t in batch.column(1).to_pylist():
            found = Counter(t or ())
            order = sorted(found)
            dl.append(len(t or ()))
            terms.append(order)
            tfs.append([found[x] for x in order])
            tops.append(min(found, key=lambda x: (-found[x], x)) if found else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dl, pa.int32()), pa.array(terms, pa.list_(pa.string())), pa.array(tfs, pa.list_(pa.int32())), pa.array(tops, pa.string())], ["id", "dl", "terms", "tfs", "top"])


def _cut(part: Callable[[np.ndarray, np.ndarray], np.ndarray], kind: pa.DataType):
    """A sorted partition's documents as blocks. part: of the counts and lengths of postings, their weights."""

    def block(number: int, ids: list, dls: list[int], terms: list[list[str]], tfs: list[np.ndarray]) -> tuple:
        names = sorted(set().union(*terms))
        at = {t: i for i, t in enumerate(names)}
        row = np.fromiter((at[t] for own in terms for t in own), np.int64)
        doc = np.repeat(np.arange(len(ids)), [len(t) for t in terms])
        weight = part(np.concatenate(tfs).astype(np.float64), np.array(dls, np.float64)[doc])
        order = np.argsort(row, kind="stable")
        starts = np.searchsorted(row[order], np.arange(len(names) + 1))
        return number, ids, names, np.maximum.reduceat(weight[order], starts[:-1]), starts.astype(np.int32), doc[order].astype(np.int32), weight[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "ids", "terms", "most", "starts", "docs", "parts"]
        kinds = [pa.int64(), pa.list_(kind), pa.list_(pa.string()), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64())]
        held: list[tuple] = []
        number = None

        def done() -> pa.RecordBatch:
            made = block(number, *map(list, zip(*held, strict=True)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(made, kinds, strict=True)], names)

        for batch in batches:
            for i, (own, dl, terms) in enumerate(zip(batch.column("id").to_pylist(), batch.column("dl").to_pylist(), batch.column("terms").to_pylist(), strict=True)):
                if not held:
                    number = batch.column("mark")[i].as_py()  # of its first document, so no two blocks share it
                held.append((own, dl, terms, batch.column("tfs")[i].values.to_numpy(zero_copy_only=False)))
                if len(held) == BLOCK:
                    yield done()
        if held:
            yield done()

    return run


def _build(corpus: DataFrame, tokens: Column, part_of, idf_of) -> tuple[DataFrame, DataFrame]:
    """(blocks, vocabulary). Every row is a document, rows that share an id too; those without a term are in no block."""
    store, kind = Scratch(corpus.sparkSession, "blocks"), corpus.schema["doc_id"].dataType
    rows = corpus.select(F.col("doc_id").alias("id"), tokens.alias("t")).mapInArrow(_vectors, f"id {kind.simpleString()}, dl int, terms array<string>, tfs array<int>, top string")
    rows = store.put(rows)
    n, length = rows.agg(F.count("*"), F.avg("dl")).first()
    df = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    vocabulary = store.put(idf_of(df, n))
    order = [F.col("top"), F.col("dl"), F.col("id"), F.col("mark")]
    marked = rows.filter("dl > 0").withColumn("mark", F.monotonically_increasing_id())
    sorted_ = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    of = corpus.limit(0).select("doc_id").toArrow().schema.field(0).type
    name = kind.simpleString()
    blocks = sorted_.mapInArrow(_cut(part_of(length or 1.0), of), f"block long, ids array<{name}>, terms array<string>, most array<double>, starts array<int>, docs array<int>, parts array<double>")
    return store.put(blocks), vocabulary


def tfidf_blocks(corpus: DataFrame, text: str = "text", smooth: bool = True, stop: tuple[str, ...] = STOPWORDS) -> Blocks:
    """The index of (doc_id, text) for scores of n idf times tf idf. A null or empty text matches nothing."""
    tokens = lambda c: words(c, stop)
    idf = lambda df, n: df.select("term", "df", tfidf_idf(F.lit(n), F.col("df"), smooth).alias("idf"))
    blocks, vocabulary = _build(corpus, tokens(F.col(text)), lambda _: lambda tf, dl: tf, idf)
    return Blocks(blocks, vocabulary, lambda n, w: n * w * w, tokens)


def bm25_blocks(corpus: DataFrame, text: str = "text", k1: float = 1.3, b: float = 0.7, epsilon: float = 0.25) -> Blocks:
    """The index of (doc_id, text) for BM25 as `lexical.bm25_index` defines it."""
    tokens = lambda c: tokenise(F.coalesce(c, F.lit("")))

    def idf(df: DataFrame, n: int) -> DataFrame:
        raw = df.select("term", "df", bm25_raw(F.lit(n), F.col("df")).alias("raw"))
        mean = raw.agg(F.avg("raw").alias("mean"))
        return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, F.col("mean") * epsilon).otherwise(F.col("raw")).alias("idf"))

    blocks, vocabulary = _build(corpus, tokens(F.col(text)), lambda avgdl: lambda tf, dl: tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)), idf)
    return Blocks(blocks, vocabulary, lambda n, w: n * w, tokens)


class _Asked:
    """A block of queries as a matrix: by term, the queries that have it and their weights."""

    def __init__(self, ids: list, rows: np.ndarray, terms: list[str], weights: np.ndarray) -> None:
        self.ids, self.terms = ids, {t: i for i, t in enumerate(dict.fromkeys(terms))}
        column = np.fromiter((self.terms[t] for t in terms), np.int64, len(terms))
        order = np.lexsort((rows, column))
        self.rows, self.weights = rows[order], weights[order]
        self.starts = np.searchsorted(column[order], np.arange(len(self.terms) + 1))
        self.positive = bool((weights > 0).all())

    def met(self, terms: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a block's terms: numbers of those asked for; and for each query that has one, term by term, which of
        these it is, the query, and its weight."""
        get = self.terms.get
        found = [(i, j) for i, t in enumerate(terms) if (j := get(t)) is not None]
        own = np.array([i for i, _ in found], np.int64)
        lo, hi = self.starts[[j for _, j in found]], self.starts[[j + 1 for _, j in found]]
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(own) else np.zeros(0, np.int64)
        return own, np.repeat(np.arange(len(own)), n), self.rows[at], self.weights[at]

    def bounds(self, most: np.ndarray, met) -> np.ndarray:
        own, term, row, weight = met
        return np.bincount(row, np.maximum(weight, 0) * most[own][term], minlength=len(self.ids))


def _slack(x: np.ndarray) -> np.ndarray:
    """Sums of many terms depend on their order in the last digits."""
    return 10.0**-DIGITS + 1e-12 * np.abs(np.where(np.isfinite(x), x, 0))


def _likely(asked: _Asked, first: int):
    """A task's blocks of highest bound for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, which = np.full((len(asked.ids), first), -np.inf), np.zeros((len(asked.ids), first), np.int64)
        for batch in batches:
            for i, number in enumerate(batch.column("block").to_pylist()):
                met = asked.met(batch.column("terms")[i].as_py())
                bound = asked.bounds(batch.column("most")[i].values.to_numpy(zero_copy_only=False), met)
                seen = np.bincount(met[2], minlength=len(asked.ids)) > 0
                at = np.flatnonzero(seen & (bound > best[:, -1]))
                best[at, -1], which[at, -1] = bound[at], number
                order = np.argsort(-best[at], axis=1, kind="stable")
                best[at], which[at] = np.take_along_axis(best[at], order, 1), np.take_along_axis(which[at], order, 1)
        q, j = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(which[q, j]), pa.array(best[q, j])], ["q", "block", "bound"])

    return run


def _scored(asked: _Asked, k: int, known: np.ndarray, kind: pa.DataType, only: dict[int, list[int]] | None = None):
    """A task's k best documents of each query; known: thresholds, from which a task's own go on; only: the queries that
    a block is scored for. A row without a query tells how many postings there were and how many were scored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor, best = known.copy(), [[] for _ in asked.ids]
        there = scored = 0
        for batch in batches:
            for i, number in enumerate(batch.column("block").to_pylist()):
                own, term, row, weight = met = asked.met(batch.column("terms")[i].as_py())
                starts = batch.column("starts")[i].values.to_numpy(zero_copy_only=False)
                size = np.diff(starts)
                there += int(size[own][term].sum())
                bound = asked.bounds(batch.column("most")[i].values.to_numpy(zero_copy_only=False), met)
                live = np.bincount(row, minlength=len(bound)) > 0
                live &= bound >= floor - _slack(floor)
                if only is not None:
                    live &= np.isin(np.arange(len(bound)), only.get(number, []))
                active = np.flatnonzero(live)
                if not len(active):
                    continue
                scored += int(size[own][term[live[row]]].sum())
                ids = batch.column("ids")[i].as_py()
                docs, parts = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("docs", "parts"))
                dense = np.zeros((len(own), len(ids)))
                n = size[own]
                at = np.repeat(starts[own] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                dense[np.repeat(np.arange(len(own)), n), docs[at]] = parts[at]
                place = np.full(len(bound), -1)
                for lo in range(0, len(active), QUERIES):
                    now = active[lo : lo + QUERIES]
                    place[now] = np.arange(len(now))
                    mine = place[row] >= 0
                    q = np.zeros((len(now), len(own)))
                    q[place[row[mine]], term[mine]] = weight[mine]
                    s = q @ dense
                    hit = s > 0 if asked.positive else ((q != 0).astype(float) @ (dense != 0)) > 0
                    hit &= s >= (floor[now] - _slack(floor[now]))[:, None]
                    for a in np.flatnonzero(hit.any(axis=1)):
                        x = now[a]
                        best[x] = sorted([*best[x], *((-round(float(s[a, j]), DIGITS), ids[j], float(s[a, j])) for j in np.flatnonzero(hit[a]))], key=lambda t: (t[0], t[1] is not None, t[1]))[:k]
                        if len(best[x]) == k:
                            floor[x] = max(floor[x], -best[x][-1][0])
                    place[now] = -1
        q = [x for x, own in enumerate(best) for _ in own]
        flat = [t for own in best for t in own]
        yield pa.RecordBatch.from_arrays([pa.array([*q, None], pa.int32()), pa.array([*(t[1] for t in flat), None], kind), pa.array([*(t[2] for t in flat), float(scored)]), pa.array([None] * len(flat) + [there], pa.int64())], ["q", "id", "score", "there"])

    return run


def search(index: Blocks, queries: DataFrame, k: int = 10, text: str = "text", share: list[float] | None = None) -> DataFrame:
    """(query_id, rank, id, score) of each query's (query_id, text) k best documents among those with a match.

    Scores that agree to DIGITS digits are ties, by id, null first. Queries run in blocks of about QUERY_BLOCK, two scans
    each; a block is all that is sent to tasks. Queries of an equal id are one query. share gets, for each such block,
    the part of all postings of queries' terms that was scored. Queries without a known term and empty tables give no rows.
    """
    spark, store = queries.sparkSession, Scratch(queries.sparkSession, "found")
    q = queries.select("query_id", F.explode(index.tokens(F.col(text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("n"))
    q = store.put(q.join(index.vocabulary.select("term", "idf"), "term").select("query_id", "term", index.weight(F.col("n"), F.col("idf")).alias("w")))
    n = max(1, -(-q.select("query_id").distinct().count() // QUERY_BLOCK))
    key, of = queries.schema["query_id"].dataType, index.blocks.schema["ids"].dataType.elementType
    kind = index.blocks.limit(0).select("ids").toArrow().schema.field(0).type.value_type
    schema = f"q int, id {of.simpleString()}, score double, there long"
    parts = []
    for b in range(n):
        own = q.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b).toPandas().sort_values(["query_id", "term"])
        if not len(own):
            continue
        ids = list(dict.fromkeys(own["query_id"]))
        at = {x: i for i, x in enumerate(ids)}
        asked = _Asked(ids, own["query_id"].map(at).to_numpy(np.int64), own["term"].tolist(), own["w"].to_numpy(np.float64))
        named = spark.createDataFrame(list(enumerate(ids)), f"q int, query_id {key.simpleString()}")
        likely = index.blocks.select("block", "terms", "most").mapInArrow(_likely(asked, FIRST), "q int, block long, bound double")
        chosen = top_k(likely, FIRST, ascending=False, by="q", id_="block", score="bound").select("q", "block").collect()  # FIRST for each query
        only: dict[int, list[int]] = {}
        for r in chosen:
            only.setdefault(r["block"], []).append(r["q"])
        blocks = spark.createDataFrame([(x,) for x in only], "block long")
        seen = index.blocks.join(F.broadcast(blocks), "block", "left_semi").mapInArrow(_scored(asked, k, np.full(len(ids), -np.inf), kind, only), schema)
        known = np.full(len(ids), -np.inf)
        for r in top_k(seen.filter("q is not null"), k, ascending=False, by="q").filter(F.col("rank") == k).select("q", "score").collect():
            known[r["q"]] = r["score"]
        found = store.put(index.blocks.mapInArrow(_scored(asked, k, known, kind), schema))
        if share is not None:
            there, scored = found.filter("q is null").agg(F.sum("there"), F.sum("score")).first()
            share.append((scored or 0) / max(1, there or 0))
        parts.append(found.filter("q is not null").join(F.broadcast(named), "q").select("query_id", "id", "score"))
    if not parts:
        return spark.createDataFrame([], f"query_id {key.simpleString()}, rank int, id {of.simpleString()}, score double")
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    ranked = top_k(out.withColumn("_s", F.round("score", DIGITS)), k, ascending=False, score="_s")
    return ranked.select("query_id", "rank", "id", "score")
