"""Lexical retrieval: TF-IDF and BM25 over posting tables.

Postings are rows (term, doc_id, tf); statistics are small aggregates. A query joins its terms with the postings, so
only documents with a match are touched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxolume.functions.text import STOPWORDS, tokenise
from taxolume.storage import Scratch, told

from .retrieve import top_k


def words(text: Column, stop: tuple[str, ...] = STOPWORDS) -> Column:
    """Lower-cased runs of at least two letters, digits or underscores, without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    return F.filter(found, lambda x: ~x.isin(*stop)) if stop else found


@dataclass
class Index:
    """postings (term, doc_id, weight) and vocabulary (term, df, idf); for BM25 also docs (doc_id)."""

    kind: str
    postings: DataFrame
    vocabulary: DataFrame
    docs: DataFrame

    def save(self, folder: str) -> None:
        """Parquet tables in folder; postings sorted by term within files, so that a term's rows are found by range."""
        self.postings.repartitionByRange("term").sortWithinPartitions("term", F.desc("weight"), "doc_id").write.mode("overwrite").parquet(f"{folder}/postings")
        self.vocabulary.write.mode("overwrite").parquet(f"{folder}/vocabulary")
        self.docs.write.mode("overwrite").parquet(f"{folder}/docs")


def load(spark, folder: str, kind: str) -> Index:
    return Index(kind, *(spark.read.parquet(f"{folder}/{t}") for t in ("postings", "vocabulary", "docs")))


def _frequencies(corpus: DataFrame, tokens: Column) -> DataFrame:
    """(doc_id, dl, term, tf): each document's terms with its length, tokenised once into the shared folder."""
    rows = corpus.select("doc_id", tokens.alias("t")).select("doc_id", F.size("t").alias("dl"), F.explode("t").alias("term"))
    return Scratch(corpus.sparkSession, "terms").put(rows.groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf")))


def tfidf_idf(n: Column, df: Column, smooth: bool = True) -> Column:
    """ln((1 + N) / (1 + df)) + 1, or without smoothing ln(N / df) + 1."""
    one = 1 if smooth else 0
    return F.log((n + one).cast("double") / (df + one)) + 1


def bm25_raw(n: Column, df: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def tfidf_index(corpus: DataFrame, text: str = "text", smooth: bool = True, use_idf: bool = True, normalise: bool = False, stop: tuple[str, ...] = STOPWORDS, only: DataFrame | None = None) -> Index:
    """weight = tf * idf with idf = ln((1 + N) / (1 + df)) + 1 (smooth) or ln(N / df) + 1; rows of norm 1 if asked.

    only: an index for a search that is run once can leave out all but these terms (term); the others' postings would
    not be read. Their statistics are the same, as each term's own do not depend on other terms.
    """
    if only is not None and normalise:
        raise ValueError("norms need all terms")
    tf = _frequencies(corpus, words(F.col(text), stop))
    if only is not None:
        tf = tf.join(told(only.select("term").distinct()), "term", "left_semi")
    n = corpus.agg(F.count("*").alias("n"))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n))
    idf = tfidf_idf(F.col("n"), F.col("df"), smooth) if use_idf else F.lit(1.0)
    vocabulary = df.select("term", "df", idf.alias("idf"))
    postings = tf.join(vocabulary, "term").select("term", "doc_id", (F.col("tf") * F.col("idf")).alias("weight"))
    if normalise:
        norms = postings.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("l"))
        postings = postings.join(norms, "doc_id").select("term", "doc_id", (F.col("weight") / F.col("l")).alias("weight"))
    return Index("tfidf", postings, vocabulary, corpus.select("doc_id"))


def query_terms(queries: DataFrame, text: str = "text", stop: tuple[str, ...] = STOPWORDS, plain: bool = False) -> DataFrame:
    """(term) that a search with these queries reads; plain: as BM25 splits them."""
    return queries.select(F.explode(tokenise(F.col(text)) if plain else words(F.col(text), stop)).alias("term")).distinct()


def tfidf_search(index: Index, queries: DataFrame, k: int | None = 10, text: str = "text", stop: tuple[str, ...] = STOPWORDS) -> DataFrame:
    """(query_id, rank, id, score): sum of query weight times document weight, over documents with a match."""
    q = queries.select("query_id", F.explode(words(F.col(text), stop)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("n"))
    q = q.join(index.vocabulary.select("term", "idf"), "term").select("query_id", "term", (F.col("n") * F.col("idf")).alias("w"))
    hits = index.postings.join(q, "term").groupBy("query_id", F.col("doc_id").alias("id")).agg(F.sum(F.col("w") * F.col("weight")).alias("score"))
    return _rounded_top(hits, k)


def _rounded_top(hits: DataFrame, k: int | None) -> DataFrame:
    """Sums of many terms depend on their order in the last digits: scores that agree to 1e-9 are ties, by id."""
    ranked = top_k(hits.withColumn("_s", F.round("score", 9)), k, ascending=False, score="_s")
    return ranked.select("query_id", "rank", "id", "score")


def bm25_index(corpus: DataFrame, text: str = "text", k1: float = 1.3, b: float = 0.7, epsilon: float = 0.25, only: DataFrame | None = None) -> Index:
    """weight = idf * tf (k1 + 1) / (tf + k1 (1 - b + b dl / avgdl)), idf = ln(N - df + .5) - ln(df + .5); a negative
    idf becomes epsilon times the mean idf of the vocabulary. only: as for tfidf_index; the vocabulary has all terms."""
    tf = _frequencies(corpus, tokenise(F.coalesce(F.col(text), F.lit(""))))
    n = corpus.agg(F.count("*").alias("n"))
    stats = tf.agg(F.sum("tf").alias("tokens")).crossJoin(n).select("n", (F.col("tokens") / F.col("n")).alias("avgdl"))
    raw = tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats)).select("term", "df", bm25_raw(F.col("n"), F.col("df")).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    vocabulary = raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, F.col("mean") * epsilon).otherwise(F.col("raw")).alias("idf"))
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / F.col("avgdl")))
    own = tf if only is None else tf.join(told(only.select("term").distinct()), "term", "left_semi")
    postings = own.crossJoin(F.broadcast(stats)).join(vocabulary, "term").select("term", "doc_id", (F.col("idf") * part).alias("weight"))
    return Index("bm25", postings, vocabulary, corpus.select("doc_id"))


def bm25_search(index: Index, queries: DataFrame, k: int | None = 10, text: str = "text") -> DataFrame:
    """(query_id, rank, id, score): weights of the query's tokens, repeats counted; only with k None do documents
    without a match appear, with score 0."""
    q = queries.select("query_id", F.explode(tokenise(F.col(text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("n"))
    hits = index.postings.join(q, "term").groupBy("query_id", F.col("doc_id").alias("id")).agg(F.sum(F.col("n") * F.col("weight")).alias("score"))
    if k is None:
        every = queries.select("query_id").join(index.docs.select(F.col("doc_id").alias("id")))
        hits = every.join(hits, ["query_id", "id"], "left").fillna(0.0, ["score"])
    return _rounded_top(hits, k)
