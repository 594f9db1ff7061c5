"""From raw documents to packed sequences: language, near-duplicates, personal data, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run()
writes each stage's rows as Parquet into the shared folder and reads them back, so a lost executor costs one stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolume.llm import lang_mixture, pii
from taxolume.llm.common import held_out
from taxolume.llm.jaccard_tree import jaccard_components
from taxolume.llm.mixing import repeated
from taxolume.llm.packing import pack_documents
from taxolume.storage import Scratch, delete, shared_dir, spread, told


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those whose language is unknown (no text, no letter) go, all of them if nothing is
    labelled. Nothing is learned from rows without an id or language. Other columns, and repeated rows, stay."""
    model = lang_mixture.fit(docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))
    found = lang_mixture.predict(docs, model, pred="_lang", score="_score", languages="_set", keep=docs.columns)
    return found.filter(F.col("_lang") != lang_mixture.UNKNOWN).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows linked by shared 5-word shingles, the one with the smallest doc_id, null being the largest;
    of several with that id, the first by text hash and the other columns.

    Where ids are null or repeated, each row is a document of its own and is joined by its place in that order. Rows
    without words are linked with nothing and stay. What is joined with the documents is the list of those that go.
    """
    if docs.groupBy("doc_id").count().filter("doc_id is null or count > 1").isEmpty():
        gone = jaccard_components(docs).filter("component_id <> doc_id").select("doc_id")
        return docs.join(told(gone), "doc_id", "left_anti").select(*docs.columns)
    # Rows that agree in all columns can change places; _any spreads them over the sort's ranges.
    order = [F.col("doc_id").asc_nulls_last(), F.sha2("text", 256), *[F.col(c) for c in docs.columns if c not in ("doc_id", "text")], "_any"]
    rows = docs.withColumn("_any", F.monotonically_increasing_id()).orderBy(*order).withColumn("_row", F.monotonically_increasing_id()).drop("_any")
    rows = Scratch(spark, "rows").put(rows)
    gone = jaccard_components(rows, key="_row").filter("component_id <> _row").select("_row")
    return rows.join(told(gone), "_row", "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and n_chars counted anew. Null and empty texts stay as they
    are (n_chars of a null text is null), repeated rows too; an empty table gives no rows."""
    clean = pii.redact(pii.find_spans(docs, out="_pii"), spans="_pii")
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them, none more than twice. A null source is a source; texts
    without words, null ones included, are not taken; equal rows are together as many as are taken of them."""
    return repeated(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens. Documents that the mixture repeats are packed each time;
    null ids stay null, an empty text is its end token alone, and an empty table gives no sequences."""
    return pack_documents(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixture", mixture), ("packing", packing)]
#: Local search and tokenizing are not SQL; tests/llm/test_queries.py holds run() against a plain version, stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Stages are written to the shared folder; a stage's table is deleted once the next one is
    written, the last one stays."""
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4()}"
    docs, before = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if before:
            delete(spark, f"{at}/{before}")
        before = name
    return docs
