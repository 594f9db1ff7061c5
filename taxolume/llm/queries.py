"""The queries of this subpackage, each over its whole table, and the SQL of those that SQL expresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolume.storage import spread

from . import avi_media, jaccard_tree, lang_mixture, line_dedup, pii, pivot_search, quality, spelling, url_filter, warc, whitening
from .common import held_out
from .jaccard_tree import jaccard_components
from .mixing import mix
from .packing import pack_documents


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of all documents; a table in one small file is dealt over the tasks first."""
    return spread(_table(spark, sf_dir, "documents").select(*columns or ["*"]))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir, "doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    free = labels.filter(F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
    model = quality.fit_ids(docs.filter("not held_out"), free)
    return quality.score(docs, model).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_texts(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_texts(spark, sf_dir, "doc_id", "text"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_texts(spark, sf_dir, "doc_id", "text"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_search.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir, "doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    model = lang_mixture.fit(docs.filter(~F.col("held_out") & F.col("doc_id").isNotNull()))
    return lang_mixture.predict(docs, model, keep=["doc_id", "held_out"])


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.captures(_table(spark, sf_dir, "pages"))
    return found.select(F.col("page").alias("page_id"), "response.payload_bytes", "response.payload_digest", F.col("response.type").alias("record_type"), F.col("refers_to_page").alias("refers_to"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pii.find_spans(_texts(spark, sf_dir, "doc_id", "text")).select("doc_id", "pii")
    base = pii.base_only(F.col("pii"))
    counts = [pii.count_of(F.col("pii"), k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    scores = F.array_join(F.transform("pii", lambda x: F.round(x["score"] * 100).cast("int").cast("string")), ",")
    return docs.select("doc_id", *counts, F.sha2(pii.span_text(base), 256).alias("base_sha256"), pii.span_text(F.col("pii")).alias("spans"), scores.alias("scores"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = avi_media.decode(avi_media.encode_text(_texts(spark, sf_dir, "doc_id", "text")))
    cuts = F.array_join(F.transform("clips", lambda c: F.concat_ws("-", c["start_ms"], c["end_ms"], c["mean"])), ",")
    feature = F.concat(F.lit("frames="), F.col("frames"), F.lit(";clips="), F.size("clips"), F.lit(";"), cuts)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_texts(spark, sf_dir, "doc_id", "text"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeats(_texts(spark, sf_dir, "doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_mixing, op3_packing, op4_jaccard, op5_top_k, op6_language, op7_warc, op8_url_filter, op9_pii, op10_media, op11_spelling, op12_line_dedup, op13_whitening)}
ORACLES: dict[str, str] = {"op4_jaccard": jaccard_tree.SQL, "op5_top_k": pivot_search.SQL, "op7_warc": warc.SQL, "op8_url_filter": url_filter.SQL, "op9_pii": pii.SQL, "op11_spelling": spelling.SQL, "op12_line_dedup": line_dedup.SQL}
