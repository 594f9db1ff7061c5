"""Queries over labels, vocabularies and text search."""

from __future__ import annotations

from pyspark.sql import functions as F

from taxolume.functions import text as T
from taxolume.operators import blockmax as B
from taxolume.operators import lexical as L
from taxolume.operators import sets as S
from taxolume.storage import spread

from .views import r6, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"
_BROAD = ", ".join(f"'{w}'" for w in T.BROAD)
#: Names with parentheses, as lexicons have them.
PARTS = "parts AS (SELECT p_partkey AS id, 'http://id.test/C' || p_partkey AS iri, p_name || ' (' || p_brand || ') of' || ' (' || p_type || ')' AS name, p_type, p_name, p_brand FROM part)"


def parts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    name = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(") of"), F.lit(" ("), "p_type", F.lit(")"))
    return p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("http://id.test/C"), F.col("p_partkey").cast("string")).alias("iri"), name.alias("name"), "p_type", "p_name", "p_brand")


@query(rf"WITH {PARTS} SELECT id, regexp_replace(name, '\s*\([^)]*\)', '', 'g') AS label FROM parts")
def strip_parens(spark, sf_dir):
    return parts(spark, sf_dir).select("id", T.strip_parens(F.col("name")).alias("label"))


@query(f"SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '[{T.SPACES}]+'), lambda x: x <> '') AS tokens FROM conversations")
def tokenise(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.tokenise(F.col("text")).alias("tokens"))


@query("SELECT conv_id, turn, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS mention FROM conversations")
def normalise_mention(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.normalise_mention(F.col("text")).alias("mention"))


@query(f"SELECT item_id, list_sort(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z]+')), lambda x: NOT list_contains({_STOP}, x))) AS words FROM benchmark")
def lexical_repr(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_sort(T.content_words(F.col("text"))).alias("words"))


_W = f"list_filter(list_distinct(regexp_extract_all(lower({{}}), '[a-z]+')), lambda x: NOT list_contains({_STOP}, x))"


@query(f"WITH n AS (SELECT item_id, text, lead(text) OVER (ORDER BY item_id) AS other FROM benchmark), o AS (SELECT item_id, len(list_intersect({_W.format('text')}, {_W.format('other')}))::INTEGER AS overlap FROM n WHERE other IS NOT NULL) SELECT item_id, overlap FROM o WHERE overlap >= 2")
def overlap_filter(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    nxt = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return b.join(nxt, "item_id").select("item_id", T.overlap(F.col("text"), T.content_words(F.col("other"))).alias("overlap")).filter("overlap >= 2")


@query(f"SELECT p_partkey AS id, lower(split_part(CASE p_size % 4 WHEN 0 THEN 'Disease (' WHEN 1 THEN 'Body Structure (' ELSE p_type || ' (' END || p_brand || ')', ' (', 1)) IN ({_BROAD}) AS broad FROM part")
def broad_filter(spark, sf_dir):
    head = F.when(F.col("p_size") % 4 == 0, F.lit("Disease (")).when(F.col("p_size") % 4 == 1, F.lit("Body Structure (")).otherwise(F.concat("p_type", F.lit(" (")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.is_broad(F.concat(head, "p_brand", F.lit(")"))).alias("broad"))


@query(r"SELECT page_id, coalesce(nullif(regexp_extract(url, '(\d+)$', 1), '')::BIGINT, 9223372036854775807) AS number, url AS iri, nullif(regexp_extract(url, '(\d+)$', 1), '') AS digits, list_extract(string_split(url, '/'), -1) AS base FROM pages")
def numeric_key(spark, sf_dir):
    k = T.numeric_key(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", k["number"].alias("number"), k["iri"].alias("iri"), T.number_of(F.col("url"), required=False).alias("digits"), T.basename(F.col("url")).alias("base"))


@query(r"SELECT o_orderkey AS id, regexp_extract('Release_' || strftime(o_orderdate, '%Y%m%d') || 'T120000Z.zip', '(\d{8})T', 1) AS version, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS at FROM orders")
def release_version(spark, sf_dir):
    name = F.concat(F.lit("Release_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("T120000Z.zip"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), T.release_version(name).alias("version"), T.isotime(F.col("o_orderdate")).alias("at"))


_CAMEL = "regexp_extract_all(phrase, '[A-Z]+|[^A-Z]+')"


@query(f"""WITH p AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'hasFactor' || c_mktsegment WHEN 1 THEN 'StageIIPart' WHEN 2 THEN 'VIII' ELSE lower(c_mktsegment) || 'DNATest' END AS phrase FROM customer),
s AS (SELECT id, {_CAMEL} AS parts FROM p)
SELECT id, trim(array_to_string(list_transform(parts, lambda x: CASE
  WHEN NOT regexp_matches(x[-1], '[A-Z]') THEN x || ' '
  WHEN length(x) = 1 THEN lower(x)
  WHEN len(parts) > 1 AND x NOT IN ('II','III','IV','V','VI','VII','VIII','IX') THEN x[1:length(x) - 1] || ' ' || lower(x[-1])
  ELSE x END), '')) AS words FROM s""")
def camel_split(spark, sf_dir):
    m = F.col("c_custkey") % 4
    phrase = F.when(m == 0, F.concat(F.lit("x#hasFactor"), "c_mktsegment")).when(m == 1, "StageIIPart").when(m == 2, "VIII").otherwise(F.concat(F.lower("c_mktsegment"), F.lit("DNATest")))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), T.split_camel(phrase).alias("words"))


_RAW = PARTS + ", raw AS (SELECT id, iri, CASE WHEN id % 7 = 0 THEN NULL ELSE [name, p_type] END AS label FROM parts)"


def _raw(spark, sf_dir):
    return parts(spark, sf_dir).select("id", "iri", F.when(F.col("id") % 7 != 0, F.array("name", "p_type")).alias("label"))


@query(rf"WITH {_RAW} SELECT iri, coalesce(lower(regexp_replace(label[1], '\s*\([^)]*\)', '', 'g')), 'owl:Thing') AS name, coalesce(label[1], 'owl:Thing') AS plain FROM raw")
def lexicon_preprocess(spark, sf_dir):
    return _raw(spark, sf_dir).select("iri", T.lexicon_name(F.col("label")).alias("name"), T.lexicon_name(F.col("label"), strip=False).alias("plain"))


@query(rf"WITH {PARTS} SELECT id::VARCHAR AS mapping_id, name AS label, lower(regexp_replace(name, '\s*\([^)]*\)', '', 'g')) AS verbalisation, iri FROM parts")
def entity_mapping(spark, sf_dir):
    return parts(spark, sf_dir).select(F.col("id").cast("string").alias("mapping_id"), F.col("name").alias("label"), T.verbalisation(F.col("name")).alias("verbalisation"), "iri")


_WORDS = f"list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: NOT list_contains({_STOP}, x))"
_TF = f"tf AS (SELECT doc_id, t AS term, count(*) AS tf FROM (SELECT doc_id, unnest({_WORDS}) AS t FROM documents) GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents), v AS (SELECT term, count(*) AS df, ln((1.0 + n) / (1 + count(*))) + 1 AS idf FROM tf, n GROUP BY term, n)"


def _corpus(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"WITH {_TF} SELECT v.term, df, round(idf, 6) AS idf, round(sum(tf * idf), 4) AS weight, count(*) AS postings FROM v JOIN tf USING (term) GROUP BY v.term, df, idf")
def tfidf_index(spark, sf_dir):
    index = L.tfidf_index(_corpus(spark, sf_dir))
    p = index.postings.groupBy("term").agg(F.round(F.sum("weight"), 4).alias("weight"), F.count("*").alias("postings"))
    return index.vocabulary.join(p, "term").select("term", "df", r6(F.col("idf")).alias("idf"), "weight", "postings")


@query(f"WITH {_TF}, w AS (SELECT doc_id, tf * idf AS w FROM tf JOIN v USING (term)) SELECT doc_id, round(sqrt(sum(w * w)), 4) AS length, count(*) AS terms FROM w GROUP BY doc_id")
def tfidf_lengths(spark, sf_dir):
    index = L.tfidf_index(_corpus(spark, sf_dir))
    return index.postings.groupBy("doc_id").agg(F.round(F.sqrt(F.sum(F.col("weight") * F.col("weight"))), 4).alias("length"), F.count("*").alias("terms"))


_RANK = "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id)::INTEGER AS rank FROM s) SELECT query_id, rank, id, round(score, 5) AS score FROM r WHERE rank <= 10"


@query(f"WITH {_TF}, q AS (SELECT query_id, term, count(*) AS n FROM (SELECT item_id AS query_id, unnest({_WORDS}) AS term FROM benchmark) GROUP BY ALL), s AS (SELECT query_id, doc_id AS id, sum(q.n * idf * tf * idf) AS score FROM q JOIN v USING (term) JOIN tf USING (term) GROUP BY ALL), {_RANK}")
def tfidf_search(spark, sf_dir):
    asked = _asked(spark, sf_dir)
    return B.search(B.tfidf_blocks(_corpus(spark, sf_dir)), asked).withColumn("score", F.round("score", 5))


_TOK = f"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[{T.SPACES}]+'), lambda x: x <> '')"
_BM = f"""tok AS (SELECT doc_id, {_TOK} AS t FROM documents), dl AS (SELECT doc_id, len(t) AS dl FROM tok), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tok) GROUP BY ALL),
raw AS (SELECT term, count(*) AS df, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, st GROUP BY term, n), m AS (SELECT avg(raw) AS mean FROM raw),
v AS (SELECT term, df, CASE WHEN raw < 0 THEN mean * 0.25 ELSE raw END AS idf FROM raw, m)"""


@query(f"WITH {_BM} SELECT count(*) AS terms, sum(df)::BIGINT AS postings, round(avg(idf), 5) AS mean_idf, round(min(idf), 5) AS least_idf, (SELECT round(avgdl, 5) FROM st) AS avgdl FROM v")
def bm25_stats(spark, sf_dir):
    c = _corpus(spark, sf_dir)
    avgdl = c.agg(F.round(F.avg(F.size(T.tokenise(F.col("text")))), 5).alias("avgdl"))
    v = L.bm25_index(c).vocabulary.agg(F.count("*").alias("terms"), F.sum("df").alias("postings"), F.round(F.avg("idf"), 5).alias("mean_idf"), F.round(F.min("idf"), 5).alias("least_idf"))
    return v.crossJoin(F.broadcast(avgdl))


@query(f"WITH {_BM}, q AS (SELECT query_id, term, count(*) AS n FROM (SELECT item_id AS query_id, unnest({_TOK}) AS term FROM benchmark) GROUP BY ALL), s AS (SELECT query_id, tf.doc_id AS id, sum(q.n * idf * (tf * 2.3::DOUBLE / (tf + 1.3::DOUBLE * (1 - 0.7::DOUBLE + 0.7::DOUBLE * dl / avgdl)))) AS score FROM q JOIN v USING (term) JOIN tf USING (term) JOIN dl USING (doc_id), st GROUP BY ALL), {_RANK}")
def bm25_search(spark, sf_dir):
    asked = _asked(spark, sf_dir)
    return B.search(B.bm25_blocks(_corpus(spark, sf_dir)), asked).withColumn("score", F.round("score", 5))


_VOC = r"a AS (SELECT DISTINCT lower(w) AS word FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark)), b AS (SELECT DISTINCT lower(w) AS word FROM (SELECT unnest(string_split(text, ' ')) AS w FROM conversations))"


def _vocabularies(spark, sf_dir):
    words = lambda t: table(spark, sf_dir, t).select(F.explode(F.split("text", " ")).alias("word"))
    return words("benchmark"), words("conversations")


@query(f"WITH {_VOC} SELECT word FROM a INTERSECT SELECT word FROM b")
def set_intersection(spark, sf_dir):
    return S.intersection(*_vocabularies(spark, sf_dir))


@query(f"WITH {_VOC} SELECT word FROM a EXCEPT SELECT word FROM b")
def set_difference(spark, sf_dir):
    return S.difference(*_vocabularies(spark, sf_dir))


@query(f"WITH {_VOC}, c AS (SELECT count(*) AS n_a, count(b.word) AS n_common FROM a LEFT JOIN b ON a.word = b.word) SELECT n_a, n_common, n_a - n_common AS n_only, regexp_replace(regexp_replace(format('{{:.2f}}', 100.0 * n_common / n_a), '0+$', ''), '\\.$', '') AS percent FROM c")
def set_coverage(spark, sf_dir):
    return S.coverage(*_vocabularies(spark, sf_dir))


@query("SELECT DISTINCT trim(w) AS word FROM (SELECT unnest(string_split(text, ',')) AS w FROM conversations) WHERE trim(w) <> ''")
def distinct_entities(spark, sf_dir):
    return S.distinct_trimmed(table(spark, sf_dir, "conversations").select(F.explode(F.split("text", ",")).alias("w")), F.col("w"))


@query("SELECT p_partkey AS id, p_brand, p_type FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS n FROM part) WHERE n = 1")
def structural_dedup(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return S.structural_distinct(p, T.signature("p_type", "p_brand"), "p_partkey").select(F.col("p_partkey").alias("id"), "p_brand", "p_type")


@query("SELECT iri, name, 'mc-' || lpad(row_number() OVER (ORDER BY md5('7:' || iri), iri)::VARCHAR, 4, '0') AS sample_id FROM (SELECT 'http://id.test/C' || p_partkey AS iri, p_name AS name FROM part WHERE length(p_name) > 5 ORDER BY md5('7:' || iri), iri LIMIT 50)")
def deterministic_sample(spark, sf_dir):
    p = parts(spark, sf_dir).filter(T.is_long(F.col("p_name"))).select("iri", F.col("p_name").alias("name"))
    return S.sample(p, "iri", 50, 7)
