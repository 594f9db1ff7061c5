"""Queries that go through sources and sinks and back, and flows made of several operators."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from taxolume.functions import vector as V
from taxolume.operators import axioms as A
from taxolume.operators import graph as G
from taxolume.operators import lexical as L
from taxolume.operators import metrics as M
from taxolume.operators import pairs as P
from taxolume.operators import qa as Q
from taxolume.operators import retrieve as R
from taxolume.operators import sets as S
from taxolume.operators import tagger
from taxolume.sources import io, turtle
from taxolume.storage import Scratch, numbered, shared_dir

from .evaluation import _PAIRS, _scored
from .graphs import _EXPR, _TRIPLES, _axioms, _expressions, _triples
from .questions import _LINES, _MCQA, LETTER, hashed_letter, prompt_sql, questions
from .views import ASKED, EDGES, K, NEIGHBOURS, PATHS, PLACES, POINTS, SAME, asked, edges, neighbours, places, points, r6, same_as, sql_poincare, sql_subsumption, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/flow-{uuid.uuid4()}"


def _local(path: str) -> str:
    return path.removeprefix("file:")


# Sources and sinks: written to the shared folder, read back.


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def json_lines_round_trip(spark, sf_dir):
    """Rows as JSON lines, a folder a key, and back."""
    c, at = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal"), _folder(spark)
    io.write_json(c, at, by="c_nationkey")
    return io.read_jsonl(spark, at, "c_custkey long, c_name string, c_nationkey int, c_acctbal double").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")


@query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS position, n_nationkey::VARCHAR AS key, n_name AS value FROM nation")
def json_object_in_order(spark, sf_dir):
    rows, at = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect(), _folder(spark)  # 25 rows
    spark.createDataFrame([(json.dumps({str(r.n_nationkey): r.n_name for r in rows}),)], "value string").coalesce(1).write.text(at)
    return io.read_map(spark, at).select(F.col("position").cast("long").alias("position"), "key", "value")


@query("SELECT 'map' AS shape, n_nationkey::VARCHAR AS key, n_name AS value FROM nation UNION ALL SELECT 'list', n_nationkey::VARCHAR, n_name FROM nation")
def json_list_or_object(spark, sf_dir):
    rows, at = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect(), _folder(spark)  # 25 rows, keys 0 to 24
    spark.createDataFrame([(json.dumps({str(r.n_nationkey): r.n_name for r in rows}),)], "value string").coalesce(1).write.text(f"{at}/map")
    spark.createDataFrame([(json.dumps([r.n_name for r in rows]),)], "value string").coalesce(1).write.text(f"{at}/list")
    read = lambda shape: io.read_rows_or_map(spark, f"{at}/{shape}", "string").withColumn("shape", F.lit(shape))
    return read("map").union(read("list"))


@query("SELECT c_custkey AS id, c_nationkey AS n, c_name AS label FROM customer UNION ALL SELECT c_custkey, -1, c_name FROM customer WHERE c_custkey % 3 = 0")
def metrics_table_round_trip(spark, sf_dir):
    """Two appended tables under one header."""
    c, at = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("n"), F.col("c_name").alias("label")), _folder(spark)
    io.append_metrics(c, at, "\t")
    io.append_metrics(c.filter("id % 3 = 0").withColumn("n", F.lit(-1)), at, "\t")
    return io.read_metrics(spark, at, "id long, n int, label string", "\t")


@query("SELECT 'N' || n_nationkey AS s, 'iri' AS s_kind, 'rdfs:subClassOf' AS p, 'R' || n_regionkey AS o, 'iri' AS o_kind FROM nation UNION ALL SELECT '_:b' || n_nationkey, 'bnode', 'rdfs:label', n_name, 'literal' FROM nation UNION ALL SELECT NULL, NULL, NULL, 'no triple ' || r_regionkey, 'malformed' FROM region")
def ntriples_round_trip(spark, sf_dir):
    n, at = table(spark, sf_dir, "nation"), _folder(spark)
    k = F.col("n_nationkey").cast("string")
    lines = n.select(F.concat(F.lit("<N"), k, F.lit("> <rdfs:subClassOf> <R"), F.col("n_regionkey").cast("string"), F.lit("> .")).alias("value"))
    lines = lines.union(n.select(F.concat(F.lit("_:b"), k, F.lit(' <rdfs:label> "'), "n_name", F.lit('"@en . ')))).union(spark.createDataFrame([("# a comment",), ("",)], "value string"))
    lines.union(table(spark, sf_dir, "region").select(F.concat(F.lit("no triple "), F.col("r_regionkey").cast("string")))).write.text(at)
    return io.read_ntriples(spark, at, strict=False)


@query(f"WITH {_TRIPLES}, x AS (SELECT s, s_kind, p, o || CASE WHEN o_kind = 'literal' THEN ' . \"é\"' || chr(10) || ' @prefix' ELSE '' END AS o, o_kind FROM triples) SELECT * FROM x")
def turtle_round_trip(spark, sf_dir):
    """Triples as Turtle with prefixes, escapes and strings over several lines, in several files and blocks, and back."""
    t, at = _triples(spark, sf_dir), _folder(spark)
    node = lambda c, kind: F.when(F.col(kind) == "iri", F.concat(F.lit("<"), F.replace(c, F.lit(" "), F.lit("\\u0020")), F.lit(">"))).when(F.col(kind) == "bnode", F.col(c)).otherwise(F.concat(F.lit('\"\"\"'), c, F.lit(' . \\"\\u00e9\\"\n @prefix\"\"\"@en')))
    said = t.select(F.col("s_kind"), F.col("s"), F.concat("p", F.lit(" "), node("o", "o_kind")).alias("po"))
    own = said.groupBy("s", "s_kind").agg(F.array_join(F.array_sort(F.collect_list("po")), " ;\n  ").alias("po"))
    lines = own.select("s", F.concat(node("s", "s_kind"), F.lit(" "), "po", F.lit(" .")).alias("value")).repartitionByRange(3, "s").sortWithinPartitions("s").select("value")
    head = "\n".join(f"@prefix {p}: <{n}> ." for p, n in turtle.NAMESPACES.items())
    lines.withColumn("value", F.concat(F.lit(head + "\n"), "value")).write.text(at)
    return turtle.compact(turtle.read_turtle(spark, at))


@query("SELECT vec_id AS mapping_id, 'm' AS model, embedding AS vec FROM embeddings")
def matrix_file_round_trip(spark, sf_dir):
    """Vectors as a matrix file and back; ids are rows."""
    import os

    import numpy as np

    at = _local(_folder(spark))
    os.makedirs(at)
    np.save(f"{at}/m.npy", np.array(table(spark, sf_dir, "embeddings").orderBy("vec_id").toPandas()["embedding"].tolist(), np.float32))
    io.vectors_from_npy(spark, f"{at}/m.npy", f"{at}/vectors", "m", 300)
    return spark.read.parquet(f"{at}/vectors")


@query("SELECT 'nf1' AS kind, s_suppkey AS first, s_nationkey::BIGINT AS second, NULL::BIGINT AS third FROM supplier UNION ALL SELECT 'nf4', 1, s_suppkey, s_nationkey FROM supplier")
def form_files_round_trip(spark, sf_dir):
    s, at = table(spark, sf_dir, "supplier"), _local(_folder(spark))
    n = F.col("s_nationkey").cast("long")
    forms = s.select(F.lit("nf1").alias("kind"), F.col("s_suppkey").alias("first"), n.alias("second"), F.lit(None).cast("long").alias("third")).union(s.select(F.lit("nf4"), F.lit(1).cast("long"), "s_suppkey", n))
    io.forms_to_npy(forms, at)
    return io.forms_from_npy(spark, at).drop("row")


def _example_lines(spark, sf_dir, folder):
    e = places(spark, sf_dir)
    both = e.select("child", "parent", F.array("child", "parent").alias("random_negatives"), F.array("parent").alias("hard_negatives"))
    for split, own in (("train", both.filter("child like 'S%'")), ("val", both.filter("child like 'N%'"))):
        rows = own.select(F.to_json(F.struct(*own.columns, F.col("random_negatives").alias("negative"))).alias("value")).orderBy("value")
        rows.coalesce(1).write.text(f"{folder}/{split}.jsonl")


@query(f"WITH {PLACES}, e AS (SELECT CASE WHEN child LIKE 'S%' THEN 'train' ELSE 'val' END AS split, child, parent FROM edges) SELECT split, child, parent, [child] AS negative FROM e")
def training_examples(spark, sf_dir):
    """Example files, the first negative only."""
    at = _folder(spark)
    _example_lines(spark, sf_dir, at)
    out = [df.withColumn("split", F.lit(s)) for s, df in io.read_examples(spark, at, ("train", "val")).items()]
    return out[0].union(out[1])


@query(f"WITH {PLACES} SELECT 'triplet' AS shape, lower(child) AS child, lower(parent) AS parent, lower(child) AS negative, NULL::INTEGER AS label FROM edges UNION ALL SELECT 'triplet', lower(child), lower(parent), lower(parent), NULL FROM edges UNION ALL SELECT 'pair', lower(child), lower(parent), NULL, 1 FROM edges UNION ALL SELECT 'pair', lower(child), lower(parent), NULL, 0 FROM edges")
def downloaded_dataset(spark, sf_dir):
    """Triplets with random negatives and pairs with hard ones, ids replaced by names."""
    at, e = _folder(spark), places(spark, sf_dir)
    _example_lines(spark, sf_dir, at)
    names = e.select(F.col("child").alias("id")).union(e.select("parent")).distinct().withColumn("name", F.lower("id"))
    t, p = io.read_dataset(spark, at, names), io.read_dataset(spark, at, names, "hard", "pair")
    rows = [t[s].select(F.lit("triplet").alias("shape"), "child", "parent", "negative", F.lit(None).cast("int").alias("label")) for s in ("train", "val")]
    rows += [p[s].select(F.lit("pair").alias("shape"), "child", "parent", F.lit(None).cast("string").alias("negative"), "label") for s in ("train", "val")]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


_ANNOTATED = "q AS (SELECT s_suppkey AS k, 'S:' || s_suppkey AS id, 'N:' || s_nationkey AS n, 'R:' || n_regionkey AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def _annotated(spark, sf_dir):
    """Annotated queries for suppliers, written as one JSON document and read back; every third has an equivalent class."""
    s, at = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")), _folder(spark)
    c = lambda p, k, d: F.struct(F.concat(F.lit(p), F.col(k).cast("string")).alias("iri"), F.lit(d).alias("depth"))
    none = F.filter(F.array(c("S:", "s_suppkey", 0)), lambda x: F.lit(False))
    rows = s.select(
        F.col("s_suppkey").cast("string").alias("internal_id"), c("S:", "s_suppkey", 0).alias("target_entity"), F.array(c("N:", "s_nationkey", 1)).alias("parent_entities"), F.array(c("R:", "n_regionkey", 2)).alias("ancestors"),
        F.when(F.col("s_suppkey") % 3 == 0, F.array(c("E:", "s_suppkey", 0))).otherwise(none).alias("equivalent_classes"),
    )
    rows.write.json(at)
    return io.read_jsonl(spark, at, io.QUERY)


@query(f"WITH {_ANNOTATED}, t AS (SELECT k, id, 0 AS depth FROM q UNION ALL SELECT k, n, 1 FROM q UNION ALL SELECT k, r, 2 FROM q) SELECT k::VARCHAR AS query_id, id, depth, k % 3 = 0 AS equivalent, 'all' AS which FROM t UNION ALL SELECT k::VARCHAR, id, 0, k % 3 = 0, 'single' FROM q")
def query_targets(spark, sf_dir):
    some, other = io.split_by_equivalents(_annotated(spark, sf_dir))
    part = lambda df, e, single: io.query_targets(df, single).select("*", F.lit(e).alias("equivalent"), F.lit("single" if single else "all").alias("which"))
    return part(some, True, False).union(part(other, False, False)).union(part(some, True, True)).union(part(other, False, True))


@query(f"WITH {_ANNOTATED} SELECT DISTINCT id FROM q")
def target_ids(spark, sf_dir):
    return G.target_ids(_annotated(spark, sf_dir))


@query("SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS transformed FROM supplier WHERE s_suppkey % 2 = 0 AND s_name <> ''")
def with_literal(spark, sf_dir):
    return io.with_literal(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("transformed")))


_BENCH = "SELECT 'parts' AS dataset, n_nationkey::VARCHAR AS question_id, 'q ' || n_name AS question, 'A,B' AS letters, n_name || ',none' AS texts, 'A' AS answer FROM nation"


@query(_BENCH)
def benchmark_file(spark, sf_dir):
    """A benchmark document {dataset: {id: question}}, flattened."""
    rows, at = table(spark, sf_dir, "nation").collect(), _folder(spark)  # 25 rows
    doc = {"parts": {str(r.n_nationkey): {"question": f" q {r.n_name} ", "options": {"A": r.n_name, "B": " none"}, "answer": "A"} for r in rows}}
    spark.createDataFrame([(json.dumps(doc),)], "value string").coalesce(1).write.text(at)
    return io.read_questions(spark, at).select("dataset", "question_id", "question", F.array_join("options.letter", ",").alias("letters"), F.array_join("options.text", ",").alias("texts"), "answer")


# Lexical.

_TERMS = "w AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}'), lambda x: NOT list_contains(['%s'], x)) AS t FROM benchmark), tf AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(t) AS term FROM w) GROUP BY ALL), v AS (SELECT term, count(*) AS df, ln((1 + (SELECT count(*) FROM benchmark)) / (1.0::DOUBLE + count(*))) + 1 AS idf FROM tf GROUP BY term), p AS (SELECT item_id, term, tf * idf AS w FROM tf JOIN v USING (term)), n AS (SELECT item_id, sqrt(sum(w * w)) AS l FROM p GROUP BY item_id)" % "', '".join(L.STOPWORDS)


@query(f"WITH {_TERMS} SELECT term, item_id AS doc_id, round(w / l, 6) AS weight FROM p JOIN n USING (item_id)")
def tfidf_index_saved(spark, sf_dir):
    """Rows of norm 1, saved and loaded."""
    at = _folder(spark)
    L.tfidf_index(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text"), normalise=True).save(at)
    return L.load(spark, at, "tfidf").postings.select("term", "doc_id", r6(F.col("weight")).alias("weight"))


# Retrieval.


@query(f"WITH {ASKED}, s AS (SELECT query_id, id, {sql_poincare('q', 'vec')} AS score FROM asked, points WHERE TRUE), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), id)::INTEGER AS rank FROM s) SELECT query_id, rank, 'iri/' || id AS iri, round(score, 6) AS score, 'point ' || id AS verbalisation FROM r WHERE rank <= 5")
def retriever_by_model(spark, sf_dir):
    """A retriever made for a model from the common folder of vectors; norms are kept with its table."""
    pts = points(spark, sf_dir)
    vectors = pts.select(F.col("id").alias("mapping_id"), F.lit("hit").alias("model"), "vec").union(pts.select("id", F.lit("ont"), F.transform("vec", lambda x: x / 2)))
    return R.Retrievers(vectors, _entities(pts), K).make("hit").top(asked(pts).select("query_id", "q"), 5).withColumn("score", r6(F.col("score")))


def _entities(pts):
    k = F.col("id").cast("string")
    return pts.select(F.col("id").alias("mapping_id"), F.concat(F.lit("iri/"), k).alias("iri"), F.concat(F.lit("point "), k).alias("verbalisation"))


@query(f"WITH {ASKED}, s AS (SELECT query_id, id, {sql_subsumption('q', 'vec', 0.35)} AS score FROM asked, points), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM s) SELECT query_id, rank, 'iri/' || id AS iri, round(score, 6) AS score FROM r WHERE rank <= 5")
def search_by_name(spark, sf_dir):
    """The service's method hit with its score function; the weight 0 stands for 0.35."""
    pts = points(spark, sf_dir)
    found = Q.search_by_name(asked(pts).select("query_id", "q"), pts.select("id", "vec"), _entities(pts), "hit", "entity-subsumption", 5, 0.0, K)
    return found.select("query_id", "rank", "iri", r6(F.col("score")).alias("score"))


_SCORED = ASKED + ", s AS (SELECT query_id, id, list_inner_product(q, vec) AS score FROM asked, points WHERE id <> query_id), rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s), cand AS (SELECT query_id // 300 AS question_id, query_id AS mention_id, id, score FROM rk WHERE rank <= 5)"


@query(f"WITH {_SCORED} SELECT question_id, mention_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id, mention_id)::INTEGER AS place FROM cand")
def entity_selector_by_score(spark, sf_dir):
    """Candidates where a larger score is better."""
    pts = points(spark, sf_dir)
    found = R.retrieve(asked(pts).select("query_id", "q"), pts.select("id", "vec"), "inner", 20, K)
    ranked = found.select(F.floor(F.col("query_id") / 300).cast("long").alias("question_id"), F.col("query_id").alias("mention_id"), "rank", "id", "score")
    return R.select_entities(ranked, 5, 20, ascending=False).select("question_id", "mention_id", "id", r6(F.col("score")).alias("score"), "place")


@query("SELECT count(*) AS rows FROM embeddings")
def aligned_tables(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    R.assert_aligned(e, points(spark, sf_dir))
    return e.agg(F.count("*").alias("rows"))


# Graphs.

_SETS = _TRIPLES + ", " + PLACES + PATHS + """, k AS (SELECT node, ancestor, depth, coalesce(nullif(regexp_extract(ancestor, '(\\d+)$', 1), '')::BIGINT, 9223372036854775807) AS n FROM closure),
h AS (SELECT node, list_transform(list_sort(list({'d': depth, 'n': n, 'a': ancestor}) FILTER (depth = 1)), lambda x: x.a) AS parents, coalesce(list_transform(list_sort(list({'d': depth, 'n': n, 'a': ancestor}) FILTER (depth > 1)), lambda x: x.a), []) AS ancestors FROM k GROUP BY node),
r AS (SELECT a.s AS node, list_sort(list(DISTINCT {'property': p.o, 'filler': f.o})) AS restrictions FROM triples a JOIN triples p ON a.o = p.s AND p.p = 'owl:onProperty' JOIN triples f ON a.o = f.s AND f.p = 'owl:someValuesFrom' WHERE a.p = 'rdfs:subClassOf' AND a.o_kind = 'bnode' GROUP BY a.s),
nodes AS (SELECT child AS node FROM edges UNION SELECT parent FROM edges)"""


@query(f"WITH RECURSIVE {_SETS} SELECT nodes.node, coalesce(parents, []) AS parents, coalesce(ancestors, []) AS ancestors, len(coalesce(restrictions, []))::INTEGER AS n_restrictions, coalesce(restrictions[1].filler, '') AS filler FROM nodes LEFT JOIN h ON h.node = nodes.node LEFT JOIN r ON r.node = nodes.node")
def assembled_with_restrictions(spark, sf_dir):
    e = places(spark, sf_dir)
    nodes = e.select(F.col("child").alias("node")).union(e.select("parent"))
    out = G.assembled(nodes, G.ancestors(e), _triples(spark, sf_dir))
    return out.select("node", "parents", "ancestors", F.size("restrictions").alias("n_restrictions"), F.coalesce(F.get("restrictions", F.lit(0))["filler"], F.lit("")).alias("filler"))


@query(f"""WITH {PLACES}, {SAME}, sym AS (SELECT a, b FROM same UNION SELECT b, a FROM same), d AS (SELECT DISTINCT node, depth FROM (SELECT parent AS node, 0 AS depth FROM edges WHERE parent LIKE 'R%' UNION ALL SELECT child, 1 FROM edges WHERE child LIKE 'N%' UNION ALL SELECT child, 2 FROM edges WHERE child LIKE 'S%')),
says AS (SELECT child AS node, 1 AS kind, ' is a subclass of ' AS how, parent AS other FROM edges UNION ALL SELECT a, 0, ' is equivalent to ', b FROM sym)
SELECT depth, node, row_number() OVER (PARTITION BY node ORDER BY kind, lower(other), other)::INTEGER AS place, lower(node) || how || lower(other) AS sentence FROM d JOIN says USING (node)""")
def level_order(spark, sf_dir):
    e = places(spark, sf_dir)
    names = e.select(F.col("child").alias("iri")).union(e.select("parent")).distinct().withColumn("label", F.lower("iri"))
    return G.level_order(e, names, G.symmetric(same_as(spark, sf_dir)))


@query(f"WITH {_TRIPLES} SELECT DISTINCT node FROM (SELECT s AS node FROM triples WHERE p = 'rdfs:subClassOf' AND s_kind = 'iri' UNION SELECT o FROM triples WHERE p = 'rdfs:subClassOf' AND o_kind = 'iri')")
def named_nodes(spark, sf_dir):
    return G.named(G.classify_nodes(_triples(spark, sf_dir)))


@query(f"WITH {EDGES} SELECT DISTINCT parent AS node FROM edges WHERE parent = 'R:1' AND parent NOT IN (SELECT child FROM edges)")
def top_concept(spark, sf_dir):
    return spark.createDataFrame([(G.top_concept(edges(spark, sf_dir), "R:1"),)], "node string")


# Axioms.

_FORMS = f"""{_EXPR}, f AS (
  SELECT 'nf1' AS kind, name AS first, nation AS second, NULL AS third FROM sup UNION ALL SELECT 'nf3', name, 'part of', region FROM sup UNION ALL SELECT 'nf2', nation, 'part of some ' || region, name FROM sup
  UNION ALL SELECT DISTINCT 'nf3', 'part of some ' || region, 'part of', region FROM sup UNION ALL SELECT DISTINCT 'nf4', 'part of', region, 'part of some ' || region FROM sup),
names AS (SELECT n_name AS name, n_nationkey AS id FROM nation),
t AS (SELECT kind, first, second, third, CASE kind WHEN 'nf2' THEN first || ' and ' || second WHEN 'nf4' THEN first || ' some ' || second ELSE first END AS child, CASE kind WHEN 'nf1' THEN second WHEN 'nf3' THEN second || ' some ' || third ELSE third END AS parent,
  CASE kind WHEN 'nf3' THEN second || ' some ' ELSE '' END AS before, concat_ws('|', kind, first, second, coalesce(third, '')) AS key FROM f),
d AS (SELECT key, p.place, ('0x' || substr(md5('0:' || key || ':' || p.place), 1, 8))::BIGINT % (SELECT count(*) FROM names) AS id FROM (SELECT DISTINCT key FROM t), (SELECT unnest(range(10)) AS place) p)"""


@query(f"WITH {_FORMS} SELECT kind, child, parent, list(before || names.name ORDER BY d.place) AS negative FROM t JOIN d USING (key) JOIN names USING (id) GROUP BY kind, child, parent, key")
def nf_training(spark, sf_dir):
    """Training rows with ten negatives each, drawn from the nations' names."""
    forms = A.distinct_forms(A.normalise(_axioms(spark, sf_dir), _expressions(spark, sf_dir)))
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("id"))
    return A.training_rows(forms, names).select("kind", "child", "parent", "negative")


@query(f"WITH {_FORMS} SELECT DISTINCT 'conj' AS kind, first || ' and ' || second AS Concept, first AS a, second AS b FROM f WHERE kind = 'nf2' UNION SELECT 'exist', second || ' some ' || third, second, third FROM f WHERE kind = 'nf3' UNION SELECT 'exist', first || ' some ' || second, first, second FROM f WHERE kind = 'nf4'")
def nf_pairs(spark, sf_dir):
    forms = A.distinct_forms(A.normalise(_axioms(spark, sf_dir), _expressions(spark, sf_dir)))
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("id"))
    rows = A.training_rows(forms, names)
    return A.conjunction_rows(rows).select(F.lit("conj").alias("kind"), "Concept", F.col("con1").alias("a"), F.col("con2").alias("b")).union(A.existential_rows(rows).select(F.lit("exist"), "Concept", "role", "con")).distinct()


@query(f"""WITH {_EXPR}, a AS (SELECT name, row_number() OVER (ORDER BY k) - 1 AS id FROM sup),
m AS (SELECT name, min(k) AS k FROM (SELECT region AS name, k FROM sup UNION ALL SELECT 'part of some ' || region, k FROM sup) GROUP BY name),
l AS (SELECT name, row_number() OVER (ORDER BY k, name) - 1 AS i FROM m)
SELECT name, id, name AS label FROM a UNION ALL SELECT name, i + (SELECT count(*) FROM a), 'N' || i FROM l""")
def nf_concept_ids(spark, sf_dir):
    """Suppliers are the atomic names; what definitions bring in is numbered after them, by its first axiom."""
    forms = A.normalise(_axioms(spark, sf_dir), _expressions(spark, sf_dir))
    atomic = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("seq"))
    return A.concept_ids(atomic, forms)


# Samples and sets.


@query("SELECT 'parts' AS dataset, question_id FROM (SELECT question_id FROM (" + f"WITH {_MCQA} SELECT dataset, question_id FROM mcqa" + ") WHERE dataset = 'parts' ORDER BY md5('7:' || question_id), question_id LIMIT 1)")
def random_question(spark, sf_dir):
    q = questions(spark, sf_dir)
    S.check_exists(q, 1)
    return S.random_question(q, "parts", 7).select("dataset", "question_id")


@query("SELECT s_suppkey, s_nationkey AS key, n_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def id_lookup(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return S.lookup(table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("key")), names, "key", "name").select("s_suppkey", "key", "name")


@query("SELECT true AS same, false AS other")
def tables_compared(spark, sf_dir):
    e = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    near = e.withColumn("s_acctbal", F.col("s_acctbal") + 1e-10)
    return spark.createDataFrame([(S.tables_equal(e, near, ["s_suppkey"], "s_acctbal"), S.tables_equal(e, e.filter("s_suppkey > 1"), ["s_suppkey"], "s_acctbal"))], "same boolean, other boolean")


@query(f"WITH {POINTS}, i AS (SELECT id AS row, [id, (id + 1) % n, (id + 2) % n] AS idx FROM points, (SELECT count(*) AS n FROM points)), e AS (SELECT row, idx[1] AS s, unnest([0, 1]) AS place, idx FROM i) SELECT row, place::INTEGER AS place, round({sql_poincare('a.vec', 'b.vec')}, 6) AS distance FROM e JOIN points a ON a.id = s JOIN points b ON b.id = idx[place + 2]")
def static_lookup(spark, sf_dir):
    """Index lists to vectors: each subject beside its objects."""
    pts = points(spark, sf_dir)
    n = pts.agg(F.count("*").alias("n"))
    idx = pts.crossJoin(F.broadcast(n)).select(F.col("id").alias("row"), F.array("id", (F.col("id") + 1) % F.col("n"), (F.col("id") + 2) % F.col("n")).alias("idx"))
    found = S.static_vectors(idx, pts.select("id", "vec"))
    return found.select("row", "place", r6(V.poincare(F.col("subject"), F.col("object"), K)).alias("distance"))


# Evaluation flows.


@query(f"WITH {_PAIRS}, t AS (SELECT -3.0::DOUBLE AS t), o AS (SELECT score > t AS pos, label FROM sc, t) SELECT 0.35::DOUBLE AS weight, -3.0::DOUBLE AS threshold, round(sum((pos AND label = 1)::INTEGER) / nullif(sum(pos::INTEGER), 0), 6) AS precision, round(sum((pos AND label = 1)::INTEGER) / nullif(sum(label), 0), 6) AS recall FROM o")
def evaluate_fixed(spark, sf_dir):
    """The test path with a fixed weight and threshold."""
    out = M.evaluate(_scored(spark, sf_dir).withColumn("weight", F.lit(0.35)), 0.35, -3.0)
    return out.select("weight", "threshold", r6(F.col("precision")).alias("precision"), r6(F.col("recall")).alias("recall"))


_STEPS = "e AS (SELECT trunc(min(score) * {g})::INTEGER AS lo, trunc(max(score) * {g})::INTEGER AS hi FROM {of}), st AS (SELECT unnest(range(lo, hi))::INTEGER AS step FROM e), g AS (SELECT step, step / {g}.0::DOUBLE AS threshold, sum((score {op} step / {g}.0::DOUBLE AND label = 1)::INTEGER) AS tp, sum((score {op} step / {g}.0::DOUBLE)::INTEGER) AS m, sum(label) AS pos FROM {of}, st GROUP BY step), best AS (SELECT threshold, 2 * tp / nullif(m + pos, 0) AS f1 FROM g ORDER BY f1 DESC NULLS LAST, step DESC LIMIT 1)"


@query(f"WITH {_PAIRS}, v AS (SELECT * FROM sc WHERE id % 2 = 0), {_STEPS.format(g=100, of='v', op='>')}, o AS (SELECT score > threshold AS pos, label FROM sc, best WHERE id % 2 = 1) SELECT (SELECT threshold FROM best) AS threshold, round(sum((pos AND label = 1)::INTEGER) / nullif(sum(pos::INTEGER), 0), 6) AS precision, round(sum((pos AND label = 1)::INTEGER) / nullif(sum(label), 0), 6) AS recall FROM o")
def hand_off(spark, sf_dir):
    """The best threshold of one half, tested on the other."""
    rows = _scored(spark, sf_dir).withColumn("weight", F.lit(0.35))
    return M.hand_off(rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1")).select("threshold", r6(F.col("precision")).alias("precision"), r6(F.col("recall")).alias("recall"))


@query(f"WITH {PLACES}, sc AS (SELECT (('0x' || substr(md5(child || ' is a ' || parent || '.'), 1, 4))::BIGINT % 1000)::DOUBLE / 1000 AS score, (child < parent)::INTEGER AS label FROM edges), {_STEPS.format(g=1000, of='sc', op='>')} SELECT threshold, round(f1, 6) AS f1 FROM best")
def probe(spark, sf_dir):
    """A stand-in probing model scores the sentence made of each pair by its hash."""
    e = places(spark, sf_dir).select("child", "parent", (F.col("child") < F.col("parent")).cast("int").alias("label"))
    out = M.probe(e, lambda s: (F.conv(F.substring(F.md5(s), 1, 4), 16, 10).cast("long") % 1000).cast("double") / 1000)
    return out.select("threshold", r6(F.col("f1")).alias("f1"))


@query(f"WITH {NEIGHBOURS}, sc AS (SELECT round({sql_poincare('u', 'v')}, 6) AS score, 1 AS label FROM nb UNION ALL SELECT round({sql_poincare('u', 'v')}, 6) + 1, 0 FROM nb), {_STEPS.format(g=1, of='sc', op='<=')} SELECT threshold, round(f1, 6) AS f1 FROM best")
def static_evaluation(spark, sf_dir):
    d = neighbours(points(spark, sf_dir)).select("id", r6(V.poincare(F.col("u"), F.col("v"), K)).alias("score"))
    rows = d.select("id", F.lit(0).alias("place"), "score").union(d.select("id", F.lit(1), F.col("score") + 1))
    return M.static_evaluation(rows).select("threshold", r6(F.col("f1")).alias("f1"))


_KINDS = ASKED + f""", kq AS (SELECT ['nf1', 'nf2', 'nf3', 'nf4'][1 + (query_id // 100) % 4] AS kind, query_id, q, (query_id + 1) % n AS answer FROM asked, (SELECT count(*) AS n FROM points)),
s AS (SELECT kind, query_id, id, answer, round(CASE WHEN kind = 'nf3' THEN {sql_subsumption('vec', 'q', 1.0)} ELSE {sql_subsumption('q', 'vec', 1.0)} END, 9) AS score FROM kq, points),
t AS (SELECT query_id, score AS t FROM s WHERE id = answer), ranks AS (SELECT kind, query_id, sum((score > t OR score = t AND id < answer)::INTEGER) + 1 AS rank FROM s JOIN t USING (query_id) GROUP BY kind, query_id)"""


def _kind_queries(spark, sf_dir):
    pts = points(spark, sf_dir)
    n = pts.agg(F.count("*").alias("n"))
    kind = F.element_at(F.array(*[F.lit(k) for k in M.KINDS]), (F.floor(F.col("query_id") / 100) % 4 + 1).cast("int"))
    return asked(pts).crossJoin(F.broadcast(n)).select(kind.alias("kind"), "query_id", "q", ((F.col("query_id") + 1) % F.col("n")).alias("answer")), pts.select("id", "vec")


def _subsumption_score(child, parent, weight):
    return F.round(V.subsumption(V.poincare(child, parent, K, eps=0.0), V.depth(V.squared_norm(child), K), V.depth(V.squared_norm(parent), K), weight), 9)


_SUBSUMPTION = P.Kind(lambda distance, child, parent, weight: P.nine(-(distance + weight * (parent - child))), K, _subsumption_score)


@query(f"WITH {_KINDS} SELECT kind, query_id, rank::BIGINT AS rank FROM ranks")
def kind_ranks(spark, sf_dir):
    """Ranks by kind of normal form; nf3 asks for children."""
    return M.kind_ranks(*_kind_queries(spark, sf_dir), _SUBSUMPTION).drop("weight")


@query(f"WITH {_KINDS}, k AS (SELECT kind, rank FROM ranks UNION ALL SELECT 'combined', rank FROM ranks WHERE (SELECT count(DISTINCT kind) FROM ranks) = 4), shown AS (SELECT * FROM k WHERE kind = 'combined' OR NOT EXISTS (SELECT 1 FROM (SELECT unnest(['nf1', 'nf2', 'nf3', 'nf4']) AS x) a WHERE x < k.kind AND x NOT IN (SELECT kind FROM ranks))) SELECT kind, count(*) AS n, round(avg((rank <= 1)::INTEGER), 6) AS h1, round(avg((rank <= 10)::INTEGER), 6) AS h10, round(avg(1.0::DOUBLE / rank), 6) AS mrr, round(avg(rank), 6) AS mr FROM shown GROUP BY kind")
def kind_evaluation(spark, sf_dir):
    """All four kinds together only if all are there."""
    out = M.kind_evaluation(*_kind_queries(spark, sf_dir), _SUBSUMPTION)
    return out.select("kind", "n", *[r6(F.col(c)).alias(c) for c in ("h1", "h10", "mrr", "mr")])


_WEIGHTS = ASKED + f""", w AS (SELECT unnest(range(20)) / 10.0::DOUBLE AS weight), base AS (SELECT query_id, id, (query_id + 1) % n AS answer, {sql_subsumption('q', 'vec', 0.0)} AS a, {sql_subsumption('q', 'vec', 1.0)} AS b FROM asked, points, (SELECT count(*) AS n FROM points)),
s AS (SELECT weight, query_id, id, answer, round(a + weight * (b - a), 9) AS score FROM base, w), t AS (SELECT weight, query_id, score AS t FROM s WHERE id = answer),
ranks AS (SELECT weight, query_id, sum((score > t OR score = t AND id < answer)::INTEGER) + 1 AS rank FROM s JOIN t USING (weight, query_id) GROUP BY weight, query_id)"""


@query(f"WITH {_WEIGHTS} SELECT weight, round(avg(1.0::DOUBLE / rank), 6) AS mrr, count(*) AS n FROM ranks GROUP BY weight ORDER BY round(avg(1.0::DOUBLE / rank), 9) DESC, weight LIMIT 1")
def best_rank_weight(spark, sf_dir):
    """The weight of the largest MRR, the first of equal ones."""
    queries_, candidates = _kind_queries(spark, sf_dir)
    score = P.Kind(lambda distance, child, parent, weight: P.nine(-distance + weight * (-(distance + (parent - child)) - -distance)), K, _subsumption_score)
    return M.best_rank_weight(queries_.withColumn("kind", F.lit("nf1")), candidates, score).select("weight", r6(F.col("mrr")).alias("mrr"), "n")


@query(f"WITH {ASKED}, c AS (SELECT query_id, (query_id + 1) % n AS answer, q FROM asked, (SELECT count(*) AS n FROM points)), s AS (SELECT query_id, id, answer, round(vec[1] * 3 + q[2], 9) AS score FROM c, points), t AS (SELECT query_id, score AS t FROM s WHERE id = answer) SELECT query_id, (sum((score > t OR score = t AND id < answer)::INTEGER) + 1)::BIGINT AS rank FROM s JOIN t USING (query_id) GROUP BY query_id")
def classified_ranks(spark, sf_dir):
    """A stand-in classifier reads the first component of a candidate and the second of the query from their concatenation."""
    q, candidates = _kind_queries(spark, sf_dir)
    classify = lambda both: F.round(F.element_at(both, 1) * 3 + F.element_at(both, (F.size(both) / 2).cast("int") + 2), 9)
    return M.classified_ranks(q.select("query_id", "q", "answer"), candidates, classify)


@query(f"WITH {NEIGHBOURS}, d AS (SELECT {sql_poincare('u', 'v')} AS d FROM nb) SELECT round((avg(greatest(0, d - 2)) + avg(greatest(0, d - 1))) / 2, 6) AS conjunction, round((avg(d) + avg(d * 2)) / 2, 6) AS hit, round(avg(d), 6) AS dist FROM d")
def logical_losses(spark, sf_dir):
    d = neighbours(points(spark, sf_dir)).select(V.poincare(F.col("u"), F.col("v"), K).alias("d"))
    over = lambda m: F.avg(F.greatest(F.lit(0.0), F.col("d") - m))
    return d.agg(r6(M.conjunction_loss(over(2), over(1))).alias("conjunction"), r6(M.existential_loss("hit", F.avg("d"), F.avg(F.col("d") * 2))).alias("hit"), r6(M.existential_loss("dist", F.col("d"))).alias("dist"))


# Question flows.


@query(f"WITH {_MCQA}, u AS (SELECT DISTINCT dataset, question_id FROM mcqa) SELECT row_number() OVER (ORDER BY question_id) - 1 AS i, question_id FROM u WHERE dataset = 'parts'")
def question_map(spark, sf_dir):
    return Q.question_map(questions(spark, sf_dir), "parts")


_WORD = "[\\p{L}\\p{N}''-]+"


@query(f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS f, string_split_regex(coalesce(text, ''), '{_WORD}') AS g FROM documents),
u AS (SELECT doc_id, unnest(f) AS w, unnest(g[1:len(f)]) AS g, generate_subscripts(f, 1) AS i FROM w), p AS (SELECT *, sum(length(g) + length(w)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM u),
q AS (SELECT doc_id, e - length(w) AS s, w, e, {', '.join(f'lead({c}, {n}) OVER x AS {c}{n}' for n in (1, 2, 3) for c in 'wge')} FROM p WINDOW x AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, s, e, w AS lit FROM q UNION ALL SELECT doc_id, s, e1, w || g1 || w1 FROM q UNION ALL SELECT doc_id, s, e2, w || g1 || w1 || g2 || w2 FROM q UNION ALL SELECT doc_id, s, e3, w || g1 || w1 || g2 || w2 || g3 || w3 FROM q),
d(word, type) AS (VALUES ('token', 'secret'), ('the', 'word'), ('der', 'word'), ('of the', 'phrase')), m AS (SELECT doc_id, s, e, lit, type FROM r JOIN d ON lower(lit) = word),
k AS (SELECT *, coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS far FROM m)
SELECT doc_id, lit AS entity_literal, s::INTEGER AS start_position, e::INTEGER AS end_position, type AS entity_type FROM k WHERE e > far""")
def span_tagger(spark, sf_dir):
    """Dictionary spans of all documents."""
    words = spark.createDataFrame([("token", "secret"), ("the", "word"), ("der", "word"), ("of the", "phrase")], "word string, entity_type string")
    return tagger.tag_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), words)


_SPANS = ORACLES["span_tagger"].replace("SELECT doc_id, lit", "SELECT entity_type, entity_literal, count(*) AS n, sum(start_position)::BIGINT AS starts, sum(end_position)::BIGINT AS ends FROM (SELECT doc_id, lit") + ") GROUP BY ALL"


@query(_SPANS)
def span_tagger_in_sql(spark, sf_dir):
    """The same spans by the table function of SQL, counted by literal."""
    words = spark.createDataFrame([("token", "secret"), ("the", "word"), ("der", "word"), ("of the", "phrase")], "word string, entity_type string")
    tagger.register(spark, "tagger", words)
    table(spark, sf_dir, "documents").createOrReplaceTempView("tagged_documents")
    return spark.sql("SELECT entity_type, entity_literal, count(*) AS n, sum(start_position) AS starts, sum(end_position) AS ends FROM tagger(TABLE(SELECT doc_id, text FROM tagged_documents)) GROUP BY entity_type, entity_literal")


@query(f"WITH {_MCQA} SELECT question_id, '{Q.INSTRUCTION_WITH_CONTEXT}' || chr(10) || chr(10) || 'Context:' || chr(10) || 'fact ' || question_id || chr(10) || 'more' || chr(10) || chr(10) || 'Question:' || chr(10) || question || chr(10) || chr(10) || 'Answer: ' AS prompt FROM mcqa WHERE dataset = 'parts'")
def open_prompts(spark, sf_dir):
    """Prompts without choices."""
    q = Q.questions_of(questions(spark, sf_dir), ["parts"])
    return q.select("question_id", Q.open_prompt(F.col("question"), F.array(F.concat(F.lit("fact "), F.col("question_id").cast("string")), F.lit("more"))).alias("prompt"))


_CONTEXT = ASKED + f", s AS (SELECT query_id, id, {sql_poincare('q', 'vec')} AS score FROM asked, points), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), id) AS rank FROM s), best AS (SELECT query_id // 200 AS question_id, id, round(min(score), 9) AS score FROM r WHERE rank <= 3 GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score, id) AS place FROM best)"


@query(f"WITH {_CONTEXT} SELECT question_id, 'iri/' || id AS id, 'point ' || id || ' is a thing .. DL: point ' || id || ' ⊑ T' AS context FROM p WHERE place = 1".replace("ORDER BY score, id) AS place", "ORDER BY score, 'iri/' || id) AS place"))
def answer_context(spark, sf_dir):
    """Open questions over pairs of mentions: entities, their axioms, the prompt and the context that is shown."""
    pts = points(spark, sf_dir)
    m = asked(pts).select(F.floor(F.col("query_id") / 200).cast("long").alias("question_id"), F.col("query_id").alias("mention_id"), "q")
    q = m.select("question_id").distinct().withColumn("question", F.concat(F.lit("what is "), F.col("question_id").cast("string")))
    axioms = _entities(pts).select("iri", F.col("verbalisation").alias("label"), F.array(F.lit("is a thing")).alias("sentences"), F.array(F.lit("⊑ T")).alias("logic"))
    vectors = pts.select(F.col("id").alias("mapping_id"), F.lit("hit").alias("model"), "vec")
    out = Q.answer_context(q, m, R.Retrievers(vectors, _entities(pts), K).make("hit"), axioms, "hit", 3, 3)
    return out.filter("prompt like '%Question:%'").select("question_id", "id", "context")


#: Some questions have a mention, whose nearest point says something that shares two words with the question, or not.
_HARNESS = ASKED + f""", {_MCQA}, u AS (SELECT dataset, question_id, row_number() OVER (ORDER BY dataset, question_id) - 1 AS i FROM mcqa),
m AS (SELECT dataset, question_id, list_transform(q, lambda x: x * 0.9::DOUBLE) AS q FROM u JOIN asked ON query_id = i * 100),
s AS (SELECT dataset, question_id, id, row_number() OVER (PARTITION BY dataset, question_id ORDER BY round({sql_poincare('q', 'vec')}, 9), id) AS place FROM m, points),
c AS (SELECT dataset, question_id, CASE WHEN id // 100 % 3 <> 0 THEN 'point ' || id || ' is a brand that has a part' END AS said FROM s WHERE place = 1),
p AS (SELECT dataset, question_id, {prompt_sql('question', _LINES, 'said')} AS prompt, answer FROM mcqa LEFT JOIN c USING (dataset, question_id)),
r AS (SELECT dataset, question_id, prompt, {LETTER.format('prompt')} AS prediction, answer FROM p)"""


def _harness(spark, sf_dir):
    q, pts = questions(spark, sf_dir), points(spark, sf_dir)
    some = numbered(q.select("dataset", "question_id").distinct(), [F.col("dataset"), F.col("question_id")], "i", Scratch(spark, "mentions"))
    mentions = some.join(asked(pts).select((F.col("query_id") / 100).cast("long").alias("i"), F.transform("q", lambda x: x * 0.9).alias("q")), "i").select("dataset", "question_id", F.lit(1).alias("mention_id"), "q")
    kind = F.when(F.floor(F.col("mapping_id") / 100) % 3 != 0, " is a brand that has a part").otherwise(" is a thing apart")
    axioms = _entities(pts).select("iri", F.array(F.concat("verbalisation", kind)).alias("sentences"))
    vectors = pts.select(F.col("id").alias("mapping_id"), F.lit("hit").alias("model"), "vec")
    return Q.harness(q, mentions, R.Retrievers(vectors, _entities(pts), K).make("hit"), axioms, hashed_letter, ["parts", "brands"], _folder(spark))


@query(f"WITH {_HARNESS} SELECT dataset, sum((prediction = answer)::INTEGER)::BIGINT AS correct, count(*) AS total, round(avg((prediction = answer)::INTEGER) * 100, 2) AS accuracy FROM r GROUP BY dataset")
def harness_over_datasets(spark, sf_dir):
    """The whole flow over two datasets, with mentions for some questions, a predictor that depends on the whole prompt,
    and result tables."""
    return _harness(spark, sf_dir)[1]


@query(f"WITH {_HARNESS} SELECT dataset, question_id, prompt, prediction, answer FROM r")
def harness_results(spark, sf_dir):
    """Every prompt and prediction of that flow, read back from its result files."""
    return _harness(spark, sf_dir)[0].select("dataset", "question_id", "prompt", "prediction", "answer")
