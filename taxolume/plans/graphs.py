"""Queries over concept graphs, axioms and training sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from taxolume.operators import axioms as A
from taxolume.operators import graph as G
from taxolume.operators import owl as O
from taxolume.operators import reach as X
from taxolume.operators import sets as S
from taxolume.storage import Scratch, numbered

from .views import CLOSURE, EDGES, PATHS, PLACES, SAME, edges, places, same_as, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_COMP = SAME + """, sym AS (SELECT a, b FROM same UNION SELECT b, a FROM same),
reach AS (SELECT a AS member, a AS other FROM sym UNION SELECT r.member, s.b FROM reach r JOIN sym s ON r.other = s.a),
canon AS (SELECT member, 'S:' || min(substr(other, 3)::BIGINT) AS canon FROM reach GROUP BY member)"""


@query(f"WITH RECURSIVE {_COMP} SELECT member, canon FROM canon")
def equivalence_canon(spark, sf_dir):
    return G.canonical(same_as(spark, sf_dir))


@query(f"WITH RECURSIVE {_COMP} SELECT canon, list_transform(list_sort(list(substr(member, 3)::BIGINT)), lambda x: 'S:' || x) AS members FROM canon WHERE member <> canon GROUP BY canon")
def equivalent_members(spark, sf_dir):
    return G.equivalents(G.canonical(same_as(spark, sf_dir)))


@query(f"WITH RECURSIVE {_COMP}, {EDGES} SELECT DISTINCT coalesce(c.canon, child) AS child, coalesce(p.canon, parent) AS parent FROM edges LEFT JOIN canon c ON c.member = child LEFT JOIN canon p ON p.member = parent")
def direct_parents(spark, sf_dir):
    return G.canonicalise(edges(spark, sf_dir), G.canonical(same_as(spark, sf_dir)))


@query(f"WITH RECURSIVE {CLOSURE} SELECT node, ancestor, depth FROM closure")
def ancestors_depth(spark, sf_dir):
    return G.ancestors(edges(spark, sf_dir))


@query(f"WITH RECURSIVE {CLOSURE} SELECT node, ancestor, depth FROM closure WHERE depth <= 2")
def ancestors_capped(spark, sf_dir):
    return G.ancestors(edges(spark, sf_dir), max_depth=2)


@query(f"WITH RECURSIVE {CLOSURE} SELECT node AS child, ancestor AS parent FROM closure EXCEPT SELECT child, parent FROM edges")
def transitive_edges(spark, sf_dir):
    return G.transitive_edges(edges(spark, sf_dir))


@query(f"WITH RECURSIVE {CLOSURE} SELECT child, parent FROM edges e WHERE NOT EXISTS (SELECT 1 FROM edges m JOIN closure c ON c.node = m.parent AND c.ancestor = e.parent WHERE m.child = e.child AND m.parent <> e.parent)")
def transitive_reduction(spark, sf_dir):
    return G.transitive_reduction(edges(spark, sf_dir))


_PAIRED = CLOSURE + ", asked AS (SELECT DISTINCT child, 'N:' || (hash_ % 25) AS parent FROM (SELECT child, ('0x' || substr(md5(child), 1, 8))::BIGINT AS hash_ FROM edges))"


@query(f"WITH RECURSIVE {_PAIRED} SELECT a.child, a.parent, c.node IS NOT NULL AS above FROM asked a LEFT JOIN closure c ON c.node = a.child AND c.ancestor = a.parent")
def reachable_pairs(spark, sf_dir):
    """Whether a nation is above a node, for a nation drawn for every node, by the labels of both."""
    e = edges(spark, sf_dir)
    drawn = F.conv(F.substring(F.md5("child"), 1, 8), 16, 10).cast("long") % 25
    pairs = e.select("child").distinct().withColumn("parent", F.concat(F.lit("N:"), drawn.cast("string")))
    return X.related(X.reach_index(e), pairs)


@query(f"WITH RECURSIVE {CLOSURE} SELECT node, ancestor FROM closure WHERE node NOT LIKE 'O:%'")
def ancestor_lookup(spark, sf_dir):
    """All ancestors of customers, suppliers, nations and parts, by their labels."""
    e = edges(spark, sf_dir)
    return X.look_up(X.reach_index(e), e.select(F.col("child").alias("node")).filter("node not like 'O:%'"))


@query(f"WITH {EDGES} SELECT DISTINCT parent AS node FROM edges WHERE parent NOT IN (SELECT child FROM edges)")
def roots(spark, sf_dir):
    return G.roots(edges(spark, sf_dir))


@query(f"WITH {EDGES} SELECT child, list_sort(list(DISTINCT parent)) AS parents FROM edges GROUP BY child")
def antecedents(spark, sf_dir):
    return G.antecedents(edges(spark, sf_dir))


@query(f"WITH {EDGES} SELECT parent, list_sort(list(DISTINCT child)) AS children FROM edges GROUP BY parent")
def descendants(spark, sf_dir):
    return G.descendants(edges(spark, sf_dir))


@query(f"WITH {SAME} SELECT a, b FROM same UNION SELECT b, a FROM same")
def equivalence_pairs(spark, sf_dir):
    return G.symmetric(same_as(spark, sf_dir))


_HASSE = """, k AS (SELECT node, ancestor, depth, coalesce(nullif(regexp_extract(ancestor, '(\\d+)$', 1), '')::BIGINT, 9223372036854775807) AS n FROM closure)
SELECT node, list_transform(list_sort(list({'d': depth, 'n': n, 'a': ancestor}) FILTER (depth = 1)), lambda x: x.a) AS parents,
  coalesce(list_transform(list_sort(list({'d': depth, 'n': n, 'a': ancestor}) FILTER (depth > 1)), lambda x: x.a), []) AS ancestors FROM k GROUP BY node"""


@query(f"WITH RECURSIVE {CLOSURE}{_HASSE}")
def hasse_assemble(spark, sf_dir):
    return G.assemble(G.ancestors(edges(spark, sf_dir)))


@query(f"WITH RECURSIVE {CLOSURE}, h AS (SELECT node, list_sort(list(ancestor)) AS a FROM closure GROUP BY node) SELECT n.node, len(coalesce(a, []))::INTEGER AS n FROM (SELECT child AS node FROM edges UNION SELECT parent FROM edges) n LEFT JOIN h ON h.node = n.node")
def merge_left_default(spark, sf_dir):
    e = edges(spark, sf_dir)
    targets = e.select(F.col("child").alias("node")).union(e.select("parent")).distinct()
    merged, _ = G.merge_ancestors(targets, G.assemble(G.ancestors(e)))
    return merged.select("node", (F.size("parents") + F.size("ancestors")).alias("n"))


_TRIPLES = """triples AS (
  SELECT 'S:' || s_suppkey AS s, 'iri' AS s_kind, 'rdfs:subClassOf' AS p, '_:r' || s_suppkey AS o, 'bnode' AS o_kind FROM supplier
  UNION ALL SELECT 'S:' || s_suppkey, 'iri', 'rdfs:subClassOf', 'N:' || s_nationkey, 'iri' FROM supplier
  UNION ALL SELECT '_:r' || s_suppkey, 'bnode', 'owl:onProperty', 'located in', 'iri' FROM supplier
  UNION ALL SELECT '_:r' || s_suppkey, 'bnode', 'owl:someValuesFrom', 'N:' || s_nationkey, 'iri' FROM supplier WHERE s_suppkey % 3 <> 0
  UNION ALL SELECT 'S:' || s_suppkey, 'iri', 'rdfs:label', s_name, 'literal' FROM supplier
  UNION ALL SELECT 'N:' || s_nationkey, 'iri', 'skos:altLabel', s_name, 'literal' FROM supplier
  UNION ALL SELECT 'N:' || n_nationkey, 'iri', 'skos:prefLabel', n_name, 'literal' FROM nation)"""


def _triples(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    key, blank, nat = F.concat(F.lit("S:"), F.col("s_suppkey").cast("string")), F.concat(F.lit("_:r"), F.col("s_suppkey").cast("string")), F.concat(F.lit("N:"), F.col("s_nationkey").cast("string"))
    row = lambda df, a, ak, p, b, bk: df.select(a.alias("s"), F.lit(ak).alias("s_kind"), F.lit(p).alias("p"), b.alias("o"), F.lit(bk).alias("o_kind"))
    out = row(s, key, "iri", G.SUBCLASS, blank, "bnode")
    for x in (
        row(s, key, "iri", G.SUBCLASS, nat, "iri"), row(s, blank, "bnode", G.ON_PROPERTY, F.lit("located in"), "iri"), row(s.filter("s_suppkey % 3 <> 0"), blank, "bnode", G.SOME_VALUES, nat, "iri"),
        row(s, key, "iri", G.LABEL, F.col("s_name"), "literal"), row(s, nat, "iri", G.ALT_LABEL, F.col("s_name"), "literal"), row(n, F.concat(F.lit("N:"), F.col("n_nationkey").cast("string")), "iri", G.PREF_LABEL, F.col("n_name"), "literal"),
    ):
        out = out.union(x)
    return out


@query(f"WITH {_TRIPLES} SELECT DISTINCT a.s, p.o AS property, f.o AS filler FROM triples a JOIN triples p ON a.o = p.s AND p.p = 'owl:onProperty' JOIN triples f ON a.o = f.s AND f.p = 'owl:someValuesFrom' WHERE a.p = 'rdfs:subClassOf' AND a.o_kind = 'bnode'")
def restrictions(spark, sf_dir):
    return G.restrictions(_triples(spark, sf_dir))


@query(f"WITH {_TRIPLES} SELECT s, min(o) FILTER (p = 'rdfs:label') AS label, min(o) FILTER (p = 'skos:prefLabel') AS pref_label, coalesce(list_sort(list(DISTINCT o) FILTER (p = 'skos:altLabel')), []) AS alt_labels FROM triples WHERE p IN ('rdfs:label', 'skos:prefLabel', 'skos:altLabel') GROUP BY s")
def labels_pick(spark, sf_dir):
    return G.labels(_triples(spark, sf_dir))


@query(f"WITH {_TRIPLES} SELECT DISTINCT node, kind FROM (SELECT s AS node, s_kind AS kind FROM triples WHERE p = 'rdfs:subClassOf' UNION SELECT o, o_kind FROM triples WHERE p = 'rdfs:subClassOf')")
def classify_nodes(spark, sf_dir):
    return G.classify_nodes(_triples(spark, sf_dir))


@query(f"WITH RECURSIVE {CLOSURE}, x AS (SELECT depth FROM closure WHERE ancestor = 'R:1' UNION ALL SELECT 0) SELECT (depth + 1)::BIGINT AS bin, count(*) AS n FROM x GROUP BY depth")
def depth_histogram(spark, sf_dir):
    return G.histogram(G.depths_from(edges(spark, sf_dir), "R:1"), "depth", 0, 10, 10)


_HARD = PLACES + PATHS + ", hard AS (SELECT DISTINCT a.child, b.child AS negative FROM edges a JOIN edges b ON a.parent = b.parent WHERE a.child <> b.child AND NOT EXISTS (SELECT 1 FROM closure c WHERE c.node = a.child AND c.ancestor = b.child))"


@query(f"WITH RECURSIVE {_HARD} SELECT child, negative FROM hard")
def hard_negatives(spark, sf_dir):
    e = places(spark, sf_dir)
    return S.hard_negatives(e, X.parents_index(e))


def _examples(spark, sf_dir):
    e = places(spark, sf_dir)
    closure = Scratch(spark, "examples").put(G.ancestors(e))
    nodes = e.select(F.col("child").alias("node")).union(e.select("parent")).distinct()
    random = S.random_negatives(e, nodes, closure, 10, 3)
    return S.examples(e, S.first_hard_negatives(e, closure, 10), random, 10)


_EX = _HARD + """, nodes AS (SELECT child AS node FROM edges UNION SELECT parent FROM edges),
total AS (SELECT count(*) AS total FROM nodes), numbered AS (SELECT node, row_number() OVER (ORDER BY md5('3#' || node), node) - 1 AS i FROM nodes), kids AS (SELECT DISTINCT child FROM edges),
drawn AS (SELECT child, d, ('0x' || substr(md5('3|' || child || '|' || d), 1, 12))::BIGINT % total AS i FROM kids, (SELECT unnest(range(640)) AS d), total),
met AS (SELECT child, node AS negative, min(d) AS d FROM drawn JOIN numbered USING (i) WHERE node <> child AND NOT EXISTS (SELECT 1 FROM closure x WHERE x.node = drawn.child AND x.ancestor = numbered.node) GROUP BY ALL),
met2 AS (SELECT child, negative, row_number() OVER (PARTITION BY child ORDER BY d, negative) AS place, d FROM met),
enough AS (SELECT child FROM met2, total WHERE place = 10 AND 20 * power(2, CASE WHEN d < 20 THEN 0 ELSE floor(log2(d / 20.0::DOUBLE)) + 1 END) < total),
rnd AS (SELECT child, negative, place FROM met2 WHERE child IN (SELECT child FROM enough) UNION ALL SELECT child, node AS negative, row_number() OVER (PARTITION BY child ORDER BY md5('3:' || child || '|' || node), node) AS place FROM kids c, nodes
  WHERE node <> child AND child NOT IN (SELECT child FROM enough) AND NOT EXISTS (SELECT 1 FROM closure x WHERE x.node = c.child AND x.ancestor = nodes.node)),
neg AS (SELECT child, negative, row_number() OVER (PARTITION BY child ORDER BY kind, o, negative) AS i FROM (
  SELECT child, negative, 0 AS kind, 0 AS o FROM hard UNION ALL SELECT child, negative, 1, place FROM rnd r WHERE place <= 10 AND NOT EXISTS (SELECT 1 FROM hard h WHERE h.child = r.child AND h.negative = r.negative))),
ex AS (SELECT e.child, e.parent, n.negative FROM edges e JOIN neg n ON e.child = n.child WHERE i <= 10)"""


@query(f"WITH RECURSIVE {_EX} SELECT child, parent, negative FROM ex")
def triplets(spark, sf_dir):
    return S.triplets(_examples(spark, sf_dir))


@query(f"WITH RECURSIVE {_EX} SELECT child, parent, 1 AS label FROM edges UNION ALL SELECT child, negative, 0 FROM ex")
def pairs(spark, sf_dir):
    return S.pairs(_examples(spark, sf_dir))


@query(f"WITH RECURSIVE {_EX}, ids AS (SELECT node AS name, row_number() OVER (ORDER BY node) AS id FROM nodes), f AS (SELECT e.child, e.parent, list(i.id ORDER BY n.i) AS neg FROM edges e JOIN neg n ON e.child = n.child JOIN ids i ON i.name = n.negative WHERE n.i <= 10 GROUP BY e.child, e.parent) SELECT list_concat([c.id, p.id], neg) AS idx FROM f JOIN ids c ON c.name = f.child JOIN ids p ON p.name = f.parent")
def index_lists(spark, sf_dir):
    e = places(spark, sf_dir)
    nodes = e.select(F.col("child").alias("name")).union(e.select("parent")).distinct()
    ids = numbered(nodes, [F.col("name")], "id", Scratch(spark, "ids")).withColumn("id", F.col("id") + 1)
    return S.index_lists(_examples(spark, sf_dir), ids)


@query(f"WITH {EDGES}, u AS (SELECT child, parent, ('0x' || substr(md5('5:' || child || '|' || parent), 1, 8))::BIGINT % 1000 AS u FROM edges) SELECT child, parent, CASE WHEN u < 50 THEN 'val' WHEN u < 100 THEN 'test' ELSE 'train' END AS split FROM u")
def split_buckets(spark, sf_dir):
    return S.splits(edges(spark, sf_dir), F.concat("child", F.lit("|"), "parent"), 5)


_EXPR = """sup AS (SELECT s_suppkey AS k, s_name AS name, n_name AS nation, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _expressions(spark, sf_dir):
    """supplier = its name and located in some (nation and part of some region)."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    row = lambda i, parent, pos, kind, name: F.struct(F.concat("k", F.lit(i)).alias("expr_id"), (F.concat("k", F.lit(parent)) if parent else F.lit(None).cast("string")).alias("parent_expr"), F.lit(pos).alias("pos"), F.lit(kind).alias("kind"), (F.lit(name) if isinstance(name, str) else name).alias("name"))
    rows = F.array(row("/a", "", 0, "and", ""), row("/b", "/a", 0, "iri", F.col("s_name")), row("/c", "/a", 1, "some", "located in"), row("/d", "/c", 0, "and", ""), row("/e", "/d", 0, "iri", F.col("n_name")), row("/f", "/d", 1, "some", "part of"), row("/g", "/f", 0, "iri", F.col("r_name")))
    return s.withColumn("k", F.col("s_suppkey").cast("string")).select(F.explode(rows).alias("r")).select("r.*")


@query(f"WITH {_EXPR} SELECT k || '/a' AS expr_id, name || ' and located in some ' || nation || ' and part of some ' || region AS text, name || ' ⊓  ∃located in.' || nation || ' ⊓  ∃part of.' || region || '  ' AS logic FROM sup")
def verbalise(spark, sf_dir):
    e = _expressions(spark, sf_dir)
    both = A.render(e).join(A.render(e, A.LOGIC, "logic"), "expr_id")
    return both.filter("expr_id like '%/a'").select("expr_id", "text", "logic")


def _owl(spark, sf_dir):
    """The same expressions as triples: a supplier is equivalent to located in some (nation and part of some region)."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    key, nat, reg = text("S:", "s_suppkey"), text("N:", "n_nationkey"), text("R:", "n_regionkey")
    b = {x: text(f"_:{x}", "s_suppkey") for x in "adfxyuv"}
    t = lambda a, ak, p, o, ok: F.struct(a.alias("s"), F.lit(ak).alias("s_kind"), F.lit(p).alias("p"), (F.lit(o) if isinstance(o, str) else o).alias("o"), F.lit(ok).alias("o_kind"))
    rows = [t(key, "iri", G.EQUIVALENT, b["a"], "bnode"), t(b["a"], "bnode", O.INTERSECTION, b["x"], "bnode"), t(b["x"], "bnode", O.FIRST, nat, "iri"), t(b["x"], "bnode", O.REST, b["y"], "bnode"), t(b["y"], "bnode", O.FIRST, b["d"], "bnode"), t(b["y"], "bnode", O.REST, O.NIL, "iri")]
    rows += [t(b["d"], "bnode", G.ON_PROPERTY, "part of", "iri"), t(b["d"], "bnode", G.SOME_VALUES, b["f"], "bnode"), t(b["f"], "bnode", O.INTERSECTION, b["u"], "bnode"), t(b["u"], "bnode", O.FIRST, reg, "iri"), t(b["u"], "bnode", O.REST, b["v"], "bnode"), t(b["v"], "bnode", O.FIRST, nat, "iri"), t(b["v"], "bnode", O.REST, O.NIL, "iri")]
    return s.select(F.explode(F.array(*rows)).alias("t")).select("t.*")


def _names(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("S:"), F.col("s_suppkey").cast("string")).alias("iri"), F.col("s_name").alias("label")).union(table(spark, sf_dir, "nation").select(F.concat(F.lit("N:"), F.col("n_nationkey").cast("string")), F.col("n_name"))).union(table(spark, sf_dir, "region").select(F.concat(F.lit("R:"), F.col("r_regionkey").cast("string")), F.col("r_name")))


@query(f"WITH {_EXPR} SELECT 'S:' || k || '|owl:equivalentClass|_:a' || k || '/r' AS expr_id, nation || ' and part of some ' || region || ' and ' || nation AS text, nation || ' ⊓  ∃part of.' || region || ' ⊓ ' || nation || ' ' AS logic FROM sup")
def verbalise_triples(spark, sf_dir):
    """Expressions out of triples with lists, in words and in logic."""
    found = O.expressions(_owl(spark, sf_dir), _names(spark, sf_dir))
    own = found.axioms.select(F.col("parent").alias("expr_id"))
    return own.join(A.render(found.expressions), "expr_id").join(A.render(found.expressions, A.LOGIC, "logic"), "expr_id").select("expr_id", "text", "logic")


@query(f"""WITH {_EXPR}, f AS (
  SELECT 'nf1' AS kind, name AS first, nation AS second, NULL AS third FROM sup
  UNION ALL SELECT 'nf3', name, 'part of', region || ' and ' || nation FROM sup
  UNION ALL SELECT 'nf2', nation, 'part of some ' || region || ' and ' || nation, name FROM sup
  UNION ALL SELECT DISTINCT 'nf3', 'part of some ' || region || ' and ' || nation, 'part of', region || ' and ' || nation FROM sup
  UNION ALL SELECT DISTINCT 'nf4', 'part of', region || ' and ' || nation, 'part of some ' || region || ' and ' || nation FROM sup
  UNION ALL SELECT DISTINCT 'nf1', region || ' and ' || nation, region, NULL FROM sup
  UNION ALL SELECT DISTINCT 'nf1', region || ' and ' || nation, nation, NULL FROM sup
  UNION ALL SELECT DISTINCT 'nf2', region, nation, region || ' and ' || nation FROM sup
) SELECT kind, first, second, third FROM f""")
def nf_from_triples(spark, sf_dir):
    """Normal forms of the axioms that the triples hold."""
    found = O.expressions(_owl(spark, sf_dir), _names(spark, sf_dir))
    return A.distinct_forms(A.normalise(found.axioms, found.expressions)).select("kind", "first", "second", "third")


#: A supplier is in its nation, whose suppliers are traders; who is in a nation that is part of a region is of the region.
_EL = """sub0 AS (SELECT 'S:' || s_suppkey AS x, 'N:' || s_nationkey AS n, 'R:' || n_regionkey AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey),
nf AS (
  SELECT DISTINCT 'nf1' AS kind, x AS first, 'in ' || n AS second, NULL AS third FROM sub0
  UNION SELECT 'nf3', 'in ' || n, 'located in', n FROM sub0
  UNION SELECT 'nf4', 'part of', r, 'of ' || r FROM sub0
  UNION SELECT 'nf3', n, 'located in', r FROM sub0
  UNION SELECT 'nf4', 'part of', 'of ' || r, 'trader of ' || r FROM sub0
  UNION SELECT 'nf2', 'in ' || n, 'trader of ' || r, 'both ' || n FROM sub0
  UNION SELECT 'nf1', 'both ' || n, 'in ' || n, NULL FROM sub0)"""


@query(f"""WITH RECURSIVE {_EL}, role AS (SELECT 'located in' AS r, 'located in' AS w UNION ALL SELECT 'located in', 'part of'),
name AS (SELECT first AS c FROM nf WHERE kind IN ('nf1', 'nf2', 'nf3') UNION SELECT second FROM nf WHERE kind IN ('nf1', 'nf2', 'nf4') UNION SELECT third FROM nf WHERE kind <> 'nf1'),
one AS (SELECT c AS sub, c AS super FROM name UNION SELECT o.sub, f.second FROM one o JOIN nf f ON f.kind = 'nf1' AND f.first = o.super),
link1 AS (SELECT DISTINCT o.sub, w AS role, f.third AS filler FROM one o JOIN nf f ON f.kind = 'nf3' AND f.first = o.super JOIN role ON r = f.second),
two AS (SELECT * FROM one UNION SELECT l.sub, f.third FROM link1 l JOIN one o ON o.sub = l.filler JOIN nf f ON f.kind = 'nf4' AND f.first = l.role AND f.second = o.super),
three AS (SELECT * FROM two UNION SELECT l.sub, f.third FROM link1 l JOIN two o ON o.sub = l.filler JOIN nf f ON f.kind = 'nf4' AND f.first = l.role AND f.second = o.super),
four AS (SELECT * FROM three UNION SELECT a.sub, f.third FROM three a JOIN nf f ON f.kind = 'nf2' AND f.first = a.super JOIN three b ON b.sub = a.sub AND b.super = f.second)
SELECT DISTINCT sub, super FROM four""")
def el_saturation(spark, sf_dir):
    """What follows from normal forms and a role inclusion, as a reasoner derives it."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    x, n, r = text("S:", "s_suppkey"), text("N:", "s_nationkey"), text("R:", "n_regionkey")
    row = lambda kind, a, b, c: F.struct(F.lit(kind).alias("kind"), a.alias("first"), b.alias("second"), c.alias("third"))
    say, none = (lambda p, c: F.concat(F.lit(p), c)), F.lit(None).cast("string")
    rows = [row("nf1", x, say("in ", n), none), row("nf3", say("in ", n), F.lit("located in"), n), row("nf4", F.lit("part of"), r, say("of ", r)), row("nf3", n, F.lit("located in"), r), row("nf4", F.lit("part of"), say("of ", r), say("trader of ", r)), row("nf2", say("in ", n), say("trader of ", r), say("both ", n)), row("nf1", say("both ", n), say("in ", n), none)]
    forms = s.select(F.explode(F.array(*rows)).alias("f")).select("f.*").distinct()
    wider = spark.createDataFrame([("located in", "part of")], "sub string, super string")
    return O.saturate(forms, wider)[0]


@query(f"WITH {_EXPR} SELECT 'S:' || k AS iri, name AS label, [nation] AS subclass_of, ['located in some ' || nation] AS equivalent_to, 'is a type of ' || nation AS verbal, 'defined as located in some ' || nation AS defined, '⊑ ' || nation AS dl, '≡  ∃located in.' || nation || ' ' AS dl_equivalent FROM sup")
def axiom_catalogue(spark, sf_dir):
    c = _catalogue(spark, sf_dir).filter("iri like 'S:%'")
    first = lambda x: F.element_at(x, 1)
    return c.select("iri", "label", "subclass_of", "equivalent_to", first("verbalization.subclass_of").alias("verbal"), first("verbalization.equivalent_to").alias("defined"), first("dl_subclass_of").alias("dl"), first("dl_equivalent_to").alias("dl_equivalent"))


def _catalogue(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    names = s.select(key("S:", "s_suppkey").alias("iri"), F.col("s_name").alias("label")).union(n.select(key("N:", "n_nationkey"), F.col("n_name")))
    up = s.select(key("S:", "s_suppkey").alias("child"), key("N:", "s_nationkey").alias("parent"))
    eq = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(key("S:", "s_suppkey").alias("iri"), F.concat(F.lit("located in some "), "n_name").alias("words"), F.concat(F.lit(" ∃located in."), "n_name", F.lit(" ")).alias("logic"))
    return A.catalogue(names, up, eq)


@query(f"WITH {_EXPR} SELECT 'S:' || k AS iri, [name || ' is a type of ' || nation, name || ' defined as located in some ' || nation] AS sentences, nation AS first FROM sup")
def axiom_gate(spark, sf_dir):
    """Sentences that share a content word with a question that names the nation."""
    c = _catalogue(spark, sf_dir).filter("iri like 'S:%'")
    firsts = c.select("iri", A.first_axiom(F.col("subclass_of"), F.col("equivalent_to")).alias("first"))
    kept = A.axiom_sentences(c).join(firsts, "iri")
    question = F.concat(F.lit("Which one is of type "), F.col("first"), F.lit("?"))
    return kept.select("iri", A.gate_axioms(F.col("sentences"), question, 1).alias("sentences"), "first")


def _axioms(spark, sf_dir):
    """Each supplier's name is equivalent to its nation and part of some region."""
    e = _expressions(spark, sf_dir)
    return e.filter("expr_id like '%/d'").select(F.regexp_extract("expr_id", "[0-9]+", 0).cast("long").alias("axiom_id"), F.lit("equiv").alias("kind"), F.regexp_replace("expr_id", "/d", "/b").alias("child"), F.col("expr_id").alias("parent"))


@query(f"""WITH {_EXPR}, f AS (
  SELECT 'nf1' AS kind, name AS first, nation AS second, NULL AS third FROM sup
  UNION ALL SELECT 'nf3', name, 'part of', region FROM sup
  UNION ALL SELECT 'nf2', nation, 'part of some ' || region, name FROM sup
  UNION ALL SELECT DISTINCT 'nf3', 'part of some ' || region, 'part of', region FROM sup
  UNION ALL SELECT DISTINCT 'nf4', 'part of', region, 'part of some ' || region FROM sup
) SELECT kind, first, second, third FROM f""")
def nf_normalise(spark, sf_dir):
    return A.distinct_forms(A.normalise(_axioms(spark, sf_dir), _expressions(spark, sf_dir))).select("kind", "first", "second", "third")


@query(f"WITH {_EXPR} SELECT 'nf1' AS kind, name AS left, nation AS right, name AS query, nation AS answer FROM sup UNION ALL SELECT 'nf2', nation || ' and ' || region, name, nation || ' and ' || region, name FROM sup UNION ALL SELECT 'nf3', name, 'part of some ' || region, 'part of some ' || region, name FROM sup UNION ALL SELECT 'nf4', 'part of some ' || region, name, 'part of some ' || region, name FROM sup")
def nf_text(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    f = lambda k, a, b, c: F.struct(F.lit(k).alias("kind"), a.alias("a"), b.alias("b"), c.alias("c"))
    n, t, r, p, none = F.col("s_name"), F.col("n_name"), F.col("r_name"), F.lit("part of"), F.lit(None).cast("string")
    rows = s.select(F.explode(F.array(f("nf1", n, t, none), f("nf2", t, r, n), f("nf3", n, p, r), f("nf4", p, r, n))).alias("f")).select("f.*")
    x, q = A.form_text(F.col("kind"), F.col("a"), F.col("b"), F.col("c")), A.query_answer(F.col("kind"), F.col("a"), F.col("b"), F.col("c"))
    return rows.select("kind", x["left"].alias("left"), x["right"].alias("right"), q["query"].alias("query"), q["answer"].alias("answer"))


@query("WITH n AS (SELECT p_brand AS name, min(p_partkey) AS k FROM part GROUP BY p_brand) SELECT name, row_number() OVER (ORDER BY k, name) - 1 AS id FROM n")
def nf_ids(spark, sf_dir):
    return A.number_names(table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("seq")))


@query("WITH u AS (SELECT s_suppkey AS axiom_id, row_number() OVER (ORDER BY md5('0:' || s_suppkey), s_suppkey::VARCHAR) - 1 AS i, count(*) OVER () AS n FROM supplier) SELECT axiom_id, CASE WHEN i < floor(0.8::DOUBLE * n) THEN 'train' WHEN i < floor(0.8::DOUBLE * n) + floor(0.1::DOUBLE * n) THEN 'val' ELSE 'test' END AS split FROM u")
def nf_split(spark, sf_dir):
    return A.split_forms(_axioms(spark, sf_dir).select("axiom_id"), F.col("axiom_id").cast("string"))


@query("WITH roles AS (SELECT n_name AS name, n_nationkey AS id FROM nation) SELECT a.id AS sub, b.id AS super FROM nation JOIN region ON n_regionkey = r_regionkey JOIN roles a ON a.name = n_name JOIN roles b ON b.id = r_regionkey")
def role_inclusions(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    roles = n.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("id"))
    first = n.select(F.col("n_nationkey").alias("n_regionkey"), F.col("n_name").alias("super_name"))
    return A.role_inclusions(n.join(first, "n_regionkey").select(F.col("n_name").alias("sub_name"), "super_name"), roles)
