"""Reachability labels, block-max search, counted ranks, tagging, class expressions and Turtle against plain versions."""

import random
import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from taxolume.functions import text as T
from taxolume.functions import vector as V
from taxolume.operators import axioms as A
from taxolume.operators import blockmax as B
from taxolume.operators import graph as G
from taxolume.operators import lexical as L
from taxolume.operators import metrics as M
from taxolume.operators import owl as O
from taxolume.operators import ranks as N
from taxolume.operators import reach as X
from taxolume.operators import retrieve as R
from taxolume.operators import tagger
from taxolume.sources import io, turtle


def closure_of(edges):
    up = {x: set() for e in edges for x in e}
    while True:
        before = sum(map(len, up.values()))
        for a, b in edges:
            up[a] |= {b} | up[b]
        if sum(map(len, up.values())) == before:
            return up


@pytest.mark.parametrize("seed,loops", [(1, []), (2, []), (3, [("n3", "n9"), ("n9", "n3"), ("n20", "n20")])])
def test_reachability_labels(spark, seed, loops):
    rnd = random.Random(seed)
    edges = {(f"n{a}", f"n{b}") for a in range(30) for b in range(a) if rnd.random() < 0.1} | set(loops)
    up = closure_of(edges)
    df = spark.createDataFrame([*sorted(edges), (None, "n1"), ("n1", None)], "child string, parent string")
    index = X.reach_index(df)
    nodes = spark.createDataFrame([(x,) for x in up] + [("other",)], "node string")
    assert sorted(tuple(r) for r in X.look_up(index, nodes).collect()) == sorted((a, b) for a in up for b in up[a])
    pairs = spark.createDataFrame([(a, b, 1) for a in up for b in up] + [("other", "n1", 1), (None, "n1", 1)], "child string, parent string, lo int")
    assert all(r.above == (r.child in up and r.parent in up[r.child]) for r in X.related(index, pairs).collect())
    want = sorted((c, p) for c, p in edges if not any(p in up[q] - {q} for c2, q in edges if c2 == c))
    assert sorted(tuple(r) for r in G.transitive_reduction(df.dropna()).select("child", "parent").collect()) == want
    assert bool(loops) == (not index.loose.isEmpty())


def test_reachability_of_nothing_and_of_a_hub(spark):
    assert X.reach_index(spark.createDataFrame([], "child string, parent string")).labels.count() == 0
    hub = spark.range(3000).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("child"), F.lit("hub").alias("parent")).union(spark.createDataFrame([("hub", "top"), ("c1", "top")], "child string, parent string"))
    assert [tuple(r) for r in G.transitive_reduction(hub).join(hub.filter("parent = 'top'"), ["child", "parent"]).collect()] == [("hub", "top")]
    assert X.look_up(X.reach_index(hub), hub.select(F.col("child").alias("node"))).count() == 6001


def test_block_max_search_is_exact(spark):
    """Against the search without blocks: many blocks, ties, repeated and null ids, unknown words."""
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rnd.choices(vocabulary, [1 / (k + 1) for k in range(60)], k=rnd.randint(1, 25)))) for i in range(900)] + [(2000, None), (2001, ""), (2002, "w0"), (2003, "w0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame([(i, " ".join(rnd.choices(vocabulary, k=6))) for i in range(40)] + [(98, "unknown"), (99, "w0 w0")], "query_id long, text string")
    of = lambda df: sorted((r.query_id, r["rank"], r.id, round(r.score, 8)) for r in df.collect())
    share: list[float] = []
    got = B.search(B.tfidf_blocks(docs), asked, 7, share=share)
    assert of(got) == of(L.tfidf_search(L.tfidf_index(docs), asked, 7)) and 0 < share[0] <= 1
    assert of(B.search(B.bm25_blocks(docs), asked, 7)) == of(L.bm25_search(L.bm25_index(docs), asked, 7))
    assert B.search(B.tfidf_blocks(docs.limit(0)), asked).count() == 0 and B.search(B.tfidf_blocks(docs), asked.limit(0)).count() == 0
    twice = B.search(B.tfidf_blocks(spark.createDataFrame([(1, "cat dog"), (1, "cat"), (None, "cat")], "doc_id long, text string")), spark.createDataFrame([(1, "cat")], "query_id int, text string"))
    assert [(r["rank"], r.id) for r in twice.collect()] == [(1, None), (2, 1), (3, 1)]


@pytest.mark.parametrize("score,chunk", [("poincare", 1 << 14), ("subsumption", 3), ("l2", 5)])
def test_counted_ranks(spark, monkeypatch, score, chunk):
    """Against sorting, with ties, with thresholds of a query in several chunks and in several blocks."""
    monkeypatch.setattr(N, "CHUNK", chunk)
    monkeypatch.setattr(N, "THRESHOLDS", 40)
    rnd = random.Random(6)
    points = [(i, [rnd.choice([0.1, 0.2, 0.3]), rnd.choice([0.0, 0.2])]) for i in range(200)] + [(300, [0.0, 0.0])]
    table = spark.createDataFrame(points, "id long, vec array<double>").repartition(3)
    queries = table.filter("id % 40 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("q"))
    wanted = spark.createDataFrame([(q, i) for q in (0, 40, 80, 120) for i in range(0, 200, 7)] + [(0, 999), (0, None), (77, 1), (0, 7)], "query_id long, id long")
    ranked = {(r.query_id, r.id): r["rank"] for r in R.top_k(R.scan(queries, table, score).filter("query_id <> id"), None, V.SCORES[score][1]).collect()}
    got = N.relevant_ranks(queries, table, wanted, score).collect()
    assert {(r.query_id, r.id): r["rank"] for r in got} == {k: v for k, v in ranked.items() if k[0] in (0, 40, 80, 120) and k[1] % 7 == 0 and k[1] < 200}
    assert len(got) == len({(r.query_id, r.id) for r in got}) and {r.length for r in got} == {200}
    full = R.retrieve(queries, table, score, None)
    assert {(r.query_id, r.id): r["rank"] for r in full.collect()} == ranked


def test_curve_from_its_corners(spark):
    """The area under all depths, from the depths with hits."""
    ranks = [(1, 10, 2), (1, 11, 5), (1, 12, 6), (2, 10, 1), (2, 13, 9)]
    df = spark.createDataFrame([(*r, 12) for r in ranks], "query_id int, id int, rank long, length long")
    relevant = spark.createDataFrame([(q, i) for q, i, _ in ranks] + [(2, 99)], "query_id int, id int")
    total, pts = {1: 3, 2: 3}, []
    for k in range(1, 13):
        seen = {q: sum(1 for a, _, r in ranks if a == q and r <= k) for q in total}
        pts.append((sum(seen[q] / total[q] for q in total) / 2, sum(seen[q] / k for q in total) / 2))
    pts.sort()
    want = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(pts, pts[1:]))
    assert M.trapezoid(M.pr_curve(df, relevant), "recall", "precision").first().area == pytest.approx(want)


def test_tagger_by_row(spark, monkeypatch):
    """Repeated and null keys; dictionary, join and table function agree; patterns; types of equal entries."""
    words = spark.createDataFrame([("token", "b"), ("token", "a"), ("of the", "phrase"), ("the", "word"), ("a token of the", "long"), ("x y z u v", "never"), ("é-b", "acc"), (None, "n"), ("", "e")], "word string, entity_type string")
    docs = spark.createDataFrame([(1, "a token here"), (1, "some other token"), (None, "Token of  the, of the"), (None, None), (2, ""), (3, "A TOKEN OF THE tokens é-B x y z u v İthe the")], "doc_id int, text string")
    of = lambda df: sorted((str(r.doc_id), r.start_position, r.end_position, r.entity_literal, r.entity_type) for r in df.collect())
    got = of(tagger.tag_spans(docs, words))
    assert got[:2] == [("1", 2, 7, "token", "a"), ("1", 11, 16, "token", "a")] and len(got) == 8
    tagger.register(spark, "tag_them", words)
    docs.createOrReplaceTempView("to_tag")
    assert of(spark.sql("SELECT * FROM tag_them(TABLE(SELECT doc_id, text FROM to_tag))")) == got
    capitals = tagger.tag_spans(docs, words, patterns=[("[A-Z]{5} OF", "caps"), ("x*", "empty")])
    assert ("3", 2, 10, "TOKEN OF", "caps") not in of(capitals) and ("3", 25, 26, " ", "caps") not in of(capitals)
    with pytest.raises(Exception, match="column text"):
        spark.sql("SELECT * FROM tag_them(TABLE(SELECT doc_id FROM to_tag))").collect()
    monkeypatch.setattr(tagger, "DICTIONARY_BYTES", 1)
    assert of(tagger.tag_spans(docs, words.dropna().filter("word <> ''"))) == got
    with pytest.raises(ValueError):
        tagger.register(spark, "too_large", words)


def test_white_space_of_all_kinds(spark):
    text = "A b　c\u0085d\x1ce  f﻿g\n"
    assert spark.createDataFrame([(text,)], "t string").select(T.tokenise(F.col("t")).alias("t")).first().t == text.lower().split()


def triples_of(spark, rows):
    kind = lambda x: "bnode" if x.startswith("_:") else "iri"
    return spark.createDataFrame([(s, kind(s), p, o, kind(o)) for s, p, o in rows], "s string, s_kind string, p string, o string, o_kind string")


def test_lists_and_expressions_of_triples(spark):
    long = [(f"_:c{i}", O.FIRST, f"I{i}") for i in range(1000)] + [(f"_:c{i}", O.REST, f"_:c{i + 1}" if i < 999 else O.NIL) for i in range(1000)]
    got = sorted((r.pos, r.item) for r in O.list_members(triples_of(spark, long)).collect())
    assert got == [(i, f"I{i}") for i in range(1000)]
    for bad in ([("_:a", O.FIRST, "x"), ("_:b", O.FIRST, "y"), ("_:a", O.REST, "_:b"), ("_:b", O.REST, "_:a")], [(c, O.FIRST, "x") for c in ("_:a", "_:b", "_:c")] + [("_:a", O.REST, "_:c"), ("_:b", O.REST, "_:c")]):
        with pytest.raises(ValueError):
            O.list_members(triples_of(spark, bad)).collect()
    rows = [("A", G.SUBCLASS, "B"), ("A", G.EQUIVALENT, "_:and"), ("_:and", O.INTERSECTION, "_:l"), ("_:l", O.FIRST, "B"), ("_:l", O.REST, "_:m"), ("_:m", O.FIRST, "_:s"), ("_:m", O.REST, O.NIL), ("_:s", G.ON_PROPERTY, "r"), ("_:s", G.SOME_VALUES, "C"), ("D", G.SUBCLASS, "_:s"), ("E", G.SUBCLASS, "_:union")]
    found = O.expressions(triples_of(spark, rows), spark.createDataFrame([("B", "bee"), ("r", "has")], "iri string, label string"))
    texts = {r.expr_id: r.text for r in A.render(found.expressions).collect()}
    said = {(texts[r.child], r.kind, texts[r.parent]) for r in found.axioms.collect()}
    assert said == {("A", "sub", "bee"), ("A", "equiv", "bee and has some C"), ("D", "sub", "has some C")}
    assert [r.axiom_id for r in found.left_out.collect()] == [f"E|{G.SUBCLASS}|_:union"]
    assert O.expressions(triples_of(spark, rows).limit(0)).axioms.count() == 0
    with pytest.raises(ValueError):
        O.expressions(triples_of(spark, [("A", G.SUBCLASS, "_:s"), ("_:s", G.ON_PROPERTY, "r"), ("_:s", G.SOME_VALUES, "_:s")]))


def plain_el(forms, roles):
    sub = {(x, x) for k, a, b, c in forms for x in ((a, b) if k == "nf1" else (a, b, c) if k == "nf2" else (a, c) if k == "nf3" else (b, c))}
    link, wider = set(), lambda r: {r} | {w for a, w in roles if a == r}
    while True:
        size = len(sub) + len(link)
        for kind, a, b, c in forms:
            if kind == "nf1":
                sub |= {(x, b) for x, y in sub if y == a}
            elif kind == "nf2":
                sub |= {(x, c) for x, y in sub if y == a and (x, b) in sub}
            elif kind == "nf3":
                link |= {(x, r, c) for x, y in sub if y == a for r in wider(b)}
            else:
                sub |= {(x, c) for x, r, f in link if r == a and (f, b) in sub}
        if len(sub) + len(link) == size:
            return sub, link


@pytest.mark.parametrize("seed", [1, 2])
def test_saturation(spark, seed):
    rnd = random.Random(seed)
    c, r = [f"C{i}" for i in range(9)], ["r", "s"]
    forms = [("nf1", rnd.choice(c), rnd.choice(c), None) for _ in range(6)] + [("nf2", *rnd.choices(c, k=3)) for _ in range(4)]
    forms += [("nf3", rnd.choice(c), rnd.choice(r), rnd.choice(c)) for _ in range(4)] + [("nf4", rnd.choice(r), *rnd.choices(c, k=2)) for _ in range(4)]
    df = spark.createDataFrame(forms, "kind string, first string, second string, third string")
    subs, links = O.saturate(df, spark.createDataFrame([("r", "s")], "sub string, super string"))
    want = plain_el(forms, [("r", "s")])
    assert {tuple(x) for x in subs.collect()} == want[0] and {(x.sub, x.role, x.filler) for x in links.collect()} == want[1]
    assert subs.count() == len(want[0])


TURTLE = '''@prefix ex: <http://x.org/> . # a comment . with dots.
@base <http://b.org/dir/> .
PREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#>
ex:a a ex:C ; rdfs:label "short . \\"q\\" \\u00e9"@en , """long .
 <not an iri> . "inner" #no comment
 ex:z ex:z ex:z .
end"""^^ex:t ; .
<rel> ex:p ( 1 2.5 "x" [ ex:q _:b1 ; ex:r true ] ) .
[ ex:p ex:o ] .
_:b1 ex:p <http://full/\\u0041>, ex:c\\,d, ex:a.b.
@prefix ex: <http://y.org/> .
ex:a ex:b -1e3 , \'\'\'single .
 \'\' x\'\'\' , () .
'''


def test_turtle_in_blocks_of_any_size(spark, tmp_path):
    (tmp_path / "a.ttl").write_text(TURTLE)
    (tmp_path / "b.ttl").write_text("\n\n")
    (tmp_path / "c.ttl").write_text("@prefix : <http://c/> .\n:s :p :o .")
    same = lambda rows: sorted(tuple("_:?" if re.match("_:[0-9a-f]{8}b", x) else x for x in r) for r in rows)
    whole = [tuple(r) for r in turtle.read_turtle(spark, str(tmp_path)).collect()]
    found = {(s, p, o) for s, _, p, o, _ in whole}
    assert len(whole) == 22 and {("http://x.org/a", turtle.RDF + "type", "http://x.org/C"), ("http://c/s", "http://c/p", "http://c/o"), ("_:b1", "http://x.org/p", "http://full/A"), ("_:b1", "http://x.org/p", "http://x.org/c,d"), ("_:b1", "http://x.org/p", "http://x.org/a.b"), ("http://y.org/a", "http://y.org/b", "-1e3")} <= found
    assert ("http://x.org/a", "http://www.w3.org/2000/01/rdf-schema#label", 'short . "q" é') in found and any(o.startswith("long .\n <not") and o.endswith("end") for _, _, o in found)
    settings = {"spark.sql.files.maxPartitionBytes": None, "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    try:
        for n in (17, 64, 150):
            for k, v in settings.items():
                spark.conf.set(k, v or str(n))
            assert same(tuple(r) for r in turtle.read_turtle(spark, str(tmp_path)).collect()) == same(whole)
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert [r.p for r in turtle.compact(turtle.read_turtle(spark, str(tmp_path))).filter("o = 'http://x.org/C'").collect()] == ["rdf:type"]
    (tmp_path / "bad.ttl").write_text("<a> <b> nothing:c .")
    with pytest.raises(Exception, match="not declared"):
        turtle.read_turtle(spark, str(tmp_path / "bad.ttl")).collect()


def test_escapes_in_ntriples(spark, tmp_path):
    (tmp_path / "a.nt").write_text('<a> <b> "x \\"q\\" \\u00e9 \\U0001F600 \\n\\\\n"@en .\n')
    assert [tuple(r) for r in io.read_ntriples(spark, str(tmp_path / "a.nt")).collect()] == [("a", "iri", "b", 'x "q" é 😀 \n\\n', "literal")]


def test_exact_shares(spark):
    forms = spark.createDataFrame([Row(kind=k, derived=d, axiom_id=i) for k, d, n in (("nf1", False, 57), ("nf1", True, 9), ("nf2", False, 30)) for i in range(n)])
    got = A.split_forms(forms, F.concat_ws("|", "kind", F.col("derived").cast("string"), F.col("axiom_id").cast("string")))
    sizes = {(r.kind, r.derived, r.split): r["count"] for r in got.groupBy("kind", "derived", "split").count().collect()}
    assert sizes == {("nf1", False, "train"): 45, ("nf1", False, "val"): 5, ("nf1", False, "test"): 7, ("nf1", True, "train"): 7, ("nf1", True, "test"): 2, ("nf2", False, "train"): 24, ("nf2", False, "val"): 3, ("nf2", False, "test"): 3}
