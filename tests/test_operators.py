"""Operators on small hand-made inputs."""

import random

import pytest
from pyspark.sql import functions as F

from taxolume.operators import axioms as A
from taxolume.operators import graph as G
from taxolume.operators import lexical as L
from taxolume.operators import metrics as M
from taxolume.operators import qa as Q
from taxolume.operators import retrieve as R
from taxolume.operators import sets as S

#: A diamond, a redundant edge (a, d), two paths of different length to e, and an isolated pair.
EDGES = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("a", "d"), ("d", "e"), ("a", "e"), ("x", "y")]


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def dag(spark):
    return spark.createDataFrame(EDGES, "child string, parent string")


def test_closure_and_reduction(dag):
    up = G.ancestors(dag)
    assert ("a", "e", 1) in rows(up) and ("b", "e", 2) in rows(up) and len(rows(up)) == 10
    assert rows(G.transitive_reduction(dag)) == [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("x", "y")]
    reduced = G.transitive_reduction(dag)
    assert rows(G.ancestors(reduced).select("node", "ancestor")) == rows(up.select("node", "ancestor"))
    assert rows(G.transitive_edges(dag)) == [("b", "e"), ("c", "e")]
    assert rows(G.roots(dag)) == [("e",), ("y",)]
    assert rows(G.ancestors(dag, max_depth=1)) == sorted((a, b, 1) for a, b in EDGES)
    with pytest.raises(ValueError):
        G.top_concept(dag, "a")


def test_cycles_end(spark):
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "child string, parent string")
    assert len(rows(G.ancestors(ring))) == 9


def test_equivalence_chain(spark):
    eq = spark.createDataFrame([("u/10", "u/9"), ("u/9", "u/30"), ("v", "w")], "a string, b string")
    assert rows(G.canonical(eq)) == [("u/10", "u/9"), ("u/30", "u/9"), ("u/9", "u/9"), ("v", "v"), ("w", "v")]


def test_negatives(dag):
    hard = S.hard_negatives(dag, G.ancestors(dag))
    assert ("b", "c") in rows(hard) and ("a", "b") not in rows(hard) and ("b", "a") in rows(hard)
    ex = S.examples(dag, hard, S.random_negatives(dag, dag.select(F.col("child").alias("node")).distinct(), G.ancestors(dag), 3, 1))
    assert all(len(r.negatives) <= 10 and r.child not in r.negatives for r in ex.collect())
    assert S.pairs(ex).filter("label = 1").count() == len(EDGES)


def test_set_law(spark):
    a, b = (spark.createDataFrame([(w,) for w in x], "word string") for x in (["A", "b", "c", "a"], ["B", "z"]))
    assert rows(S.intersection(a, b)) == [("b",)] and rows(S.difference(a, b)) == [("a",), ("c",)]
    assert S.coverage(a, b).first()["percent"] == "33.33"
    with pytest.raises(ValueError):
        S.sample(a, "word", 9, 1)


def test_gain_golden(spark):
    ideal, got = [5, 4, 4, 3, 3, 3, 2, 2, 1, 1], [2, 3, 5, 4, 3, 3, 2, 0, 1, 0]
    n = lambda xs: spark.createDataFrame([(x, i + 1) for i, x in enumerate(xs)], "rel int, rank int").agg(F.sum(M.gain(F.col("rel"), F.col("rank")))).first()[0]
    assert n(ideal) == pytest.approx(58.72, abs=0.01) and n(got) == pytest.approx(35.88, abs=0.01) and n(got) / n(ideal) == pytest.approx(0.611, abs=1e-3)


def test_rank_metrics(spark):
    ranked = spark.createDataFrame([(1, i, i) for i in range(1, 6)] + [(2, i, i) for i in range(1, 6)], "query_id long, id long, rank int")
    rel = spark.createDataFrame([(1, 2), (1, 4), (2, 9)], "query_id long, id long")
    assert [r.ap for r in M.average_precision(ranked, rel).orderBy("query_id").collect()] == [0.5, 0.0]
    assert [r.rp for r in M.r_precision(ranked, rel).orderBy("query_id").collect()] == [0.5, 0.0]
    one = M.single_target(M.first_hits(ranked, rel), 5).first()
    assert one["mrr"] == 0.25 and one["mr"] == 4.0 and one["median"] == 4.0 and one["hits_3"] == 0.5
    p = [r.precision for r in M.macro_pr(ranked, rel).orderBy("recall").collect()]
    assert len(p) == 101 and p == sorted(p, reverse=True)


def test_threshold_grid_matches_brute_force(spark):
    data = [(-1.27, 0), (-0.4, 1), (-0.4, 0), (0.35, 1), (0.9, 1), (1.01, 0), (1.5, 1)]
    df = spark.createDataFrame(data, "score double, label int")
    for small in (False, True):
        for r in M.threshold_grid(df, 100, small).collect():
            t = r.step / 100
            yes = [y for s, y in data if (s <= t if small else s > t)]
            assert (r.tp, r.fp) == (sum(yes), len(yes) - sum(yes))


def test_rank_auc(spark):
    best = spark.createDataFrame([(1,), (1,)], "rank long")
    worst = spark.createDataFrame([(10,), (10,)], "rank long")
    assert M.rank_auc(best, 10).first()["auc"] == pytest.approx(1.0) and M.rank_auc(worst, 10).first()["auc"] <= 0.51


def test_lexical_index_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red apple red"), (2, "green apple"), (3, "blue sky"), (4, None), (5, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "red apple apple")], "query_id long, text string")
    index = L.tfidf_index(docs)
    index.save(str(tmp_path / "index"))
    again = L.load(spark, str(tmp_path / "index"), "tfidf")
    assert [r.id for r in L.tfidf_search(again, asked).orderBy("rank").collect()] == [1, 2]
    bm = L.bm25_index(docs)
    assert [r.id for r in L.bm25_search(bm, asked, None).orderBy("rank").collect()][:2] == [1, 2] and L.bm25_search(bm, asked, None).count() == 5


def test_search_validation_and_bulk(spark):
    table = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "id long, vec array<double>")
    q = table.filter("id = 3").selectExpr("id query_id", "vec q")
    entities = table.selectExpr("id mapping_id", "concat('i', id) iri", "'v' verbalisation")
    assert rows(Q.search(q, table, entities, "dense", "l2", 2))[0][2] == "i3"
    with pytest.raises(ValueError):
        Q.search(q, table, entities, "dense", None, 2)
    with pytest.raises(ValueError):
        Q.search(q, table, entities, "other", "l2", 2)
    slow = R.retrieve(q, table, "l2", 4)
    assert rows(slow) == rows(R.bulk_top_k(q, table, 4, kind="l2"))
    with pytest.raises(ValueError):
        R.select_entities(slow, 5, 4, True)
    with pytest.raises(ValueError):
        R.assert_aligned(table, q)


def test_render_and_normalise(spark):
    e = spark.createDataFrame([("r", None, 0, "some", "has"), ("p", "r", 0, "and", ""), ("x", "p", 0, "iri", "X"), ("y", "p", 1, "iri", "Y")], "expr_id string, parent_expr string, pos int, kind string, name string")
    assert dict(map(tuple, A.render(e).collect()))["r"] == "has some X and Y"
    assert dict(map(tuple, A.render(e, A.LOGIC).collect()))["r"] == " ∃has.X ⊓ Y "


def plain_forms(tree, kind, left, right):
    """Normal forms of one axiom by definition; tree: id -> (kind, name, parts)."""

    def text(x):
        k, name, parts = tree[x]
        return name if k == "iri" else " and ".join(map(text, parts)) if k == "and" else f"{name} some {text(parts[0])}"

    out, defined = set(), set()

    def define(parts):
        """parts: one expression, or the parts of a conjunction."""
        if len(parts) == 1:
            k, name, own = tree[parts[0]]
            if k == "iri":
                return
            if k == "some":
                define(own)
                defined.update({("nf3", text(parts[0]), name, text(own[0])), ("nf4", name, text(own[0]), text(parts[0]))})
                return
            parts = own
        words = [text(p) for p in parts]
        for p in parts:
            define([p])
        defined.update(("nf1", " and ".join(words), w, None) for w in words)
        defined.update(("nf2", words[i], " and ".join(words[i + 1 :]), " and ".join(words[i:])) for i in range(len(words) - 1))

    def below(x, y):
        k, name, parts = tree[y]
        if k == "and":
            for p in parts:
                below(x, p)
        elif k == "some":
            define([x])
            define(parts)
            out.add(("nf3", text(x), name, text(parts[0])))
        else:
            kx, nx, px = tree[x]
            if kx == "iri":
                out.add(("nf1", text(x), text(y), None))
            elif kx == "and":
                define([px[0]])
                define(px[1:])
                out.add(("nf2", text(px[0]), " and ".join(map(text, px[1:])), text(y)))
            else:
                define(px)
                out.add(("nf4", nx, text(px[0]), text(y)))

    below(left, right)
    if kind == "equiv":
        below(right, left)
    return {(False, *x) for x in out} | {(True, *x) for x in defined}


def test_normal_forms_match_their_definition(spark):
    rng, rows, trees, axioms = random.Random(3), [], {}, []

    def grow(axiom, height):
        at = f"{axiom}/{len(trees[axiom])}"
        kind = rng.choice(["iri", "and", "some"]) if height else "iri"
        trees[axiom][at] = None
        parts = [grow(axiom, height - 1) for _ in range({"iri": 0, "and": rng.choice([2, 2, 3, 4]), "some": 1}[kind])]
        trees[axiom][at] = (kind, {"iri": rng.choice("ABCDE"), "and": "", "some": rng.choice("rs")}[kind], parts)
        return at

    for i in range(25):
        trees[i] = {}
        axioms.append((i, rng.choice(["sub", "equiv"]), grow(i, 3), grow(i, 3)))
        for x, (kind, name, parts) in trees[i].items():
            up = [(y, p.index(x)) for y, (_, _, p) in trees[i].items() if x in p]
            rows.append((x, up[0][0] if up else None, up[0][1] if up else 0, kind, name))
    e = spark.createDataFrame(rows, "expr_id string, parent_expr string, pos int, kind string, name string")
    a = spark.createDataFrame(axioms, "axiom_id long, kind string, child string, parent string")
    forms = A.normalise(a, e).checkpoint()
    got = {}
    for r in forms.collect():
        got.setdefault(r.axiom_id, []).append((r.derived, r.kind, r.first, r.second, r.third))
    for i, kind, left, right in axioms:
        assert sorted(set(got[i]), key=repr) == sorted(plain_forms(trees[i], kind, left, right), key=repr)
    assert A.normalise(a.limit(0), e).count() == 0
    names = spark.createDataFrame([(n, i) for i, n in enumerate("ABCDE")], "name string, seq long")
    ids = {r.name: (r.id, r.label) for r in A.concept_ids(names, forms).collect()}
    assert [ids[n] for n in "ABCDE"] == [(i, n) for i, n in enumerate("ABCDE")] and sorted(i for i, _ in ids.values()) == list(range(len(ids)))
    assert all(label == f"N{i - 5}" for n, (i, label) in ids.items() if n not in "ABCDE")
    made = A.training_rows(A.distinct_forms(forms), A.concept_ids(names, forms).select("name", "id"), 4)
    assert made.count() == A.distinct_forms(forms).select("kind", "first", "second", "third").count()
    for r in made.collect():
        assert len(r.negative) == 4 and (r.kind != "nf3" or all(x.startswith(f"{r.role} some ") for x in r.negative))
        assert (r.con1 is not None) == (r.kind == "nf2") and (r.role is not None) == (r.kind in ("nf3", "nf4"))
    assert A.conjunction_rows(made).filter("Concept <> concat(con1, ' and ', con2)").isEmpty() and A.existential_rows(made).count() == made.filter("role is not null").count()


def test_stream(spark, tmp_path):
    from taxolume.streaming.scoring import retrieve_stream

    table = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "id long, vec array<double>")
    table.selectExpr("id query_id", "vec q").write.parquet(str(tmp_path / "in"))
    q = spark.readStream.schema("query_id long, q array<double>").parquet(str(tmp_path / "in"))
    retrieve_stream(q, table, str(tmp_path / "out"), str(tmp_path / "state"), score="l2", k=2).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 18
