"""What larger tables showed: memory, work and results that only hold on small ones."""

import random
import re
import types

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from taxolume import storage
from taxolume.functions import vector as V
from taxolume.operators import graph as G
from taxolume.operators import metrics as M
from taxolume.operators import pairs as P
from taxolume.operators import reach as X
from taxolume.operators import retrieve as R
from taxolume.operators import sets as S
from taxolume.operators import tagger
from taxolume.sources import turtle


def test_tagger_sends_no_text_and_few_spans_at_a_time(monkeypatch):
    monkeypatch.setattr(tagger, "MOST_SPANS", 100)
    told = types.SimpleNamespace(value=([("the", "word")], [], 4))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["the " * 250, None, "a the"])], ["k", "t"])
    out = list(tagger._tagged(told, "of this test", 1)(iter([batch, batch])))
    assert all(b.schema.names == ["k", *tagger.SPANS] and b.num_rows <= 100 for b in out)
    rows = [r for b in out for r in zip(b.column("k").to_pylist(), b.column("start_position").to_pylist(), strict=True)]
    assert rows == [*((1, 4 * i) for i in range(250)), (3, 2)] * 2


def test_turtle_with_more_declarations_than_once_were_taken(spark, tmp_path):
    head = "".join(f"@prefix p{i}: <http://p{i}/> .\n" for i in range(5))
    (tmp_path / "many.ttl").write_text("".join(f"{head}p{i % 5}:s{i} p0:p p1:o .\n" for i in range(20_100)))
    got = turtle.read_turtle(spark, str(tmp_path / "many.ttl"))
    assert got.select("s").distinct().count() == 20_100 and got.filter("s = 'http://p3/s13'").count() == 1


def test_turtle_declarations_hold_over_blocks(spark, tmp_path):
    lines, base = [], "http://b/"
    wanted = []
    for i in range(60):
        if i % 7 == 0:
            lines.append(f"@prefix x: <ns{i}/> .\n")
            ns = base + f"ns{i}/"
        if i % 11 == 0:
            lines.append(f"@base <{'http://b/' if i % 22 == 0 else f'd{i}/'}> .\n")
            base = "http://b/" if i % 22 == 0 else base + f"d{i}/"
        if i == 0:
            lines.append("@prefix x: <ns0/> .\n")
            ns = base + "ns0/"
        lines.append(f'<s{i}> x:p """long\n{i}""" .\n')
        wanted.append((base + f"s{i}", ns + "p", f"long\n{i}"))
    (tmp_path / "a.ttl").write_text("".join(lines))
    settings = {"spark.sql.files.maxPartitionBytes": None, "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    try:
        for n in (170, 100_000):
            for k, v in settings.items():
                spark.conf.set(k, v or str(n))
            assert sorted((r.s, r.p, r.o) for r in turtle.read_turtle(spark, str(tmp_path)).collect()) == sorted(wanted)
    finally:
        for k in settings:
            spark.conf.unset(k)


def vectors(spark, n, seed=1):
    """Points of which every third repeats another, so that scores tie."""
    rnd = random.Random(seed)
    some = [[rnd.uniform(-0.4, 0.4) for _ in range(5)] for _ in range(n)]
    rows = [(i, some[i // 6 if i % 3 == 0 else i], i % 4) for i in range(n)]
    return spark.createDataFrame(rows, "id long, vec array<double>, label int").repartition(3)


def never(*args):
    raise AssertionError("scored pair by pair")


@pytest.mark.parametrize("score", ["cosine", "inner", "l2", "poincare", "subsumption"])
def test_best_rows_by_numpy_are_those_of_the_expressions(spark, monkeypatch, score):
    monkeypatch.setattr(P, "BLOCK", 40)
    t = vectors(spark, 1300)
    q = t.filter("id % 13 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("q"))
    build, ascending = V.SCORES[score]
    every = R.scan(q, t.select("id", "vec"), score, 0.5, 0.7).filter("query_id <> id")
    plain = R.top_k(every, 7, ascending).select("query_id", "rank", "id", F.round("score", 12))
    monkeypatch.setattr(R, "scan", never)
    got = R.retrieve(q, t.select("id", "vec"), score, 7, 0.5, 0.7).select("query_id", "rank", "id", F.round("score", 12))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_best_rows_of_odd_vectors_are_left_to_the_expressions(spark):
    t = vectors(spark, 30).select("id", "vec").union(spark.createDataFrame([(100, None), (101, [0.1, None, 0.0, 0.0, 0.0])], "id long, vec array<double>"))
    q = t.filter("id = 4").select(F.col("id").alias("query_id"), F.col("vec").alias("q"))
    assert P.ready(q, t, P.score("l2", 1.0, 0.0)) is None and R.retrieve(q, t, "l2", 50).count() == 31


@pytest.mark.parametrize("score, group, shift", [("subsumption", 2_000_000, 0), ("subsumption", 60, 0), ("cosine", 60, -7), ("l2", 150, 1 << 33)])
def test_full_rankings_by_numpy_are_those_of_the_expressions(spark, monkeypatch, score, group, shift):
    monkeypatch.setattr(P, "GROUP", group)
    monkeypatch.setattr(P, "KEPT", 100)
    monkeypatch.setattr(P, "SORTED", 5000)
    monkeypatch.setattr(P, "BLOCK", 40)
    t = vectors(spark, 700).select((F.col("id") + shift).alias("id"), "vec")
    q = t.filter("id % 13 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("q"))
    q = q.union(q.filter("query_id % 26 = 0").select("query_id", F.reverse("q")))  # a query that is there twice is ranked as one
    every = R.scan(q, t, score, 0.5, 0.0).filter("query_id <> id")
    rows = lambda df: sorted(map(tuple, df.select("query_id", "rank", "id", "score").collect()))
    plain = R.top_k(every, None, V.SCORES[score][1])
    monkeypatch.setattr(R, "scan", never)
    got = R.retrieve(q, t, score, None, 0.5, 0.0)
    assert [f.dataType for f in got.schema] == [plain.schema[c].dataType for c in ("query_id", "rank", "id", "score")]
    mine, theirs = rows(got), rows(plain)
    assert [r[:3] for r in mine] == [r[:3] for r in theirs] and len(mine) > 50 * 600
    assert max(abs(a[3] - b[3]) for a, b in zip(mine, theirs, strict=True)) < 1e-12


@pytest.mark.parametrize("sorted_, block", [(16_000_000, 4096), (5000, 40), (150, 40)])
def test_full_rankings_shuffle_no_pairs(spark, monkeypatch, sorted_, block):
    monkeypatch.setattr(P, "SORTED", sorted_)  # 150: ranges of a query's rows
    monkeypatch.setattr(P, "BLOCK", block)
    monkeypatch.setattr(P, "LISTED", 64)
    t = vectors(spark, 700).select("id", "vec")
    q = t.filter("id % 13 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("q"))
    q = q.union(q.filter("query_id % 26 = 0").select("query_id", F.reverse("q")))
    plain = R.top_k(R.scan(q, t, "subsumption", 0.5, 0.0).filter("query_id <> id"), None, False).select("query_id", "rank", "id")
    got = R.retrieve(q, t, "subsumption", None, 0.5, 0.0)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.select("query_id", "rank", "id").collect())) == sorted(map(tuple, plain.collect()))


def test_rounding_without_decimals_is_rounding(spark):
    rnd = random.Random(5)
    some = [rnd.uniform(-50, 50) for _ in range(3000)] + [(2 * rnd.randrange(10**7) + 1) / 2e6 * rnd.choice((1, -1)) for _ in range(3000)]
    some += [0.0, -0.0, -1e-9, 4.9999999e-7, 5e-7, -5e-7, 999.9999995, 1e3, 1.5e300, float("inf"), float("-inf"), float("nan"), None]
    df = spark.createDataFrame([(x,) for x in some], "x double").select("x", F.round("x", 6).alias("a"), V.rounded(F.col("x"), 6).alias("b"))
    assert df.filter("not a <=> b").count() == 0 and df.count() == len(some)


@pytest.mark.parametrize("kernel", ["exp", "inv", "dist"])
def test_fusion_in_one_scan(spark, monkeypatch, kernel):
    t = vectors(spark, 700).select("id", "vec")
    q = t.filter("id % 70 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("q"))
    tables = [R.scan(q, t, s, 0.5).filter("query_id <> id") for s in ("poincare", "l2", "cosine")]
    tables[2] = tables[2].withColumn("score", F.lit(1.0) - F.col("score"))
    plain = R.mixed(tables, [1.0, 0.5, 0.35], kernel, 6).select("query_id", "rank", "id", F.round("score", 12))
    monkeypatch.setattr(R, "mixed_scan", never)
    got = R.mixed_top(q, t, ("poincare", "l2", "cosine"), [1.0, 0.5, 0.35], kernel, 6, 0.5).select("query_id", "rank", "id", F.round("score", 12))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_kinds_by_numpy_are_those_of_the_expressions(spark, monkeypatch):
    t = vectors(spark, 600).select("id", "vec")
    kind = F.element_at(F.array(*map(F.lit, M.KINDS)), (F.col("id") % 4 + 1).cast("int"))
    q = t.filter("id < 60").select(kind.alias("kind"), (F.col("id") % 50).alias("query_id"), F.col("vec").alias("q"), (F.col("id") + 3).alias("answer"))
    column = lambda c, p, w: F.round(V.subsumption(V.poincare(c, p, 0.5, eps=0.0), V.depth(V.squared_norm(c), 0.5), V.depth(V.squared_norm(p), 0.5), w), 9)
    own = P.Kind(lambda d, c, p, w: P.nine(-(d + w * (p - c))), 0.5, lambda *a: 1 / 0)
    plain = sorted(map(tuple, M.kind_ranks(q, t, column, (0.0, 0.5, 1.5)).select("weight", "kind", "query_id", "rank").collect()))
    assert len(plain) == 180 and sorted(map(tuple, M.kind_ranks(q, t, own, (0.0, 0.5, 1.5)).select("weight", "kind", "query_id", "rank").collect())) == plain


def test_first_hard_negatives_meet_few_siblings(spark, monkeypatch):
    rnd = random.Random(3)
    pairs = {(f"c{i}", f"p{rnd.randrange(4)}") for i in range(300)} | {(f"c{rnd.randrange(300)}", f"p{rnd.randrange(4)}") for _ in range(80)}
    pairs |= {("c7", "c0"), ("c0", "p1"), ("c7", "p1"), ("c1", "c7"), ("c1", "p1"), ("p2", "p1"), ("only", "alone")}
    edges = spark.createDataFrame(sorted(pairs), "child string, parent string")
    closure = G.ancestors(edges)
    wanted = {}
    for r in S.hard_negatives(edges, closure).collect():
        wanted.setdefault(r.child, []).append(r.negative)
    wanted = {(c, n) for c, own in wanted.items() for n in sorted(own)[:5]}
    met, real = [], S._no_ancestors
    monkeypatch.setattr(S, "_no_ancestors", lambda p, up: met.append(p.count()) or real(p, up))
    assert {(r.child, r.negative) for r in S.first_hard_negatives(edges, closure, 5).collect()} == wanted
    assert met[0] < 400 * 9


@pytest.mark.parametrize("cycles", [False, True])
def test_all_hard_negatives_in_blocks(spark, monkeypatch, cycles):
    monkeypatch.setattr(S, "SIBLINGS", 7)
    rnd = random.Random(11)
    pairs = {(f"n{i}", f"n{rnd.randrange(min(i, 6))}") for i in range(1, 30)} | {(f"n{i}", f"n{rnd.randrange(9)}") for i in range(9, 30, 2)}
    pairs |= {(f"leaf{i}", "n3") for i in range(40)} | {("leaf1", "n2"), ("leaf2", "leaf1"), ("leaf2", "n3")}
    if cycles:
        pairs |= {("n5", "n20"), ("n20", "n5"), ("n21", "n21"), ("leaf3", "n21"), ("n4", "n3"), ("n3", "n4"), ("leaf4", "n4")}
    rows = [*sorted(pairs), ("leaf1", "n2"), (None, "n3"), ("leaf9", None)]
    up, own = {}, {}
    for c, p in pairs:
        own.setdefault(c, set()).add(p)
    for c in own:
        todo = list(own[c])
        while todo:
            if (x := todo.pop()) not in up.setdefault(c, set()):
                up[c].add(x)
                todo += own.get(x, ())
    wanted = sorted({(a, b) for a, p in pairs for b, q in pairs if p == q and a != b and b not in up[a]})
    assert any(b in up[a] for a, p in pairs for b, q in pairs if p == q and a != b)
    edges = spark.createDataFrame(rows, "child string, parent string")
    for closure in (X.parents_index(edges), G.ancestors(edges))[: 1 + cycles]:
        assert sorted(map(tuple, S.hard_negatives(edges, closure).collect())) == wanted


def test_hard_negatives_of_a_tree_are_not_gathered(spark):
    edges = spark.createDataFrame([(f"c{i}", f"p{i % 3}") for i in range(300)], "child string, parent string")
    got = S.hard_negatives(edges, X.reach_index(edges))
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.count() == 3 * 100 * 99 and S.hard_negatives(edges.limit(0), X.reach_index(edges.limit(0))).count() == 0


def test_training_sets_broadcast_no_table_by_the_size_of_its_files(spark, monkeypatch):
    monkeypatch.setattr(storage, "FILED_ROWS", 10)
    plans, real = [], storage.Scratch.put
    shown = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    monkeypatch.setattr(storage.Scratch, "put", lambda self, df: real(self, shown(df)))
    edges = spark.createDataFrame([(f"c{i}", f"p{i % 3}") for i in range(300)] + [(f"p{i}", "top") for i in range(3)], "child string, parent string")
    nodes = edges.select(F.col("child").alias("node")).union(edges.select("parent")).distinct()
    closure = storage.Scratch(spark, "closure").put(G.ancestors(edges))
    ex = S.examples(edges, S.first_hard_negatives(edges, closure, 10), S.random_negatives(edges, nodes, closure, 10, 1), 10)
    assert shown(S.triplets(ex)).count() == 3030
    # What is meant to be broadcast has a row a range, or a row a parent.
    found = [x for p in plans for x in re.findall(r"BroadcastHashJoin \[(.*?)\]", p)]
    assert found and all(re.match(r"(coalesce\()?(_range|parent)#", x) for x in found), found


def test_index_lists_do_not_broadcast_all_ids(spark):
    ex = spark.createDataFrame([("a", "b", ["d", "c"]), ("c", "b", [])], "child string, parent string, negatives array<string>")
    ids = storage.Scratch(spark, "ids").put(spark.createDataFrame([(x, i) for i, x in enumerate("abcd")], "name string, id long"))
    got = S.index_lists(ex, ids)
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.idx for r in got.collect()) == [[0, 1, 3, 2], [2, 1]]


def test_rankings_by_class_in_rounds_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(P, "ROUND", 500 * 8)
    monkeypatch.setattr(P, "GROUP", 60)
    monkeypatch.setattr(P, "KEPT", 100)
    t = vectors(spark, 500).withColumn("label", F.when(F.col("id") != 40, F.col("label")))
    q = t.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("q"), "label")
    every = R.top_k(R.scan(q, t.select("id", "vec"), "poincare", 0.5).filter("query_id <> id"), None, True)
    relevant = q.join(t.select("id", "label"), "label").filter("id <> query_id").select("query_id", "id")
    plain = M.hits(every, relevant).select("query_id", "id", "rank", "rel")
    plain = M._running(plain).filter("rel = 1").join(relevant.groupBy("query_id").count(), "query_id")
    own = P.score("poincare", 0.5, 0.0)
    got = P.class_ranks(*P.ready(q, t, own), own)
    assert sorted(map(tuple, got.collect())) == sorted((r.query_id, r.id, r["rank"], r.seen, r["count"], 499) for r in plain.collect())
    for metric in (M.average_precisions, M.r_precision, M.pr_points, M.macro_pr, M.pr_curve):
        rows = lambda df: sorted(tuple(round(x, 9) for x in r) for r in df.collect())
        assert rows(metric(got, relevant)) == rows(metric(got.select("query_id", "id", "rank", "length"), relevant)), metric
    joined = []
    monkeypatch.setattr(M, "hits", lambda *a: joined.append(a))
    M.average_precisions(got, relevant), M.r_precision(got, relevant), M.pr_points(got, relevant)
    assert not joined


def test_ranks_of_targets_by_numpy_are_those_of_the_expressions(spark):
    t = vectors(spark, 600).select("id", "vec")
    q = t.filter("id % 7 = 0 and id < 590").select(F.col("id").alias("query_id"), F.col("vec").alias("q"), (F.col("id") + 9).alias("answer"))
    every = R.top_k(R.scan(q, t, "poincare", 0.5).filter("query_id <> id"), None, True)
    plain = every.join(q.select("query_id", F.col("answer").alias("id")), ["query_id", "id"]).select("query_id", "rank")
    own = q.join(t.select(F.col("id").alias("answer"), F.col("vec").alias("a")), "answer").withColumn("kind", F.lit("nf1")).withColumn("up", F.lit(True))
    got = P.before(*P.ready(own, t, P.score("poincare", 0.5, 0.0)), P.Kind(lambda d, c, p, w: -d, 0.5, eps=1e-7), [0.0], exclude_self=True)
    assert sorted((r.query_id, r.n + 1) for r in got.collect()) == sorted(map(tuple, plain.collect()))
