"""Span tagging, flows, scratch tables, hot keys, and the library without its training-data part."""

import os
import re
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from taxolume import storage
from taxolume.functions import vector as V
from taxolume.operators import graph as G
from taxolume.operators import metrics as M
from taxolume.operators import qa as Q
from taxolume.operators import retrieve as R
from taxolume.operators import sets as S
from taxolume.operators import tagger
from taxolume.sources import io

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_spans_of_a_dictionary(spark):
    words = {"type 2 diabetes": "disease", "diabetes": "disease", "insulin": "drug", "heart": "part", "heart failure": "disease", "failure of the heart": "disease"}
    texts = ["Type 2 diabetes and INSULIN, insulin.", "heart  failure or heart failure; failure of the heart failure", "", None, "no such words", "é insulin 🙂 diabetes insulin's"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.start_position, r.end_position, r.entity_literal, r.entity_type) for r in tagger.tag_spans(docs, spark.createDataFrame(list(words.items()), "word string, entity_type string")).collect())
    want = []
    for i, t in enumerate(texts):
        tokens, far = list(re.finditer(r"[\w'-]+", (t or "").replace("_", " "))), 0
        for a, first in enumerate(tokens):
            for last in reversed(tokens[a : a + 4]):
                own = t[first.start() : last.end()]
                if own.lower() in words and last.end() > far:
                    want.append((i, first.start(), last.end(), own, words[own.lower()]))
                    far = last.end()
                    break
    assert got == sorted(want) and len(got) == 9


def test_flow_errors(spark):
    q = spark.createDataFrame([("a", 1, "what", [Row(letter="A", text="x")], "A")], "dataset string, question_id long, question string, options array<struct<letter:string,text:string>>, answer string")
    with pytest.raises(ValueError):
        Q.run_datasets(q, ["a", "b"], None, lambda c: F.lit("A"))
    assert Q.run_datasets(q, ["a"], None, lambda c: F.lit("A")).count() == 1
    for call in (lambda: Q.search_by_name(q, q, q, "none"), lambda: Q.answer_context(q, q, None, q, "sbert"), lambda: R.Retrievers(q, q).make("none"), lambda: S.check_exists(q, 2), lambda: M.existential_loss("none", F.lit(1))):
        with pytest.raises(ValueError):
            call()


def test_bulk_retriever_and_combined_rank_rows(spark):
    t = spark.createDataFrame([(i, [i * i / 200, 0.1]) for i in range(10)], "id long, vec array<double>")
    q = spark.createDataFrame([(100 + i, [i / 21, 0.2]) for i in range(3)], "query_id long, q array<double>")
    by_score = R.Retriever("m", "l2", t)
    assert sorted(map(tuple, by_score.bulk(q, 3).select("query_id", "rank", "id").collect())) == sorted(map(tuple, by_score.top(q, 3).select("query_id", "rank", "id").collect()))
    plain = R.Retriever("m", "poincare", t, curvature=0.5).top(q, 4)
    kept = R.Retriever("m", "poincare", R.with_norms(t), curvature=0.5).top(q, 4)
    assert [(r.query_id, r.id, round(r.score, 9)) for r in plain.orderBy("query_id", "rank").collect()] == [(r.query_id, r.id, round(r.score, 9)) for r in kept.orderBy("query_id", "rank").collect()]
    score = lambda c, p, w: -V.l2(c, p) * w
    rows = [(k, i, [i * i / 200, 0.1], i) for i, k in enumerate(("nf1", "nf2", "nf3", "nf4"))]
    asked = spark.createDataFrame(rows, "kind string, query_id long, q array<double>, answer long")
    assert {r.kind for r in M.kind_evaluation(asked, t, score).collect()} == {"nf1", "nf2", "nf3", "nf4", "combined"}
    assert {r.kind for r in M.kind_evaluation(asked.filter("kind <> 'nf3'"), t, score).collect()} == {"nf1", "nf2"}
    assert M.kind_evaluation(asked, t, score).filter("kind = 'combined'").first().mrr == 1.0
    assert M.best_rank_weight(asked, t, score, (0.5, 1.0)).first().weight == 0.5


def test_evaluation_of_nothing_and_falling_recall(spark):
    none = spark.createDataFrame([], "weight double, score double, label int")
    assert M.evaluate(none).first().weight is None
    pts = spark.createDataFrame([(1, 0.0, 1.0), (2, 0.5, 0.5), (3, 0.4, 0.4)], "k int, r double, p double")
    assert M.trapezoid(pts.filter("k < 3"), "r", "p", order="k").first().area == 0.375
    with pytest.raises(Exception, match="r falls"):
        M.trapezoid(pts, "r", "p", order="k").collect()


def test_negatives_are_as_many_as_there_are(spark):
    edges = spark.createDataFrame([(f"c{i}", "p") for i in range(300)] + [("p", "top")], "child string, parent string")
    nodes = edges.select(F.col("child").alias("node")).union(edges.select("parent")).distinct()
    closure = G.ancestors(edges)
    got = S.random_negatives(edges, nodes, closure, 5, 1).groupBy("child").agg(F.count_distinct("negative").alias("n"), F.max("place").alias("last")).collect()
    assert len(got) == 301 and all(r.n == r["last"] == 5 for r in got)
    every = S.random_negatives(edges.filter("child = 'p'"), nodes, closure, 1000, 1)
    assert every.count() == 300 and every.filter("negative in ('p', 'top')").count() == 0
    assert S.random_negatives(edges.limit(0), nodes, closure, 5, 1).count() == 0
    hard, all_hard = S.hard_negatives(edges, closure, 6, 2), S.hard_negatives(edges, closure)
    assert hard.join(all_hard, ["child", "negative"], "left_anti").isEmpty() and {r.n for r in hard.groupBy("child").agg(F.count_distinct("negative").alias("n")).collect()} == {6}
    assert S.hard_negatives(edges, closure, 400).count() == all_hard.count() == 300 * 299
    with pytest.raises(Exception, match="no id for"):
        S.index_lists(spark.createDataFrame([("a", "b", ["d"])], "child string, parent string, negatives array<string>"), spark.createDataFrame([("a", 1), ("b", 2)], "name string, id long")).collect()
    with pytest.raises(Exception, match="no vector for"):
        S.static_vectors(spark.createDataFrame([(1, [1, 2])], "row long, idx array<long>"), spark.createDataFrame([(1, [0.0])], "id long, vec array<double>")).collect()


def test_triples_that_are_none_are_errors(spark, tmp_path):
    (tmp_path / "t.nt").write_text('<a> <p> <b> .\n# note\n\nbroken line\n<a> <p> "x" .\n')
    assert {(r.s, r.o_kind) for r in io.read_ntriples(spark, str(tmp_path / "t.nt"), strict=False).collect()} == {("a", "iri"), ("a", "literal"), (None, "malformed")}
    with pytest.raises(Exception, match="no triple: broken line"):
        io.read_ntriples(spark, str(tmp_path / "t.nt")).collect()
    io.write_summary({"a": 1}, str(tmp_path / "s.json"))
    assert io.read_json(spark, str(tmp_path / "s.json"), "a int").first().a == 1
    with pytest.raises(ValueError):
        io.read_dataset(spark, str(tmp_path), None, "none")


def test_windowed_counts_of_a_stream(spark, tmp_path):
    from taxolume.streaming import scoring

    rows = spark.sql("select timestamp'2020-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(id * 10 as int)) as ts, if(id % 2 = 0, 'a', 'b') as event_type, cast(id as double) as value from range(12)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = scoring.windowed_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    run.awaitTermination(60)
    got = sorted((r.start.hour, r.event_type, r.n, r.total) for r in spark.table("windows").collect())
    assert got == sorted((h, k, 3, float(sum(i for i in range(6 * h, 6 * h + 6) if i % 2 == (k == "b")))) for h in (0, 1) for k in "ab")


def test_nested_signatures(spark):
    from taxolume.functions.text import signature

    a = spark.sql("select 1 as id, named_struct('x', 1, 'y', array(named_struct('p', 1, 'q', map('k', 1, 'a', 2)))) as s")
    b = spark.sql("select 1 as id, named_struct('y', array(named_struct('q', map('a', 2, 'k', 1), 'p', 1)), 'x', 1) as s")
    c = spark.sql("select 1 as id, named_struct('y', array(named_struct('q', map('a', 2, 'k', 1), 'p', 2)), 'x', 1) as s")
    sign = lambda df: df.select(signature("s", "id", schema=df.schema)).first()[0]
    assert sign(a) == sign(b) != sign(c)


def test_queries_beyond_a_block(spark, monkeypatch):
    monkeypatch.setattr(R, "QUERY_BLOCK", 7)
    t = spark.createDataFrame([(i, [float(i * i % 17), float(i % 5)]) for i in range(700)], "id long, vec array<double>")
    q = t.filter("id < 20").select(F.col("id").alias("query_id"), F.col("vec").alias("q"))
    rows = lambda df: sorted((r.query_id, r["rank"], r.id) for r in df.collect())
    x = {r.id: r.vec for r in t.collect()}
    want = []
    for i in range(20):
        near = sorted((round(sum((a - b) ** 2 for a, b in zip(x[i], x[j], strict=True)), 9), j) for j in x if j != i)[:4]
        want += [(i, n + 1, j) for n, (_, j) in enumerate(near)]
    assert rows(R.retrieve(q, t, "l2", 4)) == want and rows(R.bulk_top_k(q, t, 4, kind="l2", block=7)) == want
    assert "CartesianProduct" not in R.scan(q, t, "l2")._jdf.queryExecution().toString()


def test_joins_on_hot_keys(spark):
    many = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    one = spark.range(10_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    got = storage.join_hot(many, one, "k", F.xxhash64("v"))
    assert got.count() == many.join(one, "k").count() and got.filter("w <> 2 * k").count() == 0
    left = storage.join_hot(many, one, "k", F.xxhash64("v"), how="left")
    assert left.count() == 20_000
    numbered = storage.numbered(many.select("v").repartition(7), [F.desc("v")], "i", storage.Scratch(spark, "t"))
    assert numbered.filter("i <> 19999 - v").isEmpty() and numbered.count() == 20_000
    times = storage.multiplied(spark.createDataFrame([("a", 25_000), ("b", 1), ("c", 0)], "k string, n long"), "n", "i", ["k"])
    assert times.count() == 25_001 and times.groupBy("k").agg(F.count_distinct("i").alias("d"), F.max("i").alias("m")).filter("d <> m + 1").isEmpty()
    store = storage.Scratch(spark, "kept")
    a, b = store.put(one), store.put(many)
    store.clear(a)
    assert os.listdir(store.folder.removeprefix("file:")) == ["1"] and a.count() == 10_000 and b is not None
    storage.clean(spark)
    assert not os.path.exists(store.folder.removeprefix("file:")) and not storage.Scratch.made_here


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_library_without_its_training_data_part(tmp_path):
    """Both folders deleted, with and without the pipeline's file."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", ".pytest_cache"))
    shutil.rmtree(copy / "taxolume" / "llm", ignore_errors=True)
    shutil.rmtree(copy / "tests" / "llm", ignore_errors=True)
    look = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 100 and set(o) <= set(q) and 'pipeline' not in q and not any(k.startswith('op') and k[2:3].isdigit() for k in q)"
    for _ in range(2):
        assert subprocess.run([sys.executable, "-c", look], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, timeout=120).returncode == 0
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    found = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=copy, capture_output=True, text=True, timeout=120)
    assert found.returncode == 0, found.stdout[-500:]
