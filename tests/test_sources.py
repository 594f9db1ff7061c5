"""Readers and writers on files made here."""

import json

import numpy as np
import pytest

from taxolume.sources import io


def test_json_readers(spark, tmp_path):
    (tmp_path / "lex.json").write_text(json.dumps({"i/2": {"label": ["B (x)", "b"]}, "i/1": {"label": "owl:Thing"}}))
    assert [(r.iri, r.label) for r in io.read_lexicon(spark, str(tmp_path / "lex.json")).collect()] == [("i/2", ["B (x)", "b"]), ("i/1", None)]
    (tmp_path / "q.json").write_text(json.dumps({"set": {"1": {"question": " Why? ", "options": {"B": "x ", "A": "y"}, "answer": "A", "year": 3}}}))
    r = io.read_questions(spark, str(tmp_path / "q.json")).first()
    assert (r.dataset, r.question_id, r.question, [tuple(o) for o in r.options], r.answer) == ("set", "1", "Why?", [("B", "x"), ("A", "y")], "A") and json.loads(r.metadata) == {"year": "3"}
    (tmp_path / "train.jsonl").write_text('{"child":"a","parent":"b","negative":["c","d"]}\n\n{"child":"e","parent":"f","negative":[]}\n')
    ex = io.read_examples(spark, str(tmp_path), ["train"])["train"]
    assert sorted(map(len, (r.negative for r in ex.collect()))) == [0, 1]


def test_queries(spark, tmp_path):
    e = lambda i, d: {"iri": i, "rdfs:label": i, "skos:prefLabel": i, "depth": d}
    q = [{"internal_id": "q1", "question": "?", "target_entity": e("t", 0), "parent_entities": [e("p", 1)], "ancestors": [e("p", 1), e("g", 2)], "equivalent_classes": []}]
    (tmp_path / "q.json").write_text(json.dumps(q))
    rows = io.read_queries(spark, str(tmp_path / "q.json"))
    some, none = io.split_by_equivalents(rows)
    assert some.count() == 0 and none.count() == 1
    assert sorted(tuple(r) for r in io.query_targets(rows).collect()) == [("q1", "g", 2), ("q1", "p", 1), ("q1", "p", 1), ("q1", "t", 0)]
    assert io.query_targets(rows, single=True).count() == 1


def test_triples_vectors_tables(spark, tmp_path):
    (tmp_path / "g.nt").write_text('# c\n<a> <p> <b> .\n_:x <p> "say \\"hi\\""@en .\n')
    got = {tuple(r) for r in io.read_ntriples(spark, str(tmp_path / "g.nt")).collect()}
    assert got == {("a", "iri", "p", "b", "iri"), ("_:x", "bnode", "p", 'say "hi"', "literal")}
    np.save(tmp_path / "m.npy", np.arange(12, dtype=np.float32).reshape(4, 3))
    io.vectors_from_npy(spark, str(tmp_path / "m.npy"), str(tmp_path / "vec"), "m", 3)
    assert [r.vec for r in spark.read.parquet(str(tmp_path / "vec")).orderBy("mapping_id").collect()][3] == [9.0, 10.0, 11.0]
    df = spark.createDataFrame([("x_1", 0.5)], "name string, v double")
    io.append_metrics(df, str(tmp_path / "csv"))
    io.append_metrics(df, str(tmp_path / "csv"))
    assert io.read_metrics(spark, str(tmp_path / "csv"), df.schema).count() == 2
    assert "0.50" in io.text_table(df) and r"x\_1" in io.latex_table(df)
    with pytest.raises(ValueError):
        io.text_table(df.union(df), 1)
