"""Literal vectors, and properties that hold for all inputs."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from taxolume.functions import text as T
from taxolume.functions import vector as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def vec(*x):
    return F.array(*[F.lit(float(v)) for v in x])


def test_vector_literals(spark):
    assert one(spark, V.norm(vec(3, 4))) == 5
    assert one(spark, V.dot(vec(3, 4), vec(1, 2))) == 11
    assert one(spark, V.dot(vec(1, 2), vec(5, 6))) == 17
    assert one(spark, V.cosine(vec(1, 0), vec(0, 1))) == 0
    assert one(spark, V.l2(vec(0, 5), vec(0, 1))) == 4


def test_text_literals(spark):
    assert one(spark, T.strip_parens(F.lit("Type 2 diabetes (disorder)"))) == "Type 2 diabetes"
    assert one(spark, T.tokenise(F.lit("example list of  Sentences "))) == ["example", "list", "of", "sentences"]
    assert one(spark, T.normalise_mention(F.lit("  Heart-Failure, acute! "))) == "heart failure acute"
    assert one(spark, T.answer_letter(F.lit("It is B."), F.array(F.lit("A"), F.lit("B")))) == "B"
    assert one(spark, T.answer_letter(F.lit("E"), F.array(F.lit("A")))) is None
    assert one(spark, T.is_broad(F.lit("Disease (disorder)"))) is True
    assert one(spark, T.percentage(F.lit(1), F.lit(2))) == "50"
    assert one(spark, T.lexicon_name(F.array(F.lit("A B (c)")))) == "a b"
    assert one(spark, T.lexicon_name(F.lit(None).cast("array<string>"))) == "owl:Thing"
    assert one(spark, T.numeric_key(F.lit("http://x/12"))["number"]) == 12
    with pytest.raises(Exception, match="no trailing number"):
        one(spark, T.number_of(F.lit("abc")))


def test_reflection_and_projection(spark):
    assert one(spark, V.reflect(vec(1, 2), vec(0, 1))) == [1, -2]
    p = one(spark, V.project(vec(0.3, 0.4), vec(0, 1), 1.0))
    assert abs(p[1]) < 1e-12 and p[0] > 0
    with pytest.raises(Exception, match="length 0"):
        one(spark, V.reflect(vec(1, 2), vec(0, 0)))


def test_kernels(spark):
    d = [F.lit(3.0), F.lit(4.0)]
    assert one(spark, V.mixed_distance(d, [1, 1], "dist")) == 5
    assert one(spark, V.mixed_distance(d, [1, 1], "exp")) == pytest.approx(math.exp(-5))
    assert one(spark, V.mixed_distance(d, [1, 1], "inv")) == pytest.approx(1 / 26)
    with pytest.raises(ValueError):
        V.mixed_distance(d, [1, 1], "none")


coordinate = st.floats(-0.5, 0.5, allow_nan=False)
pair = st.tuples(st.tuples(coordinate, coordinate), st.tuples(coordinate, coordinate))


@settings(max_examples=5, deadline=None)
@given(st.lists(pair, min_size=20, max_size=40))
def test_distance_properties(spark, pairs):
    df = spark.createDataFrame([(list(map(float, a)), list(map(float, b))) for a, b in pairs], "u array<double>, v array<double>")
    u, v = F.col("u"), F.col("v")
    cached = V.poincare_from_norms(V.squared_norm(u), V.squared_norm(v), V.dot(u, v), 1.0)
    rows = df.select(V.poincare(u, v, 1.0).alias("d"), V.poincare(v, u, 1.0).alias("e"), V.poincare(u, u, 1.0).alias("z"), cached.alias("c"), V.cone_energy(u, v).alias("w")).collect()
    for r in rows:
        assert r.z == 0 and r.d >= 0 and r.d == pytest.approx(r.e) and r.d == pytest.approx(r.c, abs=1e-6)
        assert r.w is None or r.w >= 0 or math.isnan(r.w)
