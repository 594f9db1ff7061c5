"""Views of the test tables that the registered queries run on, as DataFrames and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Curvature of the ball that the points lie in: radius 8, norms 4 to 6.
K = 1.0 / 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column) -> Column:
    return F.round(c, 6)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, vec): embeddings moved to different depths of the ball."""
    e = table(spark, sf_dir, "embeddings")
    scale = F.lit(4.0) + (F.col("vec_id") % 11).cast("double") * 0.2
    return e.select(F.col("vec_id").alias("id"), "label", F.transform(F.col("embedding").cast("array<double>"), lambda x: x * scale).alias("vec"))


def asked(pts: DataFrame) -> DataFrame:
    """(query_id, q): the stated query set, every point whose id is divisible by 100."""
    return pts.filter(F.col("id") % 100 == 0).select(F.col("id").alias("query_id"), F.col("vec").alias("q"), F.col("label").alias("q_label"))


def neighbours(pts: DataFrame) -> DataFrame:
    """(id, u, v): each point with the one of the next id."""
    nxt = pts.select((F.col("id") - 1).alias("id"), F.col("vec").alias("v"), F.col("label").alias("v_label"))
    return pts.select("id", F.col("vec").alias("u"), F.col("label").alias("u_label")).join(nxt, "id")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(child, parent): orders, suppliers, customers, nations, regions, parts, brands, types; customers also have an
    edge to their region, which follows from others."""
    t = lambda n: table(spark, sf_dir, n)
    node = lambda p, c: F.concat(F.lit(f"{p}:"), F.col(c).cast("string"))
    pair = lambda df, a, b: df.select(a.alias("child"), b.alias("parent"))
    c = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    parts = [
        pair(t("orders"), node("O", "o_orderkey"), node("C", "o_custkey")),
        pair(t("lineitem"), node("O", "l_orderkey"), node("S", "l_suppkey")).distinct(),
        pair(c, node("C", "c_custkey"), node("N", "c_nationkey")),
        pair(c, node("C", "c_custkey"), node("R", "n_regionkey")),
        pair(t("supplier"), node("S", "s_suppkey"), node("N", "s_nationkey")),
        pair(t("nation"), node("N", "n_nationkey"), node("R", "n_regionkey")),
        pair(t("part"), node("P", "p_partkey"), node("B", "p_brand")),
        pair(t("part"), node("P", "p_partkey"), node("T", "p_type")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(child, parent): suppliers, nations, regions."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    one = s.select(F.concat(F.lit("S:"), F.col("s_suppkey").cast("string")).alias("child"), F.concat(F.lit("N:"), F.col("s_nationkey").cast("string")).alias("parent"))
    return one.union(n.select(F.concat(F.lit("N:"), F.col("n_nationkey").cast("string")), F.concat(F.lit("R:"), F.col("n_regionkey").cast("string"))))


def same_as(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b): suppliers of neighbouring keys in one region, which form chains."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("k"), F.col("n_regionkey").alias("r"))
    nxt = s.select((F.col("k") - 1).alias("k"), F.col("r").alias("r2"), F.col("k").alias("k2"))
    return s.join(nxt, "k").filter("r = r2").select(F.concat(F.lit("S:"), F.col("k").cast("string")).alias("a"), F.concat(F.lit("S:"), F.col("k2").cast("string")).alias("b"))


POINTS = "points AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE * (4.0::DOUBLE + (vec_id % 11)::DOUBLE * 0.2::DOUBLE)) AS vec FROM embeddings)"
ASKED = POINTS + ", asked AS (SELECT id AS query_id, vec AS q, label AS q_label FROM points WHERE id % 100 = 0)"
NEIGHBOURS = POINTS + ", nb AS (SELECT a.id, a.vec AS u, b.vec AS v, a.label AS u_label, b.label AS v_label FROM points a JOIN points b ON b.id = a.id + 1)"
EDGES = """edges AS (
  SELECT 'O:' || o_orderkey AS child, 'C:' || o_custkey AS parent FROM orders
  UNION SELECT 'O:' || l_orderkey, 'S:' || l_suppkey FROM lineitem
  UNION SELECT 'C:' || c_custkey, 'N:' || c_nationkey FROM customer
  UNION SELECT 'C:' || c_custkey, 'R:' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION SELECT 'S:' || s_suppkey, 'N:' || s_nationkey FROM supplier
  UNION SELECT 'N:' || n_nationkey, 'R:' || n_regionkey FROM nation
  UNION SELECT 'P:' || p_partkey, 'B:' || p_brand FROM part
  UNION SELECT 'P:' || p_partkey, 'T:' || p_type FROM part)"""
PATHS = """, paths AS (
  SELECT child AS node, parent AS ancestor, 1 AS depth FROM edges
  UNION SELECT p.node, e.parent, p.depth + 1 FROM paths p JOIN edges e ON p.ancestor = e.child
), closure AS (SELECT node, ancestor, min(depth)::INTEGER AS depth FROM paths GROUP BY node, ancestor)"""
CLOSURE = EDGES + PATHS
PLACES = """edges AS (
  SELECT 'S:' || s_suppkey AS child, 'N:' || s_nationkey AS parent FROM supplier
  UNION SELECT 'N:' || n_nationkey, 'R:' || n_regionkey FROM nation)"""
SAME = """same AS (
  SELECT 'S:' || a.s_suppkey AS a, 'S:' || b.s_suppkey AS b
  FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1
  JOIN nation x ON a.s_nationkey = x.n_nationkey JOIN nation y ON b.s_nationkey = y.n_nationkey WHERE x.n_regionkey = y.n_regionkey)"""

#: SQL of the vector functions; u and v stand for list expressions.
N2 = "list_inner_product({0}, {0})"
D2 = "list_sum(list_transform(list_zip({0}, {1}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def sql_poincare(u: str, v: str, eps: str = "1e-7", k: float = K) -> str:
    den = f"((1 - ({k} * {N2.format(u)} + {eps}::DOUBLE)) * (1 - ({k} * {N2.format(v)} + {eps}::DOUBLE)))"
    return f"(acosh(greatest(1.0::DOUBLE, 1 + 2 * {k}::DOUBLE * {D2.format(u, v)} / {den})) / sqrt({k}::DOUBLE))"


def sql_depth(u: str, k: float = K) -> str:
    n = N2.format(u)
    return f"(acosh(greatest(1.0::DOUBLE, 1 + 2 * {k}::DOUBLE * {n} / (1 - {k}::DOUBLE * {n}))) / sqrt({k}::DOUBLE))"


def sql_subsumption(child: str, parent: str, weight: float) -> str:
    return f"(-({sql_poincare(child, parent, '0')} + {weight}::DOUBLE * ({sql_depth(parent)} - {sql_depth(child)})))"
