"""Queries over rankings and scores: retrieval metrics, thresholds, ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from taxolume.functions import vector as V
from taxolume.operators import metrics as M
from taxolume.operators import pairs as P
from taxolume.operators import ranks as N
from taxolume.operators import retrieve as R

from .views import ASKED, K, NEIGHBOURS, asked, neighbours, points, r6, sql_poincare, sql_subsumption

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Whole rankings of all points for each stated query, and what is relevant: the same label, graded by the id.
_RANKED = ASKED + f""", s AS (SELECT query_id, id, {sql_poincare('q', 'vec')} AS score FROM asked, points WHERE id <> query_id),
ranked AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score, id)::INTEGER AS rank FROM s),
relevant AS (SELECT query_id, id, (id % 4 + 1)::INTEGER AS relevance FROM asked JOIN points ON label = q_label WHERE id <> query_id),
gold AS (SELECT query_id, min(id) AS id FROM relevant WHERE id > query_id GROUP BY query_id),
h AS (SELECT r.*, (v.id IS NOT NULL)::INTEGER AS rel, coalesce(relevance, 0) AS relevance FROM ranked r LEFT JOIN relevant v ON v.query_id = r.query_id AND v.id = r.id),
run AS (SELECT *, sum(rel) OVER (PARTITION BY query_id ORDER BY rank) AS seen FROM h),
tot AS (SELECT query_id, count(DISTINCT id) AS total FROM relevant GROUP BY query_id)"""


def _ranked(spark, sf_dir, k):
    pts = points(spark, sf_dir)
    return R.retrieve(asked(pts).select("query_id", "q"), pts.select("id", "vec"), "poincare", k, K).select("query_id", "id", "rank")


def _relevant(spark, sf_dir):
    pts = points(spark, sf_dir)
    q = asked(pts).select("query_id", F.col("q_label").alias("label"))
    return q.join(pts.select("id", "label"), "label").filter("id <> query_id").select("query_id", "id", (F.col("id") % 4 + 1).cast("int").alias("relevance"))


def _ranks(spark, sf_dir, wanted):
    """Ranks of the wanted rows among all, counted."""
    pts = points(spark, sf_dir)
    return N.relevant_ranks(asked(pts).select("query_id", "q"), pts.select("id", "vec"), wanted, "poincare", K)


def _class_ranks(spark, sf_dir, relevant):
    """Ranks of all relevant rows, those of the query's label."""
    pts, own = points(spark, sf_dir), P.score("poincare", K, 0.0)
    q = asked(pts).select("query_id", "q", F.col("q_label").alias("label"))
    made = P.ready(q, pts.select("id", "vec", "label"), own)
    return P.class_ranks(*made, own) if made else _ranks(spark, sf_dir, relevant)


def _gold(spark, sf_dir):
    return _relevant(spark, sf_dir).filter("id > query_id").groupBy("query_id").agg(F.min("id").alias("id"))


def _f1(k: int) -> str:
    h = f"(coalesce(first, 1000000000) <= {k})::INTEGER::DOUBLE"
    return f"round(avg({h}), 6) AS hits_{k}, round(avg({h} / {k}), 6) AS p_{k}, round(avg({h}), 6) AS r_{k}, round(avg(CASE WHEN {h} > 0 THEN 2 * ({h} / {k}) * {h} / ({h} / {k} + {h}) ELSE 0 END), 6) AS f1_{k}"


@query(f"WITH {_RANKED}, f AS (SELECT g.query_id, min(rank) AS first FROM gold g LEFT JOIN ranked r ON r.query_id = g.query_id AND r.id = g.id AND rank <= 100 GROUP BY g.query_id) SELECT round(avg(coalesce(1.0 / first, 0)), 6) AS mrr, round(avg(coalesce(first, 101)), 6) AS mr, median(coalesce(first, 101))::DOUBLE AS median, round(avg((first IS NOT NULL)::INTEGER), 6) AS coverage, {', '.join(map(_f1, (1, 3, 5, 10)))} FROM f")
def metric_single_target(spark, sf_dir):
    """A miss within the first 100 counts as rank 101."""
    firsts = M.first_hits(_ranked(spark, sf_dir, 100), _gold(spark, sf_dir))
    out = M.single_target(firsts, 100)
    return out.select(*[(F.col(c) if c == "median" else r6(F.col(c))).alias(c) for c in out.columns])


@query(f"WITH {_RANKED}, k AS (SELECT unnest([1, 3, 5, 10]) AS k), f AS (SELECT t.query_id, k.k, total, count(DISTINCT h.id) AS hits FROM tot t CROSS JOIN k LEFT JOIN h ON h.query_id = t.query_id AND rel = 1 AND rank <= k.k GROUP BY ALL) SELECT query_id, k, hits, round(hits / k, 6) AS precision, round(hits / total, 6) AS recall, round(CASE WHEN hits > 0 THEN 2.0 * hits / k * hits / total / (hits / k + hits / total) ELSE 0 END, 6) AS f1 FROM f")
def metric_hits_at_k(spark, sf_dir):
    return M.at_k(_ranked(spark, sf_dir, 10), _relevant(spark, sf_dir)).withColumns({c: r6(F.col(c)) for c in ("precision", "recall", "f1")})


@query(f"WITH {_RANKED}, k AS (SELECT unnest([1, 3, 5, 10]) AS k), f AS (SELECT t.query_id, k.k, total, count(DISTINCT h.id) AS hits FROM tot t CROSS JOIN k LEFT JOIN h ON h.query_id = t.query_id AND rel = 1 AND rank <= k.k GROUP BY ALL) SELECT k, round(sum(hits) / sum(total), 6) AS coverage FROM f GROUP BY k")
def metric_coverage(spark, sf_dir):
    rel = _relevant(spark, sf_dir)
    n = rel.agg(F.count_distinct("query_id", "id").alias("n"))
    return M.at_k(_ranked(spark, sf_dir, 10), rel).groupBy("k").agg(F.sum("hits").alias("h")).crossJoin(F.broadcast(n)).select("k", r6(F.col("h") / F.col("n")).alias("coverage"))


@query(f"WITH {_RANKED}, a AS (SELECT query_id, sum(CASE WHEN rel = 1 THEN seen / rank ELSE 0 END) AS s, sum(rel) AS n FROM run GROUP BY query_id) SELECT query_id, round(s / total, 6) AS ap, round(s / n, 6) AS ap_seen FROM a JOIN tot USING (query_id)")
def metric_map(spark, sf_dir):
    rel = _relevant(spark, sf_dir)
    return M.average_precisions(_class_ranks(spark, sf_dir, rel), rel).withColumns({c: r6(F.col(c)) for c in ("ap", "ap_seen")})


@query(f"WITH {_RANKED} SELECT query_id, round(sum(CASE WHEN rank <= total THEN rel ELSE 0 END) / total, 6) AS rp FROM h JOIN tot USING (query_id) GROUP BY query_id, total")
def metric_rprecision(spark, sf_dir):
    rel = _relevant(spark, sf_dir)
    return M.r_precision(_class_ranks(spark, sf_dir, rel), rel).withColumn("rp", r6(F.col("rp")))


def _gain(rel: str, rank: str, kind: str) -> str:
    g = f"(power(2.0, {rel}) - 1)" if kind == "exp" else f"{rel}::DOUBLE"
    return f"(CASE WHEN {rel} > 0 THEN {g} / log2({rank} + 1.0) ELSE 0 END)"


def _ndcg_sql(kind: str) -> str:
    return f"WITH {_RANKED}, b AS (SELECT query_id, relevance, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, id) AS place FROM relevant), i AS (SELECT query_id, sum({_gain('relevance', 'place', kind)}) AS idcg FROM b WHERE place <= 10 GROUP BY query_id), d AS (SELECT query_id, sum({_gain('relevance', 'rank', kind)}) AS dcg FROM h WHERE rank <= 10 GROUP BY query_id) SELECT query_id, round(dcg, 6) AS dcg, round(idcg, 6) AS idcg, round(dcg / idcg, 6) AS ndcg FROM i JOIN d USING (query_id)"


@query(_ndcg_sql("exp"))
def metric_ndcg(spark, sf_dir):
    return M.ndcg(_ranked(spark, sf_dir, 10), _relevant(spark, sf_dir)).withColumns({c: r6(F.col(c)) for c in ("dcg", "idcg", "ndcg")})


@query(_ndcg_sql("linear"))
def metric_ndcg_linear(spark, sf_dir):
    return M.ndcg(_ranked(spark, sf_dir, 10), _relevant(spark, sf_dir), kind="linear").withColumns({c: r6(F.col(c)) for c in ("dcg", "idcg", "ndcg")})


@query(f"WITH {_RANKED}, p AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id % 6, id) AS p, (id % 6)::INTEGER AS depth FROM relevant), c AS (SELECT query_id, id, depth + 1 AS depth, p FROM p WHERE p <= 5), g AS (SELECT *, max(depth) OVER (PARTITION BY query_id) - depth + 1 AS relevance FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, p)::INTEGER AS rank FROM g) SELECT query_id, id, depth, relevance, rank, round({_gain('relevance', 'rank', 'exp')}, 6) AS dcg FROM r")
def targets_with_gain(spark, sf_dir):
    t = _relevant(spark, sf_dir).select("query_id", "id", (F.col("id") % 6).cast("int").alias("depth"))
    return M.targets_with_gain(t, 5).withColumn("dcg", r6(F.col("dcg")))


@query(f"WITH {_RANKED} SELECT query_id, rank, seen::BIGINT AS seen, total, round(seen / rank, 6) AS precision, round(seen / total, 6) AS recall FROM run JOIN tot USING (query_id) WHERE rel = 1")
def metric_pr_points(spark, sf_dir):
    rel = _relevant(spark, sf_dir)
    return M.pr_points(_class_ranks(spark, sf_dir, rel), rel).withColumns({c: r6(F.col(c)) for c in ("precision", "recall")})


_MACRO = _RANKED + ", pt AS (SELECT query_id, seen, total, seen / rank AS p FROM run JOIN tot USING (query_id) WHERE rel = 1), g AS (SELECT unnest(range(101)) AS g), m AS (SELECT t.query_id, g.g, coalesce(max(p), 0) AS p FROM tot t CROSS JOIN g LEFT JOIN pt ON pt.query_id = t.query_id AND pt.seen * 100 >= g.g * pt.total GROUP BY ALL), c AS (SELECT g / 100.0::DOUBLE AS recall, avg(p) AS precision FROM m GROUP BY g)"


@query(f"WITH {_MACRO} SELECT recall, round(precision, 6) AS precision FROM c")
def metric_macro_pr(spark, sf_dir):
    rel = _relevant(spark, sf_dir)
    return M.macro_pr(_class_ranks(spark, sf_dir, rel), rel).withColumn("precision", r6(F.col("precision")))


@query(f"WITH {_MACRO}, t AS (SELECT (recall - lag(recall) OVER (ORDER BY recall)) * (precision + lag(precision) OVER (ORDER BY recall)) / 2 AS a FROM c) SELECT round(sum(a), 6) AS area FROM t")
def metric_macro_pr_auc(spark, sf_dir):
    rel = _relevant(spark, sf_dir)
    return M.trapezoid(M.macro_pr(_class_ranks(spark, sf_dir, rel), rel), "recall", "precision").select(r6(F.col("area")).alias("area"))


@query(f"WITH {_RANKED}, x AS (SELECT rank, avg(seen / total) AS r, avg(seen / rank) AS p FROM run JOIN tot USING (query_id) GROUP BY rank), t AS (SELECT (r - lag(r) OVER (ORDER BY r, p)) * (p + lag(p) OVER (ORDER BY r, p)) / 2 AS a FROM x) SELECT round(sum(a), 5) AS area FROM t")
def metric_pr_auc(spark, sf_dir):
    """The area under (recall@k, precision@k) of all depths k."""
    rel = _relevant(spark, sf_dir)
    pts = M.pr_curve(_class_ranks(spark, sf_dir, rel), rel)
    return M.trapezoid(pts, "recall", "precision").select(F.round("area", 5).alias("area"))


_PAIRS = NEIGHBOURS + f", sc AS (SELECT id, round({sql_subsumption('u', 'v', 0.35)}, 6) AS score, (u_label = v_label OR id % 9 = 0)::INTEGER AS label FROM nb)"


def _scored(spark, sf_dir):
    u, v = F.col("u"), F.col("v")
    s = V.subsumption(V.poincare(u, v, K, eps=0.0), V.depth(V.squared_norm(u), K), V.depth(V.squared_norm(v), K), 0.35)
    return neighbours(points(spark, sf_dir)).select("id", r6(s).alias("score"), ((F.col("u_label") == F.col("v_label")) | (F.col("id") % 9 == 0)).cast("int").alias("label"))


def _prf(pos: str, by: str = "") -> str:
    tp, fp, fn, tn = f"sum(({pos} AND label = 1)::INTEGER)", f"sum(({pos} AND label = 0)::INTEGER)", f"sum((NOT {pos} AND label = 1)::INTEGER)", f"sum((NOT {pos} AND label = 0)::INTEGER)"
    return f"SELECT {by}round({tp} / nullif({tp} + {fp}, 0), 6) AS precision, round({tp} / nullif({tp} + {fn}, 0), 6) AS recall, round(2 * {tp} / nullif(2 * {tp} + {fp} + {fn}, 0), 6) AS f1, round(({tp} + {tn}) / count(*), 6) AS acc, round({tn} / nullif({tn} + {fp}, 0), 6) AS acc_neg"


@query(f"WITH {_PAIRS}, m AS (SELECT median(score) AS t FROM sc), o AS (SELECT 'larger' AS way, score > t AS pos, label FROM sc, m UNION ALL SELECT 'smaller', score <= t, label FROM sc, m) {_prf('pos', 'way, ')} FROM o GROUP BY way")
def threshold_eval(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    t = rows.agg(F.percentile("score", F.lit(0.5))).first()[0]
    one = lambda way, small: M.by_threshold(rows, t, small).withColumn("way", F.lit(way))
    out = one("larger", False).union(one("smaller", True))
    return out.select("way", *[r6(F.col(c)).alias(c) for c in out.columns if c != "way"])


_GRID = "e AS (SELECT trunc(min(score) * 100)::INTEGER AS lo, trunc(max(score) * 100)::INTEGER AS hi FROM sc), st AS (SELECT unnest(range(lo, hi))::INTEGER AS step FROM e), g AS (SELECT step, step / 100.0::DOUBLE AS threshold, sum((score > step / 100.0::DOUBLE AND label = 1)::INTEGER)::BIGINT AS tp, sum((score > step / 100.0::DOUBLE AND label = 0)::INTEGER)::BIGINT AS fp, (SELECT sum(label) FROM sc) AS pos FROM st, sc GROUP BY step), f AS (SELECT step, threshold, tp, fp, 2 * tp / nullif(tp + fp + pos, 0) AS f1 FROM g)"


@query(f"WITH {_PAIRS}, {_GRID} SELECT step, threshold, tp, fp, round(f1, 6) AS f1 FROM f")
def threshold_grid(spark, sf_dir):
    return M.threshold_grid(_scored(spark, sf_dir)).withColumn("f1", r6(F.col("f1")))


@query(f"WITH {_PAIRS}, {_GRID} SELECT threshold, round(f1, 6) AS f1 FROM f ORDER BY f1 DESC NULLS LAST, step DESC LIMIT 1")
def threshold_best(spark, sf_dir):
    return M.best_threshold(M.threshold_grid(_scored(spark, sf_dir))).withColumn("f1", r6(F.col("f1")))


_LAMBDA = NEIGHBOURS + f", w AS (SELECT unnest(range(50))::INTEGER AS w), base AS (SELECT id, {sql_subsumption('u', 'v', 0.0)} AS a, {sql_subsumption('u', 'v', 1.0)} AS b, (u_label = v_label OR id % 9 = 0)::INTEGER AS label FROM nb), sc AS (SELECT w, round(a + (w / 10.0::DOUBLE) * (b - a), 6) AS score, label FROM base, w), e AS (SELECT w, trunc(min(score) * 10)::INTEGER AS lo, trunc(max(score) * 10)::INTEGER AS hi, sum(label) AS pos FROM sc GROUP BY w), st AS (SELECT w, pos, unnest(range(lo, hi))::INTEGER AS step FROM e), g AS (SELECT st.w, st.step, sum((label = 1)::INTEGER) AS tp, count(label) AS m, any_value(pos) AS pos FROM st LEFT JOIN sc ON sc.w = st.w AND sc.score > st.step / 10.0::DOUBLE GROUP BY st.w, st.step), f AS (SELECT w, step, 2 * coalesce(tp, 0) / (m + pos) AS f1 FROM g), best AS (SELECT w, max_by(step, (f1, step)) AS step, max(f1) AS f1 FROM f GROUP BY w)"


def _by_weight(spark, sf_dir):
    u, v = F.col("u"), F.col("v")
    d, du, dv = V.poincare(u, v, K, eps=0.0), V.depth(V.squared_norm(u), K), V.depth(V.squared_norm(v), K)
    base = neighbours(points(spark, sf_dir)).select(V.subsumption(d, du, dv, 0.0).alias("a"), V.subsumption(d, du, dv, 1.0).alias("b"), ((F.col("u_label") == F.col("v_label")) | (F.col("id") % 9 == 0)).cast("int").alias("label"))
    rows = base.withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(49)))).select("w", r6(F.col("a") + F.col("w") / 10.0 * (F.col("b") - F.col("a"))).alias("score"), "label")
    return M.best_threshold(M.threshold_grid(rows, 10, by=["w"]), by=["w"])


@query(f"WITH {_LAMBDA} SELECT w, step / 10.0::DOUBLE AS threshold, round(f1, 6) AS f1 FROM best")
def lambda_grid(spark, sf_dir):
    return _by_weight(spark, sf_dir).withColumn("f1", r6(F.col("f1")))


@query(f"WITH {_LAMBDA}, b AS (SELECT w, step, round(f1, 9) AS f1 FROM best), p AS (SELECT *, max(f1) OVER (ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b), s AS (SELECT *, sum((f1 < before)::INTEGER) OVER (ORDER BY w) AS stop FROM p) SELECT w AS weight, step / 10.0::DOUBLE AS threshold, round(f1, 6) AS f1 FROM s WHERE coalesce(stop, 0) = 0 ORDER BY f1 DESC, w DESC LIMIT 1")
def lambda_search(spark, sf_dir):
    """The weight and threshold that a search with its early stop returns."""
    best = _by_weight(spark, sf_dir).select(F.col("w").alias("weight"), "threshold", F.round("f1", 9).alias("f1"))
    return M.best_weight(best).withColumn("f1", r6(F.col("f1")))


_TARGET = _RANKED + ", tr AS (SELECT CASE g.query_id % 200 WHEN 0 THEN 'nf1' ELSE 'nf2' END AS kind, g.query_id, rank::BIGINT AS rank FROM gold g JOIN ranked r ON r.query_id = g.query_id AND r.id = g.id)"


def _target_ranks(spark, sf_dir):
    pts, gold = points(spark, sf_dir), _gold(spark, sf_dir)
    q = asked(pts).select("query_id", "q").join(gold.withColumnRenamed("id", "answer"), "query_id").join(pts.select(F.col("id").alias("answer"), F.col("vec").alias("a")), "answer")
    near = P.Kind(lambda distance, child, parent, weight: -distance, K, eps=1e-7)
    made = P.ready(q.select("query_id", "q", "answer", "a", F.lit("nf1").alias("kind"), F.lit(True).alias("up")), pts.select("id", "vec"), P.score("poincare", K, 0.0))
    found = P.before(*made, near, [0.0], exclude_self=True) if made else None
    found = _ranks(spark, sf_dir, gold) if found is None else found.select("query_id", (F.col("n") + 1).alias("rank"))
    return found.withColumn("kind", F.when(F.col("query_id") % 200 == 0, "nf1").otherwise("nf2"))


@query(f"WITH {_TARGET} SELECT kind, query_id, rank FROM tr")
def rank_of_target(spark, sf_dir):
    return _target_ranks(spark, sf_dir).select("kind", "query_id", "rank")


@query(f"WITH {_TARGET} SELECT coalesce(kind, 'combined') AS kind, count(*) AS n, round(avg((rank <= 1)::INTEGER), 6) AS h1, round(avg((rank <= 10)::INTEGER), 6) AS h10, round(avg((rank <= 100)::INTEGER), 6) AS h100, round(avg(1.0 / rank), 6) AS mrr, round(avg(rank), 6) AS mr, median(rank)::DOUBLE AS median FROM tr GROUP BY ROLLUP (kind)")
def rank_combined(spark, sf_dir):
    out = M.rank_metrics(_target_ranks(spark, sf_dir))
    return out.select(*[(r6(F.col(c)) if c not in ("kind", "n", "median") else F.col(c)).alias(c) for c in out.columns])


@query(f"WITH {_TARGET}, c AS (SELECT rank, count(*) AS v FROM tr GROUP BY rank), t AS (SELECT rank, sum(v) OVER (ORDER BY rank) AS below, sum(v) OVER () AS n FROM c), x AS (SELECT ((rank - 1) * below + rank * (n - below)) / (((SELECT count(*) FROM points) - 1) * n) AS x, below / n AS y FROM t UNION ALL SELECT 0.0, 0.0 UNION ALL SELECT 1.0, 1.0), a AS (SELECT (x - lag(x) OVER (ORDER BY y, x)) * (y + lag(y) OVER (ORDER BY y, x)) / 2 AS a FROM x) SELECT round(sum(a), 6) AS auc FROM a")
def rank_roc_auc(spark, sf_dir):
    n = points(spark, sf_dir).count()
    return M.rank_auc(_target_ranks(spark, sf_dir), n).select(r6(F.col("auc")).alias("auc"))
