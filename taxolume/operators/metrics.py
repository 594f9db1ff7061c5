"""Ranking, threshold and loss metrics as aggregations.

ranked: (query_id, id, rank from 1); relevant: (query_id, id[, relevance]). Every query of `queries` or `relevant` counts,
also one without a hit. Metrics over whole rankings only look at relevant rows, so ranked may hold these alone, as
`ranks.relevant_ranks` makes them, with the length of each ranking. Rankings that also have seen and total, as
`pairs.class_ranks` makes them, hold relevant rows alone and are joined with nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxolume.storage import Scratch, numbered

from . import pairs as P
from .retrieve import stated


def _counted(ranked: DataFrame) -> bool:
    return {"seen", "total"} <= set(ranked.columns)


def hits(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """ranked with rel (0 or 1) and relevance (0 where not relevant)."""
    has = "relevance" in relevant.columns
    r = relevant.select("query_id", "id", (F.col("relevance") if has else F.lit(1)).alias("relevance")).dropDuplicates(["query_id", "id"])
    return ranked.join(r, ["query_id", "id"], "left").select("query_id", "id", "rank", F.coalesce("relevance", F.lit(0)).alias("relevance"), F.col("relevance").isNotNull().cast("int").alias("rel"))


def first_hits(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """(query_id, first): the best rank of a relevant id, null without one."""
    found = hits(ranked, relevant).groupBy("query_id").agg(F.min(F.when(F.col("rel") > 0, F.col("rank"))).alias("first"))
    return relevant.select("query_id").distinct().join(found, "query_id", "left")


def single_target(firsts: DataFrame, max_rank: int, ks: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """One row: mrr, mr, median, coverage and hits, precision, recall and F1 at each k; a miss ranks max_rank + 1."""
    rank = F.coalesce(F.col("first"), F.lit(max_rank + 1))
    out = [F.avg(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0))).alias("mrr"), F.avg(rank).alias("mr"), F.percentile(rank, F.lit(0.5)).alias("median"), F.avg(F.col("first").isNotNull().cast("double")).alias("coverage")]
    for k in ks:
        hit = F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0))
        p = hit / k
        out += [F.avg(hit).alias(f"hits_{k}"), F.avg(p).alias(f"p_{k}"), F.avg(hit).alias(f"r_{k}"), F.avg(F.when(hit > 0, p * 2 * hit / (p + hit)).otherwise(0.0)).alias(f"f1_{k}")]
    return firsts.agg(*out)


def at_k(ranked: DataFrame, relevant: DataFrame, ks: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """(query_id, k, hits, precision, recall, f1): distinct relevant ids within the first k."""
    n = relevant.groupBy("query_id").agg(F.count_distinct("id").alias("total"))
    h = hits(ranked, relevant).filter("rel = 1").crossJoin(F.broadcast(_values(ranked, ks, "k"))).filter("rank <= k")
    found = h.groupBy("query_id", "k").agg(F.count_distinct("id").alias("hits"))
    every = n.crossJoin(F.broadcast(_values(ranked, ks, "k"))).join(found, ["query_id", "k"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    p, r = F.col("hits") / F.col("k"), F.col("hits") / F.col("total")
    return every.select("query_id", "k", "hits", p.alias("precision"), r.alias("recall"), F.when(F.col("hits") > 0, p * 2 * r / (p + r)).otherwise(0.0).alias("f1"))


def _values(df: DataFrame, values: Sequence[int], name: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(v,) for v in values], f"{name} int")


def _running(h: DataFrame) -> DataFrame:
    return h.withColumn("seen", F.sum("rel").over(Window.partitionBy("query_id").orderBy("rank")))


def average_precisions(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """(query_id, ap, ap_seen): sum of hits / rank at each hit over all relevant ids, and over those that were seen. Only
    hits are sorted by rank."""
    if _counted(ranked):
        got = ranked.groupBy("query_id").agg(F.sum(F.col("seen") / F.col("rank")).alias("s"), F.max("total").alias("n"))
        return got.select("query_id", (F.col("s") / F.col("n")).alias("ap"), (F.col("s") / F.col("n")).alias("ap_seen"))
    known = relevant.select("query_id", "id").distinct()
    n = known.groupBy("query_id").agg(F.count("*").alias("total"))
    seen = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    got = ranked.join(known, ["query_id", "id"]).withColumn("seen", seen).groupBy("query_id").agg(F.sum(F.col("seen") / F.col("rank")).alias("s"), F.count("*").alias("n"))
    over = lambda c: F.coalesce(F.try_divide(F.col("s"), F.col(c)), F.lit(0.0))
    return n.join(got, "query_id", "left").select("query_id", over("total").alias("ap"), over("n").alias("ap_seen"))


def average_precision(ranked: DataFrame, relevant: DataFrame, over_seen: bool = False) -> DataFrame:
    """(query_id, ap) over all relevant ids, or over those that were seen."""
    return average_precisions(ranked, relevant).select("query_id", F.col("ap_seen" if over_seen else "ap").alias("ap"))


def r_precision(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """(query_id, rp): hits among the first R over R, R the number of relevant ids; 0 for a list shorter than R. A list's
    length is its column length, or else its largest rank."""
    if _counted(ranked):
        return ranked.groupBy("query_id").agg((F.sum((F.col("rank") <= F.col("total")).cast("long")) / F.max("total")).alias("rp"))
    n = relevant.groupBy("query_id").agg(F.count_distinct("id").alias("total"))
    own = hits(ranked, relevant)
    if "length" in ranked.columns:
        own = own.drop("rank").join(ranked.select("query_id", "id", "rank", "length"), ["query_id", "id"])
    got = own.join(n, "query_id").groupBy("query_id", "total").agg(F.sum(F.when(F.col("rank") <= F.col("total"), F.col("rel")).otherwise(0)).alias("h"), F.max("length" if "length" in ranked.columns else "rank").alias("last"))
    return n.select("query_id").join(got, "query_id", "left").select("query_id", F.coalesce(F.when(F.col("last") >= F.col("total"), F.col("h") / F.col("total")), F.lit(0.0)).alias("rp"))


def gain(relevance: Column, rank: Column, kind: str = "exp") -> Column:
    """Discounted gain of a place: (2^rel - 1) or rel, over log2(rank + 1); 0 if rel is not positive."""
    g = F.pow(F.lit(2.0), relevance) - 1 if kind == "exp" else relevance.cast("double")
    return F.when(relevance > 0, g / F.log2(rank + F.lit(1.0))).otherwise(0.0)


def ndcg(ranked: DataFrame, relevant: DataFrame, k: int = 10, kind: str = "exp") -> DataFrame:
    """(query_id, dcg, idcg, ndcg) at k; 0 where the ideal is 0. relevant has relevance."""
    best = relevant.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "id"))).filter(F.col("place") <= k)
    ideal = best.groupBy("query_id").agg(F.sum(gain(F.col("relevance"), F.col("place"), kind)).alias("idcg"))
    got = hits(ranked.filter(F.col("rank") <= k), relevant).groupBy("query_id").agg(F.sum(gain(F.col("relevance"), F.col("rank"), kind)).alias("dcg"))
    both = ideal.join(got, "query_id", "left").withColumn("dcg", F.coalesce("dcg", F.lit(0.0)))
    return both.select("query_id", "dcg", "idcg", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def targets_with_gain(targets: DataFrame, cutoff: int, kind: str = "exp") -> DataFrame:
    """(query_id, id, depth, relevance, rank, dcg) of graded targets (query_id, id, depth from 0).

    Targets are sorted by depth and cut to the first `cutoff`, then repeats go; relevance falls with depth from the
    deepest one's 1.
    """
    w = Window.partitionBy("query_id")
    cut_ = targets.withColumn("_p", F.row_number().over(w.orderBy("depth", "id"))).filter(F.col("_p") <= cutoff)
    once = cut_.groupBy("query_id", "id", "depth").agg(F.min("_p").alias("_p")).withColumn("depth", F.col("depth") + 1)
    graded = once.withColumn("relevance", F.max("depth").over(w) - F.col("depth") + 1).withColumn("rank", F.row_number().over(w.orderBy(F.desc("relevance"), "_p")))
    return graded.select("query_id", "id", "depth", "relevance", "rank", gain(F.col("relevance"), F.col("rank"), kind).alias("dcg"))


def pr_points(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """(query_id, rank, seen, total, precision, recall) at each hit."""
    if _counted(ranked):
        return ranked.select("query_id", "rank", "seen", "total", (F.col("seen") / F.col("rank")).alias("precision"), (F.col("seen") / F.col("total")).alias("recall"))
    n = relevant.groupBy("query_id").agg(F.count_distinct("id").alias("total"))
    return _running(hits(ranked, relevant)).filter("rel = 1").join(n, "query_id").select("query_id", "rank", "seen", "total", (F.col("seen") / F.col("rank")).alias("precision"), (F.col("seen") / F.col("total")).alias("recall"))


def macro_pr(ranked: DataFrame, relevant: DataFrame, steps: int = 100) -> DataFrame:
    """(grid, precision): interpolated precision at recalls 0..1, averaged over queries; compared as integers."""
    grid = relevant.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("g"))
    q = relevant.select("query_id").distinct()
    pts = pr_points(ranked, relevant)
    # The best precision at any recall from here on: a hit serves every grid point up to its own recall, so the best of
    # each grid point is taken first and then the best of it and all later ones.
    own = pts.groupBy("query_id", F.floor(F.col("seen") * steps / F.col("total")).cast("int").alias("g")).agg(F.max("precision").alias("p"))
    best = own.select("query_id", "p", F.explode(F.sequence(F.lit(0), F.col("g"))).alias("g")).groupBy("query_id", "g").agg(F.max("p").alias("p"))
    return q.crossJoin(F.broadcast(grid)).join(best, ["query_id", "g"], "left").groupBy("g").agg(F.avg(F.coalesce("p", F.lit(0.0))).alias("precision")).select((F.col("g") / F.lit(float(steps))).alias("recall"), "precision")


def pr_curve(ranks: DataFrame, relevant: DataFrame) -> DataFrame:
    """(recall, precision): the ends of the curve's steps, whose area is that of its points at all depths.

    recall and precision at a depth are means over queries, of hits so far over relevant ids and over depth. Between two
    depths with a hit of any query recall stays, and precision is largest at the first and smallest at the last depth;
    so a step is these two points. ranks: (query_id, id, rank, length) of the relevant rows.
    """
    store = Scratch(ranks.sparkSession, "curve")
    n = relevant.groupBy("query_id").agg(F.count_distinct("id").alias("total"))
    queries = n.count()
    hit = store.put((ranks if _counted(ranks) else ranks.join(n, "query_id")).groupBy("rank").agg((F.sum(F.lit(1.0) / F.col("total")) / queries).alias("dr"), F.count("*").alias("dn")))
    found = store.put(numbered(hit, [F.col("rank")], "i", store, "dr", "recall").select("i", "rank", "recall", "dn"))
    found = store.put(numbered(found, [F.col("rank")], "i", store, "dn", "seen").select("i", "rank", "recall", "seen"))
    length = ranks.agg(F.max("length").alias("length"))
    after = found.select((F.col("i") - 1).alias("i"), (F.col("rank") - 1).alias("last"))
    steps = found.join(after, "i", "left").crossJoin(F.broadcast(length)).withColumn("last", F.coalesce("last", "length"))
    at = lambda depth: (F.col("seen") / F.lit(float(queries)) / F.col(depth)).alias("precision")
    ends = steps.select("recall", at("rank")).union(steps.select("recall", at("last")))
    zero = found.agg(F.min("rank").alias("first")).filter("first > 1").select(F.lit(0.0).alias("recall"), F.lit(0.0).alias("precision"))
    return ends.union(zero)


def trapezoid(points: DataFrame, x: str, y: str, by: Sequence[str] = (), order: str | None = None) -> DataFrame:
    """([by,] area) under the points sorted by x, y. order: the points' own order, in which x must not fall, else an
    error. Without `by` each point meets the one before it by number, so that no task holds the whole curve."""
    width, height = (lambda was: F.col(x) - was), (lambda was: F.col(y) + was)
    if by:
        w = Window.partitionBy(*by).orderBy(x, y)
        rows = points.withColumn("_a", width(F.lag(x).over(w)) * height(F.lag(y).over(w)) / 2)
        if order is not None:
            was = F.lag(x).over(Window.partitionBy(*by).orderBy(order))
            rows = rows.withColumn("_a", F.when(F.col(x) < was, F.raise_error(F.lit(f"{x} falls"))).otherwise(F.col("_a")))
        return rows.groupBy(*by).agg(F.coalesce(F.sum("_a"), F.lit(0.0)).alias("area"))
    store = Scratch(points.sparkSession, "area")

    def beside(frame: DataFrame, *order_: str) -> DataFrame:
        run = store.put(numbered(frame, [F.col(c) for c in order_], "_at", store).select("_at", x, y))
        return run.join(run.select((F.col("_at") + 1).alias("_at"), F.col(x).alias("_x"), F.col(y).alias("_y")), "_at")

    points = store.put(points.select(x, y, *([order] if order else [])))
    if order is not None and not beside(points, order).filter(F.col(x) < F.col("_x")).isEmpty():
        raise ValueError(f"{x} falls")
    return beside(points, x, y).agg(F.coalesce(F.sum(width(F.col("_x")) * height(F.col("_y")) / 2), F.lit(0.0)).alias("area"))


def accuracy(answers: DataFrame, by: str = "dataset") -> DataFrame:
    """(by, correct, total, accuracy): per cent with two decimals, of (prediction, answer)."""
    ok = F.coalesce((F.col("prediction") == F.col("answer")).cast("int"), F.lit(0))
    return answers.groupBy(by).agg(F.sum(ok).alias("correct"), F.count("*").alias("total"), F.round(F.avg(ok) * 100, 2).alias("accuracy"))


def wrong_counts(answers: DataFrame, column: str, by: str = "dataset") -> DataFrame:
    return answers.filter(~F.col("prediction").eqNullSafe(F.col("answer"))).groupBy(by, column).agg(F.count("*").alias("n"))


def prf(positive: Column, truth: Column) -> dict[str, Column]:
    """Aggregates precision, recall, f1, accuracy and accuracy on negatives; null where nothing is counted."""
    tp, fp = F.sum((positive & truth).cast("long")), F.sum((positive & ~truth).cast("long"))
    fn, tn = F.sum((~positive & truth).cast("long")), F.sum((~positive & ~truth).cast("long"))
    return {"precision": F.try_divide(tp, tp + fp), "recall": F.try_divide(tp, tp + fn), "f1": F.try_divide(tp * 2, tp * 2 + fp + fn), "acc": F.try_divide(tp + tn, tp + fp + fn + tn), "acc_neg": F.try_divide(tn, tn + fp)}


def by_threshold(scored: DataFrame, t: float, smaller_better: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Metrics of (score, label) at one threshold: above it, or at most it if smaller is better."""
    positive = F.col("score") <= t if smaller_better else F.col("score") > t
    return scored.groupBy(*by).agg(*[c.alias(n) for n, c in prf(positive, F.col("label") == 1).items()])


def threshold_grid(scored: DataFrame, granularity: int = 100, smaller_better: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """([by,] step, threshold, tp, fp, f1) for each threshold step / granularity from the least to the largest score.

    A score falls in the bin of the first step that it does not exceed; counts at all thresholds are running sums over
    the bins, so cost is rows plus thresholds, not their product.
    """
    g = F.lit(granularity)
    ends = scored.groupBy(*by).agg((F.min("score") * g).cast("int").alias("lo"), (F.max("score") * g).cast("int").alias("hi"), F.sum((F.col("label") == 1).cast("long")).alias("pos"))
    steps = ends.filter("lo < hi").select(*by, "pos", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("step"))
    # The least step with score <= step / granularity, found by division and set right by the comparison itself.
    near = F.ceil(F.col("score") * g).cast("int")
    exact = F.when(F.col("score") <= (near - 1) / g, near - 1).when(F.col("score") > near / g, near + 1).otherwise(near)
    bins = scored.select(*by, exact.alias("step"), "label").groupBy(*by, "step").agg(F.sum((F.col("label") == 1).cast("long")).alias("p"), F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    rows = steps.select(*by, "step", "pos", zero.alias("p"), zero.alias("n"), F.lit(1).alias("asked")).unionByName(bins.select(*by, "step", zero.alias("pos"), "p", "n", F.lit(0).alias("asked")))
    part = list(by) or [F.lit(0)]
    upto = Window.partitionBy(*part).orderBy("step").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy(*part)
    run = rows.withColumns({"p_le": F.sum("p").over(upto), "n_le": F.sum("n").over(upto), "p_all": F.sum("p").over(every), "n_all": F.sum("n").over(every)}).filter("asked = 1")
    tp = F.col("p_le") if smaller_better else F.col("p_all") - F.col("p_le")
    m = F.col("n_le") if smaller_better else F.col("n_all") - F.col("n_le")
    return run.select(*by, "step", (F.col("step") / g).alias("threshold"), tp.alias("tp"), (m - tp).alias("fp"), F.try_divide(tp * 2, m + F.col("p_all")).alias("f1"))


def best_threshold(grid: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The row of largest f1, the last such threshold."""
    return grid.filter("f1 is not null").groupBy(*by).agg(F.max_by("threshold", F.struct("f1", "step")).alias("threshold"), F.max("f1").alias("f1"))


def best_weight(bests: DataFrame) -> DataFrame:
    """Best (weight, threshold, f1) of rows by weight, where the search stops after the first weight that reaches no
    F1 as high as the best before it."""
    w = Window.orderBy("weight").rowsBetween(Window.unboundedPreceding, -1)
    worse = bests.withColumn("_before", F.max("f1").over(w)).withColumn("_fail", (F.col("f1") < F.col("_before")).cast("int"))
    tried = worse.withColumn("_stop", F.sum("_fail").over(Window.orderBy("weight"))).filter("coalesce(_stop, 0) = 0")
    return tried.groupBy().agg(F.max_by(F.struct("weight", "threshold", "f1"), F.struct("f1", "weight")).alias("b")).select("b.*")


def evaluate(scored: DataFrame, weight: float | None = None, threshold: float | None = None, granularity: int = 100, smaller_better: bool = False) -> DataFrame:
    """(weight, threshold, precision, recall, f1, acc, acc_neg) of (weight, score, label).

    With a weight and a threshold these are tested; else the best of all is, by a search. Zero is a value like any other.
    """
    if weight is None or threshold is None:
        grid = threshold_grid(scored, granularity, smaller_better, by=["weight"])
        best = best_weight(best_threshold(grid, by=["weight"])).first()
        if best is None or best["weight"] is None:
            return by_threshold(scored.filter("false"), 0.0).select(F.lit(None).cast("double").alias("weight"), F.lit(None).cast("double").alias("threshold"), "*")
        weight, threshold = best["weight"], best["threshold"]
    own = by_threshold(scored.filter(F.col("weight") == weight), threshold, smaller_better)
    return own.select(F.lit(float(weight)).alias("weight"), F.lit(float(threshold)).alias("threshold"), "*")


def hand_off(validation: DataFrame, test: DataFrame, granularity: int = 100, smaller_better: bool = False) -> DataFrame:
    """evaluate() of test at the weight and threshold that are best on validation; both (weight, score, label)."""
    best = evaluate(validation, granularity=granularity, smaller_better=smaller_better).first()
    return evaluate(test, best["weight"], best["threshold"], granularity, smaller_better)


def probe(pairs: DataFrame, predict, template: str = "{child} is a {parent}.", granularity: int = 1000) -> DataFrame:
    """Best threshold of a probing model: predict maps a sentence made of each of (child, parent, label) to a score."""
    before, rest = template.split("{child}")
    between, after = rest.split("{parent}")
    sentence = F.concat(F.lit(before), "child", F.lit(between), "parent", F.lit(after))
    return best_threshold(threshold_grid(pairs.select(predict(sentence).alias("score"), "label"), granularity))


def static_evaluation(distances: DataFrame, poincare: bool = True) -> DataFrame:
    """Best threshold of (row, place, score) of a subject with its objects: place 0 is the true one, smaller is better.
    Steps are whole numbers for Poincare distances and hundredths for cone energies."""
    labelled = distances.select("score", (F.col("place") == 0).cast("int").alias("label"))
    return best_threshold(threshold_grid(labelled, 1 if poincare else 100, smaller_better=True))


def kind_ranks(queries: DataFrame, candidates: DataFrame, score, weights: Sequence[float] = (1.0,)) -> DataFrame:
    """(weight, kind, query_id, rank) of queries (kind, query_id, q, answer) among candidates (id, vec), by each weight.

    score(child, parent, weight) is better when large; a `pairs.Kind` is counted by numpy, with distances and depths taken
    once for all weights. A query's vector is the child; for nf3 it is the parent and the candidates are the
    children. The stated queries, times weights, are broadcast in blocks, so candidates are read once a block and never
    shuffled; each task counts those before the answer, whose own score comes from a join on its id.
    """
    if isinstance(score, P.Kind):
        counted = _counted_kinds(queries, candidates, score, weights)
        if counted is not None:
            return counted
        score = score.column
    swap = lambda q, c: F.when(F.col("kind") == "nf3", score(c, q, F.col("weight"))).otherwise(score(q, c, F.col("weight")))
    own = queries.join(candidates.select(F.col("id").alias("answer"), F.col("vec").alias("_a")), "answer")
    own = own.withColumn("weight", F.explode(F.array(*[F.lit(float(w)) for w in weights])))
    own = Scratch(candidates.sparkSession, "asked").put(own.select("weight", "kind", "query_id", "q", "answer", swap(F.col("q"), F.col("_a")).alias("t")))
    scored = stated(own, candidates, ("weight", "kind", "query_id")).withColumn("_s", swap(F.col("q"), F.col("vec")))
    before = (F.col("_s") > F.col("t")) | ((F.col("_s") == F.col("t")) & (F.col("id") < F.col("answer")))
    return scored.groupBy("weight", "kind", "query_id").agg((F.sum(before.cast("long")) + 1).alias("rank"))


def _counted_kinds(queries: DataFrame, candidates: DataFrame, score: P.Kind, weights: Sequence[float]) -> DataFrame | None:
    own = queries.join(candidates.select(F.col("id").alias("answer"), F.col("vec").alias("a")), "answer")
    own = own.select("query_id", "q", "answer", "a", "kind", (F.col("kind") != "nf3").alias("up"))
    made = P.ready(own, candidates.select("id", "vec"), P.Score(None, True, ball=score.curvature))
    found = None if made is None else P.before(*made, score, [float(w) for w in weights])
    if found is None:
        return None
    names = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("w") + 1).alias("weight")
    return found.select(names, "kind", "query_id", (F.col("n") + 1).alias("rank"))


KINDS = ("nf1", "nf2", "nf3", "nf4")


def kind_evaluation(queries: DataFrame, candidates: DataFrame, score, weight: float = 1.0) -> DataFrame:
    """rank_metrics() of kind_ranks() by kind, in their order up to the first kind without queries; only if all four are
    there is a row of all of them, kind 'combined'."""
    there = {r["kind"] for r in queries.select("kind").distinct().collect()}
    shown = KINDS[: next((i for i, k in enumerate(KINDS) if k not in there), len(KINDS))]
    ranks = kind_ranks(queries.filter(F.col("kind").isin(*shown) if shown else F.lit(False)), candidates, score, (weight,))
    return rank_metrics(ranks, grand_total=len(shown) == len(KINDS)).withColumn("weight", F.lit(float(weight)))


def best_rank_weight(queries: DataFrame, candidates: DataFrame, score, weights: Sequence[float] = tuple(i / 10 for i in range(20)), kind: str = "nf1") -> DataFrame:
    """(weight, n, h1, ..., mrr, ...) of the weight with the largest MRR on one kind, of equal ones the smallest."""
    ranks = kind_ranks(queries.filter(F.col("kind") == kind), candidates, score, weights)
    return rank_metrics(ranks, by="weight", grand_total=False).orderBy(F.desc("mrr"), "weight").limit(1)


def classified_ranks(queries: DataFrame, candidates: DataFrame, classify) -> DataFrame:
    """(query_id, rank) of each query's answer by a pair classifier: classify maps the concatenation of a candidate's
    vector and the query's to a score, better when large. Queries (query_id, q, answer) are a stated set, which is
    broadcast in blocks."""
    pair = lambda c, q: classify(F.concat(c, q))
    own = queries.join(candidates.select(F.col("id").alias("answer"), F.col("vec").alias("_a")), "answer").select("query_id", "q", "answer", pair(F.col("_a"), F.col("q")).alias("t"))
    own = Scratch(candidates.sparkSession, "asked").put(own)
    scored = stated(own, candidates).withColumn("s", pair(F.col("vec"), F.col("q")))
    before = (F.col("s") > F.col("t")) | ((F.col("s") == F.col("t")) & (F.col("id") < F.col("answer")))
    return scored.groupBy("query_id").agg((F.sum(before.cast("long")) + 1).alias("rank"))


def target_rank(scores: DataFrame, targets: DataFrame, ascending: bool = True) -> DataFrame:
    """(query_id, rank) of each query's target (query_id, id): 1 plus the candidates before it, ties by id. scores are
    computed twice; `ranks.ranks_of` computes them from vectors, once."""
    t = scores.join(targets, ["query_id", "id"]).select("query_id", F.col("id").alias("t_id"), F.col("score").alias("t"))
    before = (F.col("score") < F.col("t")) if ascending else (F.col("score") > F.col("t"))
    tie = (F.col("score") == F.col("t")) & (F.col("id") < F.col("t_id"))
    return scores.join(t, "query_id").groupBy("query_id").agg((F.sum((before | tie).cast("long")) + 1).alias("rank"))


def rank_metrics(ranks: DataFrame, by: str = "kind", grand_total: bool = True) -> DataFrame:
    """([kind,] n, h1, h10, h100, mrr, mr, median) by kind, and over all kinds together as kind 'combined'."""
    aggs = [F.count("*").alias("n"), *[F.avg((F.col("rank") <= k).cast("double")).alias(f"h{k}") for k in (1, 10, 100)], F.avg(F.lit(1.0) / F.col("rank")).alias("mrr"), F.avg("rank").alias("mr"), F.percentile("rank", F.lit(0.5)).alias("median")]
    if not grand_total:
        return ranks.groupBy(by).agg(*aggs)
    return ranks.rollup(by).agg(F.grouping(by).alias("_g"), *aggs).withColumn(by, F.when(F.col("_g") == 1, "combined").otherwise(F.col(by))).drop("_g")


def rank_auc(ranks: DataFrame, candidates: int) -> DataFrame:
    """(auc) of ranks among so many candidates: true positives so far against wrong ones placed before, by trapezoids
    from (0, 0) to (1, 1).

    Ranks are counted first; their running sums come from sums of ranges, each rank meets the one before it by number.
    """
    store = Scratch(ranks.sparkSession, "auc")
    n = ranks.count()
    if not n:
        return ranks.sparkSession.createDataFrame([(0.5,)], "auc double")
    h = ranks.groupBy(F.col("rank").cast("long").alias("rank")).agg(F.count("*").alias("v"))
    run = numbered(h, [F.col("rank")], "i", store, "v", "below")
    x = ((F.col("rank") * n - F.col("below")) / F.lit(float(candidates - 1) * n)).alias("x")
    pts = store.put(run.select("i", x, (F.col("below") / F.lit(float(n))).alias("y")))
    before = pts.select((F.col("i") + 1).alias("i"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    area = (F.col("x") - F.coalesce("x0", F.lit(0.0))) * (F.col("y") + F.coalesce("y0", F.lit(0.0))) / 2
    last = pts.agg(F.max_by("x", "i").alias("x")).select((F.lit(1.0) - F.col("x")).alias("a"))  # from the last rank, where y is 1
    return pts.join(before, "i", "left").select(area.alias("a")).union(last).agg(F.sum("a").alias("auc"))


def clustering_loss(d_pos: Column, d_neg: Column, margin: float = 5.0) -> Column:
    return F.avg(F.greatest(F.lit(0.0), d_pos - d_neg + margin))


def centripetal_loss(parent_depth: Column, child_depth: Column, margin: float = 0.5) -> Column:
    return F.avg(F.greatest(F.lit(0.0), parent_depth - child_depth + margin))


def hierarchy_loss(clustering: Column, centripetal: Column, w1: float = 1.0, w2: float = 1.0) -> Column:
    return clustering * w1 + centripetal * w2


def cone_pair_loss(energy: Column, label: Column, margin: float = 0.1) -> Column:
    return F.avg(label * energy + (F.lit(1.0) - label) * F.greatest(F.lit(0.0), F.lit(margin) - energy))


def cone_triplet_loss(pos: Column, neg: Column, margin: float = 0.1) -> Column:
    return F.avg(pos + F.greatest(F.lit(0.0), F.lit(margin) - neg))


def cone_static_loss(energy: Column, place: Column, margin: float = 0.1) -> Column:
    """Rows of a subject with its objects: place 0 is the true one."""
    return (F.sum(F.when(place == 0, energy).otherwise(F.greatest(F.lit(0.0), F.lit(margin) - energy)))) / F.count(energy)


def softmax_loss(rows: DataFrame, by: str = "subject", distance: str = "distance", place: str = "place") -> DataFrame:
    """(loss): mean cross-entropy of the true object (place 0) under a softmax over -distance."""
    low = F.min(distance).over(Window.partitionBy(by))
    z = rows.withColumn("_e", F.exp(low - F.col(distance))).withColumn("_m", low)
    per = z.groupBy(by).agg((F.log(F.sum("_e")) - F.first("_m") + F.max(F.when(F.col(place) == 0, F.col(distance)))).alias("l"))
    return per.agg(F.avg("l").alias("loss"))


def adjacent_loss(rows: DataFrame, value: str, order: str, pair: Column) -> DataFrame:
    """(loss): mean positive difference between the first and the second row, by order, of each pair."""
    p = rows.groupBy(pair.alias("_p")).agg(F.min_by(value, order).alias("a"), F.max_by(value, order).alias("b"), F.count("*").alias("n")).filter("n = 2")
    return p.agg(F.avg(F.greatest(F.lit(0.0), F.col("a") - F.col("b"))).alias("loss"))


def conjunction_loss(first: Column, second: Column) -> Column:
    """The mean of the hierarchy losses of a conjunction with each of its parts."""
    return (first + second) / 2


def existential_loss(kind: str, whole_to_made: Column, made_to_whole: Column | None = None) -> Column:
    """Loss of an existential's text against its vector made of role and filler: 'hit', the mean of the hierarchy losses
    both ways; 'pair', a pair loss of its own; 'dist', the mean distance."""
    if kind == "hit":
        if made_to_whole is None:
            raise ValueError("losses in both ways are needed")
        return (whole_to_made + made_to_whole) / 2
    if kind == "pair":
        return whole_to_made
    if kind == "dist":
        return F.avg(whole_to_made)
    raise ValueError(f"no such kind: {kind}")
