"""Vocabulary sets, samples, and training sets of hierarchies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxolume.functions.text import percentage, stable_order
from taxolume.storage import Scratch, filed, join_hot, numbered, sorted_join

from .reach import Reach, look_up, redundant, related

#: Children of a parent that stand together, about; all pairs of two such blocks are made in one step of a task, of which
#: each makes about so many pairs.
SIBLINGS, MET = 2048, 8_000_000


def _lowered(words: DataFrame) -> DataFrame:
    return words.select(F.lower("word").alias("word")).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return _lowered(a).intersect(_lowered(b))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return _lowered(a).subtract(_lowered(b))


def coverage(a: DataFrame, b: DataFrame) -> DataFrame:
    """(n_a, n_common, n_only, percent) of the lower-cased words of a that b has."""
    marked = _lowered(a).join(_lowered(b).withColumn("hit", F.lit(1)), "word", "left")
    n = marked.agg(F.count("*").alias("n_a"), F.count("hit").alias("n_common"))
    return n.select("n_a", "n_common", (F.col("n_a") - F.col("n_common")).alias("n_only"), percentage(F.col("n_common"), F.col("n_a")).alias("percent"))


def distinct_trimmed(df: DataFrame, column: Column) -> DataFrame:
    return df.select(F.trim(column).alias("word")).filter("word <> ''").distinct()


def structural_distinct(df: DataFrame, signature: Column, order: str) -> DataFrame:
    """The first row, by order, of each signature."""
    n = F.row_number().over(Window.partitionBy("_s").orderBy(order))
    return df.withColumn("_s", signature).withColumn("_n", n).filter("_n = 1").drop("_s", "_n")


def sample(df: DataFrame, key: str, n: int, seed: int | str, prefix: str = "mc-", strict: bool = True) -> DataFrame:
    """n rows in an order fixed by the seed, with id prefix and number; an error if there are fewer and strict."""
    if strict and df.limit(n).count() < n:
        raise ValueError(f"fewer than {n} rows")
    chosen = df.withColumn("_o", stable_order(F.col(key), seed)).orderBy("_o", key).limit(n)
    return chosen.withColumn("sample_id", F.format_string(f"{prefix}%04d", F.row_number().over(Window.orderBy("_o", key)))).drop("_o")


def check_exists(df: DataFrame, n: int) -> int:
    """n, if df has so many rows; else an error. Reads no more rows than that."""
    if df.limit(n).count() < n:
        raise ValueError(f"fewer than {n} rows")
    return n


def random_question(questions: DataFrame, dataset: str, seed: int | str) -> DataFrame:
    """One question of a dataset, the first in an order fixed by the seed."""
    own = questions.filter(F.col("dataset") == dataset)
    return own.withColumn("_o", stable_order(F.col("question_id").cast("string"), seed)).orderBy("_o", "question_id").limit(1).drop("_o")


def _no_ancestors(pairs: DataFrame, up: DataFrame | Reach) -> DataFrame:
    """pairs (child, negative, ...) whose negative is no ancestor of the child: by a closure (node, ancestor), or by the
    labels of an index, which need no closure."""
    if isinstance(up, Reach):
        return related(up, pairs, "child", "negative").filter("not above").drop("above")
    return pairs.join(sorted_join(up.select(F.col("node").alias("child"), F.col("ancestor").alias("negative"))), ["child", "negative"], "left_anti")


def hard_negatives(edges: DataFrame, closure: DataFrame | Reach, n: int | None = None, seed: int | str = 0) -> DataFrame:
    """(child, negative): siblings that are neither the child nor one of its ancestors, by a closure (node, ancestor) or
    by an index, which is much smaller and need hold the parents only (`reach.parents_index`).

    All of them by default, which are as many as the square of a parent's children; with n, up to n of each child, drawn
    by place among each parent's children, so that a parent of very many is no larger a task than another.
    """
    if n is None:
        return _all_siblings(edges, closure)
    store = Scratch(edges.sparkSession, "siblings")
    listed = store.put(numbered(edges.select("child", "parent").distinct(), [F.col("parent"), F.md5(F.concat(F.lit(f"{seed}#"), "child")), F.col("child")], "i", store))
    spans = listed.groupBy("parent").agg(F.min("i").alias("lo"), F.count("*").alias("m"))
    own = join_hot(listed, spans, "parent", F.xxhash64("child")).select("child", "lo", "m")
    return _drawn(store, own, listed.select("i", F.col("child").alias("node")), closure, n, seed).select("child", "negative")


def _all_siblings(edges: DataFrame, up: DataFrame | Reach) -> DataFrame:
    """All hard_negatives. A parent's children stand in blocks, and pairs of blocks are dealt over the tasks, where pairs
    of children are neither shuffled nor kept. Those that have several parents both may meet under each, and only these
    pairs are made distinct."""
    store = Scratch(edges.sparkSession, "siblings")
    pairs = store.put(edges.select("child", "parent").dropna().distinct())
    sizes = store.put(pairs.groupBy("parent").agg(F.count("*").alias("_rows")).withColumn("blocks", F.ceil(F.col("_rows") / SIBLINGS).cast("int")))
    several = pairs.groupBy("child").agg((F.count("*") > 1).alias("several"))
    told_ = pairs.join(several, "child").join(_siblings_above(pairs, up), "child", "left")
    listed = join_hot(told_, sizes.select("parent", "blocks"), "parent", F.xxhash64("child"), sizes.select("parent", "_rows"))
    listed = store.put(listed.withColumn("own", F.pmod(F.xxhash64("child"), F.col("blocks")).cast("int")))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = listed.select("parent", "child", "several", "above", F.col("own").alias("i"), every.alias("j"))
    right = listed.select("parent", F.col("child").alias("negative"), F.col("several").alias("other"), every.alias("i"), F.col("own").alias("j"))
    cells = (sizes.agg(F.sum(F.col("_rows").cast("double") * F.col("_rows"))).first()[0] or 0.0) / MET
    tasks = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(min(cells, 100_000.0)))  # fewer would be dealt again

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        a, b = a.repartition(tasks, "parent", "i", "j"), b.repartition(tasks, "parent", "i", "j")
        return a.join(b.hint("merge"), ["parent", "i", "j"]).filter((F.col("child") != F.col("negative")) & (F.col("above").isNull() | ~F.array_contains("above", F.col("negative"))))

    once = met(left, right).filter("not (several and other)").select("child", "negative")
    if listed.filter("several").isEmpty():
        return once
    return once.union(met(left.filter("several"), right.filter("other")).select("child", "negative").distinct())


def _siblings_above(pairs: DataFrame, up: DataFrame | Reach) -> DataFrame:
    """(child, above): the siblings of a child that are its ancestors, for children that have some.

    A sibling below the parent p that is above the child is reached by another of the child's parents, and reaches p; or
    it is on a cycle with p. So an index is asked only about children with a redundant edge or a parent without labels.
    """
    if isinstance(up, Reach):
        loose = pairs.join(up.loose.select(F.col("node").alias("parent")), "parent", "left_semi").select("child")
        mine = pairs.join(redundant(up, pairs).select("child").union(loose).distinct(), "child", "left_semi")
        over = look_up(up, mine.select(F.col("parent").alias("node")).distinct()).select(F.col("node").alias("parent"), F.col("ancestor").alias("negative"))
        ancestors = mine.select("child", F.col("parent").alias("negative")).union(mine.join(over, "parent").select("child", "negative"))
    else:
        ancestors = up.select(F.col("node").alias("child"), F.col("ancestor").alias("negative"))
    siblings = ancestors.distinct().join(pairs, "child").join(pairs.select(F.col("child").alias("negative"), "parent"), ["negative", "parent"])
    return siblings.groupBy("child").agg(F.collect_set("negative").alias("above"))


def first_hard_negatives(edges: DataFrame, closure: DataFrame, n: int) -> DataFrame:
    """(child, negative): the first n by name of each child's hard_negatives, which are all of them where there are fewer.

    Among the first siblings of a parent only the child itself and its ancestors are none, so as many as these and n more
    are looked up by place; no child meets all of its siblings.
    """
    store = Scratch(edges.sparkSession, "siblings")
    listed = store.put(numbered(edges.select("child", "parent").distinct(), [F.col("parent"), F.col("child")], "i", store))
    spans = listed.groupBy("parent").agg(F.min("i").alias("lo"), F.count("*").alias("m"))
    above = closure.groupBy(F.col("node").alias("child")).agg(F.count_distinct("ancestor").alias("above"))
    own = join_hot(listed, spans, "parent", F.xxhash64("child")).join(sorted_join(above), "child", "left")
    most = F.least(F.col("m"), F.coalesce("above", F.lit(0)) + F.lit(n + 1))
    met = own.select("child", F.explode(F.sequence(F.col("lo"), F.col("lo") + most - 1)).alias("i")).join(filed(listed).select("i", F.col("child").alias("negative")), "i")
    kept = store.put(_no_ancestors(met.select("child", "negative").filter("child <> negative").distinct(), closure))
    return kept.withColumn("_n", F.row_number().over(Window.partitionBy("child").orderBy("negative"))).filter(F.col("_n") <= n).drop("_n")


def random_negatives(children: DataFrame, nodes: DataFrame, closure: DataFrame | Reach, n: int, seed: int | str) -> DataFrame:
    """(child, negative, place): n nodes for each child that are neither itself nor an ancestor, or all such nodes if
    there are fewer. Nodes stand in an order fixed by the seed; each child draws places in it."""
    store = Scratch(children.sparkSession, "negatives")
    listed = store.put(numbered(nodes.select("node").distinct(), [F.md5(F.concat(F.lit(f"{seed}#"), "node")), F.col("node")], "i", store))
    total = listed.count()
    own = children.select("child").distinct().select("child", F.lit(0).cast("long").alias("lo"), F.lit(total).cast("long").alias("m"))
    return _drawn(store, own.filter("m > 0"), listed, closure, n, seed)


def _drawn(store: Scratch, own: DataFrame, listed: DataFrame, up: DataFrame | Reach, n: int, seed: int | str) -> DataFrame:
    """(child, negative, place): up to n of the nodes that each child (child, lo, m) may draw, the m from place lo on in
    listed (i, node), without itself and its ancestors, by a closure or an index.

    Places are drawn by a hash and looked up, so no child meets all nodes. Draws that repeat, or hit the child or an
    ancestor, are replaced in further rounds, twice as many each; where as many are drawn as there are, all are taken.
    """
    open_, want, found, listed = store.put(own), 2 * n, None, filed(listed)
    while not open_.isEmpty():
        whole = F.col("m") <= want
        drawn = open_.withColumn("whole", whole).withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("m"), F.lit(want)) - 1)))
        hashed = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), "child", F.lit("|"), F.col("draw").cast("string"))), 1, 12), 16, 10).cast("long") % F.col("m")
        at = F.col("lo") + F.when(F.col("whole"), F.col("draw")).otherwise(hashed)
        met = drawn.withColumn("i", at).join(listed, "i").filter("child <> node").groupBy("child", F.col("node").alias("negative")).agg(F.min("draw").alias("draw"), F.min("whole").alias("whole"))
        by_hash = F.md5(F.concat(F.lit(f"{seed}:"), "child", F.lit("|"), "negative"))
        rank = F.row_number().over(Window.partitionBy("child").orderBy("whole", F.when(~F.col("whole"), F.col("draw")), by_hash, "negative"))
        kept = store.put(_no_ancestors(met, up).withColumn("place", rank).filter(F.col("place") <= n).select("child", "negative", "place"))
        done = kept.groupBy("child").agg(F.count("*").alias("_n")).filter(F.col("_n") == n).select("child")
        done = done.union(open_.groupBy("child").agg(F.max("m").alias("m")).filter(F.col("m") <= want).select("child")).distinct()
        done = sorted_join(done)
        full = kept.join(done, "child", "left_semi")
        found = full if found is None else found.union(full)
        open_, want = store.put(open_.join(done, "child", "left_anti")), want * 2
    return own.select("child", F.col("child").alias("negative"), F.lit(1).alias("place")).limit(0) if found is None else found


def examples(edges: DataFrame, hard: DataFrame, random: DataFrame, n: int = 10) -> DataFrame:
    """(child, parent, hard_negatives, random_negatives, negatives): hard ones first, filled up with random ones to n. Of
    hard ones the first n by name are enough."""
    h = hard.groupBy("child").agg(F.array_sort(F.collect_list("negative")).alias("hard_negatives"))
    r = random.groupBy("child").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "negative"))), lambda x: x["negative"]).alias("random_negatives"))
    empty = F.expr("cast(array() as array<string>)")
    out = edges.join(sorted_join(h), "child", "left").join(sorted_join(r), "child", "left").withColumns({c: F.coalesce(F.col(c), empty) for c in ("hard_negatives", "random_negatives")})
    return out.withColumn("negatives", F.slice(F.concat("hard_negatives", F.array_except("random_negatives", "hard_negatives")), 1, n))


def splits(df: DataFrame, key: Column, seed: int | str, evaluated: float = 0.1) -> DataFrame:
    """df with split: a share for evaluation, halved into val and test, the rest train, by a hash of key."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 8), 16, 10).cast("long") % 1000
    return df.withColumn("split", F.when(u < evaluated * 500, "val").when(u < evaluated * 1000, "test").otherwise("train"))


def triplets(ex: DataFrame) -> DataFrame:
    return ex.select("child", "parent", F.explode("negatives").alias("negative"))


def pairs(ex: DataFrame) -> DataFrame:
    """(child, parent, label): the true parent once with 1, each negative with 0."""
    labelled = F.concat(F.array(F.struct(F.col("parent").alias("parent"), F.lit(1).alias("label"))), F.transform("negatives", lambda x: F.struct(x.alias("parent"), F.lit(0).alias("label"))))
    return ex.select("child", F.explode(labelled).alias("p")).select("child", "p.parent", "p.label")


def index_lists(ex: DataFrame, ids: DataFrame) -> DataFrame:
    """(idx): ids of child, parent and negatives in that order; a name without an id raises an error when it is read."""
    names = F.concat(F.array("child", "parent"), F.col("negatives"))
    rows = ex.withColumn("row", F.monotonically_increasing_id()).select("row", F.posexplode(names).alias("pos", "name")).join(sorted_join(ids), "name", "left")
    number = F.when(F.col("id").isNotNull(), F.col("id")).otherwise(F.raise_error(F.concat(F.lit("no id for "), "name")))
    return rows.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", number.alias("id")))), lambda x: x["id"]).alias("idx")).select("idx")


def static_vectors(idx: DataFrame, vectors: DataFrame) -> DataFrame:
    """(row, place, subject, object) of index lists (row, idx): the vector of the first id beside that of each other one,
    by place from 0. vectors: (id, vec); an id without a vector raises an error."""
    each = idx.select("row", F.element_at("idx", 1).alias("s"), F.posexplode(F.slice("idx", 2, F.size("idx"))).alias("place", "o"))
    found = each.join(vectors.select(F.col("id").alias("s"), F.col("vec").alias("subject")), "s", "left").join(vectors.select(F.col("id").alias("o"), F.col("vec").alias("object")), "o", "left")
    there = lambda c, i: F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.concat(F.lit("no vector for "), F.col(i).cast("string"))))
    return found.select("row", "place", there("subject", "s").alias("subject"), there("object", "o").alias("object"))


def lookup(df: DataFrame, names: DataFrame, key: str, out: str) -> DataFrame:
    """df with the name of each id in column key; an id without a name raises an error when it is read."""
    found = df.join(names.select(F.col("id").alias(key), F.col("name").alias("_name")), key, "left")
    return found.withColumn(out, F.when(F.col("_name").isNotNull(), F.col("_name")).otherwise(F.raise_error(F.concat(F.lit("no name for "), F.col(key).cast("string"))))).drop("_name")


def tables_equal(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float = 1e-8) -> bool:
    """Whether two tables have the same keys and values within a tolerance."""
    both = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys, "full")
    return both.filter(F.col("_a").isNull() | F.col("_b").isNull() | (F.abs(F.col("_a") - F.col("_b")) > tolerance)).isEmpty()
