"""A reachability index over a concept graph: interval labels over a spanning forest, and exceptions.

Every node keeps one of its parents, one of the deepest, as its parent in a forest, and gets the interval of places that
its tree takes in a walk through the forest. Its ancestors along the forest are the nodes whose intervals hold its place.
All its other ancestors lie above some node that a path enters by another edge; of these entries it keeps the lowest
ones. So b is above a exactly if b's interval holds a's place or one of a's entries: a comparison of labels, without the
closure, whose rows are many times as many.

Labels are made in rounds over levels, each a join of that level's edges with the labels of their parents. Nodes on a
cycle, or below one, have no level; they are few or none, and their ancestors come from `graph.ancestors`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxolume.storage import Scratch, join_hot, numbered, told

SPAN = "struct<lo:bigint,hi:bigint>"


@dataclass
class Reach:
    """labels (node, lo, hi, entries, path): a node's interval; its lowest entries' intervals, by place; and the places
    of its ancestors along the forest and its own. loose (node): nodes on or below a cycle, without labels. edges
    (child, parent) as given, without nulls and repeats."""

    labels: DataFrame
    loose: DataFrame
    edges: DataFrame


def reach_index(edges: DataFrame, nodes: DataFrame | None = None) -> Reach:
    """The index of edges (child, parent), and of nodes (node) that may have no edge. Null ends and repeats are left
    out; an empty graph gives an empty index."""
    store = Scratch(edges.sparkSession, "reach")
    pairs = store.put(edges.select("child", "parent").dropna().distinct())
    every = pairs.select(F.col("child").alias("node")).union(pairs.select("parent"))
    if nodes is not None:
        every = every.union(nodes.select("node").dropna())
    names = store.put(numbered(every.distinct(), [F.col("node")], "i", store))
    by = lambda df, column, out: df.join(names.select(F.col("node").alias(column), F.col("i").alias(out)), column).drop(column)
    up = store.put(by(by(pairs, "child", "a"), "parent", "b"))
    placed = _levels(store, names, up)
    labels = _labels(store, placed, up, placed.count())
    out = store.put(labels.join(names, "i").select("node", "lo", "hi", "entries", "path"))
    loose = store.put(names.join(placed.select("i"), "i", "left_anti").select("node"))
    store.clear(out, loose, pairs)
    return Reach(out, loose, pairs)


def parents_index(edges: DataFrame) -> Reach:
    """The index of the edges between nodes that are parents. Only these can reach anything, so for `redundant`, and for
    ancestors by way of a node's parents, the others need no label."""
    pairs = Scratch(edges.sparkSession, "parents").put(edges.select("child", "parent").dropna().distinct())
    over = pairs.select(F.col("parent").alias("child")).distinct()
    return reach_index(pairs.join(told(over), "child", "left_semi"), over.withColumnRenamed("child", "node"))


def _levels(store: Scratch, names: DataFrame, up: DataFrame) -> DataFrame:
    """(i, level, tree): a node is placed once all its parents are, below one of the last of them."""
    wanted = store.put(up.groupBy(F.col("a").alias("i")).agg(F.count("*").alias("wanted")))
    top = names.select("i").join(wanted, "i", "left_anti")
    now, level = store.put(top.withColumns({"level": F.lit(0), "tree": F.lit(None).cast("long")})), 0
    parts, waiting = [now], None
    while True:
        level += 1
        met = up.join(now.select(F.col("i").alias("b")), "b").groupBy(F.col("a").alias("i")).agg(F.count("*").alias("got"), F.min("b").alias("tree"))
        if waiting is not None:  # the tree's parent is of this round, the others of earlier ones only count
            met = met.unionByName(waiting.select("i", "got", F.lit(None).cast("long").alias("tree"))).groupBy("i").agg(F.sum("got").alias("got"), F.min("tree").alias("tree"))
        met = store.put(met.join(wanted, "i"))
        now = store.put(met.filter("got = wanted").select("i", F.lit(level).alias("level"), "tree"))
        if now.isEmpty():
            break
        parts.append(now)
        waiting = met.filter("got < wanted")
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return store.put(out)


def _labels(store: Scratch, placed: DataFrame, up: DataFrame, n: int) -> DataFrame:
    """(i, lo, hi, entries, path) of the n placed nodes."""
    paths = _paths(store, placed, n)
    sizes = paths.select(F.explode("ids").alias("i")).groupBy("i").agg(F.count("*").alias("size"))
    sized = store.put(placed.join(sizes, "i"))
    # A node comes after its siblings' trees before it: a running sum over all, less what ran before the first sibling.
    run = store.put(numbered(sized, [F.col("tree").asc_nulls_first(), F.col("i")], "place", store, "size", "run").select("i", "tree", "size", (F.col("run") - F.col("size")).alias("ahead")))
    first = run.groupBy("tree").agg(F.min("ahead").alias("first"), F.count("*").alias("_rows"))
    roots = run.filter("tree is null").select("i", "size", F.col("ahead").alias("skip"))
    rest = join_hot(run.filter("tree is not null"), first.select("tree", "first"), "tree", F.col("i"), first.select("tree", "_rows"), rows=n)
    skips = store.put(roots.unionByName(rest.select("i", "size", (F.col("ahead") - F.col("first")).alias("skip"))))
    steps = paths.select("i", F.posexplode("ids").alias("d", "j"))
    counts = sized.select(F.col("i").alias("j"), F.col("size").alias("_rows"))
    spent = join_hot(steps, skips.select(F.col("i").alias("j"), "skip"), "j", F.col("i"), counts, rows=n)
    # One for each node above it, besides what is skipped: the place in a walk that meets parents first.
    walked = spent.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("d", "skip"))).alias("s"))
    sums = F.aggregate("s", F.array(F.lit(-1).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + 1 + x["skip"])))
    own = walked.select("i", F.slice(sums, 2, F.size("s")).alias("path")).join(skips.select("i", "size"), "i")
    own = store.put(own.withColumn("lo", F.element_at("path", -1)).select("i", "lo", (F.col("lo") + F.col("size") - 1).alias("hi"), "path").join(placed, "i"))
    return _entries(store, own, up, n)


def _paths(store: Scratch, placed: DataFrame, n: int) -> DataFrame:
    """(i, ids): the forest's nodes from a root down to each node, by doubling the part that is known."""
    at = store.put(placed.select("i", F.array("i").alias("ids"), F.col("tree").alias("next")))
    while not at.filter("next is not null").isEmpty():
        open_, done = at.filter("next is not null"), at.filter("next is null")
        above = at.select(F.col("i").alias("next"), F.col("ids").alias("more"), F.col("next").alias("then"))
        longer = join_hot(open_, above, "next", F.col("i"), rows=n).select("i", F.concat("more", "ids").alias("ids"), F.col("then").alias("next"))
        after = store.put(done.unionByName(longer))
        store.drop(at)
        at = after
    return at.select("i", "ids")


def _lowest(spans: Column, lo: Column) -> Column:
    """Of intervals, those that hold no other one and not the place lo, by place. Of nested ones the next in order lies
    inside, as intervals of a forest are nested or apart."""
    own = F.struct(lo.alias("lo"), (lo - 1).alias("hi"))
    order = F.array_sort(F.array_union(F.array_distinct(spans), F.array(own)))
    inner = F.filter(order, lambda x, i: F.coalesce(F.get(order, i + 1)["lo"] > x["hi"], F.lit(True)))
    return F.filter(inner, lambda x: x["lo"] != lo)


def _entries(store: Scratch, own: DataFrame, up: DataFrame, n: int) -> DataFrame:
    """own with entries, level by level: the entries of all parents, and the parents that are not the tree's."""
    counts = store.put(up.groupBy("b").agg(F.count("*").alias("_rows")))
    height = own.agg(F.max("level")).first()[0]
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    keep = ["i", "lo", "hi", "path", "entries"]
    done = store.put(own.filter("level = 0").withColumn("entries", none).select(*keep))
    edges = store.put(up.join(own.select(F.col("i").alias("a"), "level", "tree"), "a"))
    for level in range(1, (height or 0) + 1):
        # An edge of the tree to a parent without entries brings none.
        above = done.select(F.col("i").alias("b"), "lo", "hi", "entries")
        met = join_hot(edges.filter(F.col("level") == level), above, "b", F.col("a"), counts, rows=n)
        met = met.select("a", F.when(F.col("b") == F.col("tree"), F.col("entries")).otherwise(F.concat("entries", F.array(F.struct("lo", "hi")))).alias("e"))
        got = met.filter(F.size("e") > 0).groupBy(F.col("a").alias("i")).agg(F.flatten(F.collect_list("e")).alias("e"))
        now = own.filter(F.col("level") == level).join(got, "i", "left")
        now = store.put(now.withColumn("entries", F.when(F.col("e").isNull(), none).otherwise(_lowest(F.col("e"), F.col("lo")))).select(*keep))
        done = done.unionByName(now)
    return done


def is_above(lo: Column, hi: Column, place: Column, entries: Column) -> Column:
    """Whether the node of interval (lo, hi) is a true ancestor of the node of this place and these entries."""
    return ((place > lo) & (place <= hi)) | F.exists(entries, lambda e: (e["lo"] >= lo) & (e["lo"] <= hi))


def related(index: Reach, pairs: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """pairs with `above`: whether parent is an ancestor of child, by any path of one edge or more. A node that the
    graph does not have has and is no ancestor; nulls neither. Other columns stay."""
    a, b = f"`{child}`", f"`{parent}`"
    lower = index.labels.select(F.col("node").alias("_a"), F.col("lo").alias("_place"), "entries").withColumnRenamed("entries", "_entries")
    upper = index.labels.select(F.col("node").alias("_b"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    labelled = pairs.join(lower, F.col(a) == F.col("_a"), "left").join(upper, F.col(b) == F.col("_b"), "left")
    out = labelled.withColumn("above", F.coalesce(is_above(F.col("_lo"), F.col("_hi"), F.col("_place"), F.col("_entries")), F.lit(False))).drop("_a", "_b", "_place", "_entries", "_lo", "_hi")
    if index.loose.isEmpty():
        return out
    # Below a cycle: the ancestors of these nodes by rounds.
    found = _loose_ancestors(index, pairs.select(F.col(a).alias("node"))).select(F.col("node").alias("_a"), F.col("ancestor").alias("_b"), F.lit(True).alias("_there"))
    return out.join(found, (F.col(a) == F.col("_a")) & (F.col(b) == F.col("_b")), "left").withColumn("above", F.col("above") | F.col("_there").isNotNull()).drop("_a", "_b", "_there")


def _loose_ancestors(index: Reach, nodes: DataFrame) -> DataFrame:
    from .graph import ancestors

    return ancestors(index.edges, nodes.distinct().join(index.loose, "node", "left_semi")).select("node", "ancestor")


def look_up(index: Reach, nodes: DataFrame) -> DataFrame:
    """(node, ancestor): all ancestors of these nodes (node), from the paths of their places and entries. Each pair
    once; nodes that the graph does not have give none."""
    own = nodes.select("node").distinct().join(index.labels, "node")
    ends = own.select("node", F.col("lo").alias("me"), F.explode(F.concat(F.array("lo"), F.transform("entries", lambda e: e["lo"]))).alias("at"))
    paths = index.labels.select(F.col("lo").alias("at"), "path")
    places = ends.join(told(paths), "at").select("node", "me", F.explode("path").alias("p")).filter("p <> me").select("node", "p").distinct()
    out = places.join(told(index.labels.select(F.col("lo").alias("p"), F.col("node").alias("ancestor"))), "p").select("node", "ancestor")
    return out if index.loose.isEmpty() else out.union(_loose_ancestors(index, nodes.select("node")))


def redundant(index: Reach, edges: DataFrame) -> DataFrame:
    """(child, parent) of the edges to a parent that another parent of the same child reaches.

    The index need hold the parents only. A child's parents and their entries stand in order of place; an edge is
    redundant if the next of them lies in its parent's interval. So children meet their own parents only, each once.
    """
    pairs = edges.select("child", "parent").dropna().distinct()
    several = pairs.groupBy("child").agg(F.count("*").alias("_n")).filter("_n > 1").select("child")
    mine = pairs.join(several, "child", "left_semi")
    label = index.labels.select(F.col("node").alias("parent"), "lo", "hi", "entries")
    spans = mine.join(told(label), "parent")
    ends = F.concat(F.array(F.struct(F.col("lo").alias("at"), F.lit(0).alias("kind"), F.col("hi").alias("hi"), F.col("parent").alias("p"))), F.transform("entries", lambda e: F.struct(e["lo"].alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("hi"), F.lit(None).cast(edges.schema["parent"].dataType).alias("p"))))
    rows = spans.select("child", F.explode(ends).alias("e")).select("child", "e.*")
    nxt = F.lead("at").over(Window.partitionBy("child").orderBy("at", "kind"))
    found = rows.withColumn("_next", nxt).filter("kind = 0 and _next <= hi").select("child", F.col("p").alias("parent"))
    if index.loose.isEmpty():
        return found
    above = _loose_ancestors(index, mine.select(F.col("parent").alias("node")))
    over = mine.withColumnRenamed("parent", "node").join(above, "node").filter("node <> ancestor").select("child", F.col("ancestor").alias("parent"))
    return found.union(mine.join(over, ["child", "parent"], "left_semi")).distinct()
