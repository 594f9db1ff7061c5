"""Operators over a concept graph: edges (child, parent), equivalences (a, b), triples (s, s_kind, p, o, o_kind).

Loops join a frontier of edges with the edge table; each round is cut into the shared checkpoint folder, so plans stay
short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxolume.functions.text import numeric_key
from taxolume.storage import Scratch, filed, numbered, sorted_join, told

from .components import connected_components
from .reach import Reach, parents_index, redundant

#: The predicates that are read.
SUBCLASS = "rdfs:subClassOf"
EQUIVALENT = "owl:equivalentClass"
LABEL, PREF_LABEL, ALT_LABEL = "rdfs:label", "skos:prefLabel", "skos:altLabel"
ON_PROPERTY, SOME_VALUES = "owl:onProperty", "owl:someValuesFrom"


def pattern(triples: DataFrame, p: str, s_kind: str | None = None, o_kind: str | None = None) -> DataFrame:
    """(s, o) of the triples with a predicate; the filters reach the scan."""
    found = triples.filter(F.col("p") == p)
    if s_kind:
        found = found.filter(F.col("s_kind") == s_kind)
    if o_kind:
        found = found.filter(F.col("o_kind") == o_kind)
    return found.select("s", "o")


def named_edges(triples: DataFrame) -> DataFrame:
    """(child, parent) between named classes."""
    return pattern(triples, SUBCLASS, "iri", "iri").select(F.col("s").alias("child"), F.col("o").alias("parent")).distinct()


def equivalence_classes(equal: DataFrame) -> DataFrame:
    """(member, group) of the connected components of (a, b); group is the least member as text."""
    return connected_components(equal).select(F.col("node").alias("member"), F.col("component").alias("group"))


def canonical(equal: DataFrame) -> DataFrame:
    """(member, canon): canon is the member with the smallest trailing number, then the smallest text."""
    groups = equivalence_classes(equal)
    best = groups.groupBy("group").agg(F.min_by("member", numeric_key(F.col("member"))).alias("canon"))
    return groups.join(best, "group").select("member", "canon")


def canonicalise(edges: DataFrame, equiv: DataFrame) -> DataFrame:
    """(child, parent) between canonical members, without loops and repeats; other nodes stand for themselves."""
    c, p = equiv.select(F.col("member").alias("child"), F.col("canon").alias("c")), equiv.select(F.col("member").alias("parent"), F.col("canon").alias("p"))
    out = edges.join(c, "child", "left").join(p, "parent", "left")
    return out.select(F.coalesce("c", "child").alias("child"), F.coalesce("p", "parent").alias("parent")).filter("child <> parent").distinct()


def ancestors(edges: DataFrame, start: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """(node, ancestor, depth): every ancestor of each start node (all nodes by default) with its least distance.

    Nodes are numbered once, so that rounds compare integers. One frontier for all nodes at once: a round extends the
    pairs of the round before by one edge, and pairs that are known are not followed again, so cycles end.
    """
    store = Scratch(edges.sparkSession, "closure")
    pairs = edges.select(F.col("child"), F.col("parent")).dropna().distinct()
    names = filed(store.put(numbered(pairs.select(F.col("child").alias("name")).union(pairs.select("parent")).distinct(), [F.col("name")], "i", store)))
    by = lambda df, column, out: df.join(names.select(F.col("name").alias(column), F.col("i").alias(out)), column).drop(column)
    up = filed(store.put(by(by(pairs, "child", "a"), "parent", "next")))
    first = up.select(F.col("a").alias("n"), F.col("next").alias("a"))
    if start is not None:
        first = first.join(by(start.select("node").distinct(), "node", "n"), "n", "left_semi")
    frontier, depth = store.put(first.withColumn("depth", F.lit(1))), 1
    seen = frontier
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.select("n", "a").join(up, "a").select("n", F.col("next").alias("a")).distinct()
        new = store.put(step.join(sorted_join(seen.select("n", "a")), ["n", "a"], "left_anti").withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            break
        seen, frontier = seen.union(new), new  # each part was computed once and is only read again
    back = lambda df, column, out: df.join(names.select(F.col("i").alias(column), F.col("name").alias(out)), column).drop(column)
    return back(back(seen, "n", "node"), "a", "ancestor").select("node", "ancestor", "depth")


def transitive_edges(edges: DataFrame, closure: DataFrame | None = None) -> DataFrame:
    """(child, parent) that follow from other edges and are not edges themselves."""
    closure = ancestors(edges) if closure is None else closure
    return closure.filter("node <> ancestor").select(F.col("node").alias("child"), F.col("ancestor").alias("parent")).join(edges, ["child", "parent"], "left_anti")


def transitive_reduction(edges: DataFrame, index: Reach | None = None) -> DataFrame:
    """edges without those to a parent that another parent of the same child reaches.

    Only parents can reach a parent, so that nodes which are nobody's parent need no label: by default the index is made
    of the edges between parents.
    """
    if index is None:
        index = parents_index(edges)
    return edges.join(redundant(index, edges), ["child", "parent"], "left_anti")


def restrictions(triples: DataFrame) -> DataFrame:
    """(s, property, filler) of anonymous parents that restrict a named property to a named filler."""
    anon = pattern(triples, SUBCLASS, "iri", "bnode").select("s", F.col("o").alias("b"))
    on = pattern(triples, ON_PROPERTY, o_kind="iri").select(F.col("s").alias("b"), F.col("o").alias("property"))
    some = pattern(triples, SOME_VALUES, o_kind="iri").select(F.col("s").alias("b"), F.col("o").alias("filler"))
    return anon.join(on, "b").join(some, "b").select("s", "property", "filler").distinct()


def equivalents(equiv: DataFrame) -> DataFrame:
    """(canon, members): the other members of each class, by trailing number."""
    other = equiv.filter("member <> canon")
    return other.groupBy("canon").agg(F.transform(F.array_sort(F.collect_list(numeric_key(F.col("member")))), lambda x: x["iri"]).alias("members"))


def labels(triples: DataFrame) -> DataFrame:
    """(s, label, pref_label, alt_labels): the least label of each kind, all alternatives sorted."""
    of = lambda p: F.when(F.col("p") == p, F.col("o"))
    kept = triples.filter(F.col("p").isin(LABEL, PREF_LABEL, ALT_LABEL))
    return kept.groupBy("s").agg(F.min(of(LABEL)).alias("label"), F.min(of(PREF_LABEL)).alias("pref_label"), F.array_sort(F.collect_set(of(ALT_LABEL))).alias("alt_labels"))


def assemble(closure: DataFrame) -> DataFrame:
    """(node, parents, ancestors): depth 1 and beyond, each by depth, then trailing number."""
    key = F.struct(F.col("depth"), numeric_key(F.col("ancestor")).alias("k"))
    near = lambda test: F.array_sort(F.collect_list(F.when(test, key)))
    names = lambda c: F.transform(c, lambda x: x["k"]["iri"])
    return closure.groupBy("node").agg(names(near(F.col("depth") == 1)).alias("parents"), names(near(F.col("depth") > 1)).alias("ancestors"))


def assembled(nodes: DataFrame, closure: DataFrame, triples: DataFrame | None = None, equiv: DataFrame | None = None) -> DataFrame:
    """(node, parents, ancestors[, restrictions][, equivalents]) of each of nodes (node), empty lists where it has none.

    restrictions (property, filler) are added if triples are given, equivalents if the classes (member, canon) are.
    """
    out = nodes.select("node").distinct().join(assemble(closure), "node", "left")
    empty = {"parents": "string", "ancestors": "string"}
    if triples is not None:
        found = restrictions(triples).groupBy(F.col("s").alias("node")).agg(F.array_sort(F.collect_list(F.struct("property", "filler"))).alias("restrictions"))
        out, empty = out.join(found, "node", "left"), empty | {"restrictions": "struct<property:string,filler:string>"}
    if equiv is not None:
        out, empty = out.join(equivalents(equiv).select(F.col("canon").alias("node"), F.col("members").alias("equivalents")), "node", "left"), empty | {"equivalents": "string"}
    return out.withColumns({c: F.coalesce(F.col(c), F.expr(f"cast(array() as array<{t}>)")) for c, t in empty.items()})


def target_ids(queries: DataFrame) -> DataFrame:
    """(id): the different targets of annotated queries."""
    return queries.select(F.col("target_entity.iri").alias("id")).filter("id is not null").distinct()


def level_order(edges: DataFrame, names: DataFrame, equal: DataFrame | None = None, top: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """(depth, node, place, sentence): what is said of each node at its least depth below the top nodes (roots by
    default): its equivalents and then its parents, each by name. names: (iri, label); equal: (a, b), symmetric.
    """
    start = roots(edges) if top is None else top.select("node")
    down = edges.select(F.col("parent").alias("child"), F.col("child").alias("parent"))
    at = ancestors(down, start, max_depth).groupBy(F.col("ancestor").alias("node")).agg(F.min("depth").alias("depth"))
    depths = start.distinct().withColumn("depth", F.lit(0)).union(at.join(start, "node", "left_anti").select("node", "depth"))
    if max_depth == 0:
        depths = depths.filter("depth = 0")
    label = names.select(F.col("iri").alias("node"), "label")
    says = edges.select(F.col("child").alias("node"), F.lit(1).alias("kind"), F.lit(" is a subclass of ").alias("how"), F.col("parent").alias("other"))
    if equal is not None:
        says = says.union(equal.select(F.col("a"), F.lit(0), F.lit(" is equivalent to "), F.col("b")))
    said = depths.join(says, "node").join(label, "node", "left").withColumn("own", F.coalesce("label", "node")).drop("label")
    said = said.join(label.withColumnRenamed("node", "other"), "other", "left").withColumn("that", F.coalesce("label", "other"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("kind", "that", "other"))
    return said.distinct().select("depth", "node", place.alias("place"), F.concat("own", "how", "that").alias("sentence"))


def merge_ancestors(targets: DataFrame, found: DataFrame) -> tuple[DataFrame, int]:
    """targets with parents and ancestors by node, empty arrays where there are none, and how many have none."""
    missing = targets.join(found, "node", "left_anti").count()
    empty = F.expr("cast(array() as array<string>)")
    out = targets.join(found, "node", "left")
    return out.withColumns({c: F.coalesce(F.col(c), empty) for c in ("parents", "ancestors")}), missing


def classify_nodes(triples: DataFrame) -> DataFrame:
    """(node, kind) of everything that a subclass or equivalence edge touches."""
    e = triples.filter(F.col("p").isin(SUBCLASS, EQUIVALENT))
    return e.select(F.col("s").alias("node"), F.col("s_kind").alias("kind")).union(e.select("o", "o_kind")).distinct()


def named(nodes: DataFrame) -> DataFrame:
    return nodes.filter("kind = 'iri'").select("node")


def antecedents(edges: DataFrame) -> DataFrame:
    return edges.groupBy("child").agg(F.array_sort(F.collect_set("parent")).alias("parents"))


def descendants(edges: DataFrame) -> DataFrame:
    return edges.groupBy("parent").agg(F.array_sort(F.collect_set("child")).alias("children"))


def roots(edges: DataFrame) -> DataFrame:
    """(node): parents that are nobody's child."""
    return edges.select(F.col("parent").alias("node")).distinct().join(edges.select(F.col("child").alias("node")), "node", "left_anti")


def symmetric(equal: DataFrame) -> DataFrame:
    return equal.select("a", "b").union(equal.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def top_concept(edges: DataFrame, name: str) -> str:
    """name, if it is a root; else an error."""
    if roots(edges).filter(F.col("node") == name).isEmpty():
        raise ValueError(f"{name} is not a root")
    return name


def depths_from(edges: DataFrame, root: str) -> DataFrame:
    """(node, depth): least number of edges below root, root itself 0, level by level."""
    down = edges.select(F.col("parent").alias("node"), F.col("child").alias("ancestor")).withColumnsRenamed({"node": "child", "ancestor": "parent"})
    start = edges.sparkSession.createDataFrame([(root,)], "node string")
    below = ancestors(down, start)
    return below.filter("ancestor <> node").select(F.col("ancestor").alias("node"), "depth").union(start.select("node", F.lit(0).alias("depth")))


def histogram(values: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n) of equal bins from low to high; values outside count in bins 0 and bins + 1."""
    return values.groupBy(F.width_bucket(F.col(column), F.lit(float(low)), F.lit(float(high)), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))
