"""Class expressions out of triples (s, s_kind, p, o, o_kind), and what follows from their normal forms.

Lists of rdf:first and rdf:rest are numbered by pointer doubling: in each round every cell looks twice as far back
towards its list's head, so that a list of n cells takes about log2(n) rounds. Blank nodes then unfold from the axioms
downwards, a round for each level; what two axioms share unfolds in each of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolume.storage import Scratch, join_hot

from .graph import EQUIVALENT, ON_PROPERTY, SOME_VALUES, SUBCLASS, pattern

#: The predicates of lists and conjunctions.
FIRST, REST, NIL, INTERSECTION = "rdf:first", "rdf:rest", "rdf:nil", "owl:intersectionOf"


def list_members(triples: DataFrame) -> DataFrame:
    """(head, pos, item, kind): the members of every list, from position 0. A list that ends without rdf:nil counts as
    far as it goes. A cell with several rests, or in several lists, and a list without a head are errors."""
    store = Scratch(triples.sparkSession, "lists")
    cells = store.put(pattern(triples, FIRST).select(F.col("s").alias("cell"), F.col("o").alias("item")).join(triples.filter(F.col("p") == FIRST).select(F.col("s").alias("cell"), F.col("o_kind").alias("kind")), "cell").distinct())
    rest = store.put(pattern(triples, REST).filter(F.col("o") != NIL).select(F.col("o").alias("cell"), F.col("s").alias("back")).distinct())
    for column in ("cell", "back"):
        if not rest.groupBy(column).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
            raise ValueError("a cell of several lists, or with several rests")
    at = store.put(cells.select("cell").join(rest, "cell", "left").select("cell", F.coalesce("back", "cell").alias("head"), F.when(F.col("back").isNull(), 0).otherwise(1).cast("long").alias("pos"), F.col("back").isNotNull().alias("open")))
    left, reach = at.count(), 1
    while not at.filter("open").isEmpty():
        if reach > 2 * left:
            raise ValueError("a list that is a circle")
        ahead = at.select(F.col("cell").alias("head"), F.col("head").alias("to"), F.col("pos").alias("more"), F.col("open").alias("on"))
        step = at.filter("open").join(ahead, "head", "left").select("cell", F.coalesce("to", "head").alias("head"), (F.col("pos") + F.coalesce("more", F.lit(0))).alias("pos"), F.coalesce("on", F.lit(False)).alias("open"))
        after = store.put(at.filter("not open").unionByName(step))
        store.drop(at)
        at, reach = after, reach * 2
    return at.join(cells, "cell").select("head", "pos", "item", "kind")


@dataclass
class Expressions:
    """axioms (axiom_id, kind, child, parent) and expressions (expr_id, parent_expr, pos, kind, name), as `axioms.render`
    and `axioms.normalise` take them; left_out (axiom_id): axioms with a part that is no class, conjunction or
    existential restriction."""

    axioms: DataFrame
    expressions: DataFrame
    left_out: DataFrame


def expressions(triples: DataFrame, names: DataFrame | None = None) -> Expressions:
    """The axioms between a named class and a class expression, and their expressions as trees.

    names (iri, label) gives classes and properties their names; others keep their iri. An axiom's id is its subject,
    predicate and object; an expression's is that of its axiom and the positions that lead to it. Repeated triples count
    once. A blank node inside itself is an error.
    """
    store = Scratch(triples.sparkSession, "expressions")
    members = list_members(triples)
    both = pattern(triples, INTERSECTION).withColumnsRenamed({"s": "node", "o": "head"}).distinct().join(members, "head")
    both = both.select("node", F.lit("and").alias("as"), F.lit("").alias("role"), F.col("pos").cast("int").alias("place"), F.col("item").alias("child"), F.col("kind").alias("child_kind"))
    on = pattern(triples, ON_PROPERTY).withColumnsRenamed({"s": "node", "o": "role"})
    some = triples.filter(F.col("p") == SOME_VALUES).select(F.col("s").alias("node"), F.col("o").alias("child"), F.col("o_kind").alias("child_kind"))
    some = on.join(some, "node").distinct().select("node", F.lit("some").alias("as"), "role", F.lit(0).alias("place"), "child", "child_kind")
    parts = store.put(both.unionByName(some))
    kinds = store.put(parts.select("node", "as", "role").distinct())
    blanks = kinds.count()

    told = triples.filter(F.col("p").isin(SUBCLASS, EQUIVALENT) & (F.col("s_kind") == "iri")).select("s", "p", "o", "o_kind").distinct()
    told = store.put(told.withColumn("axiom_id", F.concat_ws("|", "s", "p", "o")))
    axioms = told.select("axiom_id", F.when(F.col("p") == EQUIVALENT, "equiv").otherwise("sub").alias("kind"), F.concat("axiom_id", F.lit("/l")).alias("child"), F.concat("axiom_id", F.lit("/r")).alias("parent"))
    none = F.lit(None).cast("string")
    side = lambda way, node, kind: told.select("axiom_id", F.concat("axiom_id", F.lit(way)).alias("expr_id"), none.alias("parent_expr"), F.lit(0).alias("pos"), node.alias("node"), kind.alias("node_kind"))
    open_ = store.put(side("/l", F.col("s"), F.lit("iri")).unionByName(side("/r", F.col("o"), F.col("o_kind"))))
    done, depth = [], 0
    while not open_.isEmpty():
        if depth > blanks:
            raise ValueError("a blank node inside itself")
        depth += 1
        seen = store.put(join_hot(open_, kinds, "node", F.xxhash64("expr_id"), how="left"))
        done.append(seen.select("axiom_id", "expr_id", "parent_expr", "pos", F.when(F.col("node_kind") == "iri", "iri").otherwise(F.col("as")).alias("kind"), F.when(F.col("node_kind") == "iri", F.col("node")).otherwise(F.col("role")).alias("name")))
        inner = seen.filter("node_kind <> 'iri' and as is not null").select("axiom_id", F.col("expr_id").alias("parent_expr"), "node").join(parts.select("node", "place", "child", "child_kind"), "node")
        open_ = store.put(inner.select("axiom_id", F.concat_ws("/", "parent_expr", F.col("place").cast("string")).alias("expr_id"), "parent_expr", F.col("place").alias("pos"), F.col("child").alias("node"), F.col("child_kind").alias("node_kind")))
    every = done[0] if done else open_.select("axiom_id", "expr_id", "parent_expr", "pos", F.lit("").alias("kind"), F.lit("").alias("name"))
    for d in done[1:]:
        every = every.unionByName(d)
    left_out = store.put(every.filter("kind is null").select("axiom_id").distinct())
    kept = every.join(left_out, "axiom_id", "left_anti")
    if names is not None:
        label = names.groupBy(F.col("iri").alias("name")).agg(F.min("label").alias("label"))
        kept = join_hot(store.put(kept), label, "name", F.xxhash64("expr_id"), how="left").withColumn("name", F.coalesce("label", "name"))
    kept = store.put(kept.select("expr_id", "parent_expr", "pos", "kind", "name"))
    return Expressions(axioms.join(left_out, "axiom_id", "left_anti"), kept, left_out)


def saturate(forms: DataFrame, inclusions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((sub, super), (sub, role, filler)): all that follows from EL normal forms (kind, first, second, third) between
    the names in them, and role inclusions (sub, super).

    The completion rules of EL, semi-naively: each round joins what is new with what is known. Every name is below
    itself. nf1 carries a name up; nf2 joins two supers of one name; nf3 gives a name a link; nf4 turns a link to a
    filler below nf4's into a super; links follow role inclusions, closed over chains first. Facts are made once, so
    cycles of any kind end. A name is its text.
    """
    store = Scratch(forms.sparkSession, "saturation")
    forms = store.put(forms.select("kind", "first", "second", "third").distinct())
    of = lambda kind, *columns: forms.filter(F.col("kind") == kind).select(*[F.col(c).alias(a) for c, a in zip(("first", "second", "third"), columns, strict=False)])
    nf1, nf2, nf3, nf4 = of("nf1", "x", "y"), of("nf2", "x", "x2", "y"), of("nf3", "x", "role", "filler"), of("nf4", "role", "filler", "y")
    nf2 = store.put(nf2.unionByName(nf2.select(F.col("x2").alias("x"), F.col("x").alias("x2"), "y")).distinct())
    names = F.when(F.col("kind") == "nf1", F.array("first", "second")).when(F.col("kind") == "nf2", F.array("first", "second", "third")).when(F.col("kind") == "nf3", F.array("first", "third")).otherwise(F.array("second", "third"))
    roles = None
    if inclusions is not None:
        from .graph import ancestors

        roles = store.put(ancestors(inclusions.select(F.col("sub").alias("child"), F.col("super").alias("parent"))).select(F.col("node").alias("role"), F.col("ancestor").alias("wider")))
    new_sub = store.put(forms.select(F.explode(names).alias("sub")).distinct().select("sub", F.col("sub").alias("super")))
    new_link, subs, links = None, new_sub, None
    while True:
        # What new facts give, each with all that is known, the new included.
        made = [new_sub.join(nf1, new_sub["super"] == nf1["x"]).select("sub", F.col("y").alias("super"))]
        half = new_sub.join(nf2, new_sub["super"] == nf2["x"]).select("sub", F.col("x2").alias("super"), "y")
        made.append(half.join(subs, ["sub", "super"], "left_semi").select("sub", F.col("y").alias("super")))
        linked = new_sub.join(nf3, new_sub["super"] == nf3["x"]).select("sub", "role", "filler")
        if roles is not None:
            linked = linked.unionByName(linked.join(roles, "role").select("sub", F.col("wider").alias("role"), "filler"))
        linked = linked.distinct()
        next_link = store.put(linked if links is None else linked.join(links, ["sub", "role", "filler"], "left_anti"))
        for link, below in ((links, new_sub), (next_link, subs)):
            if link is not None:
                wide = link.join(below.select(F.col("sub").alias("filler"), F.col("super").alias("over")), "filler")
                made.append(wide.join(nf4.withColumnRenamed("filler", "over"), ["role", "over"]).select("sub", F.col("y").alias("super")))
        found = made[0]
        for m in made[1:]:
            found = found.unionByName(m)
        new_sub = store.put(found.distinct().join(subs, ["sub", "super"], "left_anti"))
        links = next_link if links is None else links.unionByName(next_link)
        if new_sub.isEmpty():
            return subs, links
        subs = subs.unionByName(new_sub)
