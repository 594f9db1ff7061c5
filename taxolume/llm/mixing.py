"""Mixing sources to target weights by pivotal dependent rounding.

Each document is to be taken target / source size times. The whole part is certain; the fractional parts are paired:
two documents of a source pass words at random from one to the other until one of them is taken or not, which decides
it, and the other goes on to the next pairing. What one gains in words the other loses, so every expectation and the
source's words are kept; only the last document of a source, whose coin is left, moves them. Pairs form inside small
groups of similar size (source, size class, hash bucket), the groups' leftovers in groups of groups, and so on: a
distributed reduction tree whose depth grows with the logarithm of the rows; the last pairings of a source go from its
large documents to its small ones. A source's few very large documents are decided first, in a tree of their own, and
what that moves is made up for by the others' shares, so that a source comes near its target also where one document is
a large part of it. Rows that agree in all columns are one unit of as many copies, so repeats make no
group larger. Fractions are integers and all randomness is hashed from row keys, so reruns agree. DataFrame expressions
only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxolume.storage import Scratch, join_hot, multiplied, numbered

#: The mass of a whole copy.
ONE = 1 << 40
#: Documents in a group of the tree's lowest level, about, and groups that one above takes together.
GROUP = 128
#: A document of more than this part of its source's target is decided before the others.
LARGE = 50
#: Rows of (source, size class) up to which they are broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, source: str = "source", size: str = "size", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, store: Scratch | None = None) -> DataFrame:
    """(source, source_size, target): share of all sizes, split by weight, at most `most` times a source's size.

    Sources in code-point order, null last, take the weights in turn. What a capped source cannot take is shared out
    again by weight until no target is above its cap: each round caps the sources below the level that the others
    reach, which raises the level; it ends when no source is added. Only such levels reach the driver.
    """
    store = store or Scratch(sizes.sparkSession, "targets")
    per = sizes.groupBy(source).agg(F.coalesce(F.sum(size), F.lit(0)).alias("source_size"))
    per = numbered(per, [F.col(source).asc_nulls_last()], "_turn", store)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_turn") % len(weights) + 1).cast("int"))
    per = store.put(per.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most))).drop("_turn"))
    total, level, capped = per.agg(F.sum("source_size")).first()[0] or 0, 0.0, -1
    while True:
        low = F.col("cap") < F.lit(level) * F.col("w")
        n, held, free = per.agg(F.count(F.when(low, 1)), F.coalesce(F.sum(F.when(low, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~low, F.col("w"))), F.lit(0.0))).first()
        if n == capped or not free:
            break
        capped, level = n, (float(share) * total - held) / free
    target = F.least(F.col("cap"), F.lit(level) * F.col("w")) if free else F.col("cap")
    return per.select(source, "source_size", target.alias("target"))


UNIT = ("size", "key", "id", "n", "mass")


def _fold(units: Column, seed: int) -> Column:
    """struct<open, done>: pairs an array of units one after the other; done have mass 0 or ONE, open is the last one."""
    kind = "struct<" + ",".join(f"{c}:bigint" for c in (*UNIT, "whole")) + ">"

    def step(a: Column, x: Column) -> Column:
        o = a["open"]
        ratio = x["size"] / o["size"]
        # What the open one can gain, and lose, until it or its partner is decided; the chance keeps the expectation.
        rise, fall = F.least((F.lit(ONE) - o["mass"]).cast("double"), x["mass"] * ratio), F.least(o["mass"].cast("double"), (F.lit(ONE) - x["mass"]) * ratio)
        dice = F.pmod(F.xxhash64(o["key"], x["key"], F.lit(seed)), F.lit(ONE)) / F.lit(float(ONE))
        up = dice * (rise + fall) < fall
        own = F.when(up, rise >= (F.lit(ONE) - o["mass"])).otherwise(fall >= o["mass"])  # whether the open one is decided
        moved = F.when(up, rise).otherwise(-fall)
        rest = lambda m: F.greatest(F.lit(0), F.least(F.lit(ONE), F.round(m).cast("long")))
        open_ = F.when(own, _with(x, rest(x["mass"] - moved / ratio))).otherwise(_with(o, rest(o["mass"] + moved)))
        closed = F.when(own, _with(o, F.when(up, ONE).otherwise(0))).otherwise(_with(x, F.when(up, 0).otherwise(ONE)))
        started = o.isNotNull()
        return F.struct(F.when(started, open_).otherwise(x).alias("open"), F.when(started, F.concat(a["done"], F.array(closed))).otherwise(a["done"]).alias("done"))

    zero = F.struct(F.expr(f"cast(null as {kind})").alias("open"), F.expr(f"cast(array() as array<{kind}>)").alias("done"))
    return F.aggregate(units, zero, step)


def _with(unit: Column, mass: Column) -> Column:
    return F.struct(*[unit[c].alias(c) for c in UNIT[:-1]], mass.cast("long").alias("mass"), unit["whole"].alias("whole"))


def _row_key(docs: DataFrame) -> Column:
    """A hash of all of a row's columns (maps, which have no order, apart) and of which of them are null."""
    cols = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(F.array(*[c.isNull() for c in cols]), *cols)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 1) -> DataFrame:
    """For each row of docs: key, row_key, size, source_size, target, copies, taken (size times copies).

    size is the number of words of the text, 0 for a null one. A row without words is not taken. All rows are returned,
    null keys and sources too (a null source is a source). Rows that agree in all columns are rounded together and
    differ by one copy at most. An empty table gives no rows. No row is taken more than `most` times, rounded up; with
    share and most as they are, twice. Very long texts count in full; those that are large against their source's target
    are decided first, and the others make up for them. Other columns, whatever their names, only tell rows apart.
    """
    units = _rounded(docs, key, text, source, weights, share, most, seed)
    rows = units.filter("n = 1").withColumn("copies", F.col("total"))
    if not units.filter("n > 1").isEmpty():
        each = multiplied(units.filter("n > 1"), "n", "i", ["row_key"])
        rows = rows.unionByName(each.withColumn("copies", F.floor(F.col("total") / F.col("n")) + (F.col("i") < F.col("total") % F.col("n")).cast("long")).drop("i"))
    return rows.select(F.col("id").alias(key), "row_key", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def _rounded(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 1) -> DataFrame:
    """(id, source, row_key, size, source_size, target, n, total): each different row, how often it occurs and is taken."""
    store = Scratch(docs.sparkSession, "mixing")
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{source}`").alias("source"), word_count(F.col(f"`{text}`")).alias("size"), _row_key(docs).alias("key"))
    rows = rows.groupBy("id", "source", "size", "key").agg(F.count("*").alias("n"))
    rows = store.put(rows.withColumn("class", F.when(F.col("size") > 0, F.floor(F.log2("size") * 4).cast("int")).otherwise(-1)))
    at = [F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("none")]
    classes = store.put(rows.groupBy("source", "class").agg(F.count("*").alias("rows"), F.sum(F.col("size") * F.col("n")).alias("size")))
    goal = targets(classes, weights=weights, share=share, most=most, store=store).select(*at, "source_size", "target")
    plan = classes.select(*at, "class", F.ceil(F.col("rows") / GROUP).cast("long").alias("buckets")).join(goal, ["s", "none"])
    plan = store.put(plan.select("s", "none", "class", "source_size", "target", "buckets"))
    told = plan.agg(F.count("*"), F.max("buckets")).first()
    keyed = rows.select("*", *at)
    units = keyed.join(F.broadcast(plan), ["s", "none", "class"]) if told[0] <= BROADCAST_ROWS else join_hot(keyed, plan, ["s", "none", "class"], F.col("key"))
    units = units.withColumn("bucket", F.pmod(F.xxhash64("key", F.lit(seed)), F.col("buckets")))
    share_of = F.when((F.col("source_size") > 0) & (F.col("size") > 0), F.col("target") / F.col("source_size")).otherwise(0.0)
    large = F.col("size") * LARGE > F.col("target")
    first = _decided(store, units.filter(large).withColumn("exact", share_of * F.col("n")), told[1] or 1, seed)
    # What the large documents took more or less than their part goes to the others' shares, whose mean stays as it was.
    by_source = lambda df: join_hot(df, sums, ["s", "none"], F.col("key"), how="left") if told[0] > BROADCAST_ROWS else df.join(F.broadcast(sums), ["s", "none"], "left")
    sums = store.put(first.groupBy("s", "none").agg(F.sum(F.col("size") * F.col("total")).alias("had"), F.sum(F.col("size") * F.col("n")).alias("was")))
    rest = F.col("source_size") - F.coalesce("was", F.lit(0))
    share_of = F.when((rest > 0) & (F.col("size") > 0), F.least(F.lit(float(most)), F.greatest(F.lit(0.0), (F.col("target") - F.coalesce("had", F.lit(0))) / rest))).otherwise(0.0)
    second = _decided(store, by_source(units.filter(~large)).withColumn("exact", share_of * F.col("n")).drop("had", "was"), told[1] or 1, seed + 50)
    per = plan.groupBy("s", "none").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    out = first.unionByName(second)
    out = out.join(F.broadcast(per), ["s", "none"]) if told[0] <= BROADCAST_ROWS else join_hot(out, per, ["s", "none"], F.col("key"))
    result = store.put(out.select("id", F.when(~F.col("none"), F.col("s")).alias("source"), F.col("key").alias("row_key"), "size", "source_size", "target", "n", "total"))
    store.clear(result)
    return result


def _decided(store: Scratch, units: DataFrame, buckets: int, seed: int) -> DataFrame:
    """(s, none, size, key, id, n, total) of units that are to be taken `exact` times: its whole part and, for some, one
    more. units: (s, none, class, bucket, size, key, id, n, exact), with fewer than `buckets` buckets in a class."""
    kept = ["s", "none", *UNIT[:-1], "whole"]
    units = units.withColumn("whole", F.floor("exact").cast("long"))
    units = store.put(units.withColumn("mass", F.least(F.round((F.col("exact") - F.col("whole")) * ONE).cast("long"), F.lit(ONE))).select("class", "bucket", *kept, "mass"))
    decided = [units.filter(F.col("mass").isin(0, ONE)).select(*kept, "mass")]
    open_, left, level = units.filter(~F.col("mass").isin(0, ONE)).select("class", "bucket", *kept, "mass"), buckets, 0
    cols = [*UNIT, "whole"]
    while True:
        level += 1
        last = left <= 1 and level > 1
        by = ["s", "none"] if last else ["s", "none", "class", "bucket"]
        ordered = F.reverse(F.array_sort(F.collect_list(F.struct(*cols))))
        folded = open_.groupBy(*by).agg(_fold(ordered, seed + level).alias("f"))
        if last:
            # One document of each source is left with a fraction: a coin of that weight decides it.
            coin = F.when(F.pmod(F.xxhash64(F.col("f.open.key"), F.lit(seed)), F.lit(ONE)) < F.col("f.open.mass"), ONE).otherwise(0)
            decided.append(folded.select("s", "none", F.explode(F.concat("f.done", F.array(_with(F.col("f.open"), coin)))).alias("u")).select("s", "none", "u.*").select(*kept, "mass"))
            break
        flat = store.put(folded.select(*by, F.explode(F.concat("f.done", F.array("f.open"))).alias("u")).select(*by, "u.*"))
        decided.append(flat.filter(F.col("mass").isin(0, ONE)).select(*kept, "mass"))
        open_ = flat.filter(~F.col("mass").isin(0, ONE)).withColumn("bucket", F.floor(F.col("bucket") / GROUP).cast("long"))
        left = -(-left // GROUP)
    out = decided[0]
    for d in decided[1:]:
        out = out.union(d)
    return store.put(out.select("s", "none", *UNIT[:-1], (F.col("whole") + (F.col("mass") == ONE).cast("long")).alias("total")))


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with the columns of docs. Rows that agree in all columns
    are together as many as the mix takes of them."""
    units = _rounded(docs, key, text, source, **how)
    at = lambda k, s: [F.coalesce(k, F.lit(-1)).alias("k"), F.coalesce(s, F.lit("")).alias("s")]
    counts = units.select(F.col("row_key").alias("h"), *at(F.col("id"), F.col("source")), "n", "total")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, _row_key(docs).alias("h"), *at(F.col(f"`{key}`").cast("long"), F.col(f"`{source}`")))
    same = ["h", "k", "s"]
    # Copies of a repeated row may be any part of all rows: the join splits them, and each task keeps one of each.
    taken = counts.filter("total > 0")
    if counts.filter("n > 1").isEmpty():
        return rows.join(taken.drop("n"), same).select("row", F.explode(F.sequence(F.lit(1), F.col("total").cast("int")))).select("row.*")
    all_ = join_hot(rows, taken, same, F.monotonically_increasing_id(), taken.select(*same, F.col("n").alias("_rows")))
    out = all_.filter("n = 1").select("row", F.explode(F.sequence(F.lit(1), F.col("total").cast("int"))))
    one = all_.filter("n > 1").groupBy(*same).agg(F.first("row").alias("row"), F.first("total").alias("total"))
    out = out.union(multiplied(one, "total", "i", ["h"]).select("row", F.col("i").cast("int")))
    return out.select("row.*")
