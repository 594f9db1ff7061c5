"""Readers and writers: JSON lexicons and questions, training examples, triples, vectors, axioms, result tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABELLED = "struct<iri:string,`rdfs:label`:string,`skos:prefLabel`:string,`skos:altLabels`:array<string>,depth:int>"
MENTION = "struct<entity_literal:string,start_position:int,end_position:int,entity_type:string>"
QUERY = f"internal_id string, source_dataset string, question_id string, question string, entity_mention {MENTION}, target_entity {LABELLED}, parent_entities array<{LABELLED}>, ancestors array<{LABELLED}>, equivalent_classes array<{LABELLED}>"
#: The eight files of a hierarchy's training set.
SPLITS = ("train", "val", "test", "multi_train", "multi_val", "multi_test", "mixed_val", "mixed_test")


def read_json(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A JSON document: an array of rows or one row."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines; blank lines are skipped, malformed ones are an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_map(spark: SparkSession, path: str, value: str = "string") -> DataFrame:
    """(position, key, value) of a JSON object, in the object's order."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.map_entries(F.from_json("value", f"map<string,{value}>"))).alias("position", "e")).select("position", "e.key", "e.value")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(iri, label): a raw lexicon's labels as an array, null where the entry is a plain text."""
    m = read_map(spark, path, "struct<label:string>")
    raw = F.col("value.label")
    return m.select(F.col("key").alias("iri"), F.when(F.startswith(raw, F.lit("[")), F.from_json(raw, "array<string>")).alias("label"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, question_id, question, options, answer, metadata) of a benchmark file {dataset: {id: {...}}}.

    Texts are trimmed; options keep their order; metadata has the other keys as JSON text, null if there are none.
    """
    rows = read_map(spark, path, "map<string,string>").select(F.col("key").alias("dataset"), F.explode(F.map_entries("value")).alias("e"))
    body = F.from_json("e.value", "map<string,string>")
    r = rows.select("dataset", F.col("e.key").alias("question_id"), body.alias("b"))
    options = F.transform(F.map_entries(F.from_json(F.col("b")["options"], "map<string,string>")), lambda o: F.struct(o["key"].alias("letter"), F.trim(o["value"]).alias("text")))
    rest = F.map_filter("b", lambda k, _: ~k.isin("question", "options", "answer"))
    return r.select("dataset", "question_id", F.trim(F.col("b")["question"]).alias("question"), options.alias("options"), F.trim(F.col("b")["answer"]).alias("answer"), F.when(F.size(rest) > 0, F.to_json(rest)).alias("metadata"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Annotated queries with their targets."""
    return read_json(spark, path, QUERY)


def split_by_equivalents(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries with equivalent classes, and the others."""
    some = F.coalesce(F.size("equivalent_classes"), F.lit(0)) > 0
    return queries.filter(some), queries.filter(~some)


def query_targets(queries: DataFrame, single: bool = False) -> DataFrame:
    """(query_id, id, depth): the target, its parents and its ancestors; the target alone if single."""
    pick = lambda c: F.transform(c, lambda x: F.struct(x["iri"].alias("id"), x["depth"].alias("depth")))
    own = F.array(F.struct(F.col("target_entity.iri").alias("id"), F.col("target_entity.depth").alias("depth")))
    empty = F.slice(own, 1, 0)
    every = own if single else F.concat(own, F.coalesce(pick("parent_entities"), empty), F.coalesce(pick("ancestors"), empty))
    return queries.select(F.col("internal_id").alias("query_id"), F.explode(every).alias("t")).select("query_id", "t.id", "t.depth")


def with_literal(queries: DataFrame, column: str = "transformed") -> DataFrame:
    return queries.filter(F.coalesce(F.col(column), F.lit("")) != "")


def read_examples(spark: SparkSession, folder: str, splits: Iterable[str] = SPLITS, first_negative: bool = True) -> dict[str, DataFrame]:
    """Training examples (child, parent, negative array) by split; only the first negative is kept if asked."""
    out = {}
    for s in splits:
        df = read_jsonl(spark, f"{folder}/{s}.jsonl", "child string, parent string, negative array<string>")
        out[s] = df.withColumn("negative", F.slice("negative", 1, 1)) if first_negative else df
    return out


def read_dataset(spark: SparkSession, folder: str, names: DataFrame, negative: str = "random", shape: str = "triplet") -> dict[str, DataFrame]:
    """train, val and test, as far as they are there, of a downloaded hierarchy set: JSON lines (child, parent,
    random_negatives, hard_negatives) with ids in place of names.

    shape: triplet (child, parent, negative) or pair (child, parent, label) with names (id, name), or idx (idx) with
    numbers (name being the id as text, id its number). An id without a name is an error.
    """
    from taxolume.operators import sets as S

    if negative not in ("random", "hard") or shape not in ("triplet", "pair", "idx"):
        raise ValueError(f"no such negatives or shape: {negative}, {shape}")
    out = {}
    for split in ("train", "val", "test"):
        path = f"{folder}/{split}.jsonl"
        if not _exists(spark, path):
            continue
        ex = read_jsonl(spark, path, "child string, parent string, random_negatives array<string>, hard_negatives array<string>")
        ex = ex.select("child", "parent", F.coalesce(f"{negative}_negatives", F.expr("cast(array() as array<string>)")).alias("negatives"))
        if shape == "idx":
            out[split] = S.index_lists(ex, names)
            continue
        flat = S.triplets(ex) if shape == "triplet" else S.pairs(ex)
        by = names.select(F.col("id").cast("string").alias("id"), "name")
        for c in [c for c in flat.columns if c != "label"]:
            flat = S.lookup(flat, by, c, "_named").drop(c).withColumnRenamed("_named", c)
        out[split] = flat.select("child", "parent", *(["negative"] if shape == "triplet" else ["label"]))
    return out


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_rows_or_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(key, value) of a JSON file that is an array of values or an object of them: key is the object's key, or the place
    in the array from 0. value: the values' type."""
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    listed = F.transform(F.from_json("v", f"array<{value}>"), lambda x, i: F.struct(i.cast("string").alias("key"), x.alias("value")))
    every = F.when(F.startswith("v", F.lit("[")), listed).otherwise(F.map_entries(F.from_json("v", f"map<string,{value}>")))
    return whole.select(F.explode(every).alias("e")).select("e.key", "e.value")


def forms_from_npy(spark: SparkSession, folder: str) -> DataFrame:
    """(kind, row, first, second, third) of the integer files nf1.npy to nf4.npy that folder has; numbers are ids."""
    import os

    import numpy as np

    out = spark.createDataFrame([], FORMS)
    for n in range(1, 5):
        path = f"{folder}/nf{n}.npy"
        if os.path.exists(path):
            m = np.load(path, mmap_mode="r").reshape(-1, 2 if n == 1 else 3)
            out = out.union(spark.createDataFrame([(f"nf{n}", i, *map(int, r), *([None] if n == 1 else [])) for i, r in enumerate(m)], FORMS))
    return out


FORMS = "kind string, row long, first long, second long, third long"


def forms_to_npy(forms: DataFrame, folder: str, most_rows: int = 10_000_000) -> None:
    """The files nf1.npy to nf4.npy of forms (kind, first, second, third), ids in numbers, a kind at a time on the driver;
    an error for a kind beyond most_rows. Kinds without rows have no file."""
    import os

    import numpy as np

    os.makedirs(folder, exist_ok=True)
    for kind, width in (("nf1", 2), ("nf2", 3), ("nf3", 3), ("nf4", 3)):
        own = forms.filter(F.col("kind") == kind).select(*("first", "second", "third")[:width])
        n = own.limit(most_rows + 1).count()
        if n > most_rows:
            raise ValueError(f"{kind} has more than {most_rows} rows")
        if n:
            np.save(f"{folder}/{kind}.npy", own.orderBy(*own.columns).toPandas().to_numpy(np.int64))


def read_ntriples(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(s, s_kind, p, o, o_kind) of N-Triples lines, escapes decoded; comments and blank lines are skipped. A line that is
    no triple is an error when it is read; with strict off it gives a row of nulls but for o, the line, and o_kind
    'malformed'."""
    line = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"\S*)\s*\.\s*$'
    rows = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*(?:#.*)?$"))
    ok = F.col("value").rlike(line)
    part = lambda i: F.regexp_extract("value", line, i)
    kind = lambda c: F.when(F.startswith(c, F.lit("<")), "iri").when(F.startswith(c, F.lit("_:")), "bnode").otherwise("literal")
    text = lambda c: F.when(F.startswith(c, F.lit("<")), F.substring(c, F.lit(2), F.length(c) - 2)).when(F.startswith(c, F.lit('"')), F.regexp_extract(c, r'^"((?:[^"\\]|\\.)*)"', 1)).otherwise(c)
    wrong = F.raise_error(F.concat(F.lit("no triple: "), "value")).cast("string") if strict else F.lit("malformed")
    some = lambda c: F.when(ok, c)
    text_ = lambda i: _unescaped(text(part(i)))
    return rows.select(some(text_(1)).alias("s"), some(kind(part(1))).alias("s_kind"), some(_unescaped(part(2))).alias("p"), some(text_(3)).otherwise(F.col("value")).alias("o"), some(kind(part(3))).otherwise(wrong).alias("o_kind"))


def _unescaped(c: Column) -> Column:
    """A text with its escapes decoded: a letter after a backslash, four or eight hexadecimal digits after u or U."""
    pieces = F.regexp_extract_all(c, F.lit(r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+"), F.lit(0))
    code = lambda x: F.decode(F.unhex(F.lpad(F.substring(x, F.lit(3), F.length(x)), 8, "0")), "UTF-32")

    def plain(x: Column) -> Column:
        out = F.when(F.startswith(x, F.lit("\\")) & (F.length(x) == 2), F.substring(x, 2, 1)).otherwise(x)
        for letter, means in (("t", "\t"), ("b", "\b"), ("n", "\n"), ("r", "\r"), ("f", "\f")):
            out = F.when(x == F.lit("\\" + letter), F.lit(means)).otherwise(out)
        return F.when(x.rlike(r"^\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8})$"), code(x)).otherwise(out)

    return F.when(F.contains(c, F.lit("\\")), F.array_join(F.transform(pieces, plain), "")).otherwise(c)


def vectors_from_npy(spark: SparkSession, path: str, folder: str, model: str, rows_per_file: int = 50_000) -> None:
    """A float matrix file as Parquet (mapping_id, model, vec), a slice of its memory map at a time."""
    import numpy as np
    import pyarrow as pa

    m = np.load(path, mmap_mode="r")
    for lo in range(0, len(m), rows_per_file):
        part = np.ascontiguousarray(m[lo : lo + rows_per_file], dtype=np.float32)
        vec = pa.FixedSizeListArray.from_arrays(pa.array(part.ravel()), part.shape[1]).cast(pa.list_(pa.float32()))
        t = pa.table({"mapping_id": np.arange(lo, lo + len(part)), "model": [model] * len(part), "vec": vec})
        spark.createDataFrame(t).write.mode("overwrite" if lo == 0 else "append").parquet(folder)


def write_json(df: DataFrame, folder: str, by: str | None = None) -> None:
    """JSON lines, a folder for each value of `by` if given."""
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).json(folder)


def write_summary(payload: dict, path: str, indent: int = 4) -> None:
    """A small summary as one JSON document, written by the driver."""
    import json

    with open(path, "w", encoding="utf-8") as f:
        json.dump(payload, f, indent=indent)


def append_metrics(df: DataFrame, folder: str, sep: str = ",") -> None:
    """A CSV table with one header: the first file of the folder has it, those that are appended later have none."""
    first = not _exists(df.sparkSession, folder)
    df.coalesce(1).write.mode("append").option("header", first).option("sep", sep).csv(folder)


def read_metrics(spark: SparkSession, folder: str, schema: str | T.StructType, sep: str = ",") -> DataFrame:
    """The rows of an appended table. The header is the one line that has the columns' names."""
    shape = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    raw = spark.read.option("sep", sep).schema(T.StructType([T.StructField(f.name, T.StringType()) for f in shape.fields])).csv(folder)
    names = F.lit(True)
    for f in shape.fields:
        names = names & F.col(f"`{f.name}`").eqNullSafe(F.lit(f.name))
    return raw.filter(~names).select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in shape.fields])


def text_table(df: DataFrame, most_rows: int = 1000) -> str:
    """A small result as aligned text; an error beyond most_rows."""
    rows = [df.columns, *[[f"{v:.2f}" if isinstance(v, float) else str(v) for v in r] for r in _few(df, most_rows)]]
    width = [max(len(r[i]) for r in rows) for i in range(len(df.columns))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, width, strict=True)).rstrip() for r in rows)


def latex_table(df: DataFrame, most_rows: int = 1000) -> str:
    """A small result as a LaTeX tabular."""
    body = [" & ".join(f"{v:.2f}" if isinstance(v, float) else str(v).replace("_", r"\_").replace("&", r"\&") for v in r) + r" \\" for r in _few(df, most_rows)]
    head = " & ".join(c.replace("_", r"\_") for c in df.columns) + r" \\ \hline"
    return "\n".join([r"\begin{tabular}{" + "l" * len(df.columns) + "}", head, *body, r"\end{tabular}"])


def _few(df: DataFrame, most: int) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return rows
