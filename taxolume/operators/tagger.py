"""Entity tagging by a dictionary and by patterns, as a function of DataFrames and as a table function of SQL.

The dictionary is an Aho-Corasick automaton over its lower-cased entries: one pass over a text finds all of them, however
many there are. It is sent to the tasks once, after its size was checked, and made once in each Python worker; a larger
dictionary is looked up by a join. Every row of a table is tagged by itself.
"""

from __future__ import annotations

import hashlib
import re
import sys
import types
import unicodedata
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from taxolume.storage import Scratch

#: Bytes of a dictionary up to which it is sent to the tasks; an automaton holds some fifty times as many.
DICTIONARY_BYTES = 8 << 20
#: Entities that a task holds and sends on at a time.
MOST_SPANS = 10_000
#: Words of an entry, at most; longer ones are never found.
MOST_WORDS = 4
#: Fixed value: a word is a run of letters, digits, hyphens and apostrophes.
WORD = r"[\p{L}\p{N}'-]+"
SPANS = ("entity_literal", "start_position", "end_position", "entity_type")


def lower(text: str) -> str:
    """text in lower case, character by character, so that positions stay: a character whose lower case has several
    counts as its own."""
    out = text.lower()
    return out if len(out) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _in_word(c: str) -> bool:
    return c in "'-" or unicodedata.category(c)[0] in "LN"


class Tagger:
    """Entries (word, entity_type) and patterns (regular expression, entity_type). Of equal entries the first type in
    order counts. A pattern's matches are entities as they stand; empty ones are not."""

    def __init__(self, entries: Sequence[tuple[str, str]], patterns: Sequence[tuple[str, str]] = (), most_words: int = MOST_WORDS) -> None:
        self.most = most_words
        self.patterns = [(re.compile(p), kind) for p, kind in patterns]
        kinds: dict[str, str] = {}
        for word, kind in entries:
            if word and (word := lower(word)) and (word not in kinds or kind < kinds[word]):
                kinds[word] = kind
        self.automaton = ahocorasick.Automaton()
        for word, kind in kinds.items():
            # Entries begin and end with a word and have few of them; others cannot be met.
            inner = [c for c in range(1, len(word)) if _in_word(word[c]) and not _in_word(word[c - 1])]
            if _in_word(word[0]) and _in_word(word[-1]) and len(inner) < most_words:
                self.automaton.add_word(word, (len(word), kind))
        if len(self.automaton):
            self.automaton.make_automaton()

    def tag(self, text: str | None) -> list[tuple[str, int, int, str]]:
        """(literal, start, end, type), by start: of those that begin at one place the longest, none inside another."""
        if not text:
            return []
        found = [(m.start(), -m.end(), kind) for p, kind in self.patterns for m in p.finditer(text) if m.end() > m.start()]
        if len(self.automaton):
            low, n = lower(text), len(text)
            for end, (size, kind) in self.automaton.iter(low):
                start, end = end + 1 - size, end + 1
                if (start == 0 or not _in_word(text[start - 1])) and (end == n or not _in_word(text[end])):
                    found.append((start, -end, kind))
        out, far = [], 0
        for start, end, kind in sorted(found):
            if -end > far:
                far = -end
                out.append((text[start:far], start, far, kind))
        return out


def _made(told, digest: str) -> Tagger:
    """The automaton of a broadcast dictionary, made once in a worker."""
    held = sys.modules.setdefault("_taggers", types.ModuleType("_taggers")).__dict__.setdefault("held", {})
    if digest not in held:
        held.clear()
        held[digest] = Tagger(*told.value)
    return held[digest]


def _told(words: DataFrame, patterns, most_words: int):
    """(broadcast, digest) of a dictionary, or None if it is too large."""
    size = words.agg(F.sum(F.octet_length("word") + F.octet_length("entity_type"))).first()[0] or 0
    if size > DICTIONARY_BYTES:
        return None
    entries = sorted((r["word"], r["entity_type"]) for r in words.select("word", "entity_type").dropna().distinct().collect())
    return words.sparkSession.sparkContext.broadcast((entries, list(patterns), most_words)), hashlib.sha256(repr((entries, list(patterns), most_words)).encode()).hexdigest()


def _tagged(told, digest: str, text: int):
    """Of batches, each row's other columns as often as it has entities, beside these. What goes out at a time has about
    MOST_SPANS entities, and never the texts, which would come once for each entity."""

    def made(batch: pa.RecordBatch, rows: list[int], spans: list[tuple[str, int, int, str]]) -> pa.RecordBatch:
        kept = batch.select([i for i in range(batch.num_columns) if i != text]).take(pa.array(rows, pa.int64()))
        out = [pa.array([s[j] for s in spans], kind) for j, kind in enumerate((pa.string(), pa.int32(), pa.int32(), pa.string()))]
        return pa.RecordBatch.from_arrays([*kept.columns, *out], [*kept.schema.names, *SPANS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tagger, rows, spans = _made(told, digest), [], []
            for i, t in enumerate(batch.column(text)):
                for span in tagger.tag(t.as_py()):
                    rows.append(i)
                    spans.append(span)
                    if len(rows) == MOST_SPANS:
                        yield made(batch, rows, spans)
                        rows, spans = [], []
            yield made(batch, rows, spans)

    return run


def tag_spans(docs: DataFrame, words: DataFrame, text: str = "text", key: str = "doc_id", most_words: int = MOST_WORDS, patterns: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """(key, entity_literal, start_position, end_position, entity_type): runs of up to most_words words that are in a
    dictionary (word, entity_type), in any case, and matches of patterns (regular expression, entity_type).

    Of entities that begin at one place the longest counts, of equal ones the first type; one inside another does not.
    Positions are code points. Each row is tagged by itself, so rows may share a key or have none. A null or empty text
    has no entities. A dictionary of more than DICTIONARY_BYTES is looked up by a join.
    """
    made = _told(words, patterns, most_words)
    if made is None:
        if patterns:
            raise ValueError("patterns go with a dictionary that is sent to the tasks")
        return _by_join(docs, words, text, key, most_words)
    run = _tagged(*made, 1)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t"))
    found = rows.mapInArrow(run, f"k {kind}, entity_literal string, start_position int, end_position int, entity_type string")
    return found.select(F.col("k").alias(key), *SPANS)


def _by_join(docs: DataFrame, words: DataFrame, text: str, key: str, most_words: int) -> DataFrame:
    """tag_spans for a dictionary of any size: words and gaps of each row come from one split, runs are looked up."""
    store = Scratch(docs.sparkSession, "tagging")
    body = F.coalesce(F.col("t"), F.lit(""))
    found, gaps = F.regexp_extract_all(body, F.lit(WORD), F.lit(0)), F.split(body, WORD, -1)
    own = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t"))
    own = own.select(F.monotonically_increasing_id().alias("row"), "k", "t")
    rows = store.put(own.select("row", "k", F.posexplode(F.arrays_zip(found.alias("w"), F.slice(gaps, 1, F.size(found)).alias("g"))).alias("i", "p")))
    upto = Window.partitionBy("row").orderBy("i")
    rows = rows.select("row", "k", "i", F.col("p.w").alias("w"), F.col("p.g").alias("g"))
    rows = rows.withColumn("end", F.sum(F.length("g") + F.length("w")).over(upto)).withColumn("start", F.col("end") - F.length("w"))
    rows = rows.withColumn("next", F.collect_list(F.struct("w", "g", "end")).over(upto.rowsBetween(0, most_words - 1)))
    run = lambda n: F.array_join(F.transform(F.slice("next", 1, n), lambda x, j: F.when(j == 0, x["w"]).otherwise(F.concat(x["g"], x["w"]))), "")
    every = rows.withColumn("n", F.explode(F.sequence(F.lit(1), F.size("next")))).select("row", "k", "start", F.element_at("next", F.col("n"))["end"].alias("end"), run(F.col("n")).alias("entity_literal"))
    known = words.select(F.lower("word").alias("_w"), "entity_type").groupBy("_w").agg(F.min("entity_type").alias("entity_type"))
    met = every.withColumn("_w", F.lower("entity_literal")).join(known, "_w")
    before = Window.partitionBy("row").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    kept = met.withColumn("_far", F.coalesce(F.max("end").over(before), F.lit(0))).filter(F.col("end") > F.col("_far"))
    return kept.select(F.col("k").alias(key), "entity_literal", F.col("start").cast("int").alias("start_position"), F.col("end").cast("int").alias("end_position"), "entity_type")


def register(spark: SparkSession, name: str, words: DataFrame, patterns: Sequence[tuple[str, str]] = (), most_words: int = MOST_WORDS) -> None:
    """Makes `SELECT * FROM name(TABLE(...))` tag the column `text` of a table: its columns come back beside those of
    SPANS, a row for each entity. An error if the dictionary is too large to be sent, the table has no text, or it has a
    column of the same name."""
    made = _told(words, patterns, most_words)
    if made is None:
        raise ValueError(f"the dictionary has more than {DICTIONARY_BYTES} bytes")
    told, digest = made

    class Table:
        @staticmethod
        def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable:
                raise ValueError(f"{name} takes a table")
            have = {f.name: f.dataType for f in rows.dataType.fields}
            if not isinstance(have.get("text"), StringType):
                raise ValueError(f"{name} takes a table with a column text of strings")
            if clash := [c for c in SPANS if c in have]:
                raise ValueError(f"{name} adds columns that the table has: {', '.join(clash)}")
            new = [StructField(c, StringType() if k in (0, 3) else IntegerType()) for k, c in enumerate(SPANS)]
            return AnalyzeResult(StructType([*rows.dataType.fields, *new]))

        def eval(self, row: Row) -> Iterator[tuple]:
            for span in _made(told, digest).tag(row["text"]):
                yield (*row, *span)

    # Batches travel as Arrow; functions of whole Arrow batches cannot analyse their table's columns yet.
    spark.udtf.register(name, F.udtf(Table, useArrow=True))
