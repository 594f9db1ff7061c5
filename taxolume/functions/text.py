"""Scalar functions over labels, mentions, options and identifiers, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words without weight in lexical comparisons.
STOPWORDS = (
    "the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "with", "without", "from",
    "by", "at", "as", "is", "are", "was", "were", "be", "been", "being", "that", "which",
    "this", "these", "those", "it", "its", "their", "there", "then", "than", "such",
)
#: Labels of concepts too broad to inform a question.
BROAD = (
    "clinical finding", "finding", "disease", "disorder", "procedure", "event", "body structure", "organism",
    "substance", "situation with explicit context", "qualifier value", "morphologic abnormality",
)
#: Roman numerals that stay whole when camel case is split.
ROMAN = ("II", "III", "IV", "V", "VI", "VII", "VIII", "IX")
#: Fixed value: options that depend on each other or on their order.
DEPENDENT = r"(?i)(all of the above|none of the above|neither|both|option\s+[A-F]|answers?\s+[A-F])"
#: Fixed value: Unicode's white space and the separators U+001C to U+001F, as a class of characters.
SPACES = "\\t-\\r\\x1c-\\x20\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: the label of what has no name.
TOP_LABEL = "owl:Thing"
NO_NUMBER = 9223372036854775807


def strip_parens(s: Column) -> Column:
    """s without parenthesised parts and the white space before them."""
    return F.regexp_replace(s, r"\s*\([^)]*\)", "")


def tokenise(s: Column) -> Column:
    """Lower-cased runs of other characters than white space, of which Unicode has more than ASCII."""
    return F.filter(F.split(F.lower(s), f"[{SPACES}]+"), lambda x: x != "")


def verbalisation(name: Column) -> Column:
    return F.lower(strip_parens(name))


def lexicon_name(label: Column, lower: bool = True, strip: bool = True) -> Column:
    """The name of a raw lexicon entry: its first label, stripped of parentheses and then lower-cased if asked; an
    entry without labels is the top. Lower-casing happens only together with stripping."""
    first = F.try_element_at(label, F.lit(1))
    out = (F.lower(strip_parens(first)) if lower else strip_parens(first)) if strip else first
    return F.coalesce(out, F.lit(TOP_LABEL))


def normalise_mention(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))


def content_words(s: Column) -> Column:
    """The distinct runs of a-z of lower-cased s that are not stop words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(s), F.lit("[a-z]+"), F.lit(0)))
    return F.array_except(words, F.array(*[F.lit(w) for w in STOPWORDS]))


def overlap(s: Column, reference: Column) -> Column:
    """How many content words of s are in the array `reference`."""
    return F.size(F.array_intersect(content_words(s), reference))


def is_broad(label: Column) -> Column:
    return F.lower(F.substring_index(label, " (", 1)).isin(*BROAD)


def numeric_key(iri: Column) -> Column:
    """struct<number, iri> to sort identifiers by their trailing number, those without one last."""
    digits = F.nullif(F.regexp_extract(iri, r"(\d+)$", 1), F.lit(""))
    return F.struct(F.coalesce(digits.try_cast("bigint"), F.lit(NO_NUMBER)).alias("number"), iri.alias("iri"))


def number_of(iri: Column, required: bool = True) -> Column:
    """The trailing digits of iri; without any an error, or null if not required."""
    digits = F.nullif(F.regexp_extract(iri, r"(\d+)$", 1), F.lit(""))
    if not required:
        return digits
    return F.when(digits.isNotNull(), digits).otherwise(F.raise_error(F.concat(F.lit("no trailing number: "), iri)))


def basename(iri: Column) -> Column:
    return F.element_at(F.split(iri, "/"), -1)


def release_version(s: Column) -> Column:
    return F.regexp_extract(s, r"(\d{8})(?=T)", 1)


def split_camel(phrase: Column) -> Column:
    """Words of a camel-case name. Runs of capitals give their last one to the next word, Roman numerals stay."""
    parts = F.regexp_extract_all(F.element_at(F.split(phrase, "#"), -1), F.lit("[A-Z]+|[^A-Z]+"), F.lit(0))
    last = lambda p: F.substring(p, -1, 1)
    body = lambda p: F.substring(p, F.lit(1), F.length(p) - 1)

    def words(p: Column) -> Column:
        several = (F.size(parts) > 1) & ~p.isin(*ROMAN)
        upper = F.when(F.length(p) == 1, F.lower(p)).when(several, F.concat(body(p), F.lit(" "), F.lower(last(p)))).otherwise(p)
        return F.when(last(p).rlike("[A-Z]"), upper).otherwise(F.concat(p, F.lit(" ")))

    return F.trim(F.array_join(F.transform(parts, words), ""))


def option_letters(options: Column) -> Column:
    return F.array_join(F.transform(options, lambda o: o["letter"]), ",")


def option_lines(options: Column) -> Column:
    return F.array_join(F.transform(options, lambda o: F.concat(o["letter"], F.lit(". "), o["text"])), "\n")


def options_depend(options: Column) -> Column:
    return F.exists(options, lambda o: F.coalesce(o["text"], F.lit("")).rlike(DEPENDENT))


def answer_letter(text: Column, letters: Column) -> Column:
    """The first capital that stands alone, if it is one of letters; else null."""
    found = F.regexp_extract(text, r"\b([A-Z])\b", 1)
    return F.when(F.array_contains(letters, found), found)


def signature(*fields: str, schema: T.StructType | None = None) -> Column:
    """A canonical text of columns, independent of the order in which they are named; with their schema, also of the
    order of fields in nested structs and of keys in maps."""
    known = {f.name: f.dataType for f in schema.fields} if schema is not None else {}
    return F.to_json(F.struct(*[_sorted(F.col(f), known.get(f)).alias(f) for f in sorted(fields)]), {"ignoreNullFields": "false"})


def _sorted(c: Column, kind: T.DataType | None) -> Column:
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_sorted(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _sorted(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(e["key"].alias("key"), _sorted(e["value"], kind.valueType).alias("value"))))
    return c


def stable_order(key: Column, seed: int | str) -> Column:
    """A text that sorts keys in an order fixed by the seed, the same in any engine with MD5."""
    return F.md5(F.concat(F.lit(str(seed)), F.lit(":"), key.cast("string")))


def question_seed(dataset: Column, question_id: Column) -> Column:
    """An unsigned 32-bit seed of a question, the same in every process."""
    return F.conv(F.substring(F.md5(F.concat(dataset, F.lit("|"), question_id.cast("string"))), 1, 8), 16, 10).cast("long")


def percentage(part: Column, whole: Column) -> Column:
    """100 * part / whole with two decimals, without trailing zeros, as text."""
    shown = F.format_string("%.2f", F.lit(100.0) * part / whole)
    return F.regexp_replace(F.regexp_replace(shown, "0+$", ""), r"\.$", "")


def contains_any(text: Column, words: Sequence[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def is_long(s: Column, least: int = 6) -> Column:
    return F.length(s) >= least


def isotime(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
