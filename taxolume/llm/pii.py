"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust a score.

DataFrame expressions only. A kind's matches come from one extraction of the matches and one split of the text between
them, so offsets are sums of lengths in code points. Patterns are written so that a match is tried once for each run
of characters (possessive quantifiers, a look-behind at the start of a run), and arrays grow in blocks, so time is close
to linear in the text also where it is one run of digits or holds very many matches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    """A pattern, a text that each match has (so that texts without it are skipped), the score of a confirmed match
    before its surroundings are read, the words nearby that adjust it, and by how much."""

    name: str
    pattern: str
    needs: str
    score: float
    context: str
    boost: float = 0.1


#: Patterns and context words.
EMAIL = Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, r"(?i)\b(?:e-?mail|mail|contact|write)\b")
IP = Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, r"(?i)\b(?:ip|host|server|address|login)\b")
CARD = Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", 0.8, r"(?i)\b(?:card|visa|credit|debit|payment|pay)\b")
PHONE = Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.7, r"(?i)\b(?:phone|call|tel|mobile|fax|contact)\b")
IBAN = Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "", 0.6, r"(?i)\b(?:iban|account|bank|transfer)\b", 0.3)
SECRET = Kind("secret", r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+", "", 0.3, r"(?i)\b(?:tokens?|secrets?|passwords?|api[ _-]?keys?|keys?|bearer|credentials?)\b", 0.4)
#: In the order that breaks ties between spans of one start. Base spans always stay; added ones need THRESHOLD.
BASE, ADDED = (EMAIL, IP, CARD, PHONE), (IBAN, SECRET)
KINDS = tuple(k.name for k in BASE + ADDED)
THRESHOLD = 0.5
#: Code points on either side of a span, up to the neighbouring match of its kind, in which context words count.
WINDOW = 40
#: Spans in a block.
BLOCK = 128
SPAN = "struct<start:int,rank:int,end:int,kind:string,score:double>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(items: Column, state: Column, step: Callable[[Column, Column], Column], out: Callable[[Column, Column], Column], kind: str, opened: Callable[[Column, Column], Column] | None = None) -> Column:
    """struct<state, out>: out of each item in turn, as an array of `kind`, and the last state.

    step and out take the state and an item. Results grow in blocks, so that each is copied a few times only. opened:
    what a block of items and the state before it give, computed once a block; step and out then take a struct of that
    (as `open`) and the state (as `state`).
    """
    none = F.expr(f"cast(array() as array<{kind}>)")

    def block(a: Column, own: Column) -> Column:
        def inner(o: Column | None) -> Column:
            see = (lambda s: s) if o is None else (lambda s: F.struct(o.alias("open"), s.alias("state")))
            return F.aggregate(own, F.struct(a["state"].alias("state"), none.alias("out")), lambda b, x: F.struct(step(see(b["state"]), x).alias("state"), F.concat(b["out"], F.array(out(see(b["state"]), x))).alias("out")))

        done = inner(None) if opened is None else _let(opened(a["state"], own), inner)
        return _let(done, lambda d: F.struct(d["state"].alias("state"), F.concat(a["out"], F.array(d["out"])).alias("out")))

    def whole(held: Column) -> Column:
        n = F.size(held)
        blocks = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda i: F.slice(held, i * BLOCK + 1, BLOCK))).otherwise(F.array())
        return F.aggregate(blocks, F.struct(state.alias("state"), F.expr(f"cast(array() as array<array<{kind}>>)").alias("out")), block)

    return _let(_let(items, whole), lambda e: F.struct(e["state"].alias("state"), F.flatten(e["out"]).alias("out")))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check; doubled digits count by the sum of their digits."""
    n = F.length(digits)
    value = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces passes the mod-97 check: letters as 10 to 35, the first four characters last."""
    turned = F.concat(F.substring(iban, 5, 1000), F.substring(iban, 1, 4))
    value = F.transform(F.sequence(F.lit(1), F.length(turned)), lambda i: F.conv(F.substring(turned, i, F.lit(1)), 36, 10).cast("int"))
    return F.aggregate(value, F.lit(0), lambda a, x: F.pmod(a * F.when(x > 9, 100).otherwise(10) + x, F.lit(97))) == 1


def _confirmed(kind: str, s: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda x: x.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":  # the length is looked at first: a longer run has no sum taken
        return _let(_digits(s), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(s)).between(9, 15)
    if kind == "secret":  # letters and digits mixed, as in no word or number
        return s.rlike("[0-9]") & s.rlike("[A-Za-z]") & (F.length(_digits(s)) * 8 >= F.length(s))
    return _let(F.regexp_replace(s, " ", ""), lambda t: F.when(F.length(t).between(15, 34), mod97(t)).otherwise(False))


def _spans(kind: Kind, text: Column) -> Column:
    """array<SPAN> of the confirmed matches of a kind; offsets in code points."""
    none = F.expr(f"cast(array() as array<{SPAN}>)")

    def seen(found: Column, between: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            near = F.concat(F.right(F.get(between, i), F.lit(WINDOW)), F.lit(" "), F.left(F.get(between, i + 1), F.lit(WINDOW)))
            score = F.when(near.rlike(kind.context), F.lit(kind.score + kind.boost)).otherwise(F.lit(kind.score))
            return F.struct(F.length(F.get(between, i)).alias("g"), F.length(m).alias("n"), F.when(_confirmed(kind.name, m), score).alias("score"))

        placed = _running(
            F.transform(found, one),
            F.lit(0),
            lambda at, p: at + p["g"] + p["n"],
            lambda at, p: F.struct((at + p["g"]).alias("start"), F.lit(KINDS.index(kind.name)).alias("rank"), (at + p["g"] + p["n"]).alias("end"), F.lit(kind.name).alias("kind"), p["score"].alias("score")),
            SPAN,
        )["out"]
        return F.filter(placed, lambda x: x["score"] >= (0.0 if kind in BASE else THRESHOLD))

    may = F.contains(text, F.lit(kind.needs)) if kind.needs else F.lit(True)
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    full = _let(found, lambda f: F.when(F.size(f) == 0, none).otherwise(_let(F.split(text, kind.pattern, -1), lambda b: seen(f, b))))
    return F.when(may, full).otherwise(none)


def find_spans(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """docs with `out`: array<struct<start, rank, end, kind, score>> of all confirmed spans, by start, then kind.

    Matches of a kind are leftmost and do not overlap; those of different kinds may. A match that fails its check is
    dropped and its characters are not tried again. The score, 0 to 1, says how surely a span is personal data: its
    kind's value, raised where context words stand within `WINDOW` characters. Base kinds stay at any score; added ones
    (IBANs, secrets) only from `THRESHOLD` on, so that a secret needs its context. Null and empty texts have no spans.
    All rows and all other columns stay, repeated rows too; a column that has the name of the new one gives way to it.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.withColumn(out, F.array_sort(F.concat(*[_spans(k, body) for k in BASE + ADDED])))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda x: x["rank"] < len(BASE))


def redact(docs: DataFrame, text: str = "text", spans: str = "pii") -> DataFrame:
    """docs with each span's characters replaced by its kind in angle brackets; of overlapping spans the earliest names
    the place and the rest of a later one goes too. A null text stays null. The spans column is dropped."""
    body = F.col(f"`{text}`")
    done = _running(
        F.col(f"`{spans}`"),
        F.lit(0),
        lambda a, x: F.greatest(a["state"], x["end"]),
        # The text between is looked up in the block's own part of the text.
        lambda a, x: F.when(x["start"] >= a["state"], F.concat(F.substring(a["open"]["part"], a["state"] - a["open"]["at"] + 1, x["start"] - a["state"]), F.lit("<"), x["kind"], F.lit(">"))).otherwise(F.lit("")),
        "string",
        opened=lambda at, own: F.struct(at.alias("at"), F.substring(body, at + 1, F.greatest(F.array_max(F.transform(own, lambda x: x["end"])) - at, F.lit(0))).alias("part")),
    )
    changed = _let(done, lambda d: F.concat(F.array_join(d["out"], ""), F.substring(body, d["state"] + 1, F.length(body))))
    return docs.withColumn(text, F.when(F.size(F.col(f"`{spans}`")) > 0, changed).otherwise(body)).drop(spans)


def _sql() -> str:
    """The same rows; IBANs, whose pattern looks around itself, are left out: the test tables have none."""
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    doubled = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN (length({digits}) - i) % 2 = 0 THEN substring({digits}, i, 1)::INT WHEN substring({digits}, i, 1)::INT > 4 THEN 2 * substring({digits}, i, 1)::INT - 9 ELSE 2 * substring({digits}, i, 1)::INT END))"
    valid = {
        "email": "true",
        "ip": "coalesce(list_bool_and(list_transform(string_split(m, '.'), lambda x: coalesce(try_cast(x AS HUGEINT) <= 255, false))), false)",
        "card": f"CASE WHEN length({digits}) BETWEEN 12 AND 19 THEN {doubled} % 10 = 0 ELSE false END",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "secret": f"regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND length({digits}) * 8 >= length(m)",
    }
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "secret": r"[A-Za-z0-9_-]{20,}",
    }
    kinds = [k for k in BASE + ADDED if k.name in patterns]
    each = [
        f"""SELECT doc_id, '{k.name}' AS kind, {KINDS.index(k.name)} AS rank, m.m AS m, m.near AS near, m.pos AS pos, round(100 * ({k.score} + CASE WHEN regexp_matches(m.near, '{k.context}') THEN {k.boost} ELSE 0 END))::INT AS score FROM (
  SELECT doc_id, unnest(list_transform(range(1, len(f) + 1), lambda i: {{'m': f[i], 'near': right(g[i], {WINDOW}) || ' ' || left(g[i + 1], {WINDOW}), 'pos': list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0)}})) AS m
  FROM (SELECT doc_id, regexp_extract_all(s, '{patterns[k.name]}') AS f, string_split_regex(s, '{patterns[k.name]}') AS g FROM t))"""
        for k in kinds
    ]
    ok = " ".join(f"WHEN '{k.name}' THEN {valid[k.name]}" for k in kinds)
    added = ", ".join(f"'{k.name}'" for k in ADDED)
    base = ", ".join(f"'{k.name}'" for k in BASE)
    counts = ", ".join(f"count(*) FILTER (kind = '{k.name}') AS n_{k.name}" for k in BASE)
    listed = "string_agg(kind || ':' || pos::BIGINT || ':' || (pos + length(m))::BIGINT, ',' ORDER BY pos, rank)"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS s FROM documents), every AS (
{" UNION ALL ".join(each)}
), kept AS (SELECT * FROM every WHERE (CASE kind {ok} END) AND (kind NOT IN ({added}) OR score >= {round(100 * THRESHOLD)}))
SELECT t.doc_id, {counts}, sha256(coalesce({listed} FILTER (kind IN ({base})), '')) AS base_sha256, coalesce({listed} FILTER (kind IS NOT NULL), '') AS spans,
  coalesce(string_agg(score::VARCHAR, ',' ORDER BY pos, rank) FILTER (kind IS NOT NULL), '') AS scores
FROM t LEFT JOIN kept ON t.doc_id = kept.doc_id GROUP BY t.doc_id
"""


SQL = _sql()
