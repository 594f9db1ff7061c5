"""Turtle documents as triples, read in blocks by Spark's own text reader, wherever the files are.

A file is cut into blocks at line ends. What a block's first line is part of depends on the blocks before it, but only a
long string can reach over a line end, so a block starts in one of three states. A first pass finds, for each state, the
state in which the block ends and whether a statement ends in it: a row a block, from which the driver follows the
states through each file. The second pass cuts the blocks into statements; the parts of one that reaches over several
blocks are put together by the block that it begins in. Then the statements of a block are parsed in their order, with the
prefixes that hold where it begins, which the driver follows likewise, and those declared in it so far.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolume.storage import Scratch

#: States at a line's start: between or inside statements, and inside a long string of either quote.
PLAIN, DOUBLE, SINGLE = 0, 1, 2
#: The namespaces that `compact` knows, and the predicates and types that the syntax stands for.
NAMESPACES = {"rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "owl": "http://www.w3.org/2002/07/owl#", "skos": "http://www.w3.org/2004/02/skos/core#", "xsd": "http://www.w3.org/2001/XMLSchema#"}
RDF = NAMESPACES["rdf"]
ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}

_PLAIN = re.compile(r"""#[^\n]*|<[^<>\s]*>|\"\"\"|'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|\.(?=[\s#<\[("']|$)""")
_CLOSE = {DOUBLE: re.compile(r'(?:[^"\\]|\\.|"(?!""))*"""', re.S), SINGLE: re.compile(r"(?:[^'\\]|\\.|'(?!''))*'''", re.S)}
_TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)|(?P<text>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')"""
    r"""|(?P<iri><[^<>\s]*>)|(?P<told>@prefix\b|@base\b|(?i:prefix|base)(?=\s))|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<type>\^\^)"""
    r"""|(?P<blank>_:[\w·-]+(?:\.+[\w·-]+)*)|(?P<number>[+-]?(?:\d+(?:\.\d*)?[eE][+-]?\d+|\.\d+[eE][+-]?\d+|\d*\.\d+|\d+))(?![\w:])"""
    r"""|(?P<name>(?:\w[\w-]*(?:\.+[\w-]+)*)?:(?:(?:[\w:%-]|\\.)(?:[\w:%·-]|\\.|\.+(?=[\w:%\\-]))*)?)|(?P<word>a(?=[\s<\[("'_])|true\b|false\b)|(?P<mark>[.;,\[\]()])""",
    re.S,
)


def ends(text: str, state: int) -> tuple[int, list[int]]:
    """The state after a text of whole lines, and the places where its statements end."""
    at, found = 0, []
    while at < len(text):
        if state == PLAIN:
            m = _PLAIN.search(text, at)
            if m is None:
                break
            at = m.end()
            if m[0] == ".":
                found.append(at)
            elif m[0] in ('"""', "'''"):
                state = DOUBLE if m[0] == '"""' else SINGLE
        else:
            m = _CLOSE[state].match(text, at)
            if m is None:
                break
            at, state = m.end(), PLAIN
    return state, found


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str]]:
    """Runs of lines of one block, in order, as ((file, start), text)."""
    for batch in batches:
        files, starts, lines = (batch.column(i).to_pylist() for i in range(3))
        first = 0
        for i in range(1, batch.num_rows + 1):
            if i == batch.num_rows or (files[i], starts[i]) != (files[first], starts[first]):
                yield (files[first], starts[first]), "\n".join(lines[first:i]) + "\n"
                first = i


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, from, to, ended) of each block and each state that it may start in."""
    held: dict[tuple[str, int], list[list]] = {}
    for block, text in _by_block(batches):
        for now in held.setdefault(block, [[s, False] for s in (PLAIN, DOUBLE, SINGLE)]):
            if now[0] == PLAIN and now[1] and '"""' not in text and "'''" not in text:
                continue
            now[0], found = ends(text, now[0])
            now[1] = now[1] or bool(found)
    rows = [(*block, s, to, ended) for block, own in held.items() for s, (to, ended) in enumerate(own)]
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "start", "from", "to", "ended"])


def _parts(known: dict[tuple[str, int], tuple[int, int]]):
    """(file, block, n, part, i, text): statements that begin and end in one block, by number n from 1, and the parts of
    others, as number 0 of the block that they begin in, each with its own block and its place i there. known: each
    block's state and that other block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, held, count, owner, i = None, PLAIN, "", 0, 0, 0
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "block", "n", "part", "i", "text"])
            rows.clear()
            return out

        for block, text in _by_block(batches):
            i += 1
            if block != now:
                if held:
                    rows.append((*now, 0, now[1], i, held))
                now, held, count = block, "", 0
                state, owner = known[block]
            state, found = ends(text, state)
            last = 0
            for at in found:
                whole, held, last = held + text[last:at], "", at
                count += 1
                # What ends first in a block began before it, unless it is the file's first.
                rows.append((block[0], owner, 0, block[1], i, whole) if count == 1 and owner >= 0 else (*block, count, 0, 0, whole))
            held += text[last:]
            if count == 0 and owner >= 0:  # all of the block so far is the middle of a statement
                rows.append((block[0], owner, 0, block[1], i, held))
                held = ""
            if len(rows) >= 10_000:
                yield flush()
        if held:
            rows.append((*now, 0, now[1], i + 1, held))
        if rows:
            yield flush()

    return run


def statements(spark: SparkSession, path: str, store: Scratch) -> DataFrame:
    """(file, block, n, text) of all statements, in the order of file, block and n."""
    lines = spark.read.option("lineSep", "\n").text(path).select("_metadata.file_path", "_metadata.file_block_start", "value")
    found = lines.mapInArrow(_states, "file string, start long, `from` int, `to` int, ended boolean").collect()  # three rows a block
    by: dict[str, dict[int, dict[int, tuple[int, bool]]]] = {}
    for r in found:
        by.setdefault(r["file"], {}).setdefault(r["start"], {})[r["from"]] = (r["to"], r["ended"])
    known: dict[tuple[str, int], tuple[int, int]] = {}
    for file, blocks in by.items():
        state, owner = PLAIN, -1  # -1: nothing is open
        for start in sorted(blocks):
            known[file, start] = (state, owner)
            state, ended = blocks[start][state]
            owner = start if ended or owner < 0 else owner
    parts = store.put(lines.mapInArrow(_parts(known), "file string, block long, n long, part long, i long, text string"))
    pieces = parts.filter("n = 0").groupBy("file", "block").agg(F.array_sort(F.collect_list(F.struct("part", "i", "text"))).alias("p"))
    whole = pieces.select("file", "block", F.lit(1 << 40).cast("long").alias("n"), F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))
    return parts.filter("n > 0").select("file", "block", "n", "text").unionByName(whole)


class _Parser:
    """The triples of one statement."""

    def __init__(self, text: str, prefixes: dict[str, str], base: str, place: str) -> None:
        self.text, self.prefixes, self.base, self.place = text, prefixes, base, place
        self.out: list[tuple[str, str, str, str, str]] = []
        self.made = 0
        self.tokens = [(m.lastgroup, m[0]) for m in self._all() if m.lastgroup != "skip"]
        self.at = 0

    def _all(self):
        at = 0
        while at < len(self.text):
            m = _TOKEN.match(self.text, at)
            if m is None:
                raise ValueError(f"no Turtle: {self.text[at : at + 40]!r}")
            at = m.end()
            yield m

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, mark: str | None = None) -> tuple[str, str]:
        got = self.peek()
        if mark is not None and got[1] != mark:
            raise ValueError(f"no Turtle: {mark} is missing in {self.text[:80]!r}")
        self.at += 1
        return got

    def fresh(self) -> tuple[str, str]:
        self.made += 1
        return f"_:{self.place}n{self.made}", "bnode"

    def iri(self, kind: str, token: str) -> str:
        if kind == "iri":
            return resolved(self.base, unescaped(token[1:-1]))
        prefix, local = token.split(":", 1)
        if prefix not in self.prefixes:
            raise ValueError(f"no Turtle: the prefix {prefix}: is not declared before {self.text[:80]!r}")
        return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)

    def node(self) -> tuple[str, str]:
        kind, token = self.take()
        if kind in ("iri", "name"):
            return self.iri(kind, token), "iri"
        if kind == "blank":
            return token, "bnode"
        if token == "[":
            own = self.fresh()
            if self.peek()[1] != "]":
                self.pairs(own)
            self.take("]")
            return own
        if token == "(":
            return self.members()
        if kind == "text":
            quote = 3 if token[:3] in ('"""', "'''") else 1
            if self.peek()[0] == "lang":
                self.take()
            elif self.peek()[0] == "type":
                self.take()
                self.take()
            return unescaped(token[quote:-quote]), "literal"
        if kind in ("number", "word") and token != "a":
            return token, "literal"
        raise ValueError(f"no Turtle: {token!r} in {self.text[:80]!r}")

    def members(self) -> tuple[str, str]:
        head: tuple[str, str] = (RDF + "nil", "iri")
        before = None
        while self.peek()[1] != ")":
            cell = self.fresh()
            if before is None:
                head = cell
            else:
                self.out.append((*before, RDF + "rest", *cell))
            self.out.append((*cell, RDF + "first", *self.node()))
            before = cell
        self.take(")")
        if before is not None:
            self.out.append((*before, RDF + "rest", RDF + "nil", "iri"))
        return head

    def pairs(self, subject: tuple[str, str]) -> None:
        while True:
            kind, token = self.take()
            predicate = RDF + "type" if token == "a" else self.iri(kind, token) if kind in ("iri", "name") else None
            if predicate is None:
                raise ValueError(f"no Turtle: {token!r} is no predicate in {self.text[:80]!r}")
            while True:
                self.out.append((*subject, predicate, *self.node()))
                if self.peek()[1] != ",":
                    break
                self.take()
            if self.peek()[1] != ";":
                return
            while self.peek()[1] == ";":
                self.take()
            if self.peek()[1] in (".", "]"):
                return

    def triples(self) -> list[tuple[str, str, str, str, str]]:
        if self.peek()[0] in ("told", "end"):
            return []
        bare = self.peek()[1] == "["
        subject = self.node()
        if not (bare and self.peek()[1] == "."):
            self.pairs(subject)
        self.take(".")
        return self.out


_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")


def resolved(base: str, iri: str) -> str:
    """An iri against a base; one with a scheme stands as it is, an empty fragment stays."""
    if not base or _SCHEME.match(iri):
        return iri
    return urljoin(base, iri) + "#" * (iri.endswith("#"))


def unescaped(text: str) -> str:
    if "\\" not in text:
        return text
    code = r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))"
    return re.sub(code, lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else ESCAPES.get(m[3], m[3]), text, flags=re.S)


_TOLD = re.compile(r"(?i)\s*(?:#[^\n]*\n\s*)*@?(prefix|base)\s")


def _declared(text: str) -> tuple[str, str] | None:
    """(prefix or @, namespace) of a declaration."""
    tokens = [(m.lastgroup, m[0]) for m in _TOKEN.finditer(text) if m.lastgroup != "skip"]
    if len(tokens) < 2 or tokens[0][0] != "told":
        return None
    base = tokens[0][1].lower().lstrip("@") == "base"
    return ("@", tokens[1][1][1:-1]) if base else (tokens[1][1][:-1], tokens[2][1][1:-1])


def _tell(env: dict[str, list[str]], prefix: str, namespace: str) -> None:
    """Adds a declaration to those of a block: by prefix (the base's is @), what its namespace is resolved through, from
    the base that holds where the block begins."""
    namespace = unescaped(namespace)
    env[prefix] = [namespace] if _SCHEME.match(namespace) else [*env.get("@", []), namespace]


def _through(base: str, steps: list[str]) -> str:
    for step in steps:
        base = resolved(base, step)
    return base


def _split_sparql(text: str) -> list[str]:
    """Declarations in SPARQL's style end without a full stop: they are cut off the statement that follows."""
    out = []
    while m := re.match(r"(?i)(?:\s+|#[^\n]*\n)*(?:prefix\s+[^\s:]*:\s*<[^<>\s]*>|base\s+<[^<>\s]*>)", text):
        out.append(m[0])
        text = text[m.end() :]
    return [*out, text]


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """(s, s_kind, p, o, o_kind) of a Turtle file or folder; a kind is iri, bnode or literal.

    Prefixes and bases hold from where they are declared to the end of their file. Escapes are decoded; languages and
    datatypes of literals are left out, as the N-Triples reader leaves them. Labels of blank nodes are those of the
    document, which a folder's files are parts of; other blank nodes and list cells are named by file and place. What is
    no Turtle is an error. Empty files give no rows. A statement is parsed by one task.
    """
    store = Scratch(spark, "turtle")
    rows = statements(spark, path, store).filter(F.col("text").rlike(r"[^\s]"))
    cut = rows.mapInArrow(_each, "file string, block long, n long, i int, text string")
    cut = store.put(cut)
    in_order = lambda df: df.repartition("file", "block").sortWithinPartitions("file", "block", "n", "i")
    told = in_order(cut.filter(F.col("text").rlike(_TOLD.pattern))).mapInArrow(_told, "file string, block long, prefix string, steps array<string>")
    by: dict[str, dict[int, list[tuple[str, list[str]]]]] = {}
    for r in told.collect():  # of each block, a row for each prefix that it declares
        by.setdefault(r["file"], {}).setdefault(r["block"], []).append((r["prefix"], r["steps"]))
    changes: dict[str, tuple[list[int], list[dict[str, str]]]] = {}
    for file, blocks in by.items():
        now, after = {}, []
        for block in sorted(blocks):
            new = now | {prefix: _through(now.get("@", ""), steps) for prefix, steps in blocks[block]}
            now = now if new == now else new  # one object as long as nothing changes
            after.append(now)
        changes[file] = (sorted(blocks), after)
    return in_order(cut).mapInArrow(_parsed(changes), "s string, s_kind string, p string, o string, o_kind string")


def _by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, int, str]]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True)


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, prefix, steps) of each block's declarations, the last of each prefix."""

    def made(now: tuple[str, int], env: dict[str, list[str]]) -> pa.RecordBatch:
        columns = [pa.array([now[0]] * len(env)), pa.array([now[1]] * len(env), pa.int64()), pa.array(list(env)), pa.array(list(env.values()), pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(columns, ["file", "block", "prefix", "steps"])

    now, env = None, {}
    for file, block, _, _, text in _by_row(batches):
        if (file, block) != now:
            if env:
                yield made(now, env)
            now, env = (file, block), {}
        if (d := _declared(text)) is not None:
            _tell(env, *d)
    if env:
        yield made(now, env)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(f, b, n, i, t) for f, b, n, text in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True) for i, t in enumerate(_split_sparql(text)) if t.strip()]
        if rows:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "block", "n", "i", "text"])


def _parsed(changes: dict[str, tuple[list[int], list[dict[str, str]]]]):
    """The triples of rows sorted by file, block and place. changes: of each file, the blocks that declare something, and
    what holds after each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        now, env, start, holds, out = None, {}, {}, {}, []
        for file, block, n, i, text in _by_row(batches):
            if (file, block) != now:
                blocks, after = changes.get(file, ([], []))
                at = bisect_left(blocks, block)
                now, env, start = (file, block), {}, after[at - 1] if at else {}
                holds = start
            if (d := _declared(text) if _TOLD.match(text) else None) is not None:
                _tell(env, *d)
                if holds.get(d[0]) != (namespace := _through(start.get("@", ""), env[d[0]])):
                    holds = holds | {d[0]: namespace}
            else:
                out += _Parser(text, holds, holds.get("@", ""), f"{zlib.crc32(file.encode()):08x}b{block}s{n}i{i}").triples()
            if len(out) >= 10_000:
                yield _triples(out)
                out = []
        if out:
            yield _triples(out)

    return run


def _triples(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["s", "s_kind", "p", "o", "o_kind"])


def compact(triples: DataFrame) -> DataFrame:
    """triples with iris of the known namespaces written with their prefix, as the operators on graphs read them."""

    def short(c: Column) -> Column:
        out = c
        for prefix, namespace in NAMESPACES.items():
            out = F.when(F.startswith(c, F.lit(namespace)), F.concat(F.lit(prefix + ":"), F.substring(c, F.lit(len(namespace) + 1), F.length(c)))).otherwise(out)
        return out

    by_kind = lambda c, kind: F.when(F.col(kind) == "iri", short(F.col(c))).otherwise(F.col(c)).alias(c)
    return triples.select(by_kind("s", "s_kind"), "s_kind", short(F.col("p")).alias("p"), by_kind("o", "o_kind"), "o_kind")
