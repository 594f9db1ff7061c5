"""Grouping of spelling variants by an errata trie.

Two words are near if they differ by one inserted, deleted or replaced character. Where the paths of two near words part
in the trie of all words, at their longest common prefix x, the word below a light child differs from the other by a
skipped or replaced first character. So at each node only the light children's words, those outside the heaviest child,
are merged: with that character skipped into the node, and with it replaced, or the heavy child's put before it, into the
heavy child. Where two terminals coincide, the words are near, and each pair is found at one node, from one side. A word
lies below a light edge at most as often as the number of words can be halved.

Sorted words are cut at splitters into ranges, and a node that is no proper prefix of a splitter has all its words in one
range, whose task merges there. The few nodes above that, the splitters' prefixes, are merged by joins.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxolume.storage import Scratch, join_hot

from .common import releasing

#: Runs of letters, the modulus of occurrences that lose a character, the least length and number of a word.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
ERRATUM, LENGTH, OCCURRENCES = 97, 5, 3
#: Words of a range, about, and of the sample that its bounds are drawn from, as many a range.
RANGE, DRAWN = 200_000, 32
#: Characters of a splitter; words that agree in so many stay in one range.
SPLITTER = 64
#: Different words that a task counts before it hands them on.
COUNTED = 200_000
#: Words up to this length stand for themselves in joins, longer ones by their hash.
SHORT = 64


def occurrences(doc: str, text: str) -> Counter:
    """How often each word is read in a text: its runs, of which some lose a character by a rule of their own."""
    head, out = zlib.crc32(f"{doc}:".encode()), Counter()
    for run, n in Counter(RUN.findall(text.encode().lower().decode())).items():
        h = zlib.crc32(run.encode(), head)
        if h % ERRATUM == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= LENGTH:
            out[run] += n
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
        held.clear()
        return out

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            held.update(occurrences(doc or "", text.as_py() or ""))
            if len(held) >= COUNTED:
                yield flush()
    if held:
        yield flush()


def words(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = OCCURRENCES) -> DataFrame:
    """(word, n) of the words with `least` occurrences in all texts together. A null text has none; a null id reads as
    an empty text in the rule. Tasks add up their own words first, so a word of every text is a row a task."""
    rows = docs.select(F.col(f"`{key}`").cast("string").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(releasing(_counted), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def shared(a: str, b: str) -> int:
    """The length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid)
    return low


def probes(word: str, p: int, heavy: str | None) -> list[str]:
    """Words that a word below a light edge at depth p, or ending there, meets: with its character at p skipped, with
    the heavy child's in its place, and with that before it. None shares more than p characters with it in the trie."""
    x, rest = word[:p], word[p + 1 :]
    out = []
    if p < len(word):
        if rest[:1] != word[p]:
            out.append(x + rest)
        if heavy is not None:
            out.append(x + heavy + rest)
    if heavy is not None:
        out.append(x + heavy + word[p:])
    return out


def join_key(word: str) -> str:
    return word if len(word) <= SHORT else "#" + hashlib.md5(word.encode(), usedforsecurity=False).hexdigest()


def _join_key(word: Column) -> Column:
    return F.when(F.length(word) <= SHORT, word).otherwise(F.concat(F.lit("#"), F.md5(word.cast("binary"))))


class _Top:
    """The part of the trie above the ranges: for each proper prefix of a splitter, its heaviest child, counted in
    splitters, which are about equally many words apart."""

    def __init__(self, splitters: list[str]) -> None:
        self.splitters = splitters
        below: dict[str, Counter] = defaultdict(Counter)
        for s in splitters:
            for p in range(len(s)):
                below[s[:p]][s[p]] += 1
        self.heavy = {x: min(c, key=lambda a: (-c[a], a)) for x, c in below.items()}

    def light(self, word: str, at: int) -> Iterator[tuple[int, str]]:
        """(depth, heavy child) of the nodes above the ranges where a word of range `at` leaves the heavy path."""
        ends = [(shared(word, s), s) for s in self.splitters[max(0, at - 1) : at + 1]]
        if ends:
            m, s = max(ends)
            for p in range(min(m, len(s) - 1) + 1):
                heavy = self.heavy[s[:p]]
                if word[p : p + 1] != heavy:
                    yield p, heavy


def merge_range(found: list[tuple[str, int]], spans: Callable[[str], bool]) -> dict[str, list]:
    """For each of a range's sorted (word, n): [number of near words, (-n, word) of the first of them], as far as paths
    part at nodes that do not span ranges."""
    names, counts = [w for w, _ in found], dict(found)
    out: dict[str, list] = {w: [0, None] for w in names}

    def near(word: str, number: int, best: tuple[int, str]) -> None:
        own = out[word]
        own[0] += number
        if own[1] is None or best < own[1]:
            own[1] = best

    open_ = [(0, len(names))]
    while open_:
        lo, hi = open_.pop()
        if hi - lo < 2:
            continue
        p = shared(names[lo], names[hi - 1])
        x = names[lo][:p]
        children, at = [], lo + (len(names[lo]) == p)  # a word that ends at the node comes first
        while at < hi:
            after = bisect_left(names, x + chr(ord(names[at][p]) + 1), at, hi)
            children.append((at, after))
            at = after
        open_ += children
        if spans(x):
            continue
        big = max(children, key=lambda c: c[1] - c[0])
        heavy = names[big[0]][p]
        replaced: dict[str, list[str]] = defaultdict(list)
        for i in (*range(lo, big[0]), *range(big[1], hi)):
            w = names[i]
            for v in probes(w, p, heavy):
                if (n := counts.get(v)) is not None:
                    near(w, 1, (-n, v))
                    near(v, 1, (-counts[w], w))
            if p < len(w):
                replaced[w[p + 1 :]].append(w)
        for same in replaced.values():
            if len(same) > 1:
                first, second = sorted((-counts[w], w) for w in same)[:2]
                for w in same:
                    near(w, len(same) - 1, second if w == first[1] else first)
    return out


_ROWS = "kind string, word string, n long, near long, best_n long, best string, key string"


def _merged(top: _Top):
    def run(table: pa.Table) -> pa.Table:
        found = sorted(zip(table.column("word").to_pylist(), table.column("n").to_pylist(), strict=True))
        at = table.column("range")[0].as_py()
        ends = top.splitters[max(0, at - 1) : at + 1]
        own = merge_range(found, lambda x: any(len(s) > len(x) and s.startswith(x) for s in ends))
        rows = [("own", w, n, own[w][0], -own[w][1][0] if own[w][1] else None, own[w][1][1] if own[w][1] else None, None) for w, n in found]
        for w, n in found:
            for p, heavy in top.light(w, at):
                rows += [("probe", w, n, None, None, None, join_key(v)) for v in probes(w, p, heavy)]
                if p < len(w):
                    rows.append(("replaced", w, n, None, None, None, f"{p}:{join_key(w[:p])}:{join_key(w[p + 1:])}"))
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = ["kind", "word", "n", "near", "best_n", "best", "key"]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def near_words(found: DataFrame, store: Scratch, range_: int = RANGE) -> DataFrame:
    """(word, n, n_near, best_n, best) of each of found (word, n): how many others differ from it by one character, and
    the one of largest n among them, of equal ones the first in code-point order.

    Bounds of ranges come from DRAWN words a range, chosen by hash, which reach the driver; they decide where a pair is
    looked for, not whether it is found.
    """
    total = found.count()
    ranges = max(1, math.ceil(total / range_))
    cut = []
    if ranges > 1:
        drawn = found.select(F.substring("word", 1, SPLITTER).alias("w"), F.xxhash64("word").alias("h")).orderBy("h").limit(DRAWN * ranges).collect()
        drawn = sorted(r["w"] for r in drawn)
        cut = sorted({drawn[len(drawn) * i // ranges] for i in range(1, ranges)})
    top = _Top(cut)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [bisect_right(cut, w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *batch.columns], ["range", "word", "n"])

    rows = store.put(found.select("word", "n").mapInArrow(placed, "range int, word string, n long").groupBy("range").applyInArrow(_merged(top), _ROWS))
    keyed = found.select(_join_key(F.col("word")).alias("key"), F.col("word").alias("v"), F.col("n").alias("m"))
    met = rows.filter("kind = 'probe'").select("key", "word", "n").join(keyed, "key")
    both = F.array(F.struct(F.col("word").alias("word"), F.col("m").alias("best_n"), F.col("v").alias("best")), F.struct(F.col("v").alias("word"), F.col("n").alias("best_n"), F.col("word").alias("best")))
    met = met.select(F.explode(both).alias("r")).select("r.*", F.lit(1).cast("long").alias("near"))
    # Words that agree but for the character at one place: at most as many as there are characters.
    same = rows.filter("kind = 'replaced'").groupBy("key").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "word"))).alias("a")).filter(F.size("a") > 1)
    other = F.when(F.col("i") == 0, F.col("a")[1]).otherwise(F.col("a")[0])
    same = same.select("a", F.posexplode("a").alias("i", "w")).select("w.word", (F.size("a") - 1).cast("long").alias("near"), other.alias("o")).select("word", (-F.col("o.n")).alias("best_n"), F.col("o.word").alias("best"), "near")
    every = rows.filter("kind = 'own'").select("word", "n", "near", "best_n", "best")
    for more in (met, same):
        every = every.unionByName(more, allowMissingColumns=True)
    first = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))).alias("b")
    out = every.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), first)
    return out.select("word", "n", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def roots(forms: DataFrame, store: Scratch) -> DataFrame:
    """(word, root): where following forms (word, form) ends. Pointers double each round; a form has at least twice its
    word's n, so chains are short and have no cycles."""
    at = store.put(forms.select("word", F.col("form").alias("to")))
    while True:
        # Many words may point to one: its row goes to parts of them.
        step = join_hot(at, at.select(F.col("word").alias("to"), F.col("to").alias("next")), "to", F.xxhash64("word"), how="left")
        after = store.put(step.select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        store.drop(at)
        if after.filter("moved").isEmpty():
            return after.select("word", F.col("to").alias("root"))
        at = store.put(after.select("word", "to"))
        store.drop(after)


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", range_: int = RANGE) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of the texts.

    form: the near word of largest n, if that is at least twice the word's own, else null; of equal ones the first in
    code-point order. root: the last word that following forms leads to, the word itself without a form. Null and empty
    texts have no words, repeated rows count each, a very long text is read by one task and a very long word is one row.
    Other columns are ignored; an empty table gives no rows.
    """
    store = Scratch(docs.sparkSession, "spelling")
    found = store.put(words(docs, key, text))
    best = near_words(found, store, range_)
    well = F.col("best_n") >= 2 * F.col("n")
    out = store.put(best.select("word", "n", "n_near", F.when(well, F.col("best")).alias("form"), F.when(well, F.col("best_n")).alias("form_n")))
    ends = roots(out.filter("form is not null"), store)
    return out.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i))
), run AS (
  SELECT doc_id, w, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents)
  GROUP BY doc_id, w
), bytes AS (
  SELECT w, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c) >> 6)::BIGINT, 128 + (unicode(c) & 63)::BIGINT] END)) AS b FROM run
), hashed AS (
  SELECT w, n, xor(list_reduce(list_prepend(4294967295, b), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc
), word AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, n FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), less AS (
  SELECT word, n, k, substr(word, 1, k) AS a, substr(word, k + 2) AS b FROM (SELECT word, n, unnest(range(length(word))) AS k FROM word)
), met AS (
  SELECT l.word, v.word AS other FROM less l JOIN word v ON v.word = l.a || l.b
  UNION SELECT v.word, l.word FROM less l JOIN word v ON v.word = l.a || l.b
  UNION SELECT x.word, y.word FROM less x JOIN less y ON x.k = y.k AND x.a = y.a AND x.b = y.b AND x.word <> y.word
), best AS (
  SELECT m.word, count(*) AS n_near, min({'n': -v.n, 'word': v.word}) AS o FROM met m JOIN word v ON v.word = m.other GROUP BY m.word
), form AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -o.n >= 2 * w.n THEN o.word END AS form, CASE WHEN -o.n >= 2 * w.n THEN -o.n END AS form_n FROM word w LEFT JOIN best b ON b.word = w.word
), chain AS (
  SELECT word, word AS at FROM form UNION ALL SELECT c.word, f.form FROM chain c JOIN form f ON f.word = c.at WHERE f.form IS NOT NULL
)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, c.at AS root FROM form f JOIN chain c ON c.word = f.word JOIN form e ON e.word = c.at AND e.form IS NULL
"""
