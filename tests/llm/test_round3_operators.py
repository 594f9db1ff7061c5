"""Spelling variants, line deduplication and whitening against brute force; packing and links on hard inputs."""

import hashlib
import re
import string
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxolume.llm import line_dedup, packing, spelling, url_filter, whitening
from taxolume.storage import Scratch


def plain_words(docs):
    """(word: n) by the rule of the contract, a character at a time."""
    fold = {c: c.lower() for c in string.ascii_uppercase}
    out = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(fold.get(c, c) for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w in counts:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 2 * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (counts[w], len(near[w]), form[w], counts.get(form[w]), root)
    return out


@pytest.mark.parametrize("range_", [spelling.RANGE, 7, 2])
def test_variants_by_brute_force(spark, range_):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("aabbcé"), rng.integers(4, 8))) for _ in range(150)] + ["aaaaa", "aaaaaa", "aaaaaaa", "abcab" * 20, "abcab" * 20 + "c", "bcab" * 30]
    docs = [(i, " ".join(rng.choice(words, 120))) for i in range(30)] + [(None, "aaaaa AAAAA aaaaa, aaaaaa"), (5, None), (6, ""), (200, "zzzzz " * 30 + "zzzzy " * 12 + "zzzxy " * 4), (7, "a b c, 12 ÄBCDEé×÷ " * 3), (7, "a b c, 12 ÄBCDEé×÷ " * 3)]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"word": F.lit("x"), "n": F.lit(1), "root": F.lit(2)})
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(table, range_=range_).collect()}
    want = plain_variants(plain_words(docs))
    assert got == want and len(want) > 100 and any(v[4] != v[2] and v[2] for v in want.values())
    assert spelling.variants(table.limit(0)).count() == 0


def test_chains_of_forms_and_hubs(spark):
    """Roots over several forms; a hub with many near words."""
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(20)] + [(f"h{i}", "w0") for i in range(3000)], "word string, form string")
    got = {r.word: r.root for r in spelling.roots(forms, Scratch(spark, "t")).collect()}
    assert len(got) == 3020 and set(got.values()) == {"w20"}


def plain_lines(docs):
    first, key = {}, lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    order = lambda i: (i is None, i or 0)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                first[key(line)] = min(first.get(key(line), order(i)), order(i))
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if first.get(key(x), order(i)) == order(i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("partitions", [1, 4, 23])
def test_lines_by_brute_force(spark, partitions):
    """Among them a line of all documents, which fills several ranges, repeats within a document, and shared ids."""
    rng = np.random.default_rng(5)
    pool = ["the common line of all", " The COMMON line of all\t", "short", "ten chars!", "nine char", "ééééééééé", "éééééééééé", "", "\x0b\x0c another common line \r", "İstanbul is a city"]
    docs = [(int(i), "\n".join(rng.choice(pool, rng.integers(1, 9)).tolist() + [f"a line of {i % 40} alone"])) for i in range(300)]
    docs += [(3, "the common line of all"), (None, "the common line of all\nonly here, nowhere else"), (None, "only here, nowhere else"), (400, None), (401, ""), (402, "\n\n"), (403, "x" * 200_000), (404, "x" * 200_000), (405, "the common line of all\n" * 5_000), (7, docs[7][1])]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"id": F.lit(1), "row": F.lit(2), "keep": F.lit("k"), "pos": F.lit(0)})
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = line_dedup.drop_repeats(table).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("s"))
        assert sorted((tuple(r) for r in out.collect()), key=repr) == plain_lines(docs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    maps = {(r.id, r.n_lines): r for r in line_dedup.keep_bitmaps(table).collect()}
    for (_, n), r in maps.items():
        assert len(line_dedup.kept_positions(r.keep, n)) == n - r.n_dropped
    assert len(maps[405, 5001].keep) < 100  # 5,001 lines in a few bytes
    assert line_dedup.keep_bitmaps(table.limit(0)).count() == 0 and line_dedup.drop_repeats(table.limit(0)).count() == 0


def plain_whitening(rows, k=4):
    x = {i: np.floor(np.array(v, float) * 256).astype(np.int64) for i, v in rows}
    fit = np.unique(np.array(list(x.values())), axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    return x, n, s, e[::-1][:k], u[:, ::-1][:, :k], e.sum()


@pytest.mark.parametrize("d,block", [(8, 4), (40, 4), (40, 6), (40, 32), (40, 64)])
def test_whitening_by_brute_force(spark, d, block):
    rng = np.random.default_rng(d)
    m = rng.standard_normal((400, d)) @ np.diag(np.linspace(0.2, 1.5, d)) + 0.3
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(1000 + i, m[0].tolist()) for i in range(300)]
    odd = [(2000, None), (2001, [None] * d), (2002, [float("nan")] * d), (2003, [float("inf")] * d)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumns({"id": F.lit(1), "component": F.lit("c"), "x": F.lit(0)})
    x, n, s, e, u, trace = plain_whitening(rows)
    out = whitening.whiten(table, block=block).collect()
    assert len(out) == 4 * len(rows) and {r.n for r in out} == {n} == {400}
    sign = {}
    for r in out:
        c = r.component - 1
        want = float((x[r.vec_id] - s / n) @ u[:, c] / np.sqrt(e[c]))
        if abs(want) > 0.1:
            sign.setdefault(c, np.sign(want * r.whitened))
        assert r.deviation == int(((n * x[r.vec_id] - s) ** 2).sum()) and r.explained == pytest.approx(e[c] / trace, rel=1e-10) and r.identity_error < 1e-9
    assert all(abs(r.whitened * sign[r.component - 1] - float((x[r.vec_id] - s / n) @ u[:, r.component - 1] / np.sqrt(e[r.component - 1]))) < 1e-8 for r in out)


def test_whitening_of_little(spark):
    make = lambda rows: whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert make([]).count() == 0 and make([(1, [0.5, 0.5])]).count() == 0 and make([(1, [0.5, 0.5]), (2, [0.5, 0.5])]).count() == 0 and make([(1, [])]).count() == 0
    two = make([(1, [0.0, 1.0]), (2, [1.0, 1.0]), (None, [1.0]), (2, [1.0, 1.0])]).collect()  # a shorter vector ends in zeros
    assert len(two) == 8 and {r.n for r in two} == {3}
    far = make([(1, [1e15, 0.0]), (2, [-1e15, 1.0])]).collect()
    assert len(far) == 2 and {r.deviation for r in far} == {None}  # beyond 64 bits
    store = Scratch(spark, "t")
    _, fit, d = whitening.distinct_rows(spark.createDataFrame([(i, np.eye(20)[i % 20].tolist()) for i in range(60)], "vec_id long, embedding array<double>"), "vec_id", "embedding", store)
    assert whitening.fit(fit, d, block=4).n == 20  # equal eigenvalues


def test_packing_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i) % 700, 0, 0, int(n), int(i) % 5) for i, n in enumerate(rng.integers(1, 1025, 2000))] + [(1, 0, 0, 100, 7)] * 50 + [(2, 0, 0, 1024, 7)] * 5
    parts = spark.createDataFrame(rows, "key long, piece int, start long, length long, ids_crc32 long")
    seen = []
    for n in (1, 3, 8):
        groups = defaultdict(list)
        for r in packing.pack(parts.repartition(n), group=300).collect():
            groups[r.sequence_id].append((r.offset, r.key, r.length, r.ids_crc32))
        seen.append(sorted(sorted(g) for g in groups.values()))
    assert seen[0] == seen[1] == seen[2] and sum(map(len, seen[0])) == len(rows)


def test_chunks_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 20_000)
    chunks = packing._Chunks(lambda s: list(range(len(s))))
    for i in range(5_000):
        assert len(chunks[f"w{i}"]) % 4 == 0
        assert sum(len(k) + len(v) for k, v in chunks.items()) <= 20_000
    before = len(chunks)
    assert len(chunks["漢" * 600]) == 4 * 601 and len(chunks) == before  # long chunks are not remembered


def test_links_of_long_pages(spark):
    """A page of 1 MB that never closes a tag, and links beside it."""
    bad = "canonical http-equiv " + "<link " * 170_000 + "<meta " * 1_000
    rows = [(1, "http://a.net/1", bad), (2, "http://a.net/2", bad + '><link rel=canonical href="http://q.com/de/2">'), (3, "http://a.net/3", "<link title='a' rel='x canonical' href=z><meta name=refresh content='0;url=http://q.com/de/'>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.count()
    began = time.time()
    got = {r.page_id: r.verdict for r in url_filter.judge(pages).collect()}
    assert got == {1: "allow", 2: "block", 3: "allow"} and time.time() - began < 60
