"""The registered queries against SQL, or against a plain version of the whole query where SQL cannot express it."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from taxolume.llm import avi_media, lang_mixture, mixing, packing, pii, quality, queries
from taxolume.llm.common import word_hashes

from .test_text_operators import PATTERNS, WORD, components, valid

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def docs(con):
    return con.sql("select doc_id, text, lang, source from documents order by doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(spark, con, name):
    df, rel = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [list(rel.columns).index(c) for c in cols]
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)


def test_quality_scores_by_formula(spark, con, docs):
    out = {r.doc_id: r for r in queries.op1_quality(spark, SF).collect()}
    assert set(out) == {d[0] for d in docs} and all(set(r.asDict()) == {"doc_id", "held_out", "score", "predicted"} for r in out.values())
    labels = dict(con.sql("select doc_id, quality from labels where quality is not null").fetchall())
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    free = spark.createDataFrame([(i, q) for i, q in labels.items() if not held(i)], "doc_id long, label int")
    model = quality.fit_ids(table, free)
    odds, prior = model.odds.astype(np.float32), float(model.bias[1] - model.bias[0])
    for i, text, _, _ in docs:
        data = (text or "").encode()
        words, found = re.findall(rb"[^\x20\x09-\x0D]+", data), []
        hashes = [int(word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) for w in words]
        found += [h >> 49 for h in hashes] + [quality.REPEATED for a, b in zip(hashes, hashes[1:]) if a == b] + [quality.LENGTH + min(20, int(math.log2(len(words) + 1)))]
        for n in quality.GRAMS:
            for at in range(len(data) - n + 1):
                h = 0
                for c in data[at : at + n]:
                    h = (h * 16777619 + c) % (1 << 32)
                found.append(quality.BUCKETS + (h * 2654435761 % (1 << 32) >> 17))
        z = prior + float(np.sum(odds[found], dtype=np.float64)) / len(found)
        r = out[i]
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4) and r.held_out == held(i) and r.predicted == (r.score >= 0.7)
    unseen = [i for i in labels if held(i) and i in out]
    assert sum(out[i].predicted == labels[i] for i in unseen) >= 0.9 * len(unseen)


def plain_targets(per):
    """Targets by source of its size: weights 5, 2, 1, at most twice a size, the excess shared out again."""
    order = sorted(per, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped: set = set()
    while True:
        free = [s for s in order if s not in capped]
        level = (1.5 * sum(per.values()) - sum(2 * per[s] for s in capped)) / sum(weight[s] for s in free) if free else 0
        more = {s for s in free if level * weight[s] > 2 * per[s]}
        if not more:
            return {s: 2 * per[s] if s in capped else level * weight[s] for s in order}
        capped |= more


def test_mixing(spark, docs):
    size = {i: len(re.findall(WORD, t or "")) for i, t, _, _ in docs}
    per, taken, largest = Counter(), Counter(), Counter()
    source = {i: s for i, _, _, s in docs}
    for i in size:
        per[source[i]] += size[i]
        largest[source[i]] = max(largest[source[i]], size[i])
    goal = plain_targets(per)
    out = queries.op2_mixing(spark, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(size) and sorted(out) == sorted(queries.op2_mixing(spark, SF).collect())
    for r in out:
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == per[s] and r.target == pytest.approx(goal[s]) and 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    assert all(abs(taken[s] - goal[s]) <= largest[s] for s in per)


def test_mixing_with_a_giant(spark):
    """One document has a third of its source's words; its coin is made up for by the others."""
    rows = [(i, "w " * (3000 if i == 0 else i % 40 + 1), "a") for i in range(300)] + [(1000 + i, "w " * (i % 60 + 1), s) for i in range(600) for s in "bc"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for seed in (1, 2, 3):
        out = mixing.mix(docs, seed=seed).join(docs.select("doc_id", "source").distinct(), "doc_id").filter("source = 'a'").dropDuplicates(["doc_id"])
        r = out.agg({"taken": "sum", "target": "max"}).first()
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 0.02 * r["max(target)"]


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_vocabulary())
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for i, x, _, _ in docs}
    check_pieces(queries.op3_packing(spark, SF).collect(), ids)


def check_pieces(out, ids):
    """Whole documents in gapless sequences, hardly more of them than there must be."""
    pieces, fills = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
        fills[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for i, own in pieces.items():
        own.sort(key=lambda r: r.piece)
        n = len(ids[i])
        assert [r.piece for r in own] == list(range(-(-n // 1024))) and own[0].length == (n - 1) % 1024 + 1 and all(r.length == 1024 for r in own[1:])
        at = 0
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[i][at : at + r.length].tobytes())
            at += r.length
        assert at == n
    for own in fills.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(fills) <= 1.02 * sum(map(len, ids.values())) / 1024 + 1


def test_languages_by_plain_em(spark, docs):
    out = {r.doc_id: r for r in queries.op6_language(spark, SF).collect()}
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = lang_mixture.fit(table.filter(table.doc_id.isin([d[0] for d in docs if not held(d[0])])))
    fold = lambda b: (b | 32 if b < 91 else b) if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32
    m = len(model.languages)
    for i, text, lang, _ in docs:
        r = out[i]
        assert r.held_out == held(i)
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        ll = []
        for w in re.findall(rb"[^\x20\x09-\x0D]+", text.encode()):
            c = [32, 32, *map(fold, w)]
            at = [((c[k] | c[k - 1] << 8 | c[k - 2] << 16) * 2654435761 % (1 << 32)) >> (32 - lang_mixture.BITS) for k in range(2, len(c))]
            ll.append(model.log_p[at].astype(np.float64).sum(axis=0))
        ll = np.array(ll)
        p = np.exp(ll - ll.max(axis=1, keepdims=True))

        def em(pi):
            while True:
                r = p * pi
                new = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
                if np.abs(new - pi).max() < lang_mixture.NEAR:
                    return pi, np.log(np.maximum(r.sum(axis=1), 1e-300)).sum() + ll.max(axis=1).sum()
                pi = new

        full = em(np.full(m, 1 / m))
        best, cost = full[0], math.log(len(ll)) / 2 * (m - 1) - full[1]
        for k in range(1, m):
            start = np.where(np.argsort(np.argsort(-full[0], kind="stable"), kind="stable") < k, np.maximum(full[0], 1e-6), 0)
            pi, of_set = em(start / start.sum())
            if math.log(len(ll)) / 2 * (k - 1) - of_set <= cost:
                best, cost = pi, math.log(len(ll)) / 2 * (k - 1) - of_set
        assert r.lang_pred == model.languages[int(best.argmax())] and r.score == pytest.approx(best.max(), abs=1e-3)
    known = [d for d in docs if d[2] and held(d[0]) and any(c.isalpha() for c in d[1] or "")]
    assert sum(out[d[0]].lang_pred == d[2] for d in known) >= 0.95 * len(known)


def test_media(spark, docs):
    out = {r.doc_id: r for r in queries.op10_media(spark, SF).collect()}
    assert len(out) == len(docs)
    for i, text, _, _ in docs:
        r, data = out[i], (text or "").encode()
        payload = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        frames = np.frombuffer(payload, np.uint8).reshape(-1, 24, 24)
        media = avi_media.avi([avi_media.encode_frames(frames[k : k + 1])[0] for k in range(len(frames))])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        h = [Counter(v >> 4 for v in f.ravel().tolist()) for f in frames]
        d = [sum(abs(a[k] - b[k]) for k in range(16)) / 1152 for a, b in zip(h, h[1:])]
        cuts = [0]
        for k, x in enumerate(d):
            near = d[max(0, k - 4) : k] + d[k + 1 : k + 5]
            mean = sum(near) / len(near) if near else 0
            spread = math.sqrt(sum((y - mean) ** 2 for y in near) / len(near)) if near else 0
            if x >= avi_media.LEAST and (not near or x > max(mean + 3 * spread, 1.5 * mean)):
                cuts.append(k + 1)
        clips = [f"{a * 40}-{b * 40}-{round(float(frames[a:b].mean(axis=(1, 2)).mean()), 4)}" for a, b in zip(cuts, [*cuts[1:], len(frames)])]
        assert r.feature == f"frames={len(frames)};clips={len(clips)};" + ",".join(clips)


def plain_spans(text):
    """(start, rank, end, kind) of base and added kinds; IBANs do not occur here."""
    found = [(m.start(), list(PATTERNS).index(k), m.end(), k) for k, p in PATTERNS.items() for m in re.finditer(p, text) if valid(k, m[0])]
    runs = list(re.finditer(r"[A-Za-z0-9_-]{20,}", text))
    for k, m in enumerate(runs):
        before = text[runs[k - 1].end() if k else 0 : m.start()][-pii.WINDOW :]
        after = text[m.end() : runs[k + 1].start() if k + 1 < len(runs) else None][: pii.WINDOW]
        digits = sum(c.isdigit() for c in m[0])
        if digits and digits < len(re.sub("[-_]", "", m[0])) and digits * 8 >= len(m[0]) and re.search(pii.SECRET.context.removeprefix("(?i)"), f"{before} {after}", re.I | re.A):
            found.append((m.start(), 5, m.end(), "secret"))
    return sorted(found)


def test_pipeline_stage_by_stage(spark, docs):
    import corpus_pipeline

    from tokenizers import Tokenizer

    kept = [(i, t) for i, t, _, _ in docs if any(c.isalpha() for c in t or "")]
    group = components(kept)
    kept = [(i, t) for i, t in kept if group[i] == i]
    texts = {}
    for i, t in kept:
        parts, at = [], 0
        for start, _, end, kind in plain_spans(t):
            if start >= at:
                parts += [t[at:start], f"<{kind}>"]
            at = max(at, end)
        texts[i] = "".join(parts) + t[at:]
    source = {d[0]: d[3] for d in docs}
    rows = spark.createDataFrame([(i, t, source[i]) for i, t in texts.items()], "doc_id long, text string, source string")
    per = Counter()
    for i, t in texts.items():
        per[source[i]] += len(re.findall(WORD, t))
    goal = plain_targets(per)
    t = Tokenizer.from_file(packing.default_vocabulary())
    stage = spark.read.parquet(f"{SF}/documents.parquet")
    want = {"language": len([d for d in docs if any(c.isalpha() for c in d[1] or "")]), "near_duplicates": len(kept), "personal_data": len(kept)}
    for name, step in corpus_pipeline.STAGES[:3]:
        stage = step(spark, stage, SF).checkpoint()
        assert stage.columns == ["doc_id", "text", "lang", "source", "n_chars"] and stage.count() == want[name]
    assert {r.doc_id: r.text for r in stage.collect()} == texts
    assert stage.filter("n_chars <> length(text)").count() == 0
    out = corpus_pipeline.run(spark, SF).collect()
    first = Counter(r.doc_id for r in out if r.piece == 0)
    assert set(first) <= set(texts) and rows.count() == len(texts)
    taken = Counter()
    for i, n in first.items():
        words = len(re.findall(WORD, texts[i]))
        assert n <= 2
        taken[source[i]] += n * words
    largest = max(len(re.findall(WORD, x)) for x in texts.values())
    assert all(abs(taken[s] - goal[s]) <= largest for s in per)
    ids = {i: np.array([*t.encode(texts[i], add_special_tokens=False).ids, 2], "<u4") for i in first}
    total = sum(len(ids[i]) * n for i, n in first.items())
    assert sum(r.length for r in out) == total and len({r.sequence_id for r in out}) <= 1.05 * total / 1024 + 1
    for r in out:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())


def test_odd_tables(spark, odd, tmp_path):
    """The queries on nulls, repeats, odd texts and on empty tables."""
    documents = odd.select("doc_id", "text", "lang", "source", "n_chars")
    pages = odd.selectExpr("doc_id as page_id", "text as url", "text as html")
    vectors = odd.selectExpr("doc_id as vec_id", "if(doc_id = 4, null, array(cast(doc_id as float), 1f)) as embedding")
    labels = odd.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    for name, n in (("rows", None), ("none", 0)):
        for table, df in (("documents", documents), ("pages", pages), ("embeddings", vectors), ("labels", labels)):
            (df if n is None else df.limit(0)).write.parquet(str(tmp_path / name / f"{table}.parquet"))
    for query, run in queries.QUERIES.items():
        assert run(spark, str(tmp_path / "none")).count() == 0, query
        out = run(spark, str(tmp_path / "rows")).collect()
        if query not in ("op3_packing", "op5_top_k", "op11_spelling", "op13_whitening"):
            assert len(out) == odd.count(), query
    assert queries.op3_packing(spark, str(tmp_path / "rows")).filter("piece = 0").count() == odd.count()
    import corpus_pipeline

    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_mixing_splits_repeats(spark):
    """Equal rows are one unit: as many copies as their mass, none more than twice, whatever their number."""
    rows = spark.range(30_000).selectExpr("7 as doc_id", "'a b c' as text", "'s' as source").unionByName(spark.range(300).selectExpr("id as doc_id", "'x y' as text", "'t' as source"))
    out = mixing.mix(rows)
    assert out.count() == 30_300 and out.filter("taken > 2 * size").count() == 0
    taken = out.filter("size = 3").agg({"taken": "sum"}).first()[0]
    assert abs(taken - out.filter("size = 3").first().target) <= 3
    assert mixing.repeated(rows).filter("source = 's'").count() * 3 == taken
