"""Language, quality, shingle join, personal data, media: small cases and brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxolume.llm import avi_media, lang_mixture, pii, quality
from taxolume.llm.jaccard_tree import SEVERAL, _combined, jaccard_components, tree_links

from .conftest import TEXTS

WORD = r"[^\x20\x09-\x0D]+"


def shingles(text, size=5):
    w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def components(rows, percent=75):
    sets, parent = [(i, shingles(t)) for i, t in rows], {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def test_components_on_odd_rows(odd):
    got = jaccard_components(odd).collect()
    assert len(got) == len(TEXTS)
    want, n = components([(i, t) for i, t in TEXTS if i is not None]), {i: len(shingles(t)) for i, t in TEXTS}
    for r in got:
        assert r.n_shingles == n[r.doc_id] and (r.doc_id is None and r.component_id is None or r.component_id == want[r.doc_id])
    assert jaccard_components(odd.limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [10**6, 2500])
def test_components_of_random_copies(spark, chunk):
    """Chains of near copies around the limit, a passage shared by all, and a small chunk that forces pairs of chunks."""
    rng = random.Random(chunk)
    vocabulary, passage = [f"w{i}" for i in range(400)], " ".join(f"p{i}" for i in range(20))
    rows, i = [], 0
    for _ in range(12):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([6, 30, 60, 90]))]
        for _ in range(rng.choice([1, 2, 9])):
            rows.append((i, " ".join(words) + " " + passage))
            i += 1
            words = list(words)
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
    got = {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), chunk=chunk).collect()}
    assert got == components(rows)


@pytest.mark.parametrize("docs", [[], [[]], [[7]], [[3, 9], [9], [], [1, 3, 9], [2]], [[5, 6]] * 4])
def test_shared_grams_of_a_slice_are_counted_there(docs):
    every = np.array([x for d in docs for x in d], np.uint64)
    place = np.repeat(np.arange(len(docs), dtype=np.uint16), [len(d) for d in docs])
    gram, of, many, here = _combined(every, place, len(docs))
    times = {x: sum(x in d for d in docs) for x in every.tolist()}
    assert dict(zip(gram.tolist(), many.tolist(), strict=True)) == times and len(gram) == len(times)
    assert all((p == SEVERAL) == (times[x] > 1) and (p == SEVERAL or x in docs[p]) for x, p in zip(gram.tolist(), of.tolist(), strict=True))
    assert here.tolist() == [sum(times[x] > 1 for x in d) for d in docs]


def test_tree_links_match_all_pairs():
    rng = np.random.default_rng(3)
    for size in (30, 300):
        sets = []
        for _ in range(size):
            if sets and rng.random() < 0.7:
                s = sets[rng.integers(len(sets))].copy()
                s[rng.integers(0, len(s), 4)] = rng.integers(0, 9000, 4, dtype=np.uint64)
            else:
                s = rng.integers(0, 9000, rng.integers(5, 60), dtype=np.uint64)
            sets.append(np.unique(s))
        label = list(range(size))
        for i in range(size):
            for j in range(i):
                o = len(np.intersect1d(sets[i], sets[j]))
                if 100 * o >= 75 * (len(sets[i]) + len(sets[j]) - o) and label[i] != label[j]:
                    a, b = sorted((label[i], label[j]))
                    label = [a if x == b else x for x in label]
        got = dict(tree_links(np.arange(size), sets, 75))
        assert [got.get(i, i) for i in range(size)] == label


def test_languages(spark, odd):
    rng = random.Random(1)
    say = {"xx": "lorem ipsum dolor sit amet consectetur".split(), "yy": "zwei wörter über straßen größe schön".split()}
    rows = [(i, " ".join(rng.choice(say[k]) for _ in range(30)), k) for i in range(60) for k in ("xx", "yy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_mixture.fit(docs)
    assert model.languages == ["xx", "yy"]
    out = lang_mixture.predict(docs, model).collect()
    assert all(r.lang == r.lang_pred and r.lang_set == [r.lang] for r in out)
    mixed = spark.createDataFrame([(1, " ".join(say["xx"] * 8 + say["yy"] * 4))], "doc_id long, text string")
    r = lang_mixture.predict(mixed, model).first()
    assert r.lang_set == ["xx", "yy"] and r.lang_pred == "xx" and 0.6 < r.score < 0.75
    got = lang_mixture.predict(odd, model, keep=odd.columns)
    assert got.count() == len(TEXTS) and got.columns.count("score") == 1
    und = {r.doc_id for r in got.filter("lang_pred = 'und'").collect()}
    assert und == {4, 5, 6, 9}
    none = lang_mixture.fit(docs.limit(0))
    assert none.languages == [] and {r.lang_pred for r in lang_mixture.predict(odd, none).collect()} == {"und"}
    assert lang_mixture.predict(odd.limit(0), model).count() == 0


def test_quality(spark, odd):
    rng = random.Random(2)
    good, bad = ["alpha", "beta", "gamma", "delta"], ["b%%%", "!!", "zz$$"]
    rows = [(i, " ".join(rng.choice(good if i % 3 else bad + good[:1]) for _ in range(40)), int(i % 3 > 0)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = quality.fit(docs.filter("doc_id < 200"))
    held = quality.score(docs.filter("doc_id >= 200"), model).collect()
    assert sum((r.score >= 0.5) == r.label for r in held) >= 0.97 * len(held)
    out = quality.score(odd, model)
    assert out.count() == len(TEXTS) and out.filter("score is null or score < 0 or score > 1").count() == 0
    same = {r.text: set() for r in odd.collect()}
    for r in quality.score(odd, model, keep=["text"]).collect():
        same[r.text].add(r.score)
    assert all(len(v) == 1 for v in same.values())
    assert quality.score(odd, quality.fit(docs.limit(0))).count() == len(TEXTS)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(v - 9 * (v > 9) for i, c in enumerate(reversed(d)) for v in [int(c) * (1 + i % 2)]) % 10 == 0


def valid(k, m):
    d = re.sub("[^0-9]", "", m)
    return k == "email" or k == "ip" and all(int(x) <= 255 for x in m.split(".")) or k == "card" and 12 <= len(d) <= 19 and luhn(d) or k == "phone" and 9 <= len(d) <= 15


def test_personal_data_matches_brute_force(spark, odd):
    rng = random.Random(4)
    bits = ["a@b.c", "a.b%c@d-e.f.g", "_x@y.z@w.q", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "007.1.02.3", "4111 1111-1111 1111", "4111111111111112", "+1 (234) 567-8901", "+123", "++1 23456789-", "é", "日", " ", ".", "-", "5", "a", "\n", "🙂", "@"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(800)]
    texts += ["1" * 30_000, "a" * 60_000, "a@" * 20_000, "a@b" + ".c" * 20_000, "1." * 20_000, None, "IBAN DE89 3704 0044 0532 0130 00.", "DE89 3704 0044 0532 0130 01"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_spans(docs, out="found").collect():
        want = sorted((m.start(), list(PATTERNS).index(k), m.end(), k) for k, p in PATTERNS.items() for m in re.finditer(p, r.text or "") if valid(k, m[0]))
        assert [(x.start, x["rank"], x.end, x.kind) for x in r.found if x.kind != "iban"] == want
        assert any(x.kind == "iban" for x in r.found) == (r.text or "").startswith("IBAN")
    clean = {r.doc_id: r.text for r in pii.redact(pii.find_spans(odd, out="pii")).collect()}
    assert clean[12] == "mail <email> and <ip>, call <phone> now, card <card> é" and clean[4] is None and clean[10] == "x" * 50_000
    assert pii.find_spans(odd.limit(0)).count() == 0


def test_media_round_trip(spark, odd):
    out = avi_media.decode(avi_media.encode_text(odd.select("doc_id", "text"), keep=["doc_id", "text"]))
    assert out.count() == len(TEXTS)
    for r in out.collect():
        b = (r.text or "").encode()
        p = b + b"\xff" * (max(1, -(-len(b) // 576)) * 576 - len(b))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.frames) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(p) // 576)
        assert r.clips[0].start_ms == 0 and r.clips[-1].end_ms == 40 * r.frames and all(x.end_ms == y.start_ms for x, y in zip(r.clips, r.clips[1:]))
    rng = np.random.default_rng(1)
    frames = rng.integers(0, 256, (40, 24, 24), dtype=np.uint8)
    frames[5:20] = 200
    assert (avi_media.decode_frames(avi_media.encode_frames(frames)) == frames).all()
    video = avi_media.avi(avi_media.encode_frames(frames))
    assert len(avi_media.index_of(video)[3]) == 40 and avi_media.index_of(video)[1:3] == (24, 24)
    shots = spark.createDataFrame([(1, video)], "frames int, media binary")
    assert {r.first_frame for r in avi_media.clip_rows(shots).collect()} >= {0, 5, 20}
    assert avi_media.decode(spark.createDataFrame([(1, None)], "i int, media binary")).first().frames is None
    assert avi_media.decode(avi_media.encode_text(odd.limit(0).select("text", F.lit(1).alias("media")))).count() == 0


def test_media_errors_stay_with_their_row(spark):
    rng = np.random.default_rng(2)
    good = avi_media.avi(avi_media.encode_frames(rng.integers(0, 256, (3, 24, 24), dtype=np.uint8)))
    at = good.index(b"idx1")
    rows = [(1, good), (2, b"nothing"), (3, b""), (4, good[:200]), (5, None), (6, good[:at]), (7, good.replace(b"\xff\xc3", b"\xff\xc0"))]
    out = {r.i: r for r in avi_media.decode(spark.createDataFrame(rows, "i int, media binary").coalesce(1)).collect()}
    assert out[1].error is None and out[1].frames == 3 and out[6].frames == 3 and out[6].payload_sha256 == out[1].payload_sha256
    assert all(out[i].error and out[i].frames is None and out[i].media_bytes == len(dict(rows)[i]) for i in (2, 3, 7)) and out[5].error is None and out[5].frames is None
    assert out[4].frames in (None, 0)


def test_many_and_overlapping_spans(spark):
    text = "ab.c@d.ef 1.2.3.4, " * 3000
    over = "4111 1111 1111 1111@x.com +12 3456 7890 123 (45) 1.2.3.4@y.org"
    rows = [(1, text), (2, over), (3, "no such token here: abcdefghijklmnopqrstuvwxyz0"), (4, "number f33e61083db5dbdf4bd2369d2f80176e57f7fda2"), (5, "my key f33e61083db5dbdf4bd2369d2f80176e57f7fda2 x")]
    docs = pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string").withColumn("pii", F.lit(1)))
    found = {r.doc_id: r for r in docs.collect()}
    assert [(x.start, x.end) for x in found[1].pii] == [p for i in range(3000) for p in ((19 * i, 19 * i + 9), (19 * i + 10, 19 * i + 17))]
    assert not found[3].pii and not found[4].pii and [(x.kind, round(x.score, 2)) for x in found[5].pii] == [("secret", 0.7)]
    assert {round(x.score, 2) for x in found[1].pii} == {0.9, 0.6}
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[1] == "<email> <ip>, " * 3000
    assert clean[2] == "<card>.com <phone>) <ip>.org" or "@" not in clean[2] and "1111" not in clean[2]


def baseline_jpeg(coefs, height, width, parts, restart=0):
    """A baseline JPEG from quantised coefficients by part and block in scan order: every symbol has an 8-bit code."""
    import struct

    symbols = {0: list(range(12)), 1: [0, 0xF0, *[r << 4 | s for r in range(16) for s in range(1, 9)]]}
    code = {k: {s: i for i, s in enumerate(v)} for k, v in symbols.items()}
    out = [b"\xff\xd8\xff\xdb" + struct.pack(">HB", 67, 0) + bytes([3] + [2] * 63)]
    for k in (0, 1):
        out.append(b"\xff\xc4" + struct.pack(">HB", 19 + len(symbols[k]), k << 4) + bytes([0] * 7 + [len(symbols[k])] + [0] * 8) + bytes(symbols[k]))
    out.append(b"\xff\xc0" + struct.pack(">HBHHB", 8 + 3 * len(parts), 8, height, width, len(parts)) + b"".join(bytes([i, h << 4 | v, 0]) for i, (h, v) in enumerate(parts)))
    if restart:
        out.append(b"\xff\xdd" + struct.pack(">HH", 4, restart))
    out.append(b"\xff\xda" + struct.pack(">HB", 6 + 2 * len(parts), len(parts)) + b"".join(bytes([i, 0]) for i in range(len(parts))) + bytes([0, 63, 0]))
    bits, before, coded = "", [0] * len(parts), []

    def put(k, symbol, value, size):
        nonlocal bits
        bits += f"{code[k][symbol]:08b}" + (f"{value if value > 0 else value + (1 << size) - 1:0{size}b}" if size else "")

    def flush():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        coded.append(bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00"))
        bits = ""

    for unit, blocks in enumerate(coefs):
        if restart and unit and unit % restart == 0:
            flush()
            before = [0] * len(parts)
        for i, own in blocks:
            d = own[0] - before[i]
            before[i] = own[0]
            put(0, abs(d).bit_length(), d, abs(d).bit_length())
            run = 0
            for x in own[1:]:
                if not x:
                    run += 1
                    continue
                while run > 15:
                    put(1, 0xF0, 0, 0)
                    run -= 16
                put(1, run << 4 | abs(x).bit_length(), x, abs(x).bit_length())
                run = 0
            if run:
                put(1, 0, 0, 0)
    flush()
    marked = b"".join(c + (b"\xff" + bytes([0xD0 + i % 8]) if i < len(coded) - 1 else b"") for i, c in enumerate(coded))
    return b"".join(out) + marked + b"\xff\xd9"


@pytest.mark.parametrize("parts, restart", [([(1, 1)], 0), ([(1, 1)], 2), ([(2, 2), (1, 1), (1, 1)], 0), ([(2, 1), (1, 1), (1, 1)], 3)])
def test_baseline_frames(spark, parts, restart):
    rng = random.Random(restart)
    height, width = 29, 37
    h, v = parts[0]
    across, down = -(-width // (8 * h)), -(-height // (8 * v))
    block = lambda: [rng.randint(-150, 150), *[rng.choice([0, 0, 0, 0, rng.randint(-20, 20)]) for _ in range(40)], *[0] * 22, rng.choice([0, 5])]
    coefs = [[(i, block()) for i, (a, b) in enumerate(parts) for _ in range(a * b)] for _ in range(across * down)]
    got = avi_media.decode_baseline(baseline_jpeg(coefs, height, width, parts, restart))
    assert got.shape == (height, width)
    order = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    assert order[:6] == [(0, 0), (0, 1), (1, 0), (2, 0), (1, 1), (0, 2)]
    for y, x in ((0, 0), (7, 8), (15, 16), (28, 36), (20, 3), (9, 30)):
        by, bx = y // 8, x // 8
        own = [b for i, b in coefs[by // v * across + bx // h] if i == 0][by % v * h + bx % h]
        total = 0.0
        for k, (u, w) in enumerate(order):
            scale = (np.sqrt(1 / 8) if u == 0 else 0.5) * (np.sqrt(1 / 8) if w == 0 else 0.5)
            total += own[k] * (3 if k == 0 else 2) * scale * np.cos((2 * (y % 8) + 1) * u * np.pi / 16) * np.cos((2 * (x % 8) + 1) * w * np.pi / 16)
        assert abs(int(got[y, x]) - min(255, max(0, total + 128))) <= 0.51
    jpeg = [baseline_jpeg([[(i, [level] + [0] * 63) for i, (a, b) in enumerate(parts) for _ in range(a * b)] for _ in range(across * down)], height, width, parts, restart) for level in [-100] * 4 + [100] * 5]
    r = avi_media.decode(spark.createDataFrame([(1, avi_media.avi(jpeg))], "i int, media binary")).first()
    assert r.error is None and r.frames == 9 and [c.first_frame for c in r.clips] == [0, 4] and r.payload_bytes == 9 * height * width
