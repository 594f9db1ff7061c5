"""Mixing, packing, search, archives, URL filters, components, the pipeline."""

import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxolume.llm import mixing, packing, pivot_search, url_filter, warc
from taxolume.operators.components import connected_components

from .conftest import TEXTS


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(500 + i, 900) for i in range(50)] + [(7, 7), (None, 3)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert {got[i] for i in range(201)} == {0} and {got[500 + i] for i in range(50)} == {500} and got[900] == 500
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mixing(spark, odd):
    out = mixing.mix(odd).collect()
    assert len(out) == len(TEXTS)
    for r in out:
        assert r.size in {len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in TEXTS if i == r.doc_id} and 0 <= r.taken <= 2 * r.size
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, mixing.mix(odd).collect()), key=repr)
    assert mixing.mix(odd.limit(0)).count() == 0
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 50 + 1).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("source"))
    per = {r.source: r for r in docs.select("doc_id", "source").join(mixing.mix(docs), "doc_id").groupBy("source").agg(F.sum("size").alias("s"), F.first("target").alias("t"), F.sum("taken").alias("k")).collect()}
    total = sum(r.s for r in per.values())
    weights, caps = {"a": 5, "b": 2, None: 1}, {k: 2 * r.s for k, r in per.items()}
    capped: set = set()
    while True:
        level = (1.5 * total - sum(caps[k] for k in capped)) / sum(w for k, w in weights.items() if k not in capped)
        more = {k for k, w in weights.items() if k not in capped and level * w > caps[k]}
        if not more:
            break
        capped |= more
    for k, r in per.items():
        assert r.t == pytest.approx(caps[k] if k in capped else level * weights[k]) and abs(r.k - r.t) <= 100
    again = mixing.repeated(docs).groupBy("doc_id").count()
    assert again.join(mixing.mix(docs), "doc_id").filter("count <> copies").count() == 0 and mixing.repeated(odd).columns == odd.columns


def test_packing(spark, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_vocabulary())
    t.encode_special_tokens = True
    out = packing.pack_documents(odd).toPandas()
    ids = {i: t.encode(x or "", add_special_tokens=False).ids + [2] for i, x in TEXTS}
    want = sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x in TEXTS)
    assert out.length.sum() == want
    for r in out[out.doc_id.notna()].itertuples():
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.length.sum() <= 1024 and (g.offset.to_numpy() == np.concatenate([[0], g.length.cumsum()[:-1]])).all()
    assert out.sequence_id.nunique() <= want / 1024 + 1.5
    assert packing.pack_documents(odd.limit(0)).count() == 0


def test_added_tokens_have_their_ids(spark):
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(packing.default_vocabulary()), "<|endoftext|>"
    texts = [f"see {e} here", e, f"{e}{e}", f"a  {e}  b \n{e}\n c", f"<|{e}|>", "<|endoftext|", f"é{e}日本 {e} ", f" {e}don't", f"{e} x" * 1500, "no mark here", "", f"a \n {e} \t b"]
    with open(packing.default_vocabulary(), encoding="utf-8") as f:
        bpe = packing.ByteBpe(f.read())
    assert np.frombuffer(bpe.packed(texts[0]), "<u4").tolist() == [3826, 220, 50256, 994]
    out = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas()
    ids = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert [np.frombuffer(bpe.packed(x), "<u4").tolist() for x in texts] == ids and out.length.sum() == sum(map(len, ids)) + len(ids)
    for r in out.itertuples():
        assert zlib.crc32(np.array((ids[r.doc_id] + [2])[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32


def test_each_vocabulary_has_its_own_ids(spark, tmp_path):
    """Two vocabularies, one after the other in the same workers."""
    import json

    with open(packing.default_vocabulary(), encoding="utf-8") as f:
        whole = json.load(f)
    whole["model"]["merges"] = []
    byte = packing._bytes_of_characters()
    whole["model"]["vocab"] = {c: i for i, c in enumerate(sorted(byte, key=byte.get))}
    whole["added_tokens"] = []
    (tmp_path / "bytes.json").write_text(json.dumps(whole))
    docs = spark.createDataFrame([(1, "one two three")], "doc_id long, text string").coalesce(1)
    assert packing.pieces(docs).first()["length"] == 4
    assert packing.pieces(docs, vocabulary=str(tmp_path / "bytes.json")).first()["length"] == 14


def test_packing_in_several_groups(spark):
    sizes = [(i * 37) % 1000 + 1 for i in range(3000)]
    parts = spark.createDataFrame([(i, 0, 0, s, 0) for i, s in enumerate(sizes)], "key long, piece int, start long, length long, ids_crc32 long")
    out = packing.pack(parts, group=500).toPandas()
    assert len(out) == 3000 and out.sequence_id.nunique() <= sum(sizes) / 1024 * 1.02
    stuck = packing.pack(parts.withColumn("length", F.lit(600).cast("long")), group=500).toPandas()
    assert stuck.sequence_id.nunique() == 3000


def test_local_search_empties_bins():
    sizes = [6, 5, 4, 3, 2, 4]
    bins = packing.improve([[0, 4], [1], [2, 3], [5]], sizes, 10)
    assert sorted(i for b in bins for i in b) == list(range(6)) and all(sum(sizes[i] for i in b) <= 10 for b in bins) and len(bins) == 3
    rng = random.Random(1)
    sizes = [rng.randint(200, 600) for _ in range(2000)]
    start = packing.best_fit(sizes, 1024)
    for first in (start, [[i] for i in range(2000)]):
        bins = packing.improve(first, sizes, 1024)
        assert sorted(i for b in bins for i in b) == list(range(2000)) and all(sum(sizes[i] for i in b) <= 1024 for b in bins)
        assert len(bins) < len(start)
        fill = [sum(sizes[i] for i in b) for b in bins]
        gives = min(range(len(bins)), key=lambda b: fill[b])  # nothing is left that the emptiest bin could give
        assert not any(sizes[j] < sizes[i] <= sizes[j] + 1024 - fill[b] for i in bins[gives] for b in range(len(bins)) if b != gives for j in bins[b])


def test_smallest_packings():
    """Against the least number of bins, by trying all."""

    def least(sizes: list[int], room: tuple[int, ...] = ()) -> int:
        if not sizes:
            return len(room)
        first, *rest = sizes
        tries = [least(rest, (*room, 10 - first))]
        tries += [least(rest, (*room[:b], r - first, *room[b + 1 :])) for b, r in enumerate(room) if r >= first]
        return min(tries)

    rng = random.Random(2)
    over = 0
    for _ in range(60):
        sizes = [rng.randint(1, 9) for _ in range(rng.randint(1, 7))]
        over += len(packing.improve(packing.best_fit(sizes, 10), sizes, 10)) - least(sizes)
    assert over <= 1


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 8))
    x[100:180] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1100, [1.0] * 7 + [float("nan")]), (1200, [1.0, None] * 4), (1300, [1.0] * 3), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = pivot_search.top_k(df, F.col("vec_id") % 50 == 0, block=4).collect()
    z = np.floor(1024 * x).astype(int)
    for q in range(0, 400, 50):
        s = z @ z[q]
        want = [int(i) for i in np.lexsort((np.arange(400), -s)) if i != q][:10]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[1] for m in mine] == want and [m[2] for m in mine] == s[want].tolist() and [m[0] for m in mine] == list(range(1, 11))
    assert {r.query_id for r in got} == set(range(0, 400, 50))
    assert pivot_search.top_k(df.limit(0), F.lit(True)).count() == 0
    assert pivot_search.top_k(df.filter("vec_id < 3"), F.col("vec_id") == 0).count() == 2


def test_bounds_eliminate(spark):
    """On clustered vectors few pairs are evaluated; results are those of brute force."""
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(20, 16)), 200, axis=0) + rng.normal(size=(4000, 16)) * 0.03
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    shares: list[float] = []
    got = pivot_search.top_k(df, F.col("vec_id") % 50 == 0, evaluated=shares).collect()
    z = np.floor(1024 * x).astype(int)
    for q in range(0, 4000, 50):
        s = z @ z[q]
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [int(i) for i in np.lexsort((np.arange(4000), -s)) if i != q][:10]
    assert shares[0] < 0.25


def test_top_k_of_odd_rows(spark):
    """Lengths are compared each with its own; of queries that share a key one asks."""
    rows = [(0, [1.0, 0.0], 7), (0, [0.0, 1.0], 7), (1, [1.0, 1.0], 7), (2, [3.0], 7), (100, [2.0], 7), (3, [], 7), (200, [], 7), (4, [1.0, 1.0], 7), (4, [1.0, 1.0], 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score long")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in pivot_search.top_k(df, F.col("vec_id") % 100 == 0).collect())
    one = 1024 * 1024
    assert got == [(0, 1, 1, one), (0, 2, 4, one), (0, 3, 4, one), (100, 1, 2, 6 * one), (200, 1, 3, 0)]


def test_archives(spark, tmp_path):
    big = "<p>" + "é" * 600 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"
    rows = [(1, "http://a.b/c?d", big), (2, "http://a.b/\r\nX: y", big), (3, None, big), (4, "http://a.b", "small"), (5, "http://a.b", "small"), (6, "x", None), (None, "http://n", "nil"), (7, "", ""), (7, "", ""), (3, None, big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    out = warc.captures(pages, str(tmp_path / "w"), keep_payload=True, file_bytes=2000).collect()
    assert len(out) == len(rows)
    got = sorted((repr(r.page), r.response.type, r.response.payload_bytes, r.response.payload_digest, r.refers_to_page, bytes(r.response.payload)) for r in out)
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        again = h == big and i != 3
        want.append((repr(i), "revisit" if again else "response", len(p), hashlib.sha1(p).hexdigest(), 3 if again else None, p))
    assert got == sorted(want, key=lambda x: x[:4])
    assert len({r.capture for r in out}) == len(rows) - 2 and all(r.request and r.metadata for r in out)
    assert warc.captures(pages.limit(0), str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError):
        list(warc.parse(b"not an archive"))


def test_archives_of_long_and_broken_parts(spark, tmp_path):
    rows = [(i, f"http://a/{i}", f"{i} " * n) for i, n in enumerate([5, 900_000, 5, 200_000])] + [(9, "http://hot", "x" * 2000)] * 1500
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = warc.captures(pages, str(tmp_path / "w"), file_bytes=100_000)
    assert out.count() == len(rows) and len(list((tmp_path / "w").glob("*.gz"))) > 10
    assert sorted(r[0] for r in out.select("response.payload_bytes").distinct().collect()) == sorted({len(h) for _, _, h in rows})
    whole = gzip.decompress(next((tmp_path / "w").glob("*.gz")).read_bytes())
    told = list(warc.parse(whole))
    singly = b"".join(gzip.compress(p) for p in re.split(rb"(?=WARC/1\.1\r\nWARC-Type)", whole) if p)
    assert [f for f, _ in warc.parse(singly)] == [f for f, _ in told] and len(told) >= 3
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "a.warc").write_bytes(whole + b"WARC/1.1\r\nContent-Length: 99\r\n\r\ncut off")
    (tmp_path / "b" / "b.warc.gz").write_bytes(gzip.compress(whole)[:-20])
    (tmp_path / "b" / "c.warc").write_bytes(b"")
    kinds = [r.type for r in warc.read_records(spark, str(tmp_path / "b")).collect()]
    assert kinds.count("malformed") == 2 and len(kinds) >= 2 + len(told)
    assert warc.assemble(warc.read_records(spark, str(tmp_path / "b"))).count() >= 1


def test_url_rules_and_aliases(spark):
    rows = [
        (1, "http://A.Example.org/es/x?q", ""), (2, "http://example.org/en/17", ""), (3, "http://example.org/en/2", ""), (4, "http://notexample.org/es/1", ""), (5, "http://q.com/de/", None), (6, "http://q.com/fr/", ""), (7, None, "x"), (8, "no scheme", ""),
        (9, "http://x.net/a", '<link href="http://y.net/b" rel="canonical">'), (10, "http://y.net/b", '<meta http-equiv="refresh" content="0; url=http://q.com/de/1">'), (11, "http://z.net/p/q", '<LINK rel=canonical href="r">'), (12, "http://z.net/p/r", '<link rel="canonical" href="//q.com/de/2">'),
        (13, "http://z.net/both", '<link rel="canonical" href="http://z.net/p/r"><meta http-equiv=refresh content="1;url=http://q.com/fr/9">'), (9, "http://x.net/a", ""), (14, "http://w.net/", '<link rel="canonical" href="/">'),
    ]
    out = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("says", F.lit(1)))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    assert out.count() == len(rows)
    assert got[1] == ("a.example.org", "/es/x", "example.org/es/", "block") and got[2][2:] == ("example.org/en/1", "block") and got[3][2:] == ("org/", "allow") and got[4][2:] == ("org/", "allow")
    assert got[5][2:] == ("com/de/", "block") and got[6][2:] == ("com/fr/", "allow") and got[7] == ("", "", None, "allow") and got[8][:2] == ("", "")
    assert got[9][2:] == (None, "block") and got[10][2:] == (None, "block")  # through an alias of an alias
    assert got[11][3] == got[12][3] == got[13][3] == "allow"  # an allowed alias goes before a blocked one
    assert got[14][3] == "allow"


def test_aliases_of_every_redirect(spark):
    rows = [
        (1, "http://x.net/1", '<meta content="0;url=http://q.com/de/1" http-equiv="refresh">'), (2, "http://x.net/2", "<META content='3; URL=http://q.com/de/2' data-x HTTP-EQUIV=Refresh/>"), (3, "http://x.net/3", '<meta content="0;url=http://q.com/de/1" name="refresh">'),
        (4, "http://x.net/4", '<meta http-equiv="refresh" content="9;url=http://x.net/none"><p><meta http-equiv="refresh" content="0;url=http://q.com/de/4">'), (5, "http://x.net/5", '<link rel="canonical" href="/none5"><link rel="canonical" href="http://q.com/fr/5">'),
        (6, "http://x.net/6", '<link href="http://Y.net/b#part" rel="canonical">'), (7, "HTTP://y.NET/b", '<link rel="canonical" href="http://q.com/de/7">'), (8, "http://x.net/Case#a", '<link rel="canonical" href="http://X.NET/7b#b">'), (9, "http://x.net/7b", '<link rel="canonical" href="http://q.com/de/9">'),
        (10, "http://x.net/case", ""), (11, "http://x.net/f", '<link rel="canonical" href="#top">'), (12, "http://x.net/", '<link rel="canonical" href="http://q.com/de/12">'), (13, "http://3xx.NET/#z", ""),
    ]
    known = spark.createDataFrame([("http://3XX.net/", "http://q.COM/de/13#y")], "a string, b string")
    out = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), edges=known, default="none").collect()
    assert {r.page_id: r.verdict for r in out} == {1: "block", 2: "block", 3: "none", 4: "block", 5: "allow", 6: "block", 7: "block", 8: "block", 9: "block", 10: "none", 11: "none", 12: "block", 13: "block"}
    urls = ["HTTP://Me:Pw@A.Org:80/P?Q=R#F", "no Scheme#x", "http://A#b\nc", None]
    told = spark.createDataFrame([(u,) for u in urls], "u string").select(url_filter.normalised(F.col("u"))).collect()
    assert [r[0] for r in told] == ["http://Me:Pw@a.org:80/P?Q=R", "no Scheme#x", "http://a", None]


def test_pipeline(spark, odd, tmp_path):
    import corpus_pipeline

    odd.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    ids = set(out.doc_id.dropna().astype(int))
    assert not ids & {2, 3, 4, 5, 6, 9} and ids <= {1, 7, 8, 10, 11, 12, 13, 14}  # near copies and texts without letters are gone
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).checkpoint()
        assert docs.columns == odd.columns[:5], name
        if name == "personal_data":
            assert docs.filter("text like '%@%'").count() == 0 and docs.filter("n_chars <> length(text)").count() == 0
    assert out.groupby("doc_id").piece.apply(lambda p: (p == 0).sum()).sum() == docs.filter("doc_id is not null").count()


def test_near_duplicates_by_rows(spark):
    import corpus_pipeline

    a, b, c, d = (" ".join(f"{w}{i}" for i in range(30)) for w in "abcd")
    near = a + " more"
    rows = [(1, a), (2, near), (2, b), (3, c), (3, d), (None, d), (None, "x y"), (None, "x y"), (None, None), (5, near + " words"), (5, b), (None, "q r")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = sorted([(1, a), (2, b), (3, c), (3, d), (None, "x y"), (None, None), (None, "q r")], key=repr)
    for parts in (1, 5):
        out = corpus_pipeline.near_duplicates(spark, docs.repartition(parts).checkpoint(), "")
        assert out.columns == docs.columns and sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == want


def test_equal_rows_are_taken_each_by_its_count(spark):
    rows = [(i, "w " * 5, s) for s in ("a", "b") for i in [None] * 40 + [7] * 30] + [(100 + i, "v " * 5, "c") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").checkpoint()
    taken = mixing.mix(docs)
    assert taken.columns == ["doc_id", "row_key", "size", "source_size", "target", "copies", "taken"] and taken.select("copies").distinct().count() > 1
    out = mixing.repeated(docs).collect()
    assert len(out) == taken.agg(F.sum("copies")).first()[0]
    target = {r.s: r.t for r in mixing.targets(docs.select("source", F.lit(5).alias("size"))).select(F.col("source").alias("s"), F.col("target").alias("t")).collect()}
    for s, t in target.items():
        assert abs(5 * sum(r.source == s for r in out) - t) <= 5
