"""Line deduplication with keep bitmaps.

Each text is split at line feeds. The 128-bit hashes of its lines' keys go to ranges of hashes, sorted by hash, then
document, then position, so that one pass over a range sees a key's first document before its others and streams the
lines that go. A key whose lines fill several ranges is decided over them: a range tells the first document of its last
key, and the lines of its own first key wait for the least document of that key anywhere. What comes back are positions,
kept as one compressed bitmap for each document; texts are not shuffled until somebody applies the bitmaps to them.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxolume.storage import Scratch, told

from .common import releasing

#: A key shorter than this many code points is never a repeat.
LEAST = 10
#: Fixed value: what is stripped from a line's ends.
SPACE = b" \t\n\x0b\x0c\r"
#: Lines of one batch that a task hands on.
BATCH = 100_000
#: Kinds of what a range gives: a line that goes, a line of its first key, and the first document of its last key.
GOES, WAITS, FIRST = 0, 1, 2


def line_key(line: bytes) -> bytes | None:
    """The line without white space at its ends and with A-Z in lower case; None if it is too short to be a repeat."""
    key = line.strip(SPACE).lower()
    if len(key) < LEAST or (len(key) < 4 * LEAST and len(key.decode()) < LEAST):
        return None
    return key


def _row(key: Column, text: Column) -> Column:
    """Tells rows that share an id apart: a hash of the id and the text."""
    return F.xxhash64(key, text)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each (id, row, text): a row with the number of its lines and no hash, and one for each line with a key."""
    ids: list = []
    rows: list[int] = []
    at: list[int] = []
    digests: list[bytes] = []
    hashed: list[bool] = []

    def full() -> pa.RecordBatch:
        halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        missing = ~np.array(hashed, bool)
        arrays = [pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(at, pa.int64()), pa.array(halves[:, 0], mask=missing), pa.array(halves[:, 1], mask=missing)]
        for held in (ids, rows, at, digests, hashed):
            held.clear()
        return pa.RecordBatch.from_arrays(arrays, ["id", "row", "pos", "h1", "h2"])

    none = bytes(16)
    for batch in batches:
        texts = batch.column(2).cast(pa.large_binary())
        for i, (doc, row) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            lines = (texts[i].as_py() or b"").split(b"\n")
            for pos, line in enumerate(lines):
                key = line_key(line)
                if key is not None:
                    ids.append(doc), rows.append(row), at.append(pos), hashed.append(True)
                    digests.append(hashlib.md5(key, usedforsecurity=False).digest())
                    if len(ids) >= BATCH:
                        yield full()
            ids.append(doc), rows.append(row), at.append(len(lines)), hashed.append(False), digests.append(none)
    if ids:
        yield full()


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over a range's lines in order of hash, document and position: what goes and what waits."""
    names = ["kind", "id", "row", "pos", "h1", "h2"]
    first = last = keeper = None  # the range's first key, the key before this batch, and that key's first document
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        h1, h2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2"))
        ids, absent = batch.column("id").fill_null(0).to_numpy(zero_copy_only=False), batch.column("id").is_null().to_numpy(zero_copy_only=False)
        new = np.ones(n, bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        if (h1[0], h2[0]) == last:
            new[0] = False
        else:
            first = first or (h1[0], h2[0])
        start = np.maximum.accumulate(np.where(new, np.arange(n), -1))  # -1: the key began in an earlier batch
        before = keeper or (0, False)
        doc, none = np.where(start < 0, before[0], ids[start]), np.where(start < 0, before[1], absent[start])
        waits = (h1 == first[0]) & (h2 == first[1])
        goes = ~waits & ((ids != doc) | (absent != none))
        last, keeper = (h1[-1], h2[-1]), (doc[-1], bool(none[-1]))
        take = np.flatnonzero(waits | goes)
        if len(take):
            own = batch.take(pa.array(take))
            kind = pa.array(np.where(waits[take], WAITS, GOES).astype(np.int32))
            yield pa.RecordBatch.from_arrays([kind, *(own.column(c) for c in names[1:])], names)
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((FIRST, pa.int32()), (None if keeper[1] else int(keeper[0]), pa.int64()), (None, pa.int64()), (None, pa.int64()), (int(last[0]), pa.int64()), (int(last[1]), pa.int64()))], names)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, row, n_lines, positions that go) with the positions as a bitmap of the lines that stay."""
    for batch in batches:
        kept, gone = [], []
        for n, pos in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
            bits = np.ones(n, bool)
            bits[pos.values.to_numpy(zero_copy_only=False)] = False
            kept.append(zlib.compress(np.packbits(bits).tobytes(), 6))
            gone.append(n - int(bits.sum()))
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], ["id", "row", "n_lines", "n_dropped", "keep"])


def keep_bitmaps(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, row, n_lines, n_dropped, keep): which lines of each document stay, as a zlib-compressed bitmap, the first
    line in the highest bit.

    A line goes if its key has at least LEAST code points and a document with a smaller id has that key too; repeats
    inside the first document stay. A null or empty text is one empty line. A null id is an id of its own, larger than
    all others. Rows that share an id are one document: none of them loses a line to another. They are told apart by
    `row`, a hash of id and text, and rows that agree in both share a bitmap. A very long text is split by one task, which
    holds its lines. Other columns are ignored. An empty table gives no rows.
    """
    store = Scratch(docs.sparkSession, "lines")
    found = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    found = found.select("id", _row(F.col("id"), F.col("text")).alias("row"), "text")
    lines = store.put(found.mapInArrow(releasing(_lines), "id long, row long, pos long, h1 long, h2 long"))
    # Bounds are drawn from the rows, so that a key with many lines is cut between ranges by document and position.
    order = [F.col("h1"), F.col("h2"), F.col("id").asc_nulls_last(), F.col("row"), F.col("pos")]
    ranged = lines.filter("h1 is not null").repartitionByRange(*order).sortWithinPartitions(*order)
    seen = store.put(ranged.mapInArrow(releasing(_stream), "kind int, id long, row long, pos long, h1 long, h2 long"))
    # A row or two for each range: its first and its last key, with the least document there.
    waits = seen.filter(F.col("kind") == WAITS)
    ends = waits.unionByName(seen.filter(F.col("kind") == FIRST)).groupBy("h1", "h2").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("least"))
    open_ = waits.join(told(store.put(ends)), ["h1", "h2"]).filter(~F.col("id").eqNullSafe(F.col("least.id")))
    gone = seen.filter(F.col("kind") == GOES).select("id", "row", "pos").union(open_.select("id", "row", "pos"))
    rows = lines.filter("h1 is null").select("id", "row", F.col("pos").alias("n_lines"), F.lit(None).cast("long").alias("pos"))
    each = rows.unionByName(gone.select("id", "row", F.lit(None).cast("long").alias("n_lines"), "pos"))
    each = each.groupBy("id", "row").agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("gone"))
    return each.mapInArrow(releasing(_bitmaps), "id long, row long, n_lines long, n_dropped long, keep binary")


def kept_positions(keep: bytes, n_lines: int) -> np.ndarray:
    """The numbers of the lines that a bitmap keeps."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n_lines))


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, n_dropped, keep) with the text that the bitmap leaves, all of it without a bitmap."""
    for batch in batches:
        texts, n_lines, kept = batch.column(1).cast(pa.large_binary()), [], []
        for i, keep in enumerate(batch.column(3).to_pylist()):
            text = texts[i].as_py()
            n_lines.append(text.count(b"\n") + 1)
            if keep is not None:
                lines = text.split(b"\n")
                text = b"\n".join([lines[j] for j in kept_positions(keep, len(lines))])
            kept.append(text)
        out = pa.array(kept, pa.large_binary()).cast(pa.large_string()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_lines, pa.int64()), batch.column(2), out], ["id", "n_lines", "n_dropped", "kept"])


def drop_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_lines, n_dropped, kept): each row of docs with the text that its bitmap leaves, one row for each row.

    Only documents that lose a line are looked up with their text; if their list is short, Spark broadcasts it by the
    size of its files. All else is as for keep_bitmaps.
    """
    store = Scratch(docs.sparkSession, "kept-lines")
    maps = store.put(keep_bitmaps(docs, key, text).filter("n_dropped > 0"))
    maps = maps.select(F.col("id").alias("_id"), F.col("row").alias("_row"), "n_dropped", "keep")
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("row", _row(F.col("id"), F.col("text")))
    both = rows.join(maps, rows["id"].eqNullSafe(maps["_id"]) & (rows["row"] == maps["_row"]), "left")
    both = both.select("id", "text", F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), "keep")
    return both.mapInArrow(releasing(_applied), "id long, n_lines long, n_dropped long, kept string").withColumnRenamed("id", key)


SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM d),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), many AS (SELECT k, min(doc_id) AS keeper FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
judged AS (SELECT doc_id, line, pos, coalesce(keeper <> doc_id, false) AS gone FROM keyed LEFT JOIN many ON keyed.k = many.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
