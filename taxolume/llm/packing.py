"""Best-fit packing of token sequences by swap-based local search.

Documents become token ids; only those longer than a sequence are cut. Whole pieces of the full length are sequences of
their own. The rest is packed: a first packing by best fit, then a local search that moves a piece, exchanges one piece
for one or two or two for one between underfull bins, always raising the sum of squared fills, until bins empty and no
such step is left. The search runs in groups of `GROUP` pieces; the emptiest bins of each group are packed again in
groups of the groups, up to one last group, so the number of bins approaches the least one at any number of rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolume.storage import Scratch, multiplied

from .common import releasing, worker_cache

#: The id that ends a document, and the tokens of a sequence.
END, LENGTH = 2, 1024
#: Pieces that one task packs at a time; it bounds memory and the search's time. Of a group's pieces, those of its
#: emptiest bins, one in KEEP, are packed again with those of other groups.
GROUP, KEEP = 20_000, 8
#: Bytes of chunks and their ids that a worker remembers, about; longer chunks than CHUNK characters are encoded anew.
REMEMBERED, CHUNK = 48 << 20, 32
#: What a dictionary needs for an entry besides its key and value, about.
ENTRY = 100
#: Fixed value: how byte-level BPE of this family splits text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space that the split may join across a space; such texts are encoded whole.
_JOINED = re.compile(r"\s \s")


def _bytes_of_characters() -> dict[str, int]:
    """Byte-level vocabularies print each byte as a character: printable ones as themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class _Chunks(dict):
    """Packed little-endian uint32 ids of a space and a chunk, encoded when first asked for. Chunks of a text without
    spaces may be as long as it is, so only short ones are remembered, and all are forgotten at a number of bytes."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode, self.held = encode, 0

    def __missing__(self, chunk: str) -> bytes:
        got = _packed(self.encode(" " + chunk))
        if len(chunk) <= CHUNK:
            self.held += sys.getsizeof(chunk) + sys.getsizeof(got) + ENTRY
            if self.held > REMEMBERED:
                self.clear()
                self.held = 0
            self[chunk] = got
        return got


class ByteBpe:
    """The ids that the vocabulary file's own tokenizer gives with add_special_tokens=False.

    Added tokens' strings are ids of their own, the leftmost and of those the longest first; what lies between them is
    encoded as a text. Such a text is split at spaces, as no merge crosses from one word to the next, and short chunks
    are encoded once and remembered. Texts with runs of white space around spaces are encoded whole.
    """

    def __init__(self, vocabulary: str) -> None:
        as_byte = _bytes_of_characters()
        model = json.loads(vocabulary)
        added = [x for x in model.get("added_tokens", ()) if x["content"]]
        if any(x.get(how) for x in added for how in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that take spaces or need word limits are not known here")
        self.added = {x["content"]: _packed([x["id"]]) for x in added}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        ranks = {bytes(as_byte[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in self.added}
        self.encode = tiktoken.Encoding("chunks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.chunks = _Chunks(self.encode)

    def packed(self, text: str) -> bytes:
        if self.marks is None or not self.marks.search(text):
            return self.between(text)
        return b"".join(self.added[x] if i % 2 else self.between(x) for i, x in enumerate(self.marks.split(text)))

    def between(self, text: str) -> bytes:
        """The ids of a text without added tokens."""
        if "  " in text or _JOINED.search(text):
            return _packed(self.encode(text))
        first, *rest = text.split(" ")
        return _packed(self.encode(first)) + b"".join(map(self.chunks.__getitem__, rest))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """(key, piece, start, length, ids_crc32): the pieces of each row's ids and `end`; a null text is empty.

    The first piece takes what is left over when a document is longer than `length`. vocabulary: a file that the
    driver reads and sends to the workers. Memory follows the longest text: its ids are held as a whole, 4 bytes each.
    """
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        told = f.read()
    words, digest = docs.sparkSession.sparkContext.broadcast(told), hashlib.sha256(told.encode()).hexdigest()
    ending = _packed([end])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = worker_cache()
        if digest not in held:
            held[digest] = ByteBpe(words.value)
        bpe = held[digest]
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            texts = batch.column(1)
            for i, k in enumerate(batch.column(0).to_pylist()):
                ids = bpe.packed(texts[i].as_py() or "") + ending
                n = len(ids) // 4
                at, p = 0, 0
                size = n % length or length
                while at < n:
                    for c, v in zip(rows, (k, p, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])), strict=True):
                        c.append(v)
                    at, p, size = at + size, p + 1, length
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], ["key", "piece", "start", "length", "ids_crc32"])

    kept = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    return kept.mapInArrow(releasing(run), "key long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: each item, largest first, goes to the fullest bin that has room."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = bisect_left(room, (sizes[i], -1))
        if at == len(room):
            bins.append([i])
            left, b = capacity - sizes[i], len(bins) - 1
        else:
            left, b = room.pop(at)
            bins[b].append(i)
            left -= sizes[i]
        if left:
            insort(room, (left, b))
    return bins


class _Returns:
    """What bins can give back in an exchange: by number of tokens, the bin with the most room that has so many."""

    def __init__(self, capacity: int) -> None:
        self.most = np.full(capacity, -1)  # an upper bound of that room
        self.heaps: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity)]

    def put(self, tokens: int, room: int, b: int, version: int) -> None:
        heappush(self.heaps[tokens], (-room, b, version))
        if room > self.most[tokens]:
            self.most[tokens] = room

    def partner(self, s: int, giver: int, versions: list[int]) -> tuple[int, int] | None:
        """(bin, tokens) of the exchange of s tokens for the fewest that some other bin's room allows."""
        while True:
            can = np.flatnonzero(self.most[1:s] >= s - _UPTO[1:s])
            if not len(can):
                return None
            t = int(can[0]) + 1
            heap, own = self.heaps[t], None
            while heap and (versions[heap[0][1]] != heap[0][2] or heap[0][1] == giver):
                top = heappop(heap)
                if top[1] == giver and versions[giver] == top[2]:
                    own = top
            room, b = (-heap[0][0], heap[0][1]) if heap else (-1, -1)
            if own:
                heappush(heap, own)  # the giver's own pieces are no return; they are offered anew once it has changed
            if room + t >= s:
                return b, t
            self.most[t] = room


_UPTO = np.arange(1 << 16)


def improve(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """bins after the local search; each step raises the sum of squared fills, so it ends.

    The emptiest bin gives: a piece moves to the fullest bin that has room for it; else one piece is exchanged for one
    or two smaller ones of another underfull bin, or two for one, whichever brings most tokens over. All underfull bins
    are partners. A bin that can give nothing is set aside until others have changed; the search ends when none can.
    """
    bins = [list(b) for b in bins]
    fill = [sum(sizes[i] for i in b) for b in bins]
    versions = [0] * len(bins)
    single, double = _Returns(capacity), _Returns(capacity)
    under = sorted((f, b) for b, f in enumerate(fill) if f < capacity)

    def offer(b: int) -> None:
        """Enters what b, an underfull bin, can give back."""
        versions[b] += 1
        if not bins[b] or fill[b] == capacity:
            return
        own = sorted({sizes[i] for i in bins[b]})
        for x in own:
            single.put(x, capacity - fill[b], b, versions[b])
        for t in _pair_sums([sizes[i] for i in bins[b]]):
            double.put(t, capacity - fill[b], b, versions[b])

    def refill(b: int, now: int) -> None:
        if fill[b] < capacity:
            at = bisect_left(under, (fill[b], b))
            if at < len(under) and under[at] == (fill[b], b):
                under.pop(at)
        fill[b] = now
        if 0 < now < capacity:
            insort(under, (now, b))
        offer(b)

    def pick(b: int, tokens: int, many: int) -> list[int]:
        """One piece of so many tokens, or two that have them together."""
        if many == 1:
            return [next(i for i in bins[b] if sizes[i] == tokens)]
        seen: dict[int, int] = {}
        for i in bins[b]:
            if (other := seen.get(tokens - sizes[i])) is not None:
                return [other, i]
            seen[sizes[i]] = i
        raise AssertionError("a pair that was offered is there")

    def step(giver: int) -> tuple[int, list[int], list[int]] | None:
        """(partner, what it gets, what it gives)."""
        own = sorted(bins[giver], key=lambda i: -sizes[i])
        for i in own:
            at = bisect_left(under, (capacity - sizes[i] + 1, -1)) - 1
            while at >= 0 and under[at][1] == giver:
                at -= 1
            if at >= 0 and under[at][0] + sizes[i] > fill[giver]:
                return under[at][1], [i], []
        for s in dict.fromkeys(sizes[i] for i in own):
            for returns, many in ((single, 1), (double, 2)):
                if found := returns.partner(s, giver, versions):
                    return found[0], pick(giver, s, 1), pick(found[0], found[1], many)
        for s in sorted((s for s in _pair_sums([sizes[i] for i in own]) if s < capacity), reverse=True):
            if found := single.partner(s, giver, versions):
                return found[0], pick(giver, s, 2), pick(found[0], found[1], 1)
        return None

    for _, b in under:
        offer(b)
    settled: list[tuple[int, int]] = []
    moved = True
    while moved:
        moved = False
        while len(under) > 1:
            giver = under[0][1]
            found = step(giver)
            if found is None:
                versions[giver] += 1  # no partner of fuller ones
                settled.append(under.pop(0))
                continue
            b, there, back = found
            moved = True
            gain = sum(sizes[i] for i in there) - sum(sizes[i] for i in back)
            bins[b] = [j for j in bins[b] if j not in back] + there
            bins[giver] = [j for j in bins[giver] if j not in there] + back
            f, g = fill[b] + gain, fill[giver] - gain
            refill(b, f)
            refill(giver, g)
        for f, b in settled:
            insort(under, (f, b))
            offer(b)
        settled = []
    return [b for b in bins if b]


def _pair_sums(sizes: list[int]) -> list[int]:
    """The different sums of two of sizes."""
    seen = sums = 0
    for s in sizes:
        sums |= seen << s
        seen |= 1 << s
    out = []
    while sums:
        low = sums & -sums
        out.append(low.bit_length() - 1)
        sums ^= low
    return out


def _pack(capacity: int, level: int, keep: int | None):
    """Packs each group of a partition's rows, sorted by group. Of its emptiest bins, as many as hold a part 1 / keep of
    its pieces come back unpacked, to be packed with those of other groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "copy", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

        def done(group: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            sizes = [r[4] for r in rows]
            bins = improve(best_fit(sizes, capacity), sizes, capacity)
            bins.sort(key=lambda b: sum(sizes[i] for i in b))
            room = len(rows) // keep if keep else 0
            out: list[tuple] = []
            for b, items in enumerate(bins):
                room -= len(items)
                closed = room < 0 or sum(sizes[i] for i in items) == capacity
                at = 0
                for i in items:
                    out.append((*rows[i], (level << 58) | (group << 22) | b if closed else None, at if closed else None))
                    at += sizes[i]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

        now, rows = None, []
        for batch in batches:
            for group, *row in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if group != now and rows:
                    yield from done(now, rows)
                    rows = []
                now = group
                rows.append(tuple(row))
        if rows:
            yield from done(now, rows)

    return releasing(run)


def pack(parts: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """parts (key, piece, start, length, ids_crc32) with sequence_id and offset.

    Every row is packed once, repeated rows each; rows of a null key too. No sequence holds more than `length`; offsets
    leave no gap. Ties between pieces of one length go by key, piece, start and checksum, equal rows by a number among
    themselves, so that equal tables give equal sequences, however they are stored and dealt over tasks. An empty table
    gives no rows. A sequence's number has its level in the tree, its group and its bin in bits of their own; full
    pieces are sequences of their own with negative numbers, which alone depend on how the table is dealt.
    """
    store = Scratch(parts.sparkSession, "packing")
    kept = ["key", "copy", "piece", "start", "length", "ids_crc32"]
    # Rows that agree in all columns spread over groups too, and stay apart as copies.
    same = parts.groupBy("key", "piece", "start", "length", "ids_crc32").agg(F.count("*").alias("times"))
    same = store.put(same)
    repeats = multiplied(same.filter("times > 1"), "times", "copy", ["key", "piece", "start", "ids_crc32"])
    rows = same.filter("times = 1").withColumn("copy", F.lit(0).cast("long")).select(*kept)
    if not same.filter("times > 1").isEmpty():
        rows = store.put(rows.unionByName(repeats.select(*kept)))
        store.drop(same)
    n = rows.filter(F.col("length") < length).count()
    full = rows.filter(F.col("length") >= length)
    out = [full.select(*kept, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    open_, level = rows.filter(F.col("length") < length), 0
    schema = "key long, copy long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    while True:
        groups = max(1, -(-n // group))
        at = F.pmod(F.xxhash64("key", "piece", "ids_crc32", "copy", F.lit(level)), F.lit(groups))
        dealt = open_.withColumn("g", at).select("g", *kept).repartition(min(groups, 10_000), "g").sortWithinPartitions("g", "length", "key", "piece", "start", "ids_crc32", "copy")
        packed = store.put(dealt.mapInArrow(_pack(length, level, KEEP if groups > 1 else None), schema))
        out.append(packed.filter("sequence_id is not null"))
        if groups == 1:
            break
        open_, level = packed.filter("sequence_id is null").select(*kept), level + 1
        n = open_.count()
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    return every.drop("copy")


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row of docs.

    A null or empty text is its end token alone; a null key stays null; equal rows are packed each. A very long text is
    held by one task while its ids are made (4 bytes an id) and gives many full pieces. Other columns are ignored,
    whatever their names. An empty table gives no rows.
    """
    return pack(pieces(docs, key, text, vocabulary, length, end), length).withColumnRenamed("key", key)
