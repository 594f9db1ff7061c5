"""N-gram Jaccard join by signature trees.

Documents are sets of hashed word n-grams. The join finds every link (100 * intersection >= percent * union) without
comparing all pairs:

1. One scan deals all n-gram hashes out by hash range, as packed arrays. Each range tells which hashes occur more than
   once. A document can only have a link if at least `percent` of its n-grams also occur elsewhere; the others are done.
   An n-gram that several documents of a slice of the scan hold is counted there and dealt out once with its count, so
   a passage or a text that a third of all documents share adds one entry a slice to its range, not one a document.
2. Equal sets collapse to one representative. The representatives' rarest n-grams (the prefix that any linked pair
   must share one of) split them into groups; linked documents always fall into one group. n-grams found very often in
   step 1 come last in that order, whatever order is used the groups are safe.
3. In each group a signature tree is built: leaves are documents with a bitmap of their n-grams, nodes the OR of their
   children's bitmaps and the range of their sizes. A dual traversal descends into a pair of nodes only if sizes and
   the largest possible overlap allow a link, and skips documents that are connected already; links are then exact.
4. A group beyond `CHUNK` is cut into chunks of one size class and of like prefixes, each a tree of its own; cutting it
   anew by other hashes connects most of what belongs together. Only then are trees of two chunks joined, and of each
   chunk only those documents that share a prefix n-gram with a document of the other that they are not connected to.
5. Connected components over the links, by DataFrame operations.

Nothing is dropped or capped: a link between two different sets is found for certain (up to 64-bit hash collisions).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolume.operators.components import connected_components
from taxolume.storage import Scratch, join_hot, told

from .common import lower_ascii, mixed, releasing, utf8_slices, word_hashes, word_spans

#: n-grams (and 300 for each document) in a tree or a pair of trees.
CHUNK = 1_500_000
#: Ways in which a large group is cut before trees of different chunks are joined; it affects speed only.
CUTS = 2
#: Bytes of text for each hash range, and the most ranges as a power of 2, so that a slice has several n-grams for each.
RANGE_BYTES, RANGES = 16 << 20, 18
#: n-grams of a range that are sorted at a time.
SORTED = 4_000_000
#: Frequent n-grams that reach the driver, 5 bytes each, at most, and the least times that they occur. All tasks are told
#: a table of them with a byte for each of up to 2 ** CELLS cells. These bounds affect speed only.
FREQUENT, OFTEN, CELLS = 4_000_000, 8, 25
#: Bytes of text whose n-grams are dealt out together.
SLICE = 8 << 20
#: Stands for a document's place in a slice where an n-gram has several there.
SEVERAL = 65_535
#: Bits of a node's bitmap, at most.
BITS = 4096
FAN = 8


def _sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The distinct n-gram hashes of each text, sorted; a text of fewer words is one n-gram, one without words none."""
    data = lower_ascii(data)
    starts, ends, counts = word_spans(data, offsets)
    w = word_hashes(data, starts, ends)
    factors = mixed(np.arange(11, 11 + size, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    total = np.zeros(max(0, len(w) - size + 1), np.uint64)
    for k in range(size):
        total += w[k : k + len(total)] * factors[k]
    grams = mixed(total)
    out, at = [], 0
    for n in counts.tolist():
        if n >= size:
            out.append(np.unique(grams[at : at + n - size + 1]))
        elif n:
            out.append(mixed(np.array([(w[at : at + n] * factors[:n]).sum() + np.uint64(n)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def _read(column: pa.Array, size: int) -> list[np.ndarray]:
    return [s for _, data, offsets in utf8_slices(column) for s in _sets(data, offsets, size)]


def _prints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each set."""
    with np.errstate(over="ignore"):
        one = [int(x.sum(dtype=np.uint64)) for x in sets]
        two = [int(mixed(x ^ np.uint64(0xA5A5F00D5EED1234)).sum(dtype=np.uint64)) for x in sets]
    return np.array(one, np.uint64).view(np.int64), np.array(two, np.uint64).view(np.int64)


def _combined(every: np.ndarray, place: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n-grams of a slice, each once: itself, its document's place or SEVERAL, how often it occurs; and for each
    document how many of its n-grams others of the slice hold. Those of one document come first, in their order."""
    order = np.argsort(every).astype(np.int32)
    edge = np.ones(len(every) + 1, bool)
    own = every[order]
    np.not_equal(own[1:], own[:-1], out=edge[1:-1])
    del own
    alone = edge[:-1] & edge[1:]
    here = np.bincount(place[order[~alone]], minlength=docs).astype(np.int32)
    once, first = np.sort(order[alone]), np.flatnonzero(edge[:-1] & ~alone)
    often = order[first]
    last = np.flatnonzero(edge[1:] & ~alone)  # where the run that began at first ends
    times = last - first + 1
    at = np.concatenate([once, often])
    many = np.ones(len(at), np.uint32)
    many[len(once) :] = times
    place = place[at]
    place[len(once) :] = SEVERAL
    return every[at], place, many, here


def _packed(*arrays: np.ndarray) -> bytes:
    return np.array([a.nbytes for a in arrays], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)


def _unpacked(blob: bytes, *kinds: type) -> list[np.ndarray]:
    sizes = np.frombuffer(blob, np.int64, len(kinds)).tolist()
    out, at = [], 8 * len(kinds)
    for n, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(blob, kind, n // np.dtype(kind).itemsize, at))
        at += n
    return out


def _deal(size: int, bits: int):
    """Rows of packed n-grams by hash range, and one row a slice, of range -1, with what is known of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0

        def rows(ids: list[np.ndarray], sets: list[np.ndarray], k: int) -> pa.RecordBatch:
            at = (part << 32) + k
            sizes = np.array([len(s) for s in sets], np.int64)
            one, two = _prints(sets)
            every = np.concatenate(sets)
            place = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
            sets.clear()
            every, place, many, here = _combined(every, place, len(sizes))
            where = (every >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
            order = np.argsort(where, kind="stable")  # in each range those of one document come first
            every = ((every[order] >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            place, many = place[order], many[order]
            bounds = np.searchsorted(where[order], np.arange((1 << bits) + 1))
            ranges, blobs = [-1], [_packed(np.concatenate(ids), sizes, one, two, here)]
            for r in np.flatnonzero(np.diff(bounds)).tolist():
                own = slice(bounds[r], bounds[r + 1])
                step = np.diff(place[own], prepend=np.uint16(0))  # small numbers, which shuffle well compressed
                ranges.append(r)
                blobs.append(_packed(every[own], step, many[own][place[own] == SEVERAL]))
            return pa.RecordBatch.from_arrays([pa.array(ranges, pa.int64()), pa.array([at] * len(ranges), pa.int64()), pa.array(blobs, pa.binary())], ["range", "slice", "blob"])

        ids, sets, held = [], [], 0
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, data, offsets in utf8_slices(batch.column(1)):
                if sets and (held + len(data) > SLICE or len(sets) + len(offsets) > 65_000):
                    yield rows(ids, sets, k)
                    ids, sets, held, k = [], [], 0, k + 1
                n = len(offsets) - 1
                for lo in range(0, n, 60_000):  # only a run of nearly empty texts is that long
                    hi = min(n, lo + 60_000)
                    if lo:
                        yield rows(ids, sets, k)
                        ids, sets, held, k = [], [], 0, k + 1
                    ids.append(keys[first + lo : first + hi])
                    sets += _sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)
                    held += int(offsets[hi] - offsets[lo])
        if sets:
            yield rows(ids, sets, k)

    return releasing(run)


def _shared(bits: int, most: int):
    """For each range: how many of each document's n-grams occur more than once; the most frequent n-grams.

    A partition's rows come sorted by range; one range is held at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(**x: list) -> pa.RecordBatch:
            n = len(next(iter(x.values())))
            return pa.RecordBatch.from_arrays([pa.array(x.get(c) or [None] * n, t) for c, t in zip(TOLD, (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary()), strict=True)], list(TOLD))

        def done(r: int, slices: list[int], blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
            parts = [_unpacked(x, np.uint32, np.uint16, np.uint32) for x in blobs]
            blobs.clear()
            h = np.concatenate([p[0] for p in parts])
            place = np.concatenate([np.cumsum(p[1], dtype=np.uint16) for p in parts])
            ends = np.cumsum([len(p[0]) for p in parts])
            several = place == SEVERAL
            weight = np.ones(len(h), np.uint32)
            weight[several] = np.concatenate([p[2] for p in parts])
            del parts
            passes, found, often = -(-len(h) // SORTED), [], []
            for k in range(passes):  # by value, so that equal n-grams come together
                own = slice(None) if passes == 1 else np.flatnonzero((h.astype(np.uint64) * np.uint64(passes) >> np.uint64(32)) == k)
                value, of = h[own], np.arange(len(h)) if passes == 1 else own
                order = np.argsort(value, kind="stable")
                value, of = value[order], of[order]
                same = value[1:] == value[:-1]
                twice = np.zeros(len(value), bool)
                twice[1:] = same
                twice[:-1] |= same
                at = of[twice]
                found.append(at[~several[at]])  # those of several documents were counted in their slice
                first = np.flatnonzero(np.concatenate([[True], ~same]))
                times = np.add.reduceat(weight[of], first, dtype=np.int64)
                top = np.flatnonzero(times >= OFTEN)
                top = top[np.lexsort((top, -times[top]))][:most]
                often.append((value[first[top]], times[top]))
            at = np.sort(np.concatenate(found))
            bounds = np.searchsorted(at, ends)
            out: dict[str, list] = {"slice": [], "places": [], "counts": []}
            for s, lo, hi in zip(slices, np.concatenate([[0], bounds[:-1]]), bounds, strict=True):
                if hi > lo:
                    own, n = np.unique(place[at[lo:hi]], return_counts=True)
                    out["slice"].append(s)
                    out["places"].append(own.tobytes())
                    out["counts"].append(n.astype(np.int32).tobytes())
            if out["slice"]:
                yield row(**out)
            value, times = (np.concatenate(x) for x in zip(*often, strict=True))
            top = np.lexsort((value, -times))[:most]
            if len(top):
                yield row(range=[r], often=[_packed(value[top], np.log2(times[top]).astype(np.uint8))])

        now, slices, blobs = None, [], []
        for batch in batches:
            for r, s, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if r < 0:
                    yield row(slice=[s], places=[blob])
                    continue
                if r != now and slices:
                    yield from done(now, slices, blobs)
                    slices, blobs = [], []
                now = r
                slices.append(s)
                blobs.append(blob)
        if slices:
            yield from done(now, slices, blobs)

    return releasing(run)


#: Columns that tell of ranges: a slice's documents (no counts), shared n-grams by place in it, or frequent n-grams.
TOLD = {"slice": "long", "places": "binary", "counts": "binary", "range": "long", "often": "binary"}


def _totals(percent: int):
    """The documents of each slice, with whether they can have a link at all. Rows come sorted by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(known: list[np.ndarray], shared: np.ndarray) -> pa.RecordBatch:
            docs, sizes, one, two, here = known
            shared = shared[: len(sizes)] + here
            can = (sizes > 0) & (100 * shared >= percent * sizes)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (docs, sizes, one, two, can)], ["doc", "n", "one", "two", "can"])

        now, known, shared = None, [], np.zeros(0, np.int64)
        for batch in batches:
            for s, places, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if s != now:
                    if now is not None:
                        yield done(known, shared)
                    now, shared = s, np.zeros(SEVERAL + 1, np.int64)
                if counts is None:
                    known = _unpacked(places, np.int64, np.int64, np.int64, np.int64, np.int32)
                else:
                    shared[np.frombuffer(places, np.uint16)] += np.frombuffer(counts, np.int32)
        if now is not None:
            yield done(known, shared)

    return releasing(run)


def _places(short: np.ndarray, cells: int) -> list[np.ndarray]:
    h = mixed(short)
    return [(x & np.uint64(cells - 1)).astype(np.int64) for x in (h, h >> np.uint64(64 - CELLS))]


def _cells(told: list[tuple[int, bytes]]) -> np.ndarray:
    """Each frequent n-gram has two cells, which hold the logarithm of how often it occurs, or more where others share them."""
    parts = [(r, *_unpacked(x, np.uint32, np.uint8)) for r, x in told]
    cells = np.zeros(1 << min(CELLS, max(4, (16 * sum(len(p[1]) for p in parts)).bit_length())), np.uint8)
    for r, value, level in parts:
        for at in _places(np.uint64(r) << np.uint64(32) | value.astype(np.uint64), len(cells)):
            np.maximum.at(cells, at, level)
    return cells


def _prefix(s: np.ndarray, percent: int, bits: int, cells: np.ndarray) -> np.ndarray:
    """The n-grams of a set that any set linked with it must share one of: its rarest, as far as is known. The lesser of
    an n-gram's two cells orders it, as any function of the n-gram may."""
    one, two = _places(s >> np.uint64(32 - bits), len(cells))
    s = s[np.lexsort((s, np.minimum(cells[one], cells[two])))]
    return s[: len(s) - (percent * len(s) + 99) // 100 + 1]


def _prefix_rows(size: int, percent: int, bits: int, cells: Broadcast[np.ndarray]):
    """(doc, gram) of each document's prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for key, s in zip(keys, _read(batch.column(1), size), strict=True):
                own = _prefix(s, percent, bits, cells.value).view(np.int64) if len(s) else np.zeros(0, np.int64)
                for lo in range(0, len(own), 100_000):
                    some = own[lo : lo + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), key, np.int64)), pa.array(some)], ["doc", "gram"])

    return releasing(run)


def _prefixes(size: int, percent: int, bits: int, cells: Broadcast[np.ndarray]):
    """Edges between documents of a task that share a prefix n-gram, and for each such n-gram its smallest document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(hashes: list[np.ndarray], docs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            h, d = np.concatenate(hashes), np.concatenate(docs)
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            least = np.repeat(d[first], np.diff(np.append(first, len(h))))
            edges = np.unique(np.stack([d, least])[:, d != least], axis=1)
            yield pa.RecordBatch.from_arrays([pa.nulls(edges.shape[1], pa.int64()), pa.array(edges[0]), pa.array(edges[1])], ["gram", "a", "b"])
            for lo in range(0, len(first), 100_000):
                own = first[lo : lo + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(h[own].view(np.int64)), pa.array(d[own]), pa.nulls(len(own), pa.int64())], ["gram", "a", "b"])

        hashes, docs, held = [], [], 0
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for key, s in zip(keys, _read(batch.column(1), size), strict=True):
                if not len(s):
                    continue
                own = _prefix(s, percent, bits, cells.value)
                hashes.append(own)
                docs.append(np.full(len(own), key, np.int64))
                held += len(own)
            if held > 2_000_000:
                yield from done(hashes, docs)
                hashes, docs, held = [], [], 0
        if hashes:
            yield from done(hashes, docs)

    return releasing(run)


def tree_links(ids: np.ndarray, sets: list[np.ndarray], percent: int, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges (id, smallest id) that connect the same documents as all links among `sets` do.

    With sides, only links between documents of different sides count.
    """
    n = np.array([len(s) for s in sets], np.int64)
    keep = np.flatnonzero(n)
    if len(keep) < 2:
        return []
    if len(keep) < len(ids):
        ids, sets, n = ids[keep], [sets[i] for i in keep], n[keep]
        sides = None if sides is None else sides[keep]
    owner = np.repeat(np.arange(len(sets)), n)
    grams, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = times >= 2
    number = np.cumsum(common) - 1
    own = common[inverse]
    token, owner = number[inverse[own]], owner[own]
    m = int(common.sum())
    if not m:
        return []
    exact = m <= BITS
    bits = max(64, min(BITS, 1 << (m - 1).bit_length()))
    firsts = np.full(len(sets), m)
    np.minimum.at(firsts, owner, token)
    order = np.lexsort((n, firsts))  # neighbours in the tree share n-grams
    place = np.argsort(order)
    ids, sets, n = ids[order], [sets[i] for i in order], n[order]
    sides = None if sides is None else sides[order]
    owner = place[owner]
    bit = token % bits
    flags = np.zeros((len(sets), bits // 8), np.uint8)
    np.bitwise_or.at(flags, (owner, bit >> 3), (1 << (bit & 7)).astype(np.uint8))
    leaf = flags.view(np.uint64)
    has = np.bincount(owner, minlength=len(sets))
    slack = has - np.bitwise_count(leaf).sum(axis=1, dtype=np.int64)

    levels = [(leaf, n, n, slack)]
    while len(levels[-1][0]) > FAN:
        b, low, high, s = levels[-1]
        at = np.arange(0, len(b), FAN)
        levels.append((np.bitwise_or.reduceat(b, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(s, at)))

    def possible(level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        b, low, high, s = levels[level]
        ok = np.flatnonzero((100 * high[i] >= percent * low[j]) & (100 * high[j] >= percent * low[i]))
        most = np.empty(len(ok), np.int64)
        for lo in range(0, len(ok), 1 << 14):
            x, y = i[ok[lo : lo + (1 << 14)]], j[ok[lo : lo + (1 << 14)]]
            most[lo : lo + (1 << 14)] = np.bitwise_count(b[x] & b[y]).sum(axis=1, dtype=np.int64) + np.minimum(s[x], s[y])
        return ok[(100 + percent) * most >= percent * (low[i[ok]] + low[j[ok]])]

    def below(i: np.ndarray, j: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        a = (i[:, None, None] * FAN + np.arange(FAN)[None, :, None] + np.zeros((1, 1, FAN), np.int64)).ravel()
        c = (j[:, None, None] * FAN + np.arange(FAN)[None, None, :] + np.zeros((1, FAN, 1), np.int64)).ravel()
        ok = (a < size) & (c < size) & (a <= c)
        return a[ok], c[ok]

    label = np.arange(len(ids))

    def verify(i: np.ndarray, j: np.ndarray) -> None:
        ok = (i < j) & (label[i] != label[j])
        if sides is not None:
            ok &= sides[i] != sides[j]
        i, j = i[ok], j[ok]
        ok = possible(0, i, j)
        i, j = i[ok], j[ok]
        while len(i):
            a, c = i[0], j[0]
            if exact or (100 + percent) * len(np.intersect1d(sets[a], sets[c], assume_unique=True)) >= percent * (n[a] + n[c]):
                old, new = label[a], label[c]
                label[label == old] = new
                ok = label[i] != label[j]
                i, j = i[ok], j[ok]
            else:
                i, j = i[1:], j[1:]

    top = len(levels) - 1
    i, j = np.triu_indices(len(levels[top][0]))
    for level in range(top, 1, -1):
        ok = possible(level, i, j)
        i, j = below(i[ok], j[ok], len(levels[level - 1][0]))
    if top:
        ok = possible(1, i, j)
        i, j = i[ok], j[ok]
        near = np.argsort(j - i, kind="stable")
        for lo in range(0, len(near), 256):
            verify(*below(i[near[lo : lo + 256]], j[near[lo : lo + 256]], len(ids)))
    else:
        verify(i, j)
    _, inverse = np.unique(label, return_inverse=True)
    least = np.full(inverse.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, inverse, ids)
    least = least[inverse]
    return [(int(a), int(b)) for a, b in zip(ids, least, strict=True) if a != b]


def _join(size: int, percent: int):
    """Links of each chunk or pair of chunks; a partition's rows come sorted by them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(key: tuple, ids: list[int], sides: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            found = tree_links(np.array(ids, np.int64), sets, percent, np.array(sides) if key[0] != key[1] else None)
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        now, ids, sides, sets = None, [], [], []
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True))
            for key, side, doc, s in zip(keys, batch.column(2).to_pylist(), batch.column(3).to_pylist(), _read(batch.column(4), size), strict=True):
                if key != now and ids:
                    yield from done(now, ids, sides, sets)
                    ids, sides, sets = [], [], []
                now = key
                ids.append(doc)
                sides.append(side)
                sets.append(s)
        if ids:
            yield from done(now, ids, sides, sets)

    return releasing(run)


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 75, chunk: int = CHUNK) -> DataFrame:
    """One row for each row of docs: key, n_shingles, and component_id, the smallest key reachable by links.

    Words are runs of other characters than space and 0x09-0x0D, A-Z lower-cased; a document's set has its distinct
    n-grams of `size` words, or its whole word sequence if that is shorter. A null or empty text has an empty set and
    is linked with nothing. Equal sets are linked. Rows with equal keys but different texts are judged each by its
    own text, and their key counts as one node. A row whose key is null is returned with its set's size and a null
    component. Other columns are ignored; an empty table gives no rows. The input must give the same rows when it is
    read again, as files do.
    """
    docs = docs.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))
    spark, whole = docs.sparkSession, docs.filter(F.col("doc").isNotNull())
    store = Scratch(spark, "jaccard")
    held = whole.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = min(RANGES, max(4, (held // RANGE_BYTES).bit_length()))
    # Four ranges to a task; the rows that describe slices are spread over all.
    parts = 1 << max(3, bits - 2)
    task = F.when(F.col("range") < 0, F.pmod(F.xxhash64("slice"), F.lit(parts))).otherwise(F.shiftright("range", bits - parts.bit_length() + 1)).cast("int")
    dealt = whole.mapInArrow(_deal(size, bits), "range long, slice long, blob binary").repartitionById(parts, task)
    schema = ", ".join(f"{c} {t}" for c, t in TOLD.items())
    ranges = store.put(dealt.sortWithinPartitions("range").mapInArrow(_shared(bits, max(1, FREQUENT >> bits)), schema))
    often = [(r["range"], bytes(r["often"])) for r in ranges.filter("often is not null").select("range", "often").toLocalIterator()]
    slices = ranges.filter("slice is not null").select("slice", "places", "counts")
    many = held >> 30  # a task for each GB of text, where that is more than there are anyway
    slices = slices.repartition(many, "slice") if many > int(spark.conf.get("spark.sql.shuffle.partitions")) else slices.repartition("slice")
    known = store.put(slices.sortWithinPartitions("slice").mapInArrow(_totals(percent), "doc long, n long, one long, two long, can boolean"))
    store.drop(ranges)

    copies = store.put(known.filter("can").groupBy("n", "one", "two").agg(F.min("doc").alias("rep")))
    reps = store.put(copies.groupBy(F.col("rep").alias("doc")).agg(F.sum("n").alias("n")))
    texts = store.put(whole.join(told(reps.select("doc")), "doc", "left_semi"))
    cells = spark.sparkContext.broadcast(_cells(often))
    shared = store.put(texts.mapInArrow(_prefixes(size, percent, bits, cells), "gram long, a long, b long"))
    across = shared.filter("gram is not null").select("gram", "a")
    across = join_hot(across, across.groupBy("gram").agg(F.min("a").alias("b")), "gram", F.xxhash64("a")).select("a", "b").filter("a <> b")
    groups = connected_components(shared.filter("gram is null").select("a", "b").union(across), into=store)
    store.drop(shared)

    members = store.put(groups.select(F.col("node").alias("doc"), F.col("component").alias("group")).join(reps, "doc").withColumn("w", F.col("n") + 300))
    weights = members.groupBy("group").agg(F.sum("w").alias("all"))
    members = store.put(join_hot(members, weights, "group", F.xxhash64("doc")))
    join = _Joiner(store, texts, size, percent, chunk, (bits, cells), members.agg(F.sum("w")).first()[0] or 0)
    links = join.links(members.filter(F.col("all") <= chunk).select("doc", F.col("group").alias("i"), F.col("group").alias("j"), F.lit(0).alias("side")))
    large = members.filter(F.col("all") > chunk).drop("all")
    if not large.isEmpty():
        links = links.union(_in_chunks(join, store.put(large)))
    joined = connected_components(links, into=store)

    final = copies.join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left")
    final = final.select("n", "one", "two", F.coalesce("component", "rep").alias("component"))
    found = join_hot(known.filter("can"), final, ["n", "one", "two"], F.xxhash64("doc")).select("doc", "n", "component")
    rest = known.filter("not can").select("doc", "n", F.col("doc").alias("component"))
    nameless = docs.filter(F.col("doc").isNull()).mapInArrow(_sizes(size), "n long").select(F.lit(None).cast("long").alias("doc"), "n", F.lit(None).cast("long").alias("component"))
    out = store.put(found.union(rest).union(nameless))
    store.clear(out)
    return out.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


class _Joiner:
    """Joins signature trees of stated documents of `texts`."""

    def __init__(self, store: Scratch, texts: DataFrame, size: int, percent: int, chunk: int, known: tuple[int, Broadcast[np.ndarray]], weight: int) -> None:
        self.store, self.texts, self.size, self.percent, self.chunk, self.known = store, texts, size, percent, chunk, known
        self.tasks = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-weight // chunk))

    def links(self, dealt: DataFrame) -> DataFrame:
        """(a, b) between documents of each chunk, or of each two chunks. dealt: (doc, i, j, side)."""
        rows = self.texts.join(dealt, "doc").select("i", "j", "side", "doc", "text").repartition(self.tasks, "i", "j")
        return self.store.put(rows.sortWithinPartitions("i", "j", "doc").mapInArrow(_join(self.size, self.percent), "a long, b long"))

    def prefixes(self, docs: DataFrame) -> DataFrame:
        return self.store.put(self.texts.join(told(docs.select("doc").distinct()), "doc", "left_semi").mapInArrow(_prefix_rows(self.size, self.percent, *self.known), "doc long, gram long"))


def _in_chunks(join: _Joiner, large: DataFrame) -> DataFrame:
    """(a, b) that connect what is linked in groups too large for a tree. large: (doc, group, n, w).

    Linked documents are in one size class or in neighbouring ones and share a prefix n-gram. A chunk has documents of
    one class whose prefixes have the same least n-gram, or several such; a part only, if these alone are too many.
    """
    store, half = join.store, max(1, join.chunk // 2)
    # A little wider than the limit on sizes, so that rounding cannot set two linked documents two classes apart.
    large = store.put(large.withColumn("class", F.floor(F.log("n") / float(np.log(100 / join.percent) * 1.000001)).cast("int")))
    grams = join.prefixes(large)
    links = None
    for seed in range(CUTS):
        least = grams.groupBy("doc").agg(F.min(F.xxhash64("gram", F.lit(seed))).alias("least"))
        placed = store.put(large.join(least, "doc").withColumn("of", F.xxhash64("group", "class")).withColumn("cell", F.xxhash64("of", "least")))
        cells = store.put(placed.groupBy("cell", "of").agg(F.sum("w").alias("w")))
        light = cells.filter(F.col("w") <= half).groupBy("of").agg(F.sum("w").alias("light"))
        cells = join_hot(cells, light, "of", F.xxhash64("cell"), how="left")
        parts = F.when(F.col("w") > half, F.ceil(F.col("w") / half)).otherwise(1).cast("long")
        home = F.when(F.col("w") > half, F.col("cell")).otherwise(F.xxhash64("of", F.pmod(F.xxhash64("cell", F.lit(seed)), F.ceil(F.col("light") / half).cast("long"))))
        cells = cells.groupBy("cell").agg(F.max(parts).alias("parts"), F.max(home).alias("home"))
        chunk = F.xxhash64("home", F.pmod(F.xxhash64("doc", F.lit(seed)), F.col("parts")))
        placed = store.put(join_hot(placed, cells, "cell", F.xxhash64("doc")).select("doc", "group", "class", chunk.alias("chunk")))
        found = join.links(placed.select("doc", F.col("chunk").alias("i"), F.col("chunk").alias("j"), F.lit(0).alias("side")))
        links = found if links is None else links.union(found)
    labels = connected_components(links, into=store)
    placed = placed.join(labels.withColumnRenamed("node", "doc"), "doc", "left").withColumn("label", F.coalesce("component", "doc"))
    where = store.put(grams.join(placed.drop("component"), "doc").withColumn("g", F.xxhash64("gram", "group")).drop("gram", "group"))
    several = where.groupBy("g").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("g")
    where = store.put(join_hot(where, several, "g", F.xxhash64("doc")))
    spots = where.groupBy("g", "class", "chunk").agg(F.min("label").alias("low"), F.max("label").alias("high")).withColumnRenamed("chunk", "other")
    near = where.withColumn("class", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)))
    near = near.join(spots, ["g", "class"]).filter("other <> chunk and (low <> label or high <> label)").select("doc", "chunk", "other").distinct()
    return links.union(join.links(near.select("doc", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), (F.col("chunk") > F.col("other")).cast("int").alias("side"))))


def _sizes(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(s) for s in _read(batch.column(1), size)], pa.int64())], ["n"])

    return releasing(run)


#: The same rows by comparing all documents that share a shingle; doc_id is never repeated in the test tables.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM w
), x AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM g
), link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
  SELECT a, b FROM link
  UNION
  SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
)
SELECT g.doc_id, len(s) AS n_shingles, coalesce(least(g.doc_id, min(reach.b)), g.doc_id) AS component_id
FROM g LEFT JOIN reach ON g.doc_id = reach.a GROUP BY g.doc_id, s
"""
