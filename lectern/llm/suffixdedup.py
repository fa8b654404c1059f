"""Repeated byte strings by suffix arrays over content shards (operator 7).

Removed is each byte covered by a ``WIDTH``-byte string that also starts in a
document with a smaller id.  The steps, on packs of whole documents:

1. *Anchors.*  Of the ``GRAM``-byte strings inside each window of ``WIDTH`` bytes,
   the one with the least hash, the first of them in a tie, is the window's
   anchor.  Both depend on the window's bytes alone, so equal windows have equal
   anchors, wherever they are.
2. *Shared anchors.*  Hashes of anchors meet by hash range; a bit for each says
   whether it occurs in two documents.  Windows of other anchors can't repeat.
   An anchor with ``CROWD`` different pieces is crowded.
3. *Pieces.*  The windows of a shared anchor are a run; the bytes they span are a
   piece.  Equal pieces of a pack are settled at once: only the smallest id goes on.
   Pieces are dealt to shards by their anchor; a crowded anchor's, which may have
   as many different surroundings as there are documents, window by window, by
   the whole window's hash.
4. *Suffix arrays.*  A shard's pieces are put into arrays of ``ARRAY`` bytes at most.
   Each is sorted by Larsson and Sadakane's refinement (ranks by the first ``h``
   bytes, doubled in groups not yet told apart), Kasai's scan finds the common
   prefixes of neighbours, many lanes of text side by side, and neighbours with
   ``WIDTH`` bytes in common are equal windows.  Where a shard has several arrays,
   their distinct windows are merged by binary search.  The smallest id of equal
   windows settles them.
5. What was found goes back to the packs, where documents are cut.

Anchors meet only by their hashes, so a false meeting costs time, not results;
strings are compared byte by byte.  A pack passes on one entry for an anchor, and
one piece for equal ones, so copies don't pile up anywhere.  Packs and shards are
wide, for there is a row for each of both that have something in common: what is
done in memory goes by slices of a pack and by the ``FINE`` parts of a shard.

Defined results: a null text is empty; rows with a null id take no part and lose
nothing; rows that share an id don't remove from one another; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import discard, materialise, ragged, release, text_buffer

WIDTH, GRAM = 50, 20
#: Bytes of text in a pack, in a slice of one, and for each shard of anchors and pieces; parts of a shard whose pieces are settled in turn.
PACK, SLICE, SHARD, FINE = 16 << 20, 2 << 20, 32 << 20, 4
#: Bytes of pieces in one suffix array, and lanes of Kasai's scan.
ARRAY, LANES = 8 << 20, 1 << 14
#: Different pieces of an anchor (those of each pack, added up) from which its windows are dealt one by one, and number in a pack from which they are counted.
CROWD, COUNTED = 1 << 17, 4
_BASE = 0x9E3779B97F4A7C15


_ZSTD = pa.Codec("zstd", compression_level=6)


def squeeze(data: bytes) -> bytes:
    """Compressed bytes with their length ahead; texts cross shuffles several times, so a higher level pays."""
    return len(data).to_bytes(8, "little") + _ZSTD.compress(data, asbytes=True)


def spread(data: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True), np.uint8)


def gram_hashes(data: np.ndarray, k: int = GRAM) -> np.ndarray:
    """Hash of the ``k`` bytes from each position on, put together from powers of two."""
    if len(data) < k:
        return np.zeros(0, np.uint64)
    n, level, out, used = 1, data.astype(np.uint64) + np.uint64(1), None, 0
    while n <= k:
        if k & n:
            if out is None:
                out, used = level, n
            else:
                m = len(data) - used - n + 1
                out, used = out[:m] * np.uint64(pow(_BASE, n, 1 << 64)) + level[used : used + m], used + n
        if 2 * n <= k:
            level = level[:-n] * np.uint64(pow(_BASE, n, 1 << 64)) + level[n:]
        n *= 2
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ out >> np.uint64(32)


def window_hashes(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Hash of the window at each of ``start``."""
    out = [gram_hashes(data[start[k : k + (1 << 14), None] + np.arange(WIDTH)].reshape(-1), WIDTH)[::WIDTH] for k in range(0, len(start), 1 << 14)]
    return np.concatenate([*out, np.zeros(0, np.uint64)])


def mixed(h: np.ndarray) -> np.ndarray:
    """Anchors' hashes are the least of many, so they crowd at the low end; this spreads them evenly."""
    out = h * np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(31)
    return out * np.uint64(_BASE)


def anchors(data: np.ndarray, offsets: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the texts marked in ``use``: hash, text, first and last window (as starts)."""
    none = (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    if len(data) < WIDTH:
        return none
    h = gram_hashes(data)
    least, at, span, w = h, np.arange(len(h), dtype=np.int32), 1, WIDTH - GRAM + 1
    while span < w:
        step = min(span, w - span)
        right = least[step:] < least[:-step]  # ties go to the left
        least, at = np.where(right, least[step:], least[:-step]), np.where(right, at[step:], at[:-step])
        span += step
    # windows inside one text that is used
    room = np.maximum(0, np.diff(offsets) - WIDTH + 1) * use
    start = ragged(offsets[:-1], room)
    if not len(start):
        return none
    at = at[start].astype(np.int64)
    edge = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)]))
    first, last = start[edge], start[np.append(edge[1:], len(start)) - 1]
    return mixed(h[at[edge]]), np.searchsorted(offsets, first, "right") - 1, first, last


def anchor_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Anchor of each piece: its windows have one in common, so it is that of the first."""
    h = gram_hashes(data)
    at = offsets[:-1, None] + np.arange(WIDTH - GRAM + 1)
    return h[at].min(1) if len(at) else np.zeros(0, np.uint64)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents into rows of many: number, ids, whether they are known, offsets and bytes."""
    ids, known, texts, size, number = [], [], [], 0, 0

    def close():
        nonlocal ids, known, texts, size, number
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype("<i8")
        out = [[number], [np.array(ids, "<i8").tobytes()], [np.array(known, np.uint8).tobytes()], [offsets.tobytes()], [squeeze(b"".join(texts))]]
        ids, known, texts, size, number = [], [], [], 0, number + 1
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), *(4 * [pa.binary()])))], ["number", "ids", "known", "offsets", "data"])

    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            t = (t or "").encode()
            ids.append(i or 0)
            known.append(i is not None)
            texts.append(t)
            size += len(t)
            if size >= PACK or len(ids) >= 1 << 15:
                yield close()
    if ids:
        yield close()


_PACKS = "number long, ids binary, known binary, offsets binary, data binary"


class _Pack:
    """A pack's documents and anchors, found anew from its bytes whenever needed."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.known = np.frombuffer(row["known"], np.uint8).astype(bool)
        self.offsets = np.frombuffer(row["offsets"], "<i8")
        self.data = spread(row["data"])

    def slices(self) -> Iterator[tuple[int, int]]:
        """Runs of whole documents with ``SLICE`` bytes at most (one document at least)."""
        a, n = 0, len(self.ids)
        while a < n:
            b = min(n, max(a + 1, int(np.searchsorted(self.offsets, self.offsets[a] + SLICE, "right")) - 1))
            yield a, b
            a = b

    def find(self) -> None:
        """Anchors in the order of their hash; ``twice`` is true where two of the pack's documents share one."""
        each = []
        for a, b in self.slices():
            at = self.offsets[a]
            h, doc, first, last = anchors(self.data[at : self.offsets[b]], self.offsets[a : b + 1] - at, self.known[a:b])
            each.append((h, doc + a, first + at, last + at))
        h, doc, first, last = map(np.concatenate, zip(*each))
        order = np.argsort(h, kind="stable")
        self.hash, self.doc, self.first, self.last = h[order], doc[order], first[order], last[order]
        new = np.concatenate([[True], self.hash[1:] != self.hash[:-1]]) if len(h) else np.zeros(0, bool)
        self.group = np.flatnonzero(new)
        self.member = np.cumsum(new) - 1
        own = self.ids[self.doc]
        self.twice = np.minimum.reduceat(own, self.group) != np.maximum.reduceat(own, self.group) if len(h) else new

    def different(self) -> tuple[np.ndarray, np.ndarray]:
        """Groups with ``COUNTED`` anchors or more, and how many different pieces they have (by a hash of the first and last window)."""
        size = np.diff(np.append(self.group, len(self.hash)))
        many = np.flatnonzero(size >= COUNTED)
        own = ragged(self.group[many], size[many])
        factors = np.array([pow(_BASE, k + 1, 1 << 64) for k in range(2 * WIDTH)], np.uint64)
        name = np.zeros(len(own), np.uint64)
        for a in range(0, len(own), 1 << 14):
            for k, start in enumerate((self.first, self.last)):
                window = self.data[start[own[a : a + (1 << 14)]][:, None] + np.arange(WIDTH)].astype(np.uint64) + np.uint64(1)
                name[a : a + (1 << 14)] += (window * factors[k * WIDTH : (k + 1) * WIDTH]).sum(1, dtype=np.uint64)
        member = np.repeat(np.arange(len(many)), size[many])
        order = np.lexsort((name, member))
        name, member = name[order], member[order]
        new = np.concatenate([[True], (name[1:] != name[:-1]) | (member[1:] != member[:-1])]) if len(own) else np.zeros(0, bool)
        return many, np.bincount(member[new], minlength=len(many))


def _gather(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bytes of every (first, size), one after the other; by slices, as an index takes eight times their room."""
    return np.concatenate([*(data[ragged(first[k : k + (1 << 15)], size[k : k + (1 << 15)])] for k in range(0, len(first), 1 << 15)), np.zeros(0, np.uint8)])


def _cuts(hashes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard of sorted hashes (by their high bits), and where each shard that occurs begins."""
    shard = ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
    edge = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.zeros(0, np.int64)
    return shard, edge


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(len(batch)):
            yield batch.slice(k, 1).to_pylist()[0]


def _anchor_sets(shards: int):
    """For each pack and shard: distinct hashes, which of them two of the pack's documents share, and places and numbers of those with many pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            p = _Pack(row)
            p.find()
            h = p.hash[p.group]
            shard, edge = _cuts(h, shards)
            many, pieces = p.different()
            out = [[], [], [], [], []]
            for a, b in zip(edge, np.append(edge[1:], len(h))):
                m = slice(*np.searchsorted(many, [a, b]))
                for o, v in zip(out, (int(shard[a]), row["number"], h[a:b].astype("<u4").tobytes(), np.packbits(p.twice[a:b]).tobytes(), np.stack([many[m] - a, pieces[m]]).astype("<u4").tobytes())):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["shard", "number", "hashes", "twice", "many"])

    return run


def _meet(part: pa.Table) -> pa.Table:
    """Which of a shard's hashes occur in two packs, or twice in one, as bits for each pack; and which are crowded (no bits: none)."""
    hashes = [np.frombuffer(b, "<u4") for b in part.column("hashes").to_pylist()]
    sizes = [len(x) for x in hashes]
    twice = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(part.column("twice").to_pylist(), sizes)])
    h = np.concatenate(hashes)
    pieces = np.ones(len(h), np.int64)
    for start, b in zip(np.cumsum(sizes) - sizes, part.column("many").to_pylist()):
        at, number = np.frombuffer(b, "<u4").reshape(2, -1)
        pieces[start + at] = number
    order = np.argsort(h, kind="stable")
    h = h[order]
    group = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    count = np.diff(np.append(group, len(h)))
    flags, crowd = np.zeros(len(h), bool), np.zeros(len(h), bool)
    flags[order] = np.repeat((count > 1) | (np.maximum.reduceat(twice[order], group) > 0), count)
    crowd[order] = np.repeat(np.add.reduceat(pieces[order], group) >= CROWD, count)
    ends = np.cumsum(sizes)
    bits = [[np.packbits(f[end - n : end]).tobytes() if f is flags or f[end - n : end].any() else b"" for end, n in zip(ends, sizes)] for f in (flags, crowd)]
    return pa.table({"number": part.column("number"), "shard": part.column("shard"), "bits": pa.array(bits[0], pa.binary()), "crowd": pa.array(bits[1], pa.binary())})


def _pieces(shards: int):
    """Pieces of shared anchors for the shards; with negative shards, runs of windows that the pack settles itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            p = _Pack(row)
            p.find()
            h = p.hash[p.group]
            shard, edge = _cuts(h, shards)
            fine, _ = _cuts(h, shards * FINE)
            flags, crowd = np.zeros(len(h), bool), np.zeros(len(h), bool)
            replies = {r["shard"]: r for r in row["replies"] or []}
            for a, b in zip(edge, np.append(edge[1:], len(h))):
                r = replies[int(shard[a])]
                flags[a:b] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=b - a).astype(bool)
                if r["crowd"]:
                    crowd[a:b] = np.unpackbits(np.frombuffer(r["crowd"], np.uint8), count=b - a).astype(bool)
            own = np.flatnonzero(flags[p.member])
            doc, first, last, where = p.doc[own], p.first[own], p.last[own], fine[p.member[own]]
            if (alone := crowd[p.member[own]]).any():  # each window for itself
                n = last[alone] - first[alone] + 1
                start = ragged(first[alone], n)
                to, _ = _cuts(mixed(window_hashes(p.data, start)), shards * FINE)
                doc, first, last, where = (np.concatenate([x[~alone], y]) for x, y in ((doc, np.repeat(doc[alone], n)), (first, start), (last, start), (where, to)))
                order = np.argsort(where, kind="stable")
                doc, first, last, where = doc[order], first[order], last[order], where[order]
            size = last - first + WIDTH
            piece = _binary(_gather(p.data, first, size), size).dictionary_encode()
            code = piece.indices.to_numpy()
            ids = p.ids[doc]
            least = np.full(len(piece.dictionary), np.iinfo(np.int64).max)
            np.minimum.at(least, code, ids)
            done = ids > least[code]
            out = [[-1 - row["number"] % shards], [row["number"]], [_spans(doc[done], first[done], last[done])]]
            doc, first, last, where, ids = doc[~done], first[~done], last[~done], where[~done], ids[~done]
            cut = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])) if len(doc) else []
            parts: dict[int, list[tuple[int, bytes]]] = {}
            for a, b in zip(cut, np.append(cut[1:], len(doc))):
                docs, which = np.unique(doc[a:b], return_inverse=True)
                n = last[a:b] - first[a:b] + WIDTH
                head = np.array([b - a, len(docs)], "<u4").tobytes()
                body = b"".join((head, p.ids[docs].astype("<i8").tobytes(), docs.astype("<u4").tobytes(), which.astype("<u2").tobytes(), first[a:b].astype("<u4").tobytes(), n.astype("u1").tobytes(), _gather(p.data, first[a:b], n).tobytes()))
                parts.setdefault(int(where[a]) // FINE, []).append((int(where[a]) % FINE, body))
            for to, bodies in parts.items():
                sizes = np.zeros(FINE, "<u4")
                sizes[[k for k, _ in bodies]] = [len(x) for _, x in bodies]
                for o, v in zip(out, (to, row["number"], squeeze(sizes.tobytes() + b"".join(x for _, x in bodies)))):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.binary()))], ["shard", "number", "body"])

    return run


def _binary(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(values.tobytes())])


def _spans(doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> bytes:
    return np.stack([doc, first, last]).astype("<u4").tobytes()


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Suffixes of ``data`` in order, to the end: Kasai's scan needs more than the first ``WIDTH`` bytes in order.

    Larsson and Sadakane: suffixes are sorted by eight bytes; then those that are
    not alone in their group are sorted by the rank of the suffix ``h`` bytes on,
    and ``h`` doubles.  Groups of one are never touched again.
    """
    n = len(data)
    body = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.zeros(n, np.uint64)
    for k in range(8):
        eight |= body[k : k + n].astype(np.uint64) << np.uint64(56 - 8 * k)
    # suffixes of under eight bytes come before longer ones that go on with zeros
    short = max(0, n - 7)
    first = np.concatenate([np.arange(n - 1, short - 1, -1), np.arange(short)])
    order = first[np.argsort(eight[first], kind="stable")]
    new = np.ones(n + 1, bool)
    new[1:n] = (eight[order[1:]] != eight[order[:-1]]) | (order[1:] >= short) | (order[:-1] >= short)
    rank, h = np.full(n + 1, -1), 8
    heads = np.flatnonzero(new)
    rank[order] = np.repeat(heads[:-1], np.diff(heads))
    open_ = np.flatnonzero(~(new[:-1] & new[1:]))  # places in groups of several
    while len(open_):
        own = order[open_]
        key = rank[own] * (n + 1) + rank[np.minimum(own + h, n)] + 1
        sort = np.argsort(key, kind="stable")
        own, key = own[sort], key[sort]
        order[open_] = own
        new[open_[1:]] |= key[1:] != key[:-1]
        heads = np.where(new[open_], open_, 0)
        rank[own] = np.maximum.accumulate(heads)
        open_ = open_[~(new[open_] & new[open_ + 1])]
        h *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int = WIDTH) -> np.ndarray:
    """Bytes that each suffix in ``order`` shares with the one before it, ``most`` at most; 0 for the first.

    Kasai's scan: in the order of the text, a suffix shares with its neighbour at
    least one byte less than the suffix before it did with its own.  The text is
    cut into lanes, which are scanned side by side, eight bytes at a time.
    """
    n = len(data)
    body = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.zeros(n + 1, np.uint64)
    for k in range(8):  # the first byte is the lowest
        eight[:n] |= body[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    shared = np.zeros(n, np.uint8)
    lane = -(-n // LANES) if n else 1
    at = np.arange(0, n, lane)
    stop, h = np.minimum(at + lane, n), np.zeros(len(at), np.int64)
    while len(at):
        other = before[at]
        a, b = np.minimum(at + h, n), np.minimum(np.maximum(other, 0) + h, n)
        differ = eight[a] ^ eight[b]
        low = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, (np.bitwise_count(low - np.uint64(1)) >> 3)).astype(np.int64)
        same = np.minimum(same, np.minimum(n - a, n - b))  # no byte beyond the text
        same[other < 0] = 0
        h += same
        go_on = (same == 8) & (h < most)
        done = ~go_on
        h[done] = np.minimum(h[done], most)
        shared[at[done]] = h[done]
        h[done] = np.maximum(h[done] - 1, 0)
        at = at + done
        open_ = at < stop
        at, stop, h = at[open_], stop[open_], h[open_]
    return shared[order]


def equal_windows(data: np.ndarray, starts: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Windows ``starts`` (their places in that list) in the order of the suffix array, and where each group of equal ones begins."""
    order = suffix_array(data)
    shared = common_prefixes(data, order, width)
    group = np.cumsum(shared < width)
    place = np.full(len(data), -1)
    place[starts] = np.arange(len(starts))
    window = place[order]
    own = window >= 0
    window, group = window[own], group[own]
    return window, np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(window) else np.zeros(0, np.int64)


def least_of_equal(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Start of every window in the pieces at ``offsets``, and the least of the ``ids`` of pieces that hold an equal window.

    Pieces go into suffix arrays of ``ARRAY`` bytes at most (one piece at least);
    where there are several, each finds its distinct windows in all others' by
    binary search in one sorted list.
    """
    windows = np.maximum(0, np.diff(offsets) - width + 1)
    starts, owner = ragged(offsets[:-1], windows), np.repeat(np.arange(len(windows)), windows)
    found = ids[owner]
    bounds, k = [0], 0
    while k < len(ids):
        k = max(k + 1, int(np.searchsorted(offsets, offsets[k] + ARRAY, "right")) - 1)
        bounds.append(min(k, len(ids)))
    keys, least, parts = np.zeros(0, f"S{width}"), np.zeros(0, np.int64), []
    for a, b in zip(bounds, bounds[1:]):
        mine = slice(*np.searchsorted(owner, [a, b]))
        text, at = data[offsets[a] : offsets[b]], starts[mine] - offsets[a]
        order, group = equal_windows(text, at, width)
        if not len(order):
            continue
        size = np.diff(np.append(group, len(order)))
        low = np.minimum.reduceat(found[mine][order], group)
        found[mine.start + order] = np.repeat(low, size)
        if len(bounds) > 2:
            own = np.frombuffer(text[at[order[group]][:, None] + np.arange(width)].tobytes(), f"S{width}")  # sorted, as the array is
            parts.append((mine.start + order, size, own))
            to = np.searchsorted(keys, own)
            known = to < len(keys)
            known[known] = keys[to[known]] == own[known]
            least[to[known]] = np.minimum(least[to[known]], low[known])
            keys, least = np.insert(keys, to[~known], own[~known]), np.insert(least, to[~known], low[~known])
    for order, size, own in parts:
        found[order] = np.repeat(least[np.searchsorted(keys, own)], size)
    return starts, found


def _settle(part: pa.Table) -> pa.Table:
    """Runs of windows of a shard's pieces that also start in a document with a smaller id."""
    if part.column("shard")[0].as_py() < 0:
        return part.select(["number", "body"])
    numbers, blobs = part.column("number").to_pylist(), part.column("body").to_pylist()
    del part
    spans: list[list[bytes]] = [[] for _ in numbers]
    raw = [spread(b) for b in blobs]
    del blobs
    ends = np.stack([np.cumsum(np.append(4 * FINE, b[: 4 * FINE].view("<u4").astype(np.int64))) for b in raw])
    for f in range(FINE):
        own = np.flatnonzero(ends[:, f + 1] > ends[:, f])
        if len(own):
            for k, found in _settle_part([raw[k][ends[k, f] : ends[k, f + 1]].tobytes() for k in own]):
                spans[own[k]].append(found)
    out = [(n, _spans(*np.concatenate([np.frombuffer(x, "<u4").reshape(3, -1) for x in own], 1))) for n, own in zip(numbers, spans) if own]
    return pa.table({"number": pa.array([o[0] for o in out], pa.int64()), "body": pa.array([o[1] for o in out], pa.binary())})


def _settle_part(blobs: list[bytes]) -> list[tuple[int, bytes]]:
    """Place of a pack's pieces in ``blobs``, and its runs of such windows; all pieces of an anchor are in one part."""
    heads: list[tuple] = []
    bodies: list[np.ndarray] = []
    for k, b in enumerate(blobs):
        n, m = (int(x) for x in np.frombuffer(b, "<u4", 2))
        b = memoryview(b)[8:]
        ids, doc, which = np.frombuffer(b, "<i8", m), np.frombuffer(b, "<u4", m, 8 * m).astype(np.int64), np.frombuffer(b, "<u2", n, 12 * m)
        first, size = np.frombuffer(b, "<u4", n, 12 * m + 2 * n).astype(np.int64), np.frombuffer(b, "u1", n, 12 * m + 6 * n).astype(np.int64)
        heads.append((np.full(n, k), ids[which], doc[which], first, size))
        bodies.append(np.frombuffer(b, np.uint8, -1, 12 * m + 7 * n))
    blob, ids, doc, first, size = (np.concatenate(x) for x in zip(*heads))
    piece = _binary(np.concatenate(bodies), size).dictionary_encode()
    del bodies, blobs
    code, n = piece.indices.to_numpy(), len(piece.dictionary)
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, code, ids)
    # pieces are compared only where an anchor has several
    data, offsets = text_buffer(piece.dictionary)
    h = anchor_hashes(data, offsets)
    by_anchor = np.argsort(h, kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], np.diff(h[by_anchor]) != 0]))
    count = np.diff(np.append(edge, n))
    several = np.sort(by_anchor[np.repeat(count > 1, count)])
    data, offsets = text_buffer(piece.dictionary.take(pa.array(several)))
    windows = np.diff(offsets) - WIDTH + 1
    starts, smallest = least_of_equal(data, offsets, least[several])
    owner = np.repeat(several, windows)
    gone = least[owner] > smallest
    # runs of such windows in each piece
    inner = starts - np.repeat(offsets[:-1], windows)
    edge = np.flatnonzero(gone & np.concatenate([[True], ~gone[:-1] | (owner[1:] != owner[:-1])]))
    stop = np.flatnonzero(gone & np.concatenate([~gone[1:] | (owner[1:] != owner[:-1]), [True]]))
    run_piece, a, b = owner[edge], inner[edge], inner[stop]
    per = np.bincount(run_piece, minlength=n)
    head = np.cumsum(per) - per
    whole = ids > least[code]
    part_of = np.where(whole, 0, per[code])
    at = ragged(head[code], part_of)
    rows = np.repeat(np.arange(len(code)), part_of)
    rows, a, b = np.concatenate([rows, np.flatnonzero(whole)]), np.concatenate([a[at], np.zeros(whole.sum(), np.int64)]), np.concatenate([b[at], size[whole] - WIDTH])
    sort = np.argsort(blob[rows], kind="stable")
    rows, a, b = rows[sort], a[sort], b[sort]
    cut = np.flatnonzero(np.concatenate([[True], np.diff(blob[rows]) != 0])) if len(rows) else []
    return [(int(blob[rows[x]]), _spans(doc[rows[x:y]], first[rows[x:y]] + a[x:y], first[rows[x:y]] + b[x:y])) for x, y in zip(cut, np.append(cut[1:], len(rows)))]


_DONE = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents without their removed bytes."""
    for row in _rows(batches):
        p = _Pack(row)
        runs = np.concatenate([np.zeros((3, 0), "<u4"), *(np.frombuffer(body, "<u4").reshape(3, -1) for body in row["bodies"] or [])], 1).astype(np.int64)
        runs = runs[:, np.argsort(runs[0], kind="stable")]
        for x, y in p.slices():
            at = p.offsets[x]
            data, offsets = p.data[at : p.offsets[y]], p.offsets[x : y + 1] - at
            _, first, last = runs[:, slice(*np.searchsorted(runs[0], [x, y]))]
            change = np.zeros(len(data) + 1, np.int32)
            np.add.at(change, first - at, 1)
            np.add.at(change, last - at + WIDTH, -1)
            gone = np.cumsum(change)[:-1] > 0
            keep = np.concatenate([[0], np.cumsum(~gone)])
            inside = np.ones(len(data) + 1, bool)
            inside[offsets] = False  # runs end with their document
            edge = np.flatnonzero(gone & ~(np.concatenate([[False], gone[:-1]]) & inside[:-1]))
            stop = np.flatnonzero(gone & ~(np.concatenate([gone[1:], [False]]) & inside[1:])) + 1
            doc = np.searchsorted(offsets, edge, "right") - 1
            # empty texts share their offset with the next one
            spans = pa.StructArray.from_arrays([pa.array(edge - offsets[doc]), pa.array(stop - offsets[doc])], ["start", "end"])
            per = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=y - x))]).astype(np.int32)
            size = np.diff(keep[offsets])
            yield pa.RecordBatch.from_arrays([pa.array(p.ids[x:y], mask=~p.known[x:y]), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(per), spans), _binary(data[~gone], size)], ["doc_id", "n_bytes", "spans", "kept"])


def remove_repeats(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes``, the removed ``spans`` and the ``kept`` bytes of every row."""
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    packs = docs.mapInArrow(_pack, _PACKS).withColumn("number", F.col("number") + F.shiftleft(F.spark_partition_id().cast("long"), 32))
    packs = materialise(packs, "packs")
    total = documents.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0)).alias("n")).first()["n"]
    shards = max(64, -(-total // SHARD))
    sets = packs.mapInArrow(_anchor_sets(shards), "shard int, number long, hashes binary, twice binary, many binary")
    replies = sets.groupBy("shard").applyInArrow(_meet, "number long, shard int, bits binary, crowd binary")
    by_pack = replies.groupBy("number").agg(F.collect_list(F.struct("shard", "bits", "crowd")).alias("replies"))  # a bit for each anchor of a pack
    by_pack = materialise(by_pack, "replies")
    release(documents.sparkSession)  # what was shuffled up to here is not needed again
    found = packs.join(by_pack, "number", "left").mapInArrow(_pieces(shards), "shard long, number long, body binary")
    runs = found.groupBy("shard").applyInArrow(_settle, "number long, body binary")
    gone = materialise(runs.groupBy("number").agg(F.collect_list("body").alias("bodies")), "runs")  # runs within a pack
    discard(by_pack)
    release(documents.sparkSession)
    return packs.join(gone, "number", "left").mapInArrow(_cut, _DONE)
