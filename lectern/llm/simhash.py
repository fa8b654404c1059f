"""SimHash near-duplicates by a binary trie self-join (operator 4).

``groups`` links fingerprints themselves: two are linked if they differ in
``budget`` bits at most.  ``near_copies`` uses the same self-join to find
candidates for a similarity of shingle sets: several fingerprints of a text, a
candidate wherever one of them is near, and a check of the sets afterwards.

Defined results of both: null and empty texts have no shingles, fingerprint 0, and
are copies of each other; repeated rows are each reported; an empty table gives
no rows; further columns are ignored, whatever their names.  Rows with a null
id are reported by ``groups`` (a null is never a component's id unless all of
its ids are null) and take no part in ``near_copies``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import discard, materialise, ragged, text_buffer
from lectern.llm.components import components, forest

#: A-Z to a-z; other bytes stay.
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th hash of the same shingles, 0 being the one given."""
    if not k:
        return hashes
    out = hashes ^ np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out * np.uint64(0x94D049BB133111EB)


def _signs(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    ones = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def shingles(text: bytes, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle of ``width`` words, repeats included; of all words, if they are fewer."""
    words = text.translate(_LOWER).split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= width:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[: n - width] + 1]).tolist()
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist())), np.uint64, n - width + 1)


def fingerprints(documents: DataFrame, width: int = 4, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``fp``, the 64-bit SimHash of all shingles as a signed integer, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            raw = data.tobytes()
            own = np.array([_signs(h) if len(h := shingles(raw[a:b], width, seed)) else 0 for a, b in zip(offsets, offsets[1:])], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.view(np.int64))], ["doc_id", "fp"])

    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


#: Node pairs that one step of the traversal holds at most; more are put aside and taken up later.
_FRONTIER = 1 << 19
#: A pair of nodes with so few pairs of leaves is compared leaf by leaf.
_LEAVES = 16


def trie_pairs(keys: np.ndarray, starts: np.ndarray, depth: int, budget: int, other: np.ndarray | None = None, second: np.ndarray | None = None, most_second: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs of keys that differ in ``budget`` bits at most.

    ``keys`` are sorted within groups that begin at ``starts`` and share their
    first ``depth`` bits; a group is a subtree of a binary trie, a node a range of
    sorted keys.  Pairs of nodes are descended together: equal bits cost
    nothing, crossed ones one, and a pair over the budget is dropped with all
    that hangs below it.  With ``other``, only pairs of keys for which it differs; with ``second``, only
    pairs whose second fingerprints differ in ``most_second`` bits at most.
    """
    ends = np.append(starts[1:], len(keys))
    own = ends - starts > 1
    lo, hi = starts[own], ends[own]
    todo = [(depth, lo, hi, lo, hi, np.zeros(len(lo), np.uint8))] if len(lo) else []
    zeros: dict[int, np.ndarray] = {}
    while todo:
        d, al, ah, bl, bh, cost = todo.pop()
        if len(al) > _FRONTIER:
            k = len(al) // 2
            todo += [(d, *(x[:k] for x in (al, ah, bl, bh, cost))), (d, *(x[k:] for x in (al, ah, bl, bh, cost)))]
            continue
        few = (ah - al) * (bh - bl) <= _LEAVES if d < 64 else np.ones(len(al), bool)
        if few.any():
            na, nb = (ah - al)[few], (bh - bl)[few]
            n = na * nb
            k = ragged(np.zeros(len(n), np.int64), n)
            i, j = np.repeat(al[few], n) + k // np.repeat(nb, n), np.repeat(bl[few], n) + k % np.repeat(nb, n)
            ok = (i < j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
            if other is not None:
                ok &= other[i] != other[j]
            if second is not None:
                ok &= np.bitwise_count(second[i] ^ second[j]) <= most_second
            if ok.any():
                yield i[ok], j[ok]
            al, ah, bl, bh, cost = (x[~few] for x in (al, ah, bl, bh, cost))
        if not len(al):
            continue
        if d not in zeros:
            zeros[d] = np.concatenate([[0], np.cumsum((keys >> np.uint64(63 - d) & np.uint64(1)) == 0)])
        z = zeros[d]
        am, bm = al + z[ah] - z[al], bl + z[bh] - z[bl]
        cross = al != bl
        deeper = []
        for x, allowed in (((al, am, bl, bm, cost), None), ((am, ah, bm, bh, cost), None), ((al, am, bm, bh, cost + 1), None), ((am, ah, bl, bm, cost + 1), cross)):
            ok = (x[1] > x[0]) & (x[3] > x[2]) & (x[4] <= budget) & ((x[1] - x[0] > 1) | (x[0] != x[2]))
            deeper.append(tuple(v[ok if allowed is None else ok & allowed] for v in x))
        todo.append((d + 1, *map(np.concatenate, zip(*deeper))))


def _blocks(n: int) -> list[tuple[int, int]]:
    """First bit and width of ``n`` blocks that make up 64 bits."""
    edge = [64 * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edge, edge[1:])]


def turns(n_blocks: int, agree: int) -> list[list[tuple[int, int]]]:
    """For each choice of ``agree`` blocks: all blocks, the chosen ones first."""
    every = _blocks(n_blocks)
    return [[every[k] for k in c] + [b for k, b in enumerate(every) if k not in c] for c in combinations(range(n_blocks), agree)]


def _turned(fp: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    """Fingerprints with their blocks in another order."""
    out = np.zeros(len(fp), np.uint64)
    for first, width in order:
        out = out << np.uint64(width) | fp >> np.uint64(64 - first - width) & np.uint64((1 << width) - 1)
    return out


def choose_blocks(n: int, budget: int, bucket: int = 2048) -> tuple[int, int]:
    """Number of blocks and of agreeing ones, such that ``n`` even fingerprints leave about ``bucket`` in a subtree.

    One agreeing block serves millions of fingerprints; each further one divides
    subtrees by about a thousand and multiplies the copies of a fingerprint.
    """
    for agree in range(1, 9):
        if n / 2 ** (64 * agree / (budget + agree)) <= bucket:
            break
    return budget + agree, agree


def spanning(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which of the edges between ``a`` and ``b`` make up the minimum spanning forest; equal weights count in the order given."""
    order = np.argsort(weight, kind="stable")
    nodes, place = np.unique(np.concatenate([a[order], b[order]]), return_inverse=True)
    a, b, none = place[: len(order)], place[len(order) :], len(order)
    label, open_, taken = np.arange(len(nodes)), np.arange(len(order)), []
    while True:
        la, lb = label[a[open_]], label[b[open_]]
        apart = la != lb
        open_, la, lb = open_[apart], la[apart], lb[apart]
        if not len(open_):
            return order[np.concatenate([*taken, np.zeros(0, np.int64)]).astype(np.int64)]
        least = np.full((2, len(nodes)), none)
        least[0, la[::-1]], least[1, lb[::-1]] = open_[::-1], open_[::-1]  # the first edge is written last
        best = least.min(0)
        pick = np.unique(best[best < none])
        taken.append(pick)
        label = forest(len(nodes), label[a[pick]], label[b[pick]])[label]


def links(nodes: DataFrame, fps: tuple[str, ...] = ("fp",), budget: int = 4, most_second: int = 64, most: int = 1 << 14) -> DataFrame:
    """Edges ``(a, b)`` between nodes ``id`` that connect all nodes of which one fingerprint differs in ``budget`` bits or fewer.

    With ``most_second`` under 64, the fingerprints that come after the near ones
    in ``fps`` (the first ones, after the last) may differ in so many bits at most.

    Two fingerprints that differ in ``budget`` bits agree in at least ``agree`` of
    ``budget + agree`` blocks.  For each choice of agreeing blocks these are put
    first, so that they name a subtree of the trie, which one task joins with
    itself.  Of the pairs it finds, a task passes on the minimum spanning forest,
    by bits that differ in both fingerprints and then by a hash of the pair: edges
    that most tasks with the same nodes agree on, so a group costs edges in
    proportion to its size.  A subtree of more than ``most`` nodes is cut into
    parts, and every two parts are joined by a task of their own; nothing is
    left out.
    """
    n_blocks, agree = choose_blocks(nodes.count(), budget)
    orders = turns(n_blocks, agree)
    depth = [sum(w for _, w in o[:agree]) for o in orders]
    strict = most_second < 64

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [c.to_numpy().view(np.uint64) for c in batch.columns[1:]]
            for f, fp in enumerate(own):
                second = pa.array(own[(f + 1) % len(own)].view(np.int64) if strict else np.zeros(len(fp), np.int64))
                for k, o in enumerate(orders):
                    key = _turned(fp, o)
                    turn = pa.array(np.full(len(fp), f * len(orders) + k, np.int32))
                    yield pa.RecordBatch.from_arrays([turn, pa.array((key >> np.uint64(64 - depth[k])).view(np.int64)), second, batch.column(0), pa.array(key.view(np.int64))], ["turn", "node", "second", "id", "key"])

    spread_out = nodes.select("id", *fps).mapInArrow(spread, "turn int, node long, second long, id long, key long")
    heavy = materialise(spread_out.groupBy("turn", "node").count().where(F.col("count") > most), "subtrees")
    parts = F.ceil(F.col("count") / (most // 2)).cast("int")

    def join(cut: bool):
        grouped = 3 if cut else 2  # columns that name a subtree, or a pair of its parts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rest: list[np.ndarray] = []
            for batch in batches:
                rest.append(np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], 1))
                if sum(map(len, rest)) >= 1 << 18:
                    rows = np.concatenate(rest)
                    other_group = np.flatnonzero((rows[:, :grouped] != rows[-1, :grouped]).any(1))
                    done = other_group[-1] + 1 if len(other_group) else 0  # the last group may go on
                    yield from found(rows[:done])
                    rest = [rows[done:]]
            if rest:
                yield from found(np.concatenate(rest))

        def found(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            for turn in np.unique(rows[:, 0]).tolist():
                own = rows[rows[:, 0] == turn]
                keys = own[:, -1].copy().view(np.uint64)
                order = np.lexsort((keys, *own[:, 1:grouped].T[::-1]))
                own, keys = own[order], keys[order]
                ids, second = own[:, -2].copy(), own[:, -3].copy().view(np.uint64)
                starts = np.flatnonzero(np.concatenate([[True], (own[1:, :grouped] != own[:-1, :grouped]).any(1)]))
                side = None
                if cut:
                    side = own[:, 3]
                    lone = np.maximum.reduceat(side, starts) == np.minimum.reduceat(side, starts)
                    side = np.where(np.repeat(lone, np.diff(np.append(starts, len(keys)))), np.arange(len(keys)), side)
                a, b, pairs, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
                for i, j in trie_pairs(keys, starts, depth[turn % len(orders)], budget, side, second if strict else None, most_second):
                    pairs.append((i, j))
                    size += len(i)
                    if size > 1 << 20:
                        (a, b), pairs, size = tie(keys, second, ids, [*pairs, (a, b)]), [], 0
                a, b = tie(keys, second, ids, [*pairs, (a, b)])
                a, b = ids[a], ids[b]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        def tie(keys: np.ndarray, second: np.ndarray, ids: np.ndarray, pairs: list) -> tuple[np.ndarray, np.ndarray]:
            a, b = map(np.concatenate, zip(*pairs))
            far = (np.bitwise_count(keys[a] ^ keys[b]) + np.bitwise_count(second[a] ^ second[b])).astype(np.uint64)
            own = spanning(a, b, far << np.uint64(56) | _mixed((ids[a] ^ ids[b]).view(np.uint64), 1) >> np.uint64(8))
            return a[own], b[own]

        return run

    out = "a long, b long"
    if heavy.isEmpty():
        return spread_out.repartition("turn", "node").sortWithinPartitions("turn", "node").mapInArrow(join(False), out)
    light = spread_out.join(heavy, ["turn", "node"], "left_anti").repartition("turn", "node").sortWithinPartitions("turn", "node").mapInArrow(join(False), out)
    cut = spread_out.join(heavy, ["turn", "node"]).withColumn("n", parts).withColumn("part", F.pmod(F.xxhash64("id"), "n").cast("int"))
    rest = ["part", "second", "id", "key"]
    pairs = cut.select("turn", "node", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("q"), *rest).select("turn", "node", (F.least("part", "q") * 65536 + F.greatest("part", "q")).cast("long").alias("pair"), *rest)
    return light.union(pairs.repartition("turn", "node", "pair").sortWithinPartitions("turn", "node", "pair").mapInArrow(join(True), out))


def groups(documents: DataFrame, width: int = 4, budget: int = 4, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``, the smallest id that links reach, for every row.

    Fingerprints are the unit of all that follows: copies are one fingerprint, so
    a group of copies, however large, is one node.  Only the last join meets them
    again; its key may be skewed, which adaptive execution splits.
    """
    docs = materialise(fingerprints(documents, width, seed, doc_id, text), "fingerprints")
    fps = materialise(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(fps.select(F.col("fp").alias("id"), "fp"), budget=budget))
    named = fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = materialise(named, "roots")
    least = materialise(named.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    by_fp = materialise(named.join(least, "root").select("fp", "component_id"), "members")
    discard(fps, roots, named, least)
    return docs.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def _sets(width: int, seed: int, count: int):
    """Arrow step: each text's set of shingles as a hash, and ``count`` fingerprints of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            raw, out = data.tobytes(), np.zeros((len(batch), count + 1), np.uint64)
            for k, (a, b) in enumerate(zip(offsets, offsets[1:])):
                h = np.unique(shingles(raw[a:b], width, seed))
                if len(h):
                    out[k, 0] = _mixed(h, count).sum(dtype=np.uint64)
                    out[k, 1:] = [_signs(_mixed(h, f)) for f in range(count)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c.copy()) for c in out.view(np.int64).T)], ["doc_id", "tie", "id", *(f"fp{f}" for f in range(count))])

    return run


#: Shingles in one part of a group whose sets are all compared.
_TOGETHER = 1 << 20


def similar_pairs(ends: np.ndarray, shingle: np.ndarray, label: np.ndarray, side: np.ndarray | None, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets ``shingle[ends[k]:ends[k + 1]]`` with a Jaccard similarity of ``similarity`` or more that connect all labels so connected.

    A pair of one label, or of labels that earlier pairs connect, is left out; with
    ``side``, only pairs for which it differs count.  Two sets that are so similar
    share one of their rarest shingles, of which only as many are looked up as
    can be missing from the other set, and one; what they find is compared in whole.
    """
    size, n = np.diff(ends), len(ends) - 1
    owner = np.repeat(np.arange(n), size)
    known, code, count = np.unique(shingle, return_inverse=True, return_counts=True)
    rank = np.empty(len(known), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(known))
    code = rank[code]
    code = code[np.lexsort((code, owner))]
    looked_up = size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1
    head = np.flatnonzero(np.arange(len(code)) - ends[owner] < looked_up[owner])
    by_code = head[np.argsort(code[head], kind="stable")]  # and by owner
    first = np.flatnonzero(np.concatenate([[True], np.diff(code[by_code]) != 0])) if len(by_code) else by_code
    length = np.diff(np.append(first, len(by_code)))
    start, before = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
    start[by_code] = np.repeat(first, length)
    before[by_code] = np.arange(len(by_code)) - start[by_code]  # sets ahead with the same shingle
    holder = owner[by_code]
    root, mark = np.unique(label, return_inverse=True)[1], np.zeros(len(known), bool)
    a, b = [], []
    for k in range(n):
        own = slice(ends[k], min(ends[k] + looked_up[k], ends[k + 1]))
        other = holder[ragged(start[own], before[own])]
        other = np.unique(other[root[other] != root[k]])
        other = other[np.minimum(size[other], size[k]) >= similarity * np.maximum(size[other], size[k])]
        if side is not None:
            other = other[side[other] != side[k]]
        if not len(other):
            continue
        mark[code[ends[k] : ends[k + 1]]] = True
        at = np.cumsum(size[other]) - size[other]
        shared = np.add.reduceat(mark[code[ragged(ends[other], size[other])]], at, dtype=np.int64)
        mark[code[ends[k] : ends[k + 1]]] = False
        for j in other[shared >= similarity * (size[other] + size[k] - shared)].tolist():
            if root[j] != root[k]:
                a.append(k)
                b.append(j)
                root[root == root[j]] = root[k]
    return np.array(a, np.int64), np.array(b, np.int64)


def _links_within(groups: DataFrame, similarity: float, together: int = _TOGETHER) -> DataFrame:
    """Edges ``(a, b)`` that connect all sets ``own`` of the same ``near`` that are similar and not of one ``label``.

    A group of more than ``together`` shingles is cut into parts, and every two
    parts are compared by a task of their own.
    """
    sizes = groups.groupBy("near").agg(F.ceil(F.sum(F.size("own")) / F.lit(together)).cast("int").alias("n"))
    cut = groups.join(sizes, "near").withColumn("part", F.pmod(F.xxhash64("id"), F.greatest("n", F.lit(1))).cast("int"))
    paired = cut.select("near", F.explode(F.sequence(F.lit(0), F.greatest("n", F.lit(1)) - 1)).alias("q"), "part", "label", "id", "own")

    def run(rows: pa.Table) -> pa.Table:
        own = rows.column("own").combine_chunks()
        ids, label, side = (rows.column(c).to_numpy() for c in ("id", "label", "part"))
        ends = np.concatenate([[0], np.cumsum(own.value_lengths().to_numpy())]).astype(np.int64)
        a, b = similar_pairs(ends, own.flatten().to_numpy(), label, side if side.min() < side.max() else None, similarity)
        return pa.table({"a": ids[a], "b": ids[b]})

    return paired.withColumn("low", F.least("part", "q")).withColumn("high", F.greatest("part", "q")).drop("q").groupBy("near", "low", "high").applyInArrow(run, "a long, b long")


def near_copies(
    documents: DataFrame, similarity: float = 0.8, width: int = 5, count: int = 5, budget: int = 8, most_second: int = 20, seed: int = 42, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id``, ``tie`` (hash of the text) and ``first``, the smallest ``(doc_id, tie)`` of its group, for every row with an id.

    Texts with the same set of shingles (words in lower case) are copies.  Two
    others are candidates if one of ``count`` fingerprints of their sets differs in
    ``budget`` bits at most, and the next one in ``most_second``; ``links`` passes on
    a spanning forest of candidates, the nearest first.  Of these, links between
    sets with a Jaccard similarity of ``similarity`` or more hold, which is checked
    on the whole sets.  Where some of a forest don't hold, candidates that it
    left out may: there, all sets that candidates connect are compared, but for
    those that links connect already.  So no candidate that is similar enough is
    lost; groups are what links connect.  A document is an id and a text: texts
    that share an id are told apart, rows that repeat both are one document.

    A set is named by a 64-bit hash and a shingle by XXH64.
    """
    names = [f"fp{f}" for f in range(count)]
    source = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("tie"), F.col(text).alias("text")).where("doc_id IS NOT NULL")
    docs = materialise(source.mapInArrow(_sets(width, seed, count), f"doc_id long, tie long, id long, {', '.join(f'{n} long' for n in names)}"), "sets")
    sets = materialise(docs.groupBy("id").agg(F.min(F.struct("doc_id", "tie")).alias("least"), *[F.min(n).alias(n) for n in names]), "distinct")
    edges = materialise(links(sets, tuple(names), budget, most_second).distinct(), "edges")
    involved = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(sets.select("id", "least.*"), "id")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            raw = data.tobytes()
            each = [np.unique(shingles(raw[a:b], width, seed)).view(np.int64) for a, b in zip(offsets, offsets[1:])]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*each, np.zeros(0, np.int64)])))], ["id", "own"])

    texts = source.join(involved, ["doc_id", "tie"]).select("id", "text").mapInArrow(whole, "id long, own array<long>")
    texts = materialise(texts.dropDuplicates(["id"]), "shingles")
    both = edges.join(texts.select(F.col("id").alias("a"), F.col("own").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("own").alias("y")), "b")
    low, high = F.least(F.size("x"), F.size("y")), F.greatest(F.size("x"), F.size("y"))
    shared = F.size(F.array_intersect("x", "y"))
    similar = (low >= similarity * high) & (shared >= similarity * (low + high - shared))
    checked = materialise(both.select("a", "b", similar.alias("holds")), "checked")
    holds = checked.where("holds").select("a", "b")
    roots = components(holds)
    if not checked.where("NOT holds").isEmpty():
        near = components(edges)
        label = F.coalesce(F.col("r.root"), F.col("n.node"))
        labelled = materialise(near.alias("n").join(roots.alias("r"), F.col("n.node") == F.col("r.node"), "left").select(F.col("n.root").alias("near"), F.col("n.node").alias("id"), label.alias("label")), "labelled")
        several = labelled.groupBy("near").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("near")
        apart = materialise(labelled.join(several, "near").join(texts, "id").select("near", "label", "id", "own"), "apart")
        more = materialise(_links_within(apart, similarity), "more")
        before, roots = roots, components(holds.union(more))
        discard(before, near, labelled, apart, more)
    named = materialise(sets.join(roots, F.col("id") == F.col("node"), "left").select("id", "least", F.coalesce("root", "id").alias("root")), "roots")
    least = materialise(named.groupBy("root").agg(F.min("least").alias("first")), "firsts")
    by_set = materialise(named.join(least, "root").select("id", "first"), "members")
    discard(sets, edges, texts, checked, roots, named, least)
    return docs.join(by_set, "id").select("doc_id", "tie", "first")
