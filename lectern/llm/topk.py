"""Exact top-k inner products by norm-bucketed retrieval (operator 9).

Vectors are dealt out by descending length, so a partition holds a few buckets
of vectors of like length.  For a query ``q`` whose k-th best score so far is
``t``, a bucket whose longest vector is ``l`` can matter only if a vector's
cosine with ``q`` reaches ``c = t / (|q| l)``:

* ``c > 1``: the bucket is skipped;
* ``c`` is high: coordinate pruning.  On the query's strongest coordinate a
  candidate's unit vector must lie in an interval that ``c`` fixes; the bucket's
  vectors are looked up by this coordinate;
* else: length pruning.  Only the bucket's leading vectors, with ``|p| >= t / |q|``.

Candidates are verified by their integer products.  Bounds are loosened by a
relative ``1e-9`` against rounding, so nothing is lost.

The queries are dealt into blocks of about ``BLOCK`` bytes, as many as it takes.
A block is sent to the executors, starts from scores against the longest
vectors of all, and is searched ``STEP`` queries at a time inside the tasks.  With
more than one block, each one's best rows are written before the next is sent,
so plans and memory don't grow with the number of queries.

Defined results: vectors that are null, or hold a null or non-finite component,
or have a null id take no part; a query is not its own candidate, so rows that
repeat its id aren't either; an id with several vectors asks with the least of
them, component by component; ties go to the smaller id; equal rows are
candidates each; only vectors of the query's dimension are candidates; further
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import discard, materialise

#: Bytes of queries sent at once, queries searched at once, and vectors in a bucket.
BLOCK, STEP, BUCKET = 32 << 20, 1024, 2048
#: Vectors of greatest length that give first thresholds.
PILOT = 2048
#: Local cosine threshold from which coordinates prune better than lengths.
COSINE = 0.75
_SLACK = 1e-9


class Best:
    """The k best (score, smaller id) of each query."""

    def __init__(self, ids: np.ndarray, k: int, floor: np.ndarray | None = None):
        n = len(ids)
        self.own, self.k = ids, k
        self.query, self.vec, self.score = (np.zeros(0, np.int64) for _ in range(3))
        self.floor = np.full(n, np.iinfo(np.int64).min) if floor is None else floor.copy()

    def add(self, query: np.ndarray, vec: np.ndarray, score: np.ndarray) -> None:
        ok = (score >= self.floor[query]) & (vec != self.own[query])
        if not ok.any():
            return
        q, v, s = (np.concatenate([a, b[ok]]) for a, b in ((self.query, query), (self.vec, vec), (self.score, score)))
        order = np.lexsort((v, -s, q))
        q, v, s = q[order], v[order], s[order]
        first = np.searchsorted(q, q)
        rank = np.arange(len(q)) - first
        keep = rank < self.k
        last = rank == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], s[last])
        self.query, self.vec, self.score = q[keep], v[keep], s[keep]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products of all rows; by floating point where that is exact."""
    most = max(1, np.abs(a).max(initial=0)) * max(1, np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if float(most) < 2**53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


def search_bucket(best: Best, queries: np.ndarray, lengths: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
    """Offer a bucket's vectors to all queries."""
    own = np.sqrt((vectors.astype(float) ** 2).sum(1))
    order = np.argsort(-own, kind="stable")
    ids, vectors, own = ids[order], vectors[order], own[order]
    floor = np.where(best.floor == np.iinfo(np.int64).min, -np.inf, best.floor.astype(float))
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(lengths * own[0] > 0, floor / (lengths * own[0]), np.where(floor > 0, np.inf, -np.inf))
    open_ = np.flatnonzero(local <= 1 + _SLACK)
    strong = open_[(local[open_] >= COSINE)]
    by_length = open_[local[open_] < COSINE]
    if len(by_length):
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(floor[by_length] > 0, floor[by_length] / lengths[by_length], 0) * (1 - _SLACK)
        reach = np.searchsorted(-own, -need, "right")
        n = int(reach.max())
        score = products(queries[by_length], vectors[:n])
        q, v = np.nonzero((score >= best.floor[by_length][:, None]) & (np.arange(n) < reach[:, None]))
        best.add(by_length[q], ids[v], score[q, v])
    if len(strong):
        unit = vectors / np.where(own > 0, own, 1)[:, None]
        axis = np.abs(queries[strong]).argmax(1)
        for f in np.unique(axis):
            column = np.argsort(unit[:, f], kind="stable")
            at = unit[column, f]
            for q in strong[axis == f]:
                x, c = queries[q, f] / lengths[q], min(1.0, local[q])
                spread = np.sqrt(max(0.0, 1 - x * x) * max(0.0, 1 - c * c)) + 1e-7
                low = x * c - spread if x > -c else -1.0  # a vector along -axis still has cosine -x with the query
                high = x * c + spread if x < c else 1.0
                i, j = np.searchsorted(at, low, "left"), np.searchsorted(at, high, "right")
                if j > i:
                    who = column[i:j]
                    best.add(np.full(len(who), q), ids[who], products(queries[q : q + 1], vectors[who])[0])


def _matrix(batch: pa.RecordBatch, name: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors of a list column, by dimension."""
    column = batch.column(batch.schema.get_field_index(name))
    size = np.diff(column.offsets.to_numpy())
    flat, begin = column.values.to_numpy(), column.offsets.to_numpy()[:-1]
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        yield rows, flat[begin[rows][:, None] + np.arange(n)].astype(np.int64).reshape(len(rows), n)


def whole(embeddings: DataFrame, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id``, ``v`` (components times ``scale``, rounded down) and ``norm2`` of all rows that take part."""
    x = F.col("x")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    rows = embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x")).where(F.col("vec_id").isNotNull() & x.isNotNull() & ~bad)
    rows = rows.select("vec_id", F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))
    return rows.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))


def top_k(embeddings: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score``; ``is_query`` is a condition on ``vec_id``."""
    rows = whole(embeddings, scale)
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    size = queries.agg(F.coalesce(F.sum(F.size("v") * 8 + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK))
    context = embeddings.sparkSession.sparkContext
    pilot = rows.orderBy(F.desc("norm2"), "vec_id").limit(PILOT).select("vec_id", "v").toArrow().combine_chunks()
    dealt = rows.repartitionByRange(F.desc("norm2"), "vec_id").sortWithinPartitions(F.desc("norm2"), "vec_id").select("vec_id", "v")
    if blocks > 1:  # read again for each block
        dealt, queries = materialise(dealt, "vectors"), materialise(queries, "queries")
    parts = []
    for block in range(blocks):
        own = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block)
        sent = context.broadcast(_prepared(own.toArrow(), pilot, k))
        found = dealt.mapInArrow(_searcher(sent, k), "query_id long, vec_id long, score long")
        if blocks > 1:
            found = materialise(found, "found")
            sent.destroy()
        parts.append(found)
    if blocks > 1:
        discard(dealt, queries)
    every = parts[0] if blocks == 1 else embeddings.sparkSession.read.schema(parts[0].schema).parquet(*[p._written_at for p in parts])
    ranked = every.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _prepared(queries: pa.Table, pilot: pa.Table, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, vectors and first thresholds of a block's queries, ``STEP`` of one dimension at a time."""
    by_size: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in queries.to_batches():
        for at, m in _matrix(batch, "v"):
            by_size.setdefault(m.shape[1], []).append((batch.column(0).to_numpy()[at], m))
    out = []
    for n, held in by_size.items():
        every, vectors = np.concatenate([i for i, _ in held]), np.concatenate([m for _, m in held])
        for a in range(0, len(every), STEP):
            ids, m = every[a : a + STEP], vectors[a : a + STEP]
            best = Best(ids, k)
            for batch in pilot.to_batches():
                for at, p in _matrix(batch, "v"):
                    if p.shape[1] == n:
                        search_bucket(best, m, np.sqrt((m.astype(float) ** 2).sum(1)), batch.column(0).to_numpy()[at], p)
            out.append((ids, m, best.floor))
    return out


def _searcher(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = [(m, np.sqrt((m.astype(float) ** 2).sum(1)), Best(ids, k, floor)) for ids, m, floor in sent.value]
        for batch in batches:
            for i in range(0, len(batch), BUCKET):
                bucket = batch.slice(i, BUCKET)
                for at, vectors in _matrix(bucket, "v"):
                    for m, lengths, best in state:
                        if vectors.shape[1] == m.shape[1]:
                            search_bucket(best, m, lengths, bucket.column(0).to_numpy()[at], vectors)
        for _, _, best in state:
            yield pa.RecordBatch.from_arrays([pa.array(best.own[best.query]), pa.array(best.vec), pa.array(best.score)], ["query_id", "vec_id", "score"])

    return run
