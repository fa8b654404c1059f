"""Token ids and exact token counts of whole texts (operators 3 and 6).

Both split texts into the pieces of the tokenizer's pattern with array
operations, and run the prefix dynamic programme of ``bytepair`` once for each
distinct piece that a task (in counting, a worker) meets.  What is kept of a piece: for encoding its
ids, for counting the number of tokens and the last token's length at every
byte.  No shuffle; a task's memory is bounded by one slice of text (one text, if
it is longer) and the bytes of the piece cache.

Defined results: a null or empty text has no tokens; repeated rows are
encoded each; an empty table gives no rows; further columns are passed through
by ``encode`` and ``count`` unless they are named as an added column, which
then replaces them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lectern.llm.bytepair import PATTERN, PieceCache, Pieces, Vocabulary, check_pattern, encode_texts, vocabulary
from lectern.llm.common import give_back, slices, text_buffer

_caches: dict[tuple, PieceCache] = {}


def _ids(v: Vocabulary) -> PieceCache:
    """Ids of pieces; a special token's string, which is a piece by itself, has one id."""
    marks = {s.encode(): [i] for s, i in v.special.items()}

    def of(pieces: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
        plain = v.encode_pieces([p for p in pieces if p not in marks]) | marks
        each = [plain[p] for p in pieces]
        return [np.fromiter(chain.from_iterable(each), np.int32)], np.fromiter(map(len, each), np.int64, len(each))

    return PieceCache(of)


def _prefixes(v: Vocabulary) -> PieceCache:
    """For every prefix of a piece but the empty one: how many tokens it has, and the length of its last token.

    A special token's string is one token, at any of its bytes.
    """
    marks = {s.encode() for s in v.special}

    def of(pieces: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
        size, found = v.sizes, {m: ([1] * len(m), list(range(1, len(m) + 1))) for m in marks}
        for data, last, counts in v.tables(p for p in pieces if p not in marks):
            found[data] = counts[1:], [size[t] for t in last[1:]]
        each = [found[p] for p in pieces]
        return [np.fromiter(chain.from_iterable(e[k] for e in each), np.int32) for k in (0, 1)], np.fromiter(map(len, pieces), np.int64, len(pieces))

    return PieceCache(of, 2)


def worker_cache(path: str, make):
    """One cache of a kind for each vocabulary in a Python worker, kept from task to task."""
    if (make, path) not in _caches:
        _caches[make, path] = make(vocabulary(path))
    return _caches[make, path]


def forget_ids() -> None:
    """Drop the pieces that ``encode`` has kept.  In the pipeline, workers that kept them took their executor over 3 GB in the stages of the next run."""
    for key in [k for k in _caches if k[0] is _ids]:
        del _caches[key]
    give_back()


def _with(df: DataFrame, fields: list[T.StructField]) -> tuple[DataFrame, T.StructType]:
    kept = df.drop(*[f.name for f in fields])
    return kept, T.StructType([*kept.schema.fields, *fields])


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    if kind == pa.binary():
        return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values.tobytes())])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind.value_type))


def _append(part: pa.RecordBatch, names: list[str], added: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*part.columns, *added], [*part.schema.names, *names])


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """Add the token ids of every text, and with ``decoded`` also the bytes decoded from these ids.

    ``path`` names a vocabulary file that every executor can open, ``pattern`` the
    pattern that it is used with; any but the one that ``bytepair`` knows is refused.
    """
    check_pattern(pattern)
    fields = [T.StructField(ids, T.ArrayType(T.IntegerType(), False))] + ([T.StructField(decoded, T.BinaryType())] if decoded else [])
    source, schema = _with(df, fields)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, cache = vocabulary(path), worker_cache(path, _ids)
        for batch in batches:
            for part in slices(batch, text):
                data, offsets = text_buffer(part.column(part.schema.get_field_index(text)))
                flat, ends = encode_texts(data, offsets, v.special, cache)
                added = [lists(flat, ends, pa.list_(pa.int32()))]
                if decoded:
                    back, width = v.decode(flat)
                    added.append(lists(back, np.concatenate([[0], np.cumsum(width)])[ends], pa.binary()))
                yield _append(part, [f.name for f in fields], added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from encoded(batches)
        finally:
            forget_ids()

    return source.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the bytes that token ids stand for; null ids give empty bytes."""
    fields = [T.StructField(decoded, T.BinaryType())]
    source, schema = _with(df, fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            each = [np.array(x or [], np.int64) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield _append(batch, [decoded], [pa.array([v.decode(x)[0].tobytes() for x in each], pa.binary())])

    return source.mapInArrow(run, schema)


class PrefixCounts:
    """Token counts of every prefix of some texts, as sums over pieces and a stored table for each distinct piece.

    A prefix that ends inside a piece counts the tokens of that part of the piece;
    pieces are those of the whole text.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, v: Vocabulary, cache: PieceCache):
        self.offsets, self.pieces = offsets, Pieces(data, offsets, v.special)
        (self.counts, self.widths), self.begin, self.size = cache(self.pieces.distinct)
        #: tokens before each piece
        self.until = np.concatenate([[0], np.cumsum(self.counts[self.begin + self.size - 1][self.pieces.codes])])
        self.first = self.until[self.pieces.rows[:-1]]

    def total(self) -> np.ndarray:
        return np.diff(self.until[self.pieces.rows])

    def at(self, position: np.ndarray) -> np.ndarray:
        """Tokens of the first ``position`` bytes of every text (all of it, if it has no more)."""
        here = np.minimum(self.offsets[:-1] + np.maximum(position, 0), self.offsets[1:])
        k = np.searchsorted(self.pieces.starts, here, "right") - 1
        inside = here - self.pieces.starts[np.minimum(k, len(self.pieces.starts) - 1)]
        part = np.zeros(len(here), np.int64)
        cut = np.flatnonzero(inside > 0)
        part[cut] = self.counts[self.begin[self.pieces.codes[k[cut]]] + inside[cut] - 1]
        return self.until[k] + part - self.first

    def cut(self, row: int, limit: int) -> int:
        """Bytes of the first ``limit`` tokens of a text that has more."""
        p, first = self.pieces, int(self.pieces.rows[row])
        k = int(np.searchsorted(self.until[first : int(p.rows[row + 1]) + 1], self.first[row] + limit, "right")) - 1 + first
        left = int(self.first[row] + limit - self.until[k])
        if not left:
            return int(p.starts[k] - self.offsets[row])
        begin, i = int(self.begin[p.codes[k]]), int(self.size[p.codes[k]])
        while self.counts[begin + i - 1] > left:  # back over the piece's tokens
            i -= int(self.widths[begin + i - 1])
        return int(p.starts[k] - self.offsets[row]) + i


def count(df: DataFrame, path: str, limit: int, text: str = "text", at: str | None = None) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``cut_bytes`` of every text, and with ``at`` also ``tokens_at``.

    ``cut_bytes`` is the length of the first ``limit`` tokens (the whole text if it
    has no more); ``tokens_at`` is the number of tokens of the first so many bytes,
    where ``at`` names a column of byte positions (null: the whole text).  All are
    looked up in stored counts of prefixes; nothing is encoded again.
    """
    fields = [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_tokens", "cut_bytes", *(["tokens_at"] if at else []))]
    source, schema = _with(df, fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, cache = vocabulary(path), worker_cache(path, _prefixes)
        for batch in batches:
            for part in slices(batch, text):
                data, offsets = text_buffer(part.column(part.schema.get_field_index(text)))
                p = PrefixCounts(data, offsets, v, cache)
                n, size = p.total(), np.diff(offsets)
                cut = size.copy()
                for k in np.flatnonzero(n > limit):
                    cut[k] = p.cut(int(k), limit)
                found = [size, n, cut]
                if at:
                    position = part.column(part.schema.get_field_index(at)).cast(pa.int64())
                    found.append(p.at(np.where(position.is_null(), size, position.fill_null(0))))
                yield _append(part, [f.name for f in fields], [pa.array(x.astype(np.int64)) for x in found])

    return source.mapInArrow(run, schema)
