"""Document quality from a linear-chain conditional random field over lines (operator 8).

A text is a chain of lines, each good or bad.  A line is described by what its
bytes and words look like, and by the same figures of the lines before and
after it; neighbouring labels are tied by transition weights.  Forward-backward
gives every line's probability of being good, and a document's score is their
mean, weighted with the lines' lengths.

The field is fitted on the driver by L-BFGS from at most ``TRAIN_DOCUMENTS``
labelled documents, chosen by a hash of their id, and at most ``TRAIN_LINES``
lines of each in a row, from a place that the hash chooses; each line takes its
document's label.  Only figures of lines travel to the driver, so this is
bounded, and nothing else is sampled.

Figures are made for ``BLOCK_BYTES`` of text at a time, cut between lines, and
only three numbers of each line are kept; chains of more than ``SEGMENT`` lines are
cut into segments, which pass messages on.  So neither many lines nor long
chains need much: some 100 bytes a line, and steps with the root of the length.

Defined results: a null or empty text is one empty line; a document with
several labels takes the smallest; null labels don't count; without labels
every score is 0.5; repeated rows are each scored; an empty table gives no rows;
further columns are passed through, and replaced where they bear the name of an
added one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import ragged, slices, text_buffer

#: Most documents and most lines of each in the training sample.
TRAIN_DOCUMENTS, TRAIN_LINES = 4000, 400
#: Bytes of text whose figures are made at once (one line, if it is longer); lines of a chain's segment.
BLOCK_BYTES, SEGMENT = 256 << 10, 1024

_KINDS = [  # bytes that are counted, each kind relative to the line's length
    range(0x41, 0x5B), range(0x61, 0x7B), range(0x30, 0x3A), b" \t", b"!?", b"|", b"#$%&*+=~^@_<>{}[]\\/`", b".", b",;:", b"'\"()-", range(0x80, 0x100),
]
_KIND_OF = np.full(256, len(_KINDS), np.uint8)
for _k, _own in enumerate(_KINDS):
    _KIND_OF[list(_own)] = _k
#: Odd, so that its powers have inverses modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Number of set flags between consecutive bounds."""
    until = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=until[1:])
    return np.diff(until[bounds])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Figures of every line, lines' lengths with their end, and the first line of each text (one more at the end)."""
    # a line break after each text, so that every text has a line
    n = np.diff(offsets)
    ends = np.cumsum(n + 1)
    body = np.full(int(ends[-1]) if len(ends) else 0, 0x0A, np.uint8)
    at = np.arange(len(data)) + np.repeat(np.arange(len(n)), n)
    body[at] = data
    breaks = np.flatnonzero(body == 0x0A)
    bounds = np.concatenate([[0], breaks + 1])
    rows = np.searchsorted(breaks, np.concatenate([[0], ends]), "left")
    length = np.diff(bounds)
    size = np.maximum(1, length - 1)
    kind = _KIND_OF[body]
    share = [_sums(kind == k, bounds) / size for k in range(len(_KINDS))]
    blank = (body == 0x20) | (body == 0x0A) | (body == 0x09) | (body == 0x0D)
    inside = np.concatenate([[False], ~blank, [False]])
    first, stop = np.flatnonzero(~inside[:-1] & inside[1:]), np.flatnonzero(inside[:-1] & ~inside[1:])
    # words by hash: sums of bytes times powers, shifted to a common start
    until = np.zeros(len(body) + 1, np.uint64)
    np.cumsum(body.astype(np.uint64) * _powers(_BASE, len(body))[:-1], out=until[1:])
    word = (until[stop] - until[first]) * _powers(_INVERSE, len(body))[first]
    in_line = np.searchsorted(breaks, first)
    n_lines = len(length)
    words = np.bincount(in_line, minlength=n_lines)
    per = np.maximum(1, words)
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (in_line[1:] == in_line[:-1])
    again2 = np.zeros(len(word), bool)
    again2[2:] = (word[2:] == word[:-2]) & (in_line[2:] == in_line[:-2])
    spread = stop - first
    by = lambda x: np.bincount(in_line[x], minlength=n_lines) / per
    start = kind[np.minimum(bounds[:-1], max(0, len(body) - 1))]
    last = kind[np.maximum(0, bounds[1:] - 2)]
    out = np.stack([
        np.ones(n_lines), np.log1p(length) / 5, length == 1, words == 1, *share, by(again), by(again | again2), by(spread <= 3), by(spread >= 15),
        np.bincount(in_line, spread, n_lines) / per / 10, (start == 0) & (length > 1), (last == 7) & (length > 1),
    ], 1)
    return out, length, rows


def text_rows(column: pa.Array) -> Iterator[np.ndarray]:
    """Bytes of each text."""
    data, offsets = text_buffer(column)
    for a, b in zip(offsets, offsets[1:]):
        yield data[a:b]


def with_neighbours(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Each line's figures, then those of the lines before and after it (0 beyond the text)."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[rows[:-1]] = 0
    after[rows[1:] - 1] = 0
    return np.concatenate([x, before, after], 1)


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts in runs of about ``BLOCK_BYTES``; a longer text is cut at line breaks, which are left out there."""
    small = np.diff(offsets) <= BLOCK_BYTES
    k = 0
    while k < len(small):
        if not small[k]:
            a, end = int(offsets[k]), int(offsets[k + 1])
            while end - a > BLOCK_BYTES:
                near = np.flatnonzero(data[a + BLOCK_BYTES : min(end, a + 2 * BLOCK_BYTES)] == 0x0A)
                cut = a + BLOCK_BYTES + int(near[0]) if len(near) else data.tobytes().find(b"\n", a + BLOCK_BYTES, end)
                if cut < 0:
                    break
                yield data[a:cut], np.array([0, cut - a])
                a = cut + 1
            yield data[a:end], np.array([0, end - a])
            k += 1
            continue
        far = np.flatnonzero((offsets[k + 1 :] - offsets[k] > BLOCK_BYTES) | ~small[k:])
        j = k + max(1, int(far[0])) if len(far) else len(small)
        yield data[offsets[k] : offsets[j]], offsets[k : j + 1] - offsets[k]
        k = j


def line_odds(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every line's score for good against bad, lines' lengths, and the first line of each text (one more at the end)."""
    three = weights.reshape(3, -1).T  # of a line's own figures, of those before it, of those after it
    parts = [(x @ three, length) for x, length, _ in (line_features(*p) for p in _pieces(data, offsets))]
    if not parts:
        return np.zeros(0), np.zeros(0, np.int64), np.zeros(1, np.int64)
    own, length = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    breaks = _sums(data == 0x0A, offsets)
    rows = np.concatenate([[0], np.cumsum(breaks + 1)])
    odds, before, after = own[:, 0].copy(), np.zeros(len(own)), np.zeros(len(own))
    before[1:], after[:-1] = own[:-1, 1], own[1:, 2]
    before[rows[:-1]] = after[rows[1:] - 1] = 0
    return odds + before + after, length, rows


def messages(score: np.ndarray, ties: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Log weight of all labellings up to each line, by that line's label, for the chains that begin at ``rows``.

    Chains are cut into segments.  All segments run side by side, from either label
    of the line before; their results are joined chain by chain; then they run
    again with what came in.
    """
    n = np.diff(rows)
    per = -(-n // SEGMENT)
    first = ragged(np.zeros(len(n), np.int64), per) * SEGMENT + np.repeat(rows[:-1], per)
    size = np.minimum(SEGMENT, np.repeat(rows[1:], per) - first)
    order = np.argsort(-size, kind="stable")

    def run(which: np.ndarray, begin: np.ndarray, out: np.ndarray | None) -> np.ndarray:
        """Messages at the ends of the segments ``which``, longest first; ``begin`` is added to their first lines."""
        now = score[first[which]] + begin
        if out is not None:
            out[first[which]] = now
        for t in range(1, int(size[which].max(initial=0))):
            k = int(np.searchsorted(-size[which], -t, "left"))
            was, at = now[:k], first[which[:k]] + t
            now[:k] = np.stack([np.logaddexp(was[:, 0] + ties[0, y], was[:, 1] + ties[1, y]) for y in (0, 1)], 1) + score[at]
            if out is not None:
                out[at] = now[:k]
        return now

    begin = np.zeros((len(first), 2))
    ahead = np.concatenate([[0], np.cumsum(per)])
    if len(long := np.flatnonzero(per > 1)):
        which = order[np.isin(order, ragged(ahead[long], per[long] - 1))]
        passed = np.zeros((2, len(first), 2))
        for y in (0, 1):
            start = np.full((len(which), 2), -np.inf)
            start[:, y] = 0
            passed[y, which] = run(which, start, None)
        for c in long:
            for s in range(ahead[c], ahead[c + 1] - 1):
                end = np.logaddexp(begin[s, 0] + passed[0, s], begin[s, 1] + passed[1, s])
                begin[s + 1] = np.logaddexp(end[0] + ties[0], end[1] + ties[1])
    out = np.zeros_like(score)
    run(order, begin[order], out)
    return out


def forward_backward(odds: np.ndarray, ties: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Probability that each line is good, the log partition sum, and expected counts of label pairs.

    ``odds`` is each line's score for good against bad, ``ties`` the 2 x 2 weights of
    neighbouring labels; backwards is forwards with lines and ties turned round.
    """
    score = np.stack([np.zeros(len(odds)), odds], 1)
    ahead = messages(score, ties, rows)
    back = messages(score[::-1], ties.T, len(odds) - rows[::-1])[::-1] - score
    both = ahead + back
    total = np.logaddexp(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - total)
    inner = np.ones(len(odds), bool)
    inner[rows[:-1]] = False
    at = np.flatnonzero(inner)
    pairs = np.array([[np.exp(ahead[at - 1, a] + ties[a, b] + score[at, b] + back[at, b] - total[at]).sum() for b in (0, 1)] for a in (0, 1)])
    return good, float(total[rows[:-1]].sum()), pairs


def minimise(f, x: np.ndarray, steps: int = 300, memory: int = 8) -> np.ndarray:
    """L-BFGS with a backtracking line search; ``f`` gives value and gradient."""
    value, slope = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, used = slope.copy(), []
        for s, y in reversed(past):
            a = s @ q / (y @ s)
            used.append(a)
            q -= a * y
        q *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.linalg.norm(slope))
        for (s, y), a in zip(past, reversed(used)):
            q += s * (a - y @ q / (y @ s))
        size, down = 1.0, slope @ q
        if down <= 1e-10:
            break
        while size > 1e-8:
            new = x - size * q
            v, g = f(new)
            if v <= value - 1e-4 * size * down:
                break
            size /= 2
        else:
            break
        if (new - x) @ (g - slope) > 1e-12:
            past = [*past[1 - memory :], (new - x, g - slope)]
        done = value - v < 1e-7 * max(1.0, abs(value))
        x, value, slope = new, v, g
        if done:
            break
    return x


def fit_lines(x: np.ndarray, rows: np.ndarray, quality: np.ndarray, penalty: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights of a line's figures and of neighbouring labels, for chains with one label each."""
    y = np.repeat(quality, np.diff(rows)).astype(float)
    inner = np.ones(len(y), bool)
    inner[rows[:-1]] = False
    at = np.flatnonzero(inner)
    seen = np.array([[((y[at - 1] == a) & (y[at] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
    full, n = with_neighbours(x, rows), max(1, len(y))

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        w, ties = p[:-4], p[-4:].reshape(2, 2)
        odds = full @ w
        good, total, pairs = forward_backward(odds, ties, rows)
        value = (total - odds @ y - (seen * ties).sum()) / n + penalty * (p @ p) / 2
        return value, np.concatenate([full.T @ (good - y), (pairs - seen).ravel()]) / n + penalty * p

    p = minimise(loss, np.zeros(full.shape[1] + 4))
    return p[:-4], p[-4:].reshape(2, 2)


def fit(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Fit the field from ``labels(doc_id, quality)``."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCUMENTS)
    body = F.coalesce(F.col(text), F.lit(""))
    own = documents.select(F.col(doc_id).alias("doc_id"), body.alias("text")).join(F.broadcast(chosen), "doc_id")  # TRAIN_DOCUMENTS rows
    own = own.select("doc_id", "quality", "text", F.xxhash64("doc_id").alias("hash"))

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                each = []
                for t, h in zip(text_rows(part.column(2)), part.column(3).to_pylist()):
                    x = np.concatenate([line_features(*p)[0].astype(np.float32) for p in _pieces(t, np.array([0, len(t)]))])
                    at = h % max(1, len(x) - TRAIN_LINES + 1)
                    each.append(x[at : at + TRAIN_LINES].tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(each, pa.binary())], ["doc_id", "quality", "x"])

    got = own.mapInArrow(figures, "doc_id long, quality int, x binary").dropDuplicates(["doc_id"]).orderBy("doc_id").limit(TRAIN_DOCUMENTS).toArrow()
    width = line_features(np.zeros(0, np.uint8), np.zeros(2, np.int64))[0].shape[1]
    each = [np.frombuffer(b, np.float32).reshape(-1, width) for b in got.column("x").to_pylist()]
    if not each:
        return np.zeros(3 * width), np.zeros((2, 2))
    return fit_lines(np.concatenate(each).astype(float), np.concatenate([[0], np.cumsum([len(e) for e in each])]), got.column("quality").to_numpy())


_ADDED = [T.StructField("score", T.DoubleType()), T.StructField("line_scores", T.ArrayType(T.FloatType()))]


def score(documents: DataFrame, model: tuple[np.ndarray, np.ndarray], text: str = "text", lines: bool = True) -> DataFrame:
    """Add ``score``, from 0 to 1, and with ``lines`` also ``line_scores``, every line's probability of being good."""
    added = _ADDED if lines else _ADDED[:1]
    source = documents.drop(*[f.name for f in added])
    weights, ties = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                odds, length, rows = line_odds(*text_buffer(part.column(part.schema.get_field_index(text))), weights)
                good, _, _ = forward_backward(odds, ties, rows)
                mean = np.add.reduceat(good * length, rows[:-1]) / np.add.reduceat(length, rows[:-1])
                new = [pa.array(np.clip(mean, 0, 1))]
                if lines:
                    new.append(pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(good.astype(np.float32))))
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, *[f.name for f in added]])

    return source.mapInArrow(run, T.StructType([*source.schema.fields, *added]))
