"""Benchmark decontamination with one Aho-Corasick automaton (operator 1).

Questions and answers are normalised to words; every window of ten words
becomes a pattern.  Each document is normalised in the same way and scanned
once; matches are mapped back to words, and those to bytes of the original.

The automaton reads words, not letters: each word of the benchmark is two
symbols of an alphabet with as many symbols as the root of the number of words,
so a pattern has two nodes for each word, and no node has many children.

The benchmark is not the corpus: it is a list of test items.  An automaton is
sent to the executors only while its nodes, some 40 bytes each in every Python
worker, are under ``most_nodes``.  A larger benchmark is cut into several
automata; documents are then written between one and the next, so a worker holds
one at a time, and no list is too long.

Defined results: a null text (of a document or an item) has no words; items
with a null id take no part; items that share an id count as one; repeated
document rows are each reported; without items nothing is hit; further columns
are passed through, and replaced where they bear the name of an added one.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import discard, materialise, slices, text_buffer

#: Bytes to lower case; every ASCII byte that is neither letter nor digit to a blank.
_NORMAL = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def windows(words: list[bytes], width: int) -> list[tuple[bytes, ...]]:
    """Patterns of an item: runs of ``width`` words, or all its words if it has fewer."""
    return [tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))] if words else []


class WordAutomaton:
    """The automaton of some patterns, and the symbols of their words."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[int]]):
        every = sorted({w for p in patterns for w in p})
        side = max(1, math.isqrt(len(every)) + 1)
        sign = [chr(0x100 + k) if k < 0xD700 else chr(0x2000 + k) for k in range(2 * side)]  # past the surrogates
        self._symbols = {w: sign[k // side] + sign[side + k % side] for k, w in enumerate(every)}
        self._automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for p, items in patterns.items():
            self._automaton.add_word("".join(map(self._symbols.__getitem__, p)), (len(p), items))
        self._automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Which words are hit, and the items whose windows occur."""
        get = self._symbols.get
        text = "".join([get(w, "  ") for w in words])
        change, items = np.zeros(len(words) + 1, np.int64), set()
        for end, (n, who) in self._automaton.iter(text):
            change[end // 2 + 1 - n] += 1
            change[end // 2 + 1] -= 1
            items.update(who)
        return np.cumsum(change)[:-1] > 0, items


def _groups(benchmark: DataFrame, width: int, most_nodes: int) -> Iterator[tuple[list[str], dict[tuple[bytes, ...], list[int]]]]:
    """Items' patterns, in groups of bounded size; the items are streamed to the driver, not collected."""
    ids: dict[str, int] = {}
    patterns: dict[tuple[bytes, ...], list[int]] = {}
    nodes = 0
    items = benchmark.select(F.col("item_id").cast("string").alias("i"), F.coalesce("text", F.lit("")).alias("t")).where("i IS NOT NULL")
    for row in items.toLocalIterator():
        for p in windows(words_of(row.t.encode()), width):
            if p not in patterns and nodes and nodes + 2 * len(p) > most_nodes:
                yield list(ids), patterns
                ids, patterns, nodes = {}, {}, 0
            if p not in patterns:
                nodes += 2 * len(p)
            k, at = ids.setdefault(row.i, len(ids)), patterns.setdefault(p, [])
            if k not in at:
                at.append(k)
    yield list(ids), patterns


def word_bytes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word of the original text."""
    inside = np.frombuffer(b" " + text.translate(_NORMAL) + b" ", np.uint8) != 0x20
    return np.flatnonzero(~inside[:-1] & inside[1:]), np.flatnonzero(inside[:-1] & ~inside[1:])


_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ADDED = [T.StructField("n_words", T.LongType()), T.StructField("hit_words", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", _SPAN)]


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def find(documents: DataFrame, benchmark: DataFrame, width: int = 10, most_nodes: int = 4_000_000) -> DataFrame:
    """Add to every document ``n_words``; ``hit_words``, the numbers of words inside an occurring window;
    ``items``, the ids of items with such a window; ``spans``, the byte ranges of hit runs in the original text."""
    source = out = documents.drop(*[f.name for f in _ADDED])
    schema = T.StructType([*source.schema.fields, *_ADDED])
    context = documents.sparkSession.sparkContext
    sent = before = None
    for group in _groups(benchmark, width, most_nodes):
        if sent is not None:
            out = materialise(out, "scanned")
            sent.destroy()
            discard(*([before] if before is not None else []))
            before = out
        sent = context.broadcast(pickle.dumps(group))
        out = out.mapInArrow(_scanner(sent, schema), schema)
    return out


def _scanner(sent, schema: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, patterns = pickle.loads(sent.value)
        automaton = WordAutomaton(patterns) if patterns else None
        kinds = None
        for batch in batches:
            for part in slices(batch, "text"):
                names = part.schema.names
                data, offsets = text_buffer(part.column(names.index("text")))
                raw = data.tobytes()
                before = {n: part.column(names.index(n)).to_pylist() for n in ("hit_words", "items")} if "hit_words" in names else None
                rows = []
                for k in range(len(part)):
                    text = raw[offsets[k] : offsets[k + 1]]
                    words = words_of(text)
                    hit, items = automaton.scan(words) if automaton and words else (np.zeros(len(words), bool), set())
                    items = {ids[i] for i in items}
                    if before:  # an earlier group of items has been here
                        hit[np.array(before["hit_words"][k], np.int64)] = True
                        items.update(before["items"][k])
                    if not items:
                        rows.append((len(words), [], [], []))
                        continue
                    first, end = word_bytes(text)
                    spans = [{"start": int(first[a]), "end": int(end[b - 1])} for a, b in _runs(hit)]
                    rows.append((len(words), np.flatnonzero(hit).tolist(), sorted(items), spans))
                kinds = kinds or [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
                own = [f.name for f in _ADDED]
                kept = [(n, c) for n, c in zip(names, part.columns) if n not in own]
                yield pa.RecordBatch.from_arrays([c for _, c in kept] + [pa.array([r[x] for r in rows], kinds[x]) for x in range(4)], [n for n, _ in kept] + own)

    return run
