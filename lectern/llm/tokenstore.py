"""Token ids as binary files of Simple-8b blocks (operator 10).

Documents are dealt out by ranges of their id and sorted within each range, so
file ``part`` holds a contiguous run of them.  A block holds whole documents and
``BLOCK`` ids or more, the last one fewer: a head (ids of its documents, their lengths, the number of
ids in the file before it) and the packed ids.  Spark's writer puts the blocks
of a part into one file of the store in use, so that a lost executor's part is
written again and each is committed once.

Blocks know where they start within their part; a table with one row for each
part gives what lies before it, so documents' places in the whole stream need
no pass over the data.

Defined results: a null or empty text is the end id alone; rows with a null id
come first; rows that share an id are ordered by their text; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm import simple8b
from lectern.llm.bytepair import PieceCache, check_json, encode_texts
from lectern.llm.common import slices, text_buffer

#: Ids after which a block is closed.
BLOCK = 1 << 16
#: Bytes of text that are split into pieces at once: the more, the fewer times a common piece is looked up.
SLICE = 8 << 20
_HEAD = struct.Struct("<4sIQ")
_BLOCKS = "part int, block long, n_documents long, n_ids long, data binary"


@lru_cache(4)
def _library(path: str) -> tuple[list[str], PieceCache]:
    """Special tokens of a JSON vocabulary, and the ids that the tokenizers library gives for pieces, one call for many."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    check_json(spec)
    t = Tokenizer.from_str(json.dumps(spec))

    def of(pieces: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
        e = t.encode([p.decode() for p in pieces], is_pretokenized=True, add_special_tokens=False)
        return [np.array(e.ids, np.int32)], np.bincount(np.array(e.word_ids, np.int64), minlength=len(pieces))

    return [a["content"] for a in spec["added_tokens"]], PieceCache(of)


def block_bytes(doc_ids: np.ndarray, known: np.ndarray, lengths: np.ndarray, before: int, ids: np.ndarray) -> bytes:
    return b"".join((_HEAD.pack(b"TOK1", len(doc_ids), before), doc_ids.astype("<i8").tobytes(), known.astype("u1").tobytes(), lengths.astype("<u4").tobytes(), simple8b.pack(ids)))


def read_block(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, np.ndarray]:
    mark, n, before = _HEAD.unpack_from(data)
    if mark != b"TOK1":
        raise ValueError("not a block of token ids")
    at = _HEAD.size
    doc_ids, known = np.frombuffer(data, "<i8", n, at), np.frombuffer(data, "u1", n, at + 8 * n)
    return doc_ids, known, np.frombuffer(data, "<u4", n, at + 9 * n), before, simple8b.unpack(data[at + 13 * n :])


def blocks(documents: DataFrame, path: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of all documents, in ascending order of their id; ``path`` names a JSON vocabulary that executors can open."""
    placed = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special, cache = _library(path)
        held: list[tuple] = []
        size = before = number = part_id = 0

        def close():
            nonlocal held, size, before, number
            d, k, n, ids = (np.concatenate(x) for x in zip(*held))
            out = pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((part_id, pa.int32()), (number, pa.int64()), (len(d), pa.int64()), (len(ids), pa.int64()), (block_bytes(d, k, n, before, ids), pa.binary()))], ["part", "block", "n_documents", "n_ids", "data"])
            before, number, held, size = before + len(ids), number + 1, [], 0
            return out

        for batch in batches:
            for part in slices(batch, "text", SLICE):
                part_id = part.column(2)[0].as_py()
                data, offsets = text_buffer(part.column(1))
                ids, ends = encode_texts(data, offsets, special, cache)
                ids, lengths = np.insert(ids, ends[1:], end_id), np.diff(ends) + 1
                known = np.asarray(part.column(0).is_valid())
                held.append((part.column(0).fill_null(0).to_numpy(), known, lengths, ids))
                size += len(ids)
                if size >= BLOCK:
                    yield close()
        if held:
            yield close()

    return placed.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(run, _BLOCKS)


def write(documents: DataFrame, path: str, to: str, **kwargs) -> None:
    """Write the files of ``blocks`` to the folder ``to``; packed words gain nothing from another compression."""
    blocks(documents, path, **kwargs).write.option("compression", "uncompressed").parquet(to)


def read(spark: SparkSession, at: str) -> DataFrame:
    """Documents in the files at ``at``: ``doc_id``, ``start`` (ids before it), ``n_tokens``, ``ids`` (little-endian, 4 bytes each)."""
    files = spark.read.schema(_BLOCKS).parquet(at)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # one row for each file written: as many as there were tasks, however large the data
    placed = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("part_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc_ids, known, lengths, before, ids = read_block(data.as_py())
                ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
                flat = pa.Array.from_buffers(pa.binary(), len(doc_ids), [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4").tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(doc_ids), pa.int32()), pa.array(doc_ids, mask=known == 0), pa.array(before + ends[:-1]), pa.array(lengths.astype(np.int64)), flat], ["part", "doc_id", "within", "n_tokens", "ids"])

    found = files.select("part", "data").mapInArrow(run, "part int, doc_id long, within long, n_tokens long, ids binary")
    return found.join(F.broadcast(placed), "part").select("doc_id", (F.col("part_start") + F.col("within")).alias("start"), "n_tokens", "ids")
