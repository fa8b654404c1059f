"""Repeated line runs by a suffix array over line numbers (operator 2).

Every line that occurs more than once gets a number, the rank of its digest;
a line that occurs once ends every repeated run, so it is not carried on.  The
suffix array of the lines is refined by distributed prefix doubling: from the
ranks of suffixes by their first ``h`` lines, the rank of the pair (own rank,
rank ``h`` lines further) is the rank by ``2h`` lines.  Suffixes of equal rank are
an interval of the suffix array whose common prefix has that many lines, so an
interval for any number of lines ``m`` is named by two ranks that overlap.

A run counts as repeated if it has ``min_words`` words at least.  Each line's
shortest such run forwards and backwards is looked up in its interval; all but
the earliest place of the interval, by document and line, are later copies and
are deleted.  Their union is exactly the union of all maximal repeated runs with
enough words: a line of such a run lies in the shortest run that starts at it,
or, where too few words follow, in the one that ends with the maximal run.

Shuffles carry digests and ranks of repeated lines only, and hot lines are
pre-aggregated before they are ranked; joins back to places may be skewed,
which adaptive execution splits.  Texts move once, at the end.

Defined results: lines end at ``\\n``; words stand between ASCII white space; a
null text stays null and has no lines, an empty one has one empty line; rows
with a null id take no part and stay as they are; rows that share an id are
ordered by a hash of their text, and equal rows count as one place, so they come
out equal; an empty table gives no rows; further columns are passed through,
and replaced where they bear the name of an added one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import fresh, materialise, text_buffer

_PLACE = ["doc", "tie", "line"]


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest and number of words of every line.  Done in the JVM, arrays of lines took an executor over 3 GB after the pipeline's first stage."""
    for batch in batches:
        data, offsets = text_buffer(batch.column(2))
        raw, ids, ties = data.tobytes(), batch.column(0).to_numpy(), batch.column(1).to_numpy()
        row: list[int] = []
        line: list[int] = []
        digest: list[bytes] = []
        words: list[int] = []
        for k in range(len(batch)):
            for n, own in enumerate(raw[offsets[k] : offsets[k + 1]].split(b"\n")):
                row.append(k)
                line.append(n)
                digest.append(hashlib.md5(own).digest())
                words.append(len(own.split()))
            if len(row) > 1 << 16 or k == len(batch) - 1:
                at = np.array(row, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ties[at]), pa.array(line, pa.int32()), pa.array(digest, pa.binary()), pa.array(words, pa.int32())], ["doc", "tie", "line", "digest", "words"])
                row, line, digest, words = [], [], [], []


def ranked(keys: DataFrame, by: list[str]) -> DataFrame:
    """Add ``rank``, from 0, to rows that differ in ``by``: sorted ranges, and one count for each range."""
    dealt = materialise(keys.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("place", F.monotonically_increasing_id()), "sorted")
    dealt = dealt.withColumn("range", F.shiftright("place", 33))
    counts = dealt.groupBy("range").agg(F.count("*").alias("n"))  # as many rows as ranges
    starts = counts.select("range", F.coalesce(F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return dealt.join(F.broadcast(starts), "range").withColumn("rank", F.col("start") + (F.col("place") - F.shiftleft("range", 33))).drop("range", "place", "start")


def _windows(min_words: int):
    """Shortest runs with enough words, forwards and backwards, in each unbroken stretch of repeated lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column(2)
            line, words = (c.to_numpy().astype(np.int64) for c in places.flatten().flatten())
            row = np.repeat(np.arange(len(batch)), np.diff(places.offsets.to_numpy()))
            # stretches: runs of consecutive lines of one text
            new = np.ones(len(line), bool)
            new[1:] = (np.diff(line) != 1) | (np.diff(row) != 0)
            first = np.flatnonzero(new)
            stretch, stop = np.cumsum(new) - 1, np.append(first[1:], len(line))
            until = np.concatenate([[0], np.cumsum(words)])
            i = np.arange(len(line))
            end = np.searchsorted(until, until[:-1] + min_words, "left")  # one past the last line of the run from i
            start = np.searchsorted(until, until[1:] - min_words, "right") - 1
            ahead, back = end <= stop[stretch], start >= first[stretch]
            a, b = np.concatenate([i[ahead], start[back]]), np.concatenate([end[ahead], i[back] + 1])
            if len(a):
                a, b = np.unique(np.stack([a, b]), axis=1)
            at = pa.array(row[a])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(line[a].astype(np.int32)), pa.array((b - a).astype(np.int32))], ["doc", "tie", "line", "n"])

    return run


def _digest_of(text: Column) -> Column:
    return F.xxhash64(text)


def repeated_runs(documents: DataFrame, min_words: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc``, ``tie``, ``line`` and ``n``: runs of ``n`` lines that have an earlier copy."""
    docs = documents.select(F.col(doc_id).cast("long").alias("doc"), _digest_of(F.col(text)).alias("tie"), F.col(text).alias("text")).where(F.col("doc").isNotNull() & F.col("text").isNotNull())
    lines = materialise(docs.mapInArrow(_lines, "doc long, tie long, line int, digest binary, words int"), "lines")
    twice = lines.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    numbers = ranked(twice, ["digest"])
    now = materialise(lines.join(numbers, "digest").select(*_PLACE, "rank", "words").dropDuplicates(_PLACE), "ranks")
    places = now.groupBy("doc", "tie").agg(F.sort_array(F.collect_list(F.struct("line", "words"))).alias("places"))
    windows = materialise(places.mapInArrow(_windows(min_words), "doc long, tie long, line int, n int"), "windows")
    longest = windows.agg(F.max("n")).first()[0] or 0
    found, h = None, 1
    while h <= longest:
        # intervals for runs of h to 2h - 1 lines: two ranks by h lines that overlap
        own = windows.where((F.col("n") >= h) & (F.col("n") < 2 * h))
        ends = now.select("doc", "tie", F.col("line").alias("last"), F.col("rank").alias("then"))
        named = own.withColumn("last", F.col("line") + F.col("n") - h).join(now.select(*_PLACE, "rank"), _PLACE).join(ends, ["doc", "tie", "last"])
        key = ["n", "rank", "then"]
        first = named.groupBy(*key).agg(F.min(F.struct(*_PLACE)).alias("first"), F.count("*").alias("copies")).where("copies > 1").select(*key, "first")
        first = materialise(first, "first")  # beside an aggregate, a skewed join could not be split
        later = named.join(first, key).where(F.struct(*_PLACE) > F.col("first")).select(*_PLACE, "n")
        later = materialise(later, "later")
        found = later if found is None else found.union(later)
        h *= 2
        if h <= longest:
            ends = now.select("doc", "tie", (F.col("line") - h // 2).alias("line"), F.col("rank").alias("then"))
            pairs = now.join(ends, _PLACE)
            several = pairs.groupBy("rank", "then").agg(F.count("*").alias("n")).where("n > 1").select("rank", "then")  # a suffix of its own rank repeats no further
            now = materialise(pairs.join(_renumber(several), ["rank", "then"]).select(*_PLACE, F.col("next").alias("rank")), "ranks")
    return found if found is not None else windows.limit(0)


def _renumber(pairs: DataFrame) -> DataFrame:
    """``next``, the rank of the pair ``(rank, then)``."""
    own = pairs.select(F.col("rank").alias("a"), F.col("then").alias("b"))
    return ranked(own, ["a", "b"]).select(F.col("a").alias("rank"), F.col("b").alias("then"), F.col("rank").alias("next"))


_ADDED = [T.StructField("n_lines", T.LongType()), T.StructField("removed_lines", T.ArrayType(T.IntegerType())), T.StructField("removed_runs", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))]


def remove_repeats(documents: DataFrame, min_words: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with later copies deleted from ``text``, and with ``n_lines`` (before), ``removed_lines``, their numbers, and
    ``removed_runs``, the maximal runs that they make up (first line, and one past the last)."""
    source = documents.drop(*[f.name for f in _ADDED])
    doc, tie, found = (fresh(source, n) for n in ("doc", "tie", "runs"))
    gone = _merged(repeated_runs(source, min_words, doc_id, text)).toDF(doc, tie, found)
    key = (F.col(doc_id).cast("long") == F.col(doc)) & (_digest_of(F.col(text)) == F.col(tie))
    joined = source.join(gone.hint("merge"), key, "left")  # one plan at every size
    every, runs = F.split(F.col(text), "\n"), F.coalesce(F.col(found), F.array().cast(_ADDED[2].dataType))
    out = joined.withColumn("removed_runs", runs).withColumn("n_lines", F.coalesce(F.size(every), F.lit(0)).cast("long"))
    lines = F.flatten(F.transform("removed_runs", lambda r: F.sequence(r["start"], r["end"] - 1)))
    n = F.size("removed_runs")
    # what stands between runs; a text that repeats nothing is passed on as it is
    stop = lambda k: F.when(k == n, F.size(every)).otherwise(F.try_element_at("removed_runs", k + 1)["start"])
    begin = lambda k: F.when(k == 0, 0).otherwise(F.try_element_at("removed_runs", F.greatest(k, F.lit(1)))["end"])
    parts = F.transform(F.sequence(F.lit(0), n), lambda k: F.slice(every, begin(k) + 1, stop(k) - begin(k)))
    kept = F.when(n == 0, F.col(text)).otherwise(F.array_join(F.flatten(parts), "\n"))
    out = out.withColumn("removed_lines", lines).withColumn(text, kept)
    return out.select(*source.columns, "n_lines", "removed_lines", "removed_runs")


def _merged(runs: DataFrame) -> DataFrame:
    """Runs of a text that overlap or touch become one: ``doc``, ``tie`` and ``runs`` in order, of start and end."""
    place = W.partitionBy("doc", "tie").orderBy("line")
    until = F.max(F.col("line") + F.col("n")).over(place.rowsBetween(W.unboundedPreceding, -1))
    named = runs.withColumn("new", F.coalesce((F.col("line") > until).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(place.rowsBetween(W.unboundedPreceding, 0)))
    whole = named.groupBy("doc", "tie", "run").agg(F.min("line").alias("start"), F.max(F.col("line") + F.col("n")).alias("end"))
    return whole.groupBy("doc", "tie").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"))
