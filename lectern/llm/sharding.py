"""K-d tree sharding with DataFrame functions alone (operator 5).

Equal texts are one point with the metadata of their group (least language and
source, size), weighted with the bytes of all copies.  A node is split across
its widest dimension, measured against the whole range, at the weighted median
of its points; both halves are split again until a leaf has the target bytes.
Equal texts share a shard, at every size of table.  Only a group that alone is
heavier than a shard is split, by its rows' ids, into parts of a sixteenth of a
shard.  Among points of equal value the heavier come first, so that a cut falls
between light ones wherever it can.

A dimension of texts counts by the rank of its distinct values, so texts with
a common start are as far apart as others; with more than 65,536 distinct
values, neighbours in rank share a step of the 16 bits.

Nothing of the tree is on the driver: a level's nodes are a table of one row
each, and medians come from histograms, bytes by node and bin, with ``BITS`` bits
a round; each round looks into the bin that holds the median, and a window over
a node's bins (``2 ** BITS`` at most) finds it.  The table of nodes is broadcast
while it has ``FEW`` rows at most, which is checked; else it is joined by sorting.
Places within a shard are numbered by sorted ranges and one count for each range
and shard.

Defined results: a null text counts one byte, as an empty one; null ids come
first within a shard; repeated rows get a place each; null metadata sorts
first; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import materialise

#: Bits of a point's key: a dimension's value, then how light the group is, then a hash.
VALUE, CLASS, TIE = 16, 8, 32
#: Bits of a round's histogram; four rounds read a whole key.
BITS = (VALUE + CLASS + TIE) // 4
#: Parts of a shard into which a group is split that is heavier than a shard.
PARTS = 16
#: Most rows of a table that is broadcast: some megabytes.
FEW = 1 << 16


def _dimension(name: str, kind: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) if kind == "string" else F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def _ranked(groups: DataFrame, name: str) -> DataFrame:
    """Texts in column ``name`` become their ranks among its distinct values, by sorted ranges and one count for each."""
    values = groups.select(name).distinct().repartitionByRange(name).sortWithinPartitions(name).withColumn("place", F.monotonically_increasing_id())
    values = materialise(values, "values").withColumn("range", F.shiftright("place", 33))
    counts = values.groupBy("range").agg(F.min("place").alias("first"), F.count("*").alias("n"))  # one row for each range
    before = F.coalesce(F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("range", (before - F.col("first")).alias("shift"))
    ranks = materialise(values.join(F.broadcast(starts), "range").select(name, (F.col("place") + F.col("shift")).cast("double").alias("rank")), "ranks")
    return groups.join(ranks, name).drop(name).withColumnRenamed("rank", name)


def _near(rows: DataFrame, n: int) -> DataFrame:
    """The smaller side of a join, of ``n`` rows at most."""
    return F.broadcast(rows) if n <= FEW else rows


def _split(points: DataFrame, dimensions: list[str], n_nodes: int) -> DataFrame:
    """One level of the tree: points of a node (shards ``first`` to ``first + count``) go to one of its two halves."""
    span = {d: F.max(f"key_{d}") - F.min(f"key_{d}") for d in dimensions}
    spans = points.where("count > 1").groupBy("first", "count").agg(F.sum("bytes").alias("total"), *[c.alias(d) for d, c in span.items()])
    widest = reduce(lambda c, d: c.when(F.col(d) == F.greatest(*dimensions), d), dimensions, F.when(F.lit(False), ""))
    share = F.floor(F.col("count") / 2) / F.col("count")
    nodes = spans.select(
        F.col("first").alias("node"), widest.alias("dim"), F.greatest(F.floor(F.col("total") * share), F.lit(1)).cast("long").alias("goal"),
        F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("before"),
    )
    key = reduce(lambda c, d: c.when(F.col("dim") == d, F.col(f"key_{d}")), dimensions, F.when(F.lit(False), F.lit(0).cast("long")))
    own = ["node", "dim", "goal", "low", "before"]
    for width in range(VALUE + CLASS + TIE, 0, -BITS):
        at = points.where("count > 1").join(_near(nodes, n_nodes), F.col("first") == F.col("node")).withColumn("key", key - F.col("low"))
        bins = at.where((F.col("key") >= 0) & (F.col("key") < 1 << width)).groupBy(*own, F.shiftright("key", width - BITS).alias("bin")).agg(F.sum("bytes").alias("bytes"))
        until = F.col("before") + F.sum("bytes").over(W.partitionBy("node").orderBy("bin").rowsBetween(W.unboundedPreceding, 0))  # 2 ** BITS rows at most
        here = bins.withColumn("until", until).where((F.col("until") >= F.col("goal")) & (F.col("until") - F.col("bytes") < F.col("goal")))
        low, short = F.col("low") + F.shiftleft("bin", width - BITS), F.col("until") - F.col("bytes")
        if width == BITS:  # cut at the nearer edge of the median's key
            low = low + (F.col("goal") - short > F.col("until") - F.col("goal")).cast("int")
        nodes = here.select("node", "dim", "goal", low.alias("low"), short.alias("before"))
    half = F.floor(F.col("count") / 2).cast("int")
    done = points.join(_near(nodes.select("node", "dim", "low"), n_nodes), F.col("first") == F.col("node"), "left").withColumn("right", key >= F.col("low"))
    whole = F.col("node").isNull()
    first = F.when(whole | ~F.col("right"), F.col("first")).otherwise(F.col("first") + half)
    count = F.when(whole, F.col("count")).when(F.col("right"), F.col("count") - half).otherwise(half)
    return done.withColumn("next", first).withColumn("left_over", count).drop("first", "count", "node", "dim", "low", "right").withColumnsRenamed({"next": "first", "left_over": "count"}).select(points.columns)


def kd_shards(documents: DataFrame, target_bytes: int | None = None, n_shards: int | None = None, dimensions: tuple[str, ...] = ("lang", "source"), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``law`` ('bytes'), ``shard``, ``slot`` and ``grown_shard`` (null) of every row.

    Give the number of shards, or the bytes that a shard should have at most.
    The size in bytes is a dimension besides those named, which may be strings
    or numbers.
    """
    kinds = dict(documents.dtypes)
    body = F.coalesce(F.col(text), F.lit(""))
    names = {f"d{k}": _dimension(c, kinds[c]) for k, c in enumerate(dimensions)}
    rows = documents.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("hash"), *[c.alias(n) for n, c in names.items()],
    )
    rows = materialise(rows, "rows")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first().bytes
    n_shards = n_shards or max(1, -(-total // max(1, target_bytes or total)))
    target = max(1.0, total / n_shards)
    group = ["hash", "text_crc32", "size"]
    groups = rows.groupBy(*group).agg(F.count("*").alias("n"), *[F.min(n).alias(n) for n in names])
    bytes_ = F.col("n") * F.col("size")
    groups = materialise(groups.withColumn("parts", F.when(bytes_ > target, F.ceil(bytes_ * PARTS / target)).otherwise(1).cast("int")), "groups")
    if texts := [n for n, c in zip(names, dimensions) if kinds[c] == "string"]:
        groups = materialise(reduce(_ranked, texts, groups), "ranked")
    heavy = groups.where("parts > 1")  # fewer than shards
    salted = rows.select("doc_id", *group).join(_near(heavy.select(*group, "parts"), n_shards), group, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("parts")), F.lit(0)).cast("int"))
    split = salted.where("parts > 1").groupBy(*group, "part").agg(F.sum("size").alias("bytes"))
    light = groups.where("parts <= 1").select(*group, F.lit(0).alias("part"), bytes_.alias("bytes"), *names)
    points = light.unionByName(split.join(_near(heavy.select(*group, *names), n_shards), group).select(light.columns))
    edge = groups.agg(*[f(n).alias(f"{f.__name__}_{n}") for n in ("size", *names) for f in (F.min, F.max)]).first()
    weight = F.least(F.lit((1 << CLASS) - 1), F.floor(F.col("bytes") * (1 << CLASS) / target))
    tie = F.shiftleft((1 << CLASS) - 1 - weight.cast("long"), TIE) + F.shiftrightunsigned(F.xxhash64("hash", "part"), 64 - TIE)
    for n in ("size", *names):
        least, most = float(edge[f"min_{n}"] or 0), float(edge[f"max_{n}"] or 0)
        scaled = F.floor((F.col(n) - least) / (most - least) * ((1 << VALUE) - 1)) if most > least else F.lit(0)
        points = points.withColumn(f"key_{n}", F.shiftleft(scaled.cast("long"), CLASS + TIE) + tie)
    points = points.select(*group, "part", "bytes", *[f"key_{n}" for n in ("size", *names)], F.lit(0).alias("first"), F.lit(int(n_shards)).alias("count"))
    points, most, nodes = materialise(points, "points"), n_shards, 1
    while most > 1:
        points = materialise(_split(points, ["size", *names], nodes), "level")
        most, nodes = -(-most // 2), min(2 * nodes, n_shards)
    placed = points.select(*group, "part", F.col("first").alias("shard"))
    sharded = salted.select("doc_id", *group, "part").join(placed, [*group, "part"]).select("doc_id", "size", "text_crc32", "shard")
    return number(sharded, n_shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def number(sharded: DataFrame, n_shards: int) -> DataFrame:
    """Add ``slot``: 0, 1, ... within each shard, by ``doc_id``."""
    order = ["shard", "doc_id", "text_crc32", "size"]
    dealt = materialise(sharded.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "placed")
    dealt = dealt.withColumn("range", F.shiftright("place", 33))
    # one row for each range and each shard in it: ranges are sorted by shard, so ranges + shards rows at most
    counts = dealt.groupBy("range", "shard").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("range", "shard", (before - F.col("first")).alias("shift"))
    ranges = int(sharded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.join(_near(starts, ranges + n_shards), ["range", "shard"]).withColumn("slot", (F.col("place") + F.col("shift")).cast("long"))
