"""Tables for reports and reviews: look-ups, claims, comparisons, pivots and alignment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.operators.clusters import centroids, dot
from lectern.operators.intervals import as_of


def exactly_one(rows: DataFrame, condition: Column, value: str) -> DataFrame:
    """Value of the one row that fits; none or several are an error when the result is read."""
    found = rows.where(condition).agg(F.count("*").alias("n"), F.first(value).alias("value"))
    return found.select(F.when(F.col("n") == 1, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("rows found: "), F.col("n").cast("string"))).cast(dict(rows.dtypes)[value])).alias("value"))


def claims(parts: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """``claim_id, raw_value, display_value, unit, evidence_hash`` from single-row queries ``(value, unit, pattern)``."""
    made = []
    for claim, (row, unit, pattern) in parts.items():
        raw = F.col("value").cast("double")
        made.append(row.select(F.lit(claim).alias("claim_id"), raw.alias("raw_value"), F.format_string(pattern, raw).alias("display_value"), F.lit(unit).alias("unit")))
    out = reduce(DataFrame.unionByName, made)
    return out.withColumn("evidence_hash", F.sha2(F.concat_ws("|", "claim_id", "display_value", "unit"), 256))


def compare(models: dict[str, DataFrame]) -> DataFrame:
    """One row for each model, its measures side by side."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [m.withColumn("model", F.lit(n)) for n, m in models.items()])


def delta(rows: DataFrame, key: str, first, second, measures: list[str]) -> DataFrame:
    """Measures of two rows and what the second has more."""
    a = rows.where(F.col(key) == first).select(*[F.col(m).alias(f"{m}_first") for m in measures])
    b = rows.where(F.col(key) == second).select(*[F.col(m).alias(f"{m}_second") for m in measures])
    return a.crossJoin(b).select("*", *[F.round(F.col(f"{m}_second") - F.col(f"{m}_first"), 6).alias(f"{m}_delta") for m in measures])  # single rows


def topic_metadata(terms: DataFrame) -> DataFrame:
    """Ordered terms of each topic, and whether ranks run 1, 2, ... without a gap."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "term")))  # a topic's top terms
    out = terms.groupBy("topic").agg(F.array_join(F.transform(ordered, lambda t: t["term"]), "|").alias("terms"), F.count("*").alias("n"), F.max("rank").alias("last"), F.count_distinct("rank").alias("ranks"))
    return out.select("topic", "terms", "n", ((F.col("last") == F.col("n")) & (F.col("ranks") == F.col("n"))).alias("ranks_contiguous"))


def means_by_group(rows: DataFrame, group: str, labels: dict[str, str], measures: list[str]) -> DataFrame:
    """Means of measures for chosen groups under their labels, transposed: one row for each measure."""
    own = rows.where(F.col(group).isin(*labels))
    shown = reduce(lambda c, kv: F.when(F.col(group) == kv[0], kv[1]).otherwise(c), labels.items(), F.lit(None).cast("string"))
    pairs = F.stack(F.lit(len(measures)), *[x for m in measures for x in (F.lit(m), F.col(m).cast("double"))]).alias("measure", "x")
    return own.select(shown.alias("label"), pairs).groupBy("measure").pivot("label", list(labels.values())).agg(F.round(F.avg("x"), 6))


def pivot_share(long: DataFrame, row: str, column: str, values: list, measure: str) -> DataFrame:
    return long.groupBy(row).pivot(column, values).agg(F.first(measure))


def robustness(shares: DataFrame) -> DataFrame:
    """Shares of a topic and year in percent, the three levels side by side."""
    own = shares.withColumn("percent", F.round(F.col("prevalence_share") * 100, 6))
    return own.groupBy("topic", "year").pivot("aggregation_level", ["document", "source_turn", "session"]).agg(F.max("percent"))


def topic_lines(shares: DataFrame, level: str, topics: list[int] | None = None, years: int | None = None) -> DataFrame:
    """Points of topics' lines at one level, in percent; with ``years``, a topic with another number of points is an error."""
    own = shares.where(F.col("aggregation_level") == level)
    own = own if topics is None else own.where(F.col("topic").isin(*topics))
    if years is not None:
        wrong = own.groupBy("topic").agg(F.count("*").alias("n")).where(F.col("n") != years).limit(1).collect()
        if wrong:
            raise ValueError(f"topic {wrong[0].topic} has {wrong[0].n} points instead of {years}")
    return own.select("topic", "year", F.round(F.col("prevalence_share") * 100, 6).alias("percent"))


def selection_curve(grid: DataFrame, k: str, value: str) -> DataFrame:
    """Each configuration's value, how far it is below the best, and whether it is the one (a grid has a few rows)."""
    best = F.max(value).over(W.partitionBy())
    return grid.select(k, value, F.round(best - F.col(value), 6).alias("below_best"), (F.col(value) == best).alias("selected"))


def joined_offsets(segments: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """Where each segment begins and ends in its turn's text, segments being joined by one line break."""
    until = F.sum(F.length(text) + 1).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return segments.withColumn("joined_end", (until - 1).cast("long")).withColumn("joined_start", (F.col("joined_end") - F.length(text)).cast("long"))


def source_of_offset(offsets: DataFrame, wanted: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Segment and place in it of an offset in the joined text."""
    met = wanted.join(offsets, keys).where((F.col("joined_start") <= F.col("offset")) & (F.col("offset") <= F.col("joined_end")))
    return met.groupBy(*keys, "offset").agg(F.min(F.struct(order, (F.col("offset") - F.col("joined_start")).alias("source_offset"))).alias("s")).select(*keys, "offset", f"s.{order}", "s.source_offset")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, repeats counted; empty if they are equal."""
    return a.exceptAll(b).withColumn("only_in", F.lit("first")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("second")))


def key_problems(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that are missing on one side or repeated on either."""
    a = left.groupBy(key).agg(F.count("*").alias("a"))
    b = right.groupBy(key).agg(F.count("*").alias("b"))
    both = a.join(b, key, "full_outer").na.fill(0, ["a", "b"])
    return both.withColumn("problem", F.when(F.col("b") == 0, "missing on the right").when(F.col("a") == 0, "missing on the left").when((F.col("a") > 1) | (F.col("b") > 1), "repeated")).where("problem IS NOT NULL").select(key, "problem")


def hash_sample(rows: DataFrame, stratum: str, total: int, seed: int, key: str) -> DataFrame:
    """About ``total`` rows, each stratum in proportion: the first by a hash, so no order or partitioning matters."""
    size = rows.groupBy(stratum).agg(F.count("*").alias("_n"))
    whole = size.agg(F.sum("_n").alias("_all"))
    quota = size.crossJoin(F.broadcast(whole)).withColumn("_q", F.ceil(F.col("_n") * total / F.col("_all")))  # whole is one row
    rank = F.row_number().over(W.partitionBy(stratum).orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), key))
    return rows.withColumn("_r", rank).join(quota.select(stratum, "_q"), stratum).where("_r <= _q").drop("_r", "_q")


def distance_of_sides(rows: DataFrame, side: str, vector: str, time: str) -> DataFrame:
    """One minus the cosine of two sides' centroids, by time."""
    both = rows.withColumn("_k", F.struct(time, side))
    c = centroids(both, "_k", vector).select(F.col(f"_k.{time}").alias(time), F.col(f"_k.{side}").alias(side), "centroid")
    a, b = c.select(time, F.col(side).alias("a"), F.col("centroid").alias("ca")), c.select(time, F.col(side).alias("b"), F.col("centroid").alias("cb"))
    return a.join(b, time).where("a < b").select(time, "a", "b", F.round(1 - dot(F.col("ca"), F.col("cb")), 6).alias("distance"))


def alignment_chain(mentions: DataFrame, aliases: DataFrame, blocs: DataFrame, alignments: DataFrame) -> DataFrame:
    """Printed name to person, to bloc, to alignment, each as of the mention's date ``at``."""
    named = as_of(mentions, aliases.select("alias", "person", F.col("valid_from").alias("f1"), F.col("valid_to").alias("t1")), ["alias"], "at", "f1", "t1").drop("f1", "t1")
    member = as_of(named, blocs.select("person", "bloc", F.col("valid_from").alias("f2"), F.col("valid_to").alias("t2")), ["person"], "at", "f2", "t2").drop("f2", "t2")
    return as_of(member, alignments.select("bloc", "alignment", F.col("valid_from").alias("f3"), F.col("valid_to").alias("t3")), ["bloc"], "at", "f3", "t3").drop("f3", "t3")


def text_blocks(raw: DataFrame, normal) -> DataFrame:
    """Text blocks (type 0) with normalised text that is not blank; ``normal`` is the text function."""
    return raw.where("block_type = 0").withColumn("text", normal(F.col("text"))).where("text <> ''").drop("block_type")


def image_counts(raw: DataFrame, keys: list[str]) -> DataFrame:
    return raw.groupBy(*keys).agg(F.count_if(F.col("block_type") == 1).alias("image_block_count"), F.count_if(F.col("block_type") == 0).alias("text_block_count"))
