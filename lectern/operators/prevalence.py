"""Topic weights of documents, turns and sessions, and their means over time.

Weights are long rows ``(unit, topic, w)`` or arrays; means are means of means: a
session is the mean of its turns, not of its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def total(w: Column) -> Column:
    return F.aggregate(w, F.lit(0.0), lambda a, x: a + x)


def normalised(w: Column) -> Column:
    """Weights that sum to one; rows of zeros stay."""
    own = F.transform(w, lambda x: F.greatest(x.cast("double"), F.lit(0.0)))
    return F.when(total(own) > 0, F.transform(own, lambda x: x / total(own))).otherwise(own)


def row_check(w: Column) -> Column:
    """Why a row of weights can't be normalised, or null."""
    return (
        F.when(F.exists(w, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not_finite")
        .when(F.exists(w, lambda x: x < -1e-8), "negative")
        .when(total(w) <= 0, "zero_sum")
    )


def entropy(w: Column) -> Column:
    """Entropy of shares against that of even ones."""
    return F.aggregate(w, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.ln(x)).otherwise(0.0)) / F.ln(F.size(w).cast("double"))


def dominant(w: Column) -> Column:
    """Number of the greatest weight, the lowest on ties."""
    return (F.array_position(w, F.array_max(w)) - 1).cast("long")


def mean_weights(rows: DataFrame, keys: list[str], w: str = "w") -> DataFrame:
    """Element-wise mean of arrays by group, as long rows ``keys, topic, w``."""
    return rows.select(*keys, F.posexplode(w).alias("topic", "x")).groupBy(*keys, F.col("topic").cast("long").alias("topic")).agg(F.avg(F.col("x").cast("double")).alias("w"))


def mean_of_means(long: DataFrame, keys: list[str]) -> DataFrame:
    return long.groupBy(*keys, "topic").agg(F.avg("w").alias("w"))


def inconsistent(rows: DataFrame, keys: list[str], meta: list[str]) -> DataFrame:
    """Groups whose metadata are not constant."""
    return rows.groupBy(*keys).agg(F.count_distinct(F.struct(*meta)).alias("variants")).where("variants > 1")


def prevalence(levels: dict[str, DataFrame], time: str) -> DataFrame:
    """Mean share and number of units by level, time and topic."""
    out = None
    for name, frame in levels.items():
        one = frame.groupBy(time, "topic").agg(F.round(F.avg("w"), 8).alias("prevalence_share"), F.count("*").alias("denominator_unit_count")).withColumn("aggregation_level", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def share_check(shares: DataFrame, keys: list[str]) -> DataFrame:
    """Groups whose shares don't sum to one."""
    return shares.groupBy(*keys).agg(F.sum("prevalence_share").alias("s")).where(F.abs(F.col("s") - 1) > 1e-5)


def denominators(rows: DataFrame, years: tuple[int, int], year: str, turn: str, session: str, words: str, zero: str) -> DataFrame:
    """Documents, turns, sessions, words and zero-vector documents of every year, with zeros."""
    frame = rows.sparkSession.range(years[0], years[1] + 1).toDF("year")
    own = ~F.col(zero)
    counts = rows.groupBy(F.col(year).cast("long").alias("year")).agg(F.count_if(own).alias("modeled_documents"), F.count_distinct(F.when(own, F.col(turn))).alias("modeled_turns"), F.count_distinct(F.when(own, F.col(session))).alias("modeled_sessions"), F.sum(F.when(own, F.col(words)).otherwise(0)).alias("word_total"), F.count_if(F.col(zero)).alias("zero_documents"))
    return frame.join(counts, "year", "left").na.fill(0)


def change_summary(annual: DataFrame, periods: DataFrame, baseline: str, final: str) -> DataFrame:
    """First against last period, best and worst year, and greatest rise and fall; ties go to the earliest year."""
    by_year = W.partitionBy("topic").orderBy("year")
    step = annual.withColumn("change", F.col("share") - F.lag("share").over(by_year))
    early = -F.col("year")
    s = lambda c, y: F.struct(c.alias("v"), y.alias("y"))
    years = step.groupBy("topic").agg(
        F.max_by("year", s(F.col("share"), early)).alias("peak_year"), F.min_by("year", s(F.col("share"), F.col("year"))).alias("trough_year"),
        F.max_by("year", F.when(F.col("change").isNotNull(), s(F.col("change"), early))).alias("rise_year"), F.min_by("year", F.when(F.col("change").isNotNull(), s(F.col("change"), F.col("year")))).alias("fall_year"),
        F.round(F.max("change"), 6).alias("largest_rise"), F.round(F.min("change"), 6).alias("largest_fall"),
    )
    a = periods.where(F.col("period") == baseline).select("topic", F.col("share").alias("a"))
    b = periods.where(F.col("period") == final).select("topic", F.col("share").alias("b"))
    out = years.join(a, "topic", "left").join(b, "topic", "left")
    return out.withColumn("absolute_change", F.round(F.col("b") - F.col("a"), 6)).withColumn("relative_change", F.when(F.col("a") > 0, F.round((F.col("b") - F.col("a")) / F.col("a"), 6))).drop("a", "b")


def representatives(long: DataFrame, n: int, turn: str, key: str) -> DataFrame:
    """Best ``n`` documents of a topic, from different turns first, then filled up."""
    in_turn = F.row_number().over(W.partitionBy("topic", turn).orderBy(F.desc("w"), key))
    ranked = long.withColumn("rn", in_turn)
    best = F.row_number().over(W.partitionBy("topic").orderBy((F.col("rn") > 1).cast("int"), F.desc("w"), key))
    return ranked.withColumn("rank", best.cast("long")).where(F.col("rank") <= n).drop("rn")
