"""Joins on validity intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_of(rows: DataFrame, dated: DataFrame, keys: list[str], at: str, first: str, last: str, open_end: bool = True) -> DataFrame:
    """Left join of each row with the entries of its key that hold on its date.

    A null end is open, unless ``open_end`` is false: then such entries never hold.
    The key makes it an equi-join; the dates are a residual condition.
    """
    end = F.coalesce(F.col(f"d.{last}"), F.to_date(F.lit("9999-12-31"))) if open_end else F.col(f"d.{last}")
    on = [F.col(f"r.{k}") == F.col(f"d.{k}") for k in keys] + [F.col(f"d.{first}") <= F.col(f"r.{at}"), F.col(f"r.{at}") <= end]
    return rows.alias("r").join(dated.alias("d"), on, "left").select("r.*", *[f"d.{c}" for c in dated.columns if c not in rows.columns])


def split_label(label: Column) -> tuple[Column, Column]:
    """Surname and initials of ``SURNAME (INI)``; without brackets the whole label and an empty string."""
    pattern = r"^(.+?)\s*\(([^)]+)\)\s*$"
    return F.when(label.rlike(pattern), F.regexp_extract(label, pattern, 1)).otherwise(label), F.regexp_extract(label, pattern, 2)


def match_people(rows: DataFrame, row_key: str, name: str, initials: str) -> DataFrame:
    """``match`` of each row after ``as_of``: one name, several or none; initials decide between several."""
    starts = F.upper(F.col(name)).startswith(F.upper(F.col(initials)))
    found = rows.groupBy(row_key).agg(F.count_distinct(name).alias("names"), F.count_distinct(F.when((F.col(initials) != "") & starts, F.col(name))).alias("fitting"), F.max(F.when((F.col(initials) != "") & starts, F.col(name))).alias("by_initials"), F.max(name).alias("any_name"))
    one = (F.col("names") == 1) | (F.col("fitting") == 1)
    return found.select(row_key, F.when(one, "match_unico").when(F.col("names") > 1, "ambiguo").otherwise("sin_match").alias("match"), F.when(F.col("fitting") == 1, F.col("by_initials")).when(F.col("names") == 1, F.col("any_name")).alias("matched_name"))


def contained(spans: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """Number of segments of its block that hold a span; each span has to lie in one."""
    on = [F.col(f"s.{k}") == F.col(f"g.{k}") for k in keys] + [F.col("g.start") <= F.col("s.start"), F.col("s.end") <= F.col("g.end")]
    hit = spans.alias("s").join(segments.alias("g"), on, "left")
    return hit.groupBy(*[F.col(f"s.{k}") for k in keys], F.col("s.start"), F.col("s.end")).agg(F.count("g.start").alias("segment_count"), F.min("g.segment_index").alias("segment_index"))


def event_windows(values: DataFrame, events: DataFrame, year: str, span: int, measure: str, keys: list[str]) -> DataFrame:
    """Mean of a measure over each event's year and the ``span`` years after it; windows may overlap."""
    # an event is repeated for each of its years, so that the join has a key
    spread = events.select("event", F.explode(F.sequence(F.col("event_year"), F.col("event_year") + span)).alias(year))
    return values.join(F.broadcast(spread), year).groupBy("event", *keys).agg(F.round(F.avg(measure), 6).alias("mean_value"), F.count("*").alias("n"))


def effective(chain: DataFrame, *dated: tuple[DataFrame, list[str], str, str]) -> DataFrame:
    """Follow several dated tables in turn, each by its keys, as of ``at``."""
    for table, keys, first, last in dated:
        chain = as_of(chain, table, keys, "at", first, last).drop(first, last)
    return chain
