"""Data-quality rules: each operator gives violations, one row each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key is not blank and not among the parent's."""
    known = parent.select(F.col(parent_key).alias("_key")).where(F.col("_key").isNotNull()).distinct()
    own = child.where(F.trim(F.col(key).cast("string")) != "")
    return own.join(known, F.col(key) == F.col("_key"), "left_anti")


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("times")).where("times > 1")


def duplicate_rows(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """Second and later copies of a row, with the first one's number."""
    same = W.partitionBy(*columns).orderBy(order)
    return rows.withColumn("copy", F.row_number().over(same).cast("long")).withColumn("first", F.first(order).over(same)).where("copy > 1")


def rule(test: Column, column: str, severity: str, message: str) -> Column:
    """A violation where ``test`` is true."""
    return F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(column).alias("column"), F.lit(severity).alias("severity"), F.lit(message).alias("message")))


def required(column: str) -> Column:
    return rule(F.coalesce(F.trim(F.col(column).cast("string")), F.lit("")) == "", column, "error", "required value is blank")


def iso_date(column: str, blank_ok: bool = True) -> Column:
    x = F.trim(F.col(column).cast("string"))
    bad = (x != "") & (~x.rlike(r"^\d{4}-\d{2}-\d{2}$") | F.try_to_date(x, "yyyy-MM-dd").isNull())
    return rule(bad if blank_ok else bad | (F.coalesce(x, F.lit("")) == ""), column, "error", "not an ISO date")


def member(column: str, allowed: list[str], blank_ok: bool = True) -> Column:
    x = F.trim(F.col(column).cast("string"))
    return rule(((x != "") if blank_ok else F.lit(True)) & ~x.isin(*allowed), column, "error", "value is not allowed")


def ordered(first: str, last: str) -> Column:
    a, b = (F.try_to_date(F.trim(F.col(c).cast("string")), "yyyy-MM-dd") for c in (first, last))
    return rule(a > b, last, "error", "interval ends before it starts")


def violations(rows: DataFrame, line: str, rules: list[Column]) -> DataFrame:
    """``line``, ``column``, ``severity`` and ``message`` of every rule broken, in one pass."""
    return rows.select(F.col(line).alias("line"), F.explode(F.array_compact(F.array(*rules))).alias("v")).select("line", "v.*")


def overlaps(rows: DataFrame, keys: list[str], first: str, last: str, ident: str, value: str) -> DataFrame:
    """Pairs of closed intervals of a key that meet; a null end is open.

    Equal ``value`` is a warning, another one an error.  A row meets only rows
    that start no later than it ends, so the join is a range within a key.
    """
    far = F.to_date(F.lit("9999-12-31"))
    own = rows.where(F.col(first).isNotNull()).select(*keys, F.col(first).alias("f"), F.coalesce(F.col(last), far).alias("t"), F.col(ident).alias("i"), F.col(value).alias("v"))
    a = own.select(*keys, *[F.col(c).alias(f"a_{c}") for c in "ftiv"])
    b = own.select(*keys, *[F.col(c).alias(f"b_{c}") for c in "ftiv"])
    met = a.join(b, keys).where((F.col("a_i") < F.col("b_i")) & (F.col("a_f") <= F.col("b_t")) & (F.col("b_f") <= F.col("a_t")))
    return met.select(*keys, F.col("a_i").alias("first_id"), F.col("b_i").alias("second_id"), F.when(F.col("a_v").eqNullSafe(F.col("b_v")), "warning").otherwise("error").alias("severity"))


def header_violations(found: list[str], declared: list[str], table: str) -> list[tuple[str, str, str]]:
    """Header against the declared columns; checked for empty tables too."""
    return [] if found == declared else [(table, "error", f"columns {found} instead of {declared}")]


def report(parts: dict[str, DataFrame]) -> DataFrame:
    """Violations of all tables: ``table``, then their columns."""
    return reduce(DataFrame.unionByName, [v.withColumn("table", F.lit(name)) for name, v in parts.items()])


def ordered_digest(rows: DataFrame, key: str, levels: int = 3, span: int = 4096) -> DataFrame:
    """``rows`` and a digest of whole-number keys in their order: digests of ranges of ``span`` keys, digests of ``span`` of those, and so on.

    No task joins more than ``span`` strings, but for the last one, which joins a
    string for each ``span ** levels`` keys.
    """
    ranges = rows.select(F.floor(F.col(key) / span).alias("_r"), F.col(key).cast("string").alias("_v"), F.col(key).alias("_k"))
    now = ranges.groupBy("_r").agg(F.count("*").alias("rows"), F.array_sort(F.collect_list(F.struct("_k", "_v"))).alias("_l"))
    join = lambda: F.sha2(F.array_join(F.transform("_l", lambda x: x["_v"]), "\n"), 256)
    now = now.select(F.col("_r").alias("_k"), "rows", join().alias("_v"))
    for level in range(1, levels + 1):
        group = F.floor(F.col("_k") / span) if level < levels else F.lit(0)
        now = now.groupBy(group.alias("_r")).agg(F.sum("rows").alias("rows"), F.array_sort(F.collect_list(F.struct("_k", "_v"))).alias("_l")).select(F.col("_r").alias("_k"), "rows", join().alias("_v"))
    return now.select("rows", F.col("_v").alias("ordered_digest"))
