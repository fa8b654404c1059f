"""Exact corpus statistics: counts, ranks, quantiles, samples and anomalies.

Token statistics take documents with an array of ``universes``, so a text is cut
into tokens once, however many universes it is in, and totals are pre-aggregated
before the shuffle; the others take one row for each universe (``fan_out``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.sources.scratch import materialise

#: Reported quantiles, and sequences that betray wrongly decoded text.
QUANTILES = {"p01": 0.01, "p05": 0.05, "p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90, "p95": 0.95, "p99": 0.99}
MOJIBAKE = ["Ã", "Â", "â€", "â€“", "â€”", "â"]
LONG_TOKEN = 30


def with_universes(docs: DataFrame, primary: Column) -> DataFrame:
    """``universes``: ``all_sessions``, and ``primary`` too if the condition holds."""
    return docs.withColumn("universes", F.when(primary, F.array(F.lit("all_sessions"), F.lit("primary"))).otherwise(F.array(F.lit("all_sessions"))))


def fan_out(rows: DataFrame) -> DataFrame:
    """One row for each of a row's universes."""
    return rows.withColumn("universe", F.explode("universes")).drop("universes")


def with_universe(docs: DataFrame, primary: Column) -> DataFrame:
    return fan_out(with_universes(docs, primary))


def token_totals(docs: DataFrame, tokens: Column) -> DataFrame:
    """``total_count`` and ``document_count`` of every token of a universe, in one pass over the texts.

    A document gives a row for each token and one more for each distinct token;
    both kinds are added up before they are shuffled, and universes after that.
    """
    mark = lambda n, d: lambda t: F.struct(t.alias("token"), F.lit(n).alias("n"), F.lit(d).alias("d"))
    own = docs.select("universes", tokens.alias("_t"))
    each = own.select("universes", F.explode(F.concat(F.transform("_t", mark(1, 0)), F.transform(F.array_distinct("_t"), mark(0, 1)))).alias("t"))
    counts = each.groupBy("universes", "t.token").agg(F.sum("t.n").alias("n"), F.sum("t.d").alias("d"))
    return fan_out(counts).groupBy("universe", "token").agg(F.sum("n").alias("total_count"), F.sum("d").alias("document_count"))


def global_ranks(rows: DataFrame, group: str, name: str, ranks: dict[str, str], lead: int = 3) -> DataFrame:
    """Ranks from 1 by falling measures, ties by ``name``, with no group sorted in one task; ``ranks`` gives the column for each measure.

    Rows are counted by measure and the first ``lead`` characters of the name; the
    running sum of these counts, a small table, is where each cell's ranks begin,
    and rows are ranked within their cell alone.  ``rows`` are read several times:
    give a written table.
    """
    own = rows.withColumn("_lead", F.substring(name, 1, lead))
    out = own
    for measure, rank in ranks.items():
        cell = [group, measure, "_lead"]
        before = F.sum("_n").over(W.partitionBy(group).orderBy(F.desc(measure), "_lead").rowsBetween(W.unboundedPreceding, -1))
        starts = own.groupBy(*cell).agg(F.count("*").alias("_n")).select(*cell, F.coalesce(before, F.lit(0)).alias("_start"))
        inside = F.row_number().over(W.partitionBy(*cell).orderBy(name))
        out = out.join(starts, cell).withColumn(rank, (F.col("_start") + inside).cast("long")).drop("_start")
    return out.drop("_lead")


def token_frequency(docs: DataFrame, tokens: Column) -> DataFrame:
    """Totals, document counts and both ranks of every token of a universe."""
    size = fan_out(docs.select("universes")).groupBy("universe").agg(F.count("*").alias("documents"))
    counts = materialise(token_totals(docs, tokens), "token-totals")
    ranked = global_ranks(counts, "universe", "token", {"total_count": "rank_by_total_frequency", "document_count": "rank_by_document_frequency"})
    return ranked.join(F.broadcast(size), "universe").select(  # one row for each universe
        "universe", "rank_by_total_frequency", "rank_by_document_frequency", "token", X.token_class(F.col("token")).alias("token_class"), F.length("token").cast("long").alias("token_length"),
        "total_count", "document_count", X.safe_ratio(F.col("document_count"), F.col("documents")).alias("document_fraction"),
    )


def top_tokens(docs: DataFrame, tokens: Column, n: int) -> DataFrame:
    """The ``n`` most frequent tokens of a universe; only these reach a window's task in full."""
    rank = F.row_number().over(W.partitionBy("universe").orderBy(F.desc("total_count"), "token"))
    return token_totals(docs, tokens).withColumn("rank", rank.cast("long")).where(F.col("rank") <= n)


def vocabulary_growth(docs: DataFrame, tokens: Column, year: str) -> DataFrame:
    """Vocabulary of each year, tokens new in it, and distinct tokens so far."""
    seen = docs.select("universe", F.col(year).cast("long").alias("year"), F.explode(F.array_distinct(tokens)).alias("token")).distinct()
    sizes = seen.groupBy("universe", "year").agg(F.count("*").alias("vocabulary_size"))
    new = seen.groupBy("universe", "token").agg(F.min("year").alias("year")).groupBy("universe", "year").agg(F.count("*").alias("new_tokens"))
    out = sizes.join(new, ["universe", "year"], "left").withColumn("new_tokens", F.coalesce("new_tokens", F.lit(0)))
    return out.withColumn("cumulative_tokens", F.sum("new_tokens").over(W.partitionBy("universe").orderBy("year")))


def length_statistics(docs: DataFrame, n: str, keys: list[str]) -> DataFrame:
    """Moments and exact, linearly interpolated quantiles of a length."""
    at = F.percentile(n, F.array(*[F.lit(q) for q in QUANTILES.values()]))
    r = lambda c, name: F.round(c, 6).alias(name)
    out = docs.groupBy(*keys).agg(F.count(n).alias("documents"), F.min(n).cast("long").alias("least"), F.max(n).cast("long").alias("most"), r(F.avg(n), "mean"), r(F.median(n), "median"), r(F.stddev_pop(n), "stddev"), at.alias("q"))
    return out.select(*keys, "documents", "least", "most", "mean", "median", "stddev", *[F.round(F.col("q")[k], 6).alias(name) for k, name in enumerate(QUANTILES)])


def length_histogram(docs: DataFrame, n: str, most: int, key: str) -> DataFrame:
    """Every length from 1 to ``most``, with zeros; ``most + 1`` counts all longer ones, and 0 the empty, so that no document is left out."""
    spark = docs.sparkSession
    length = F.least(F.coalesce(F.col(n), F.lit(0)), F.lit(most + 1)).cast("long")
    counts = docs.groupBy(key, length.alias("word_count")).agg(F.count("*").alias("document_count"))
    frame = docs.select(key).distinct().crossJoin(F.broadcast(spark.range(0, most + 2).toDF("word_count")))  # groups x a fixed number
    return frame.join(counts, [key, "word_count"], "left").withColumn("document_count", F.coalesce("document_count", F.lit(0)))


def group_counts(docs: DataFrame, groups: list[str], words: str, turn: list[str], session: str) -> DataFrame:
    """Documents, turns, sessions, words and mean length for several groupings in one pass."""
    sets = ", ".join(f"(universe, {g})" for g in groups)
    view = f"group_counts_{abs(hash((tuple(groups), words))) % 10**8}"
    docs.createOrReplaceTempView(view)
    name = " ".join(f"WHEN grouping({g}) = 0 THEN '{g}'" for g in groups)
    value = "coalesce(" + ", ".join(f"CASE WHEN grouping({g}) = 0 THEN cast({g} AS string) END" for g in groups) + ")"
    return docs.sparkSession.sql(f"""
        SELECT universe, CASE {name} END AS group_name, {value} AS group_value, count(*) AS document_count, count(DISTINCT {', '.join(turn)}) AS source_turn_count,
               count(DISTINCT {session}) AS session_count, sum({words}) AS word_total, round(avg({words}), 6) AS mean_document_length
        FROM {view} GROUP BY GROUPING SETS ({sets})""")


def candidate_stopwords(frequency: DataFrame, min_fraction: float, min_total: int, seeds: list[str]) -> DataFrame:
    """Tokens that might be stop words, with all reasons; none is removed here."""
    token = F.col("token")
    reasons = F.array_sort(F.array_compact(F.array(
        F.when(F.col("document_fraction") >= min_fraction, "high_document_fraction"), F.when(F.col("total_count") >= min_total, "high_total_count"),
        F.when((F.length(token) <= 2) & (F.col("token_class") == "alphabetic"), "short_alphabetic"), F.when(token.isin(*seeds), "procedural_seed"),
    )))
    out = frequency.withColumn("reasons", reasons).where(F.size("reasons") > 0)
    return out.select("universe", "token", "token_class", "token_length", "total_count", "document_count", "document_fraction", F.array_join("reasons", "|").alias("candidate_reasons"), F.lit(False).alias("selected_for_removal"))


#: One test for all kinds of odd tokens; which kinds, is asked of the few that pass.
_ODD_TOKEN = rf"\p{{Nd}}|^\p{{L}}$|^.{{{LONG_TOKEN},}}$|(.)\1{{3}}"


def anomalies(text: Column, tokens: Column) -> Column:
    """All odd things in a text: array of reason (null for an odd token), value and how often."""
    one = lambda reason, value, n: F.struct(F.lit(reason).alias("reason"), value.alias("value"), n.cast("long").alias("n"))
    each = lambda reason: lambda value: one(reason, value, F.lit(1))
    literal = [("replacement_character", "\ufffd"), ("soft_hyphen", X.SOFT_HYPHEN), *[("mojibake_pattern", m) for m in MOJIBAKE]]
    found = [F.array(one(reason, F.lit(s), (F.length(text) - F.length(F.replace(text, F.lit(s), F.lit("")))) / len(s))) for reason, s in literal]
    for reason, pattern in (("control_character", r"[\p{Cc}&&[^\n\r\t]]"), ("format_or_unassigned_character", r"[\p{Cf}\p{Co}\p{Cs}\p{Cn}&&[^\x{AD}]]")):
        found.append(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), each(reason)))
    found.append(F.transform(F.filter(tokens, lambda t: t.rlike(_ODD_TOKEN)), each(None)))
    return F.filter(F.concat(*found), lambda a: a["n"] > 0)


def token_anomalies(token: Column) -> Column:
    """Reasons for which a token is odd."""
    kinds = [
        ("mixed_letter_digit", token.rlike(r"\p{L}") & token.rlike(r"\p{Nd}")), ("digit_only", token.rlike(r"^\p{Nd}+$")),
        ("single_letter", token.rlike(r"^\p{L}$")), ("unusually_long", F.length(token) >= LONG_TOKEN), ("repeated_character", token.rlike(r"(.)\1{3,}")),
    ]
    return F.array_compact(F.array(*[F.when(test, reason) for reason, test in kinds]))


def suspicious(docs: DataFrame, text: str, tokens: Column, key: str = "doc_id") -> DataFrame:
    """Anomalies of a universe: totals, documents and the ids of up to three lowest examples."""
    each = docs.select("universes", key, F.explode(anomalies(F.col(text), tokens)).alias("a")).groupBy("universes", key, F.col("a.reason").alias("reason"), F.col("a.value").alias("value")).agg(F.sum("a.n").alias("n"))
    each = each.withColumn("reason", F.explode(F.when(F.col("reason").isNull(), token_anomalies(F.col("value"))).otherwise(F.array("reason"))))
    each = fan_out(materialise(each, "anomalies"))
    rank = F.row_number().over(W.partitionBy("universe", "reason", "value").orderBy(key))
    # examples from a ranked prefix: a group's ids are never gathered in full
    first = each.withColumn("r", rank).where("r <= 3").groupBy("universe", "reason", "value").agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda i: i.cast("string")), "|").alias("example_ids"))
    totals = each.groupBy("universe", "reason", "value").agg(F.sum("n").alias("total_count"), F.count("*").alias("document_count"))
    return totals.join(first, ["universe", "reason", "value"]).withColumnRenamed("value", "token_or_anomaly")


def stratified_sample(docs: DataFrame, strata: list[str], k: int, seed: int, key: str = "doc_id") -> DataFrame:
    """The ``k`` documents of each stratum with the smallest SHA-256 of seed and id; no order of rows matters."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    rank = F.row_number().over(W.partitionBy(*strata).orderBy("sample_hash", key))
    return docs.withColumn("sample_hash", mark).withColumn("sample_rank", rank.cast("long")).where(F.col("sample_rank") <= k)


def bigrams(sample: DataFrame, tokens: Column, least_length: int, n: int, key: str = "doc_id") -> DataFrame:
    """Most frequent pairs of neighbouring tokens that both are long enough; never across documents."""
    kept = sample.withColumn("t", F.filter(tokens, lambda t: F.length(t) >= least_length))
    size = sample.groupBy("universe").agg(F.count("*").alias("sample_document_total"))
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda i: F.struct(F.element_at("t", i).alias("a"), F.element_at("t", i + 1).alias("b"))))
    each = kept.where(F.size("t") > 1).select("universe", key, pair.alias("p")).groupBy("universe", key, "p").agg(F.count("*").alias("n"))
    counts = each.groupBy("universe", F.col("p.a").alias("token_1"), F.col("p.b").alias("token_2")).agg(F.sum("n").alias("sample_count"), F.count("*").alias("sample_document_count"))
    rank = F.row_number().over(W.partitionBy("universe").orderBy(F.desc("sample_count"), "token_1", "token_2"))
    out = counts.withColumn("rank", rank.cast("long")).where(F.col("rank") <= n).join(F.broadcast(size), "universe")  # one row for each universe
    return out.select("universe", "rank", F.concat_ws(" ", "token_1", "token_2").alias("bigram"), "token_1", "token_2", "sample_count", "sample_document_count", X.safe_ratio(F.col("sample_document_count"), F.col("sample_document_total")).alias("sample_document_fraction"), "sample_document_total")


def token_contexts(sample: DataFrame, candidates: DataFrame, tokens: Column, text: str, n: int, key: str = "doc_id") -> DataFrame:
    """First ``n`` sampled documents that hold a candidate token, by hash and id, with the text around it."""
    each = sample.select("universe", key, "sample_hash", F.col(text).alias("body"), F.explode(F.array_distinct(tokens)).alias("token"))
    rank = F.row_number().over(W.partitionBy("universe", "token").orderBy("sample_hash", key))
    hit = each.join(candidates.select("universe", "token"), ["universe", "token"], "left_semi").withColumn("context_rank", rank.cast("long")).where(F.col("context_rank") <= n)
    return hit.select("universe", "token", "context_rank", key, X.snippet(F.col("body"), F.col("token")).alias("context"))


def extremes(counts: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Groups with most and fewest words and documents, and the largest one's share."""
    size = F.struct("word_total", "document_count")
    share = F.round(F.max("word_total") / F.sum("word_total"), 6)
    return counts.groupBy(*keys).agg(F.max_by(group, size).alias("highest"), F.min_by(group, size).alias("lowest"), share.alias("largest_share"))


def partition_check(whole: DataFrame, parts: dict[str, DataFrame], key: str, measure: str) -> DataFrame:
    """Whether parts are disjoint and make up the whole in rows, sums and keys."""
    tagged = None
    for name, part in parts.items():
        one = part.select(key, measure, F.lit(name).alias("part"))
        tagged = one if tagged is None else tagged.unionByName(one)
    own = tagged.groupBy(key).agg(F.count("*").alias("times"), F.sum(measure).alias("part_sum"))
    both = whole.groupBy(key).agg(F.sum(measure).alias("whole_sum")).join(own, key, "full_outer")
    return both.agg(
        F.count_if(F.col("times") > 1).alias("overlapping_keys"), F.count_if(F.col("whole_sum").isNull()).alias("foreign_keys"), F.count_if(F.col("times").isNull()).alias("missing_keys"),
        (F.coalesce(F.sum("whole_sum"), F.lit(0)) == F.coalesce(F.sum("part_sum"), F.lit(0))).alias("sums_agree"),
    )
