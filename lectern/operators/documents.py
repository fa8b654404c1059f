"""The strict scan of modelling documents, their records, and the order in which things first appear."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import quality as Q
from lectern.operators.corpus import ALLOWED_FAMILIES, MAXIMUM_CHUNK_WORDS, MINIMUM_WORDS, PERIODS, period_of
from lectern.sources.scratch import materialise

#: The fields that every document has.
REQUIRED = ["document_id", "source_record_id", "modeling_text", "session_date", "temporal_period", "session_category", "speaker_family", "turn_index", "chunk_index", "word_count", "year"]
_STRINGS, _NUMBERS = REQUIRED[:7], REQUIRED[7:]


def document_violations(documents: DataFrame, line: str = "document_id") -> DataFrame:
    """``line``, ``column``, ``severity`` and ``message`` for every rule that a document breaks, in one pass; missing columns are an error."""
    if missing := [c for c in REQUIRED if c not in documents.columns]:
        raise ValueError(f"documents lack {missing}")
    c = F.col
    error = lambda test, column, message: Q.rule(test, column, "error", message)
    day, year = F.try_to_date("session_date", "yyyy-MM-dd"), c("year").cast("long")
    dated = c("session_date").rlike(r"^\d{4}-\d{2}-\d{2}$") & day.isNotNull()
    rules = [error(F.coalesce(F.trim(n), F.lit("")) == "", n, "required value is blank") for n in _STRINGS]
    rules += [error(c(n).isNull(), n, "required value is missing") for n in _NUMBERS]
    rules += [
        error(c("turn_index") < 0, "turn_index", "below 0"), error(c("chunk_index") < 1, "chunk_index", "below 1"),
        error(~c("word_count").between(1, MAXIMUM_CHUNK_WORDS), "word_count", f"outside 1 to {MAXIMUM_CHUNK_WORDS}"),
        error(F.size(X.words(c("modeling_text"))) != c("word_count"), "word_count", "not the words of the text"),
        error(~c("speaker_family").isin(*ALLOWED_FAMILIES), "speaker_family", "value is not allowed"),
        error(~dated, "session_date", "not an ISO date"), error(dated & (F.year(day) != year), "year", "not the year of the date"),
        error(~c("temporal_period").eqNullSafe(period_of(year)), "temporal_period", "not the period of the year"),
    ]
    if "modeling_word_count" in documents.columns:
        rules.append(error(c("modeling_word_count") != c("word_count"), "modeling_word_count", "not the word count"))
    return Q.violations(documents, line, rules)


def validated(documents: DataFrame, line: str = "document_id") -> DataFrame:
    """The documents as they are; the first broken rule that is met ends the query."""
    broken = document_violations(documents.withColumn("_line", F.col(line)), "_line").limit(1).collect()
    if broken:
        raise ValueError(f"document {broken[0].line}: {broken[0].column} {broken[0].message}")
    return documents


def numbered(rows: DataFrame, order: list[str], name: str = "row_index") -> DataFrame:
    """Add 0, 1, ... in ``order`` (which has to be unique): sorted ranges and one count for each, so no task sorts all."""
    dealt = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), "numbered")
    dealt = dealt.withColumn("_range", F.shiftright("_place", 33))
    counts = dealt.groupBy("_range").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))  # one row for each range
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_range", (before - F.col("_first")).alias("_shift"))
    return dealt.join(F.broadcast(starts), "_range").withColumn(name, (F.col("_place") + F.col("_shift")).cast("long")).drop("_range", "_place", "_shift")


def first_appearance(rows: DataFrame, keys: list[str], index: str = "row_index", name: str = "key_index") -> DataFrame:
    """One row for each key with its first ``index``, its number of rows, and its own number in that order."""
    found = rows.groupBy(*keys).agg(F.min(index).alias("first_row_index"), F.count("*").alias("rows"))
    return numbered(found, ["first_row_index"], name)


def first_by_score(rows: DataFrame, topic: str, score: Column, row: str, n: int, outlier: int = -1) -> DataFrame:
    """The ``n`` rows of each topic with the highest score, ties in the order of rows; outliers have no topic.  Ranks start at 0."""
    rank = F.row_number().over(W.partitionBy(topic).orderBy(F.desc("score"), row)) - 1
    return rows.where(F.col(topic) != outlier).withColumn("score", score).withColumn("rank", rank.cast("long")).where(F.col("rank") < n)


def document_records(chunks: DataFrame, fragments: Column, metadata: list[str]) -> DataFrame:
    """Documents as they are exported: chunk, provenance clipped to it and counted from its start, and the pages it comes from.

    ``fragments`` is an array of ``(start, end, source)`` over the turn's text.
    """
    count = F.count("*").over(W.partitionBy("source_record_id", "turn_index"))
    cut = F.filter(fragments, lambda f: (f["end"] > F.col("start")) & (f["start"] < F.col("end")))
    clipped = F.transform(cut, lambda f: F.struct((F.greatest(f["start"], F.col("start")) - F.col("start")).alias("start"), (F.least(f["end"], F.col("end")) - F.col("start")).alias("end"), f["source"].alias("source")))
    out = chunks.withColumn("chunk_count_for_turn", count).withColumn("provenance", clipped)
    pages = F.array_sort(F.array_distinct(F.transform("provenance", lambda f: f["source"])))
    return out.select("source_record_id", "turn_index", "chunk_index", "chunk_count_for_turn", *metadata, F.col("text").alias("exact_text"), F.lit("deterministic_reconstructed_spoken_text_chunk").alias("exact_text_kind"), X.collapse(F.col("text")).alias("modeling_text"), "word_count", "provenance", pages.alias("source_pages_covered"))


def exclusion_ledger(decisions: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """What was left out, and why: turns that were not retained, and the starts that overrides cut off."""
    own = decisions.where("decision <> 'retained'").select(*keys, F.lit("source_turn").alias("unit"), F.col("decision_reason").alias("exclusion_reason"), F.col(text).alias("exact_text"))
    cut = decisions.where("discarded_prefix IS NOT NULL").select(*keys, F.lit("override_prefix").alias("unit"), F.lit("discarded_before_anchor").alias("exclusion_reason"), F.col("discarded_prefix").alias("exact_text"))
    return own.unionByName(cut).withColumn("word_count", F.size(X.words(F.coalesce("exact_text", F.lit("")))).cast("long"))


def reconciliation(decisions: DataFrame, turns: DataFrame, documents: DataFrame, overrides: DataFrame, keys: list[str], allowed: tuple[str, ...] = ALLOWED_FAMILIES, minimum: int = MINIMUM_WORDS, most: int = MAXIMUM_CHUNK_WORDS) -> DataFrame:
    """The fifteen checks of an export as ``check_name`` and ``holds``.

    ``decisions`` has one row for each input turn (``decision``, ``word_count``,
    ``speaker_family``, ``year``), ``turns`` the retained ones (``chunk_count``, ``word_count``),
    ``documents`` their chunks (``document_id``, ``word_count``, ``separators_ok``), ``overrides``
    the configured ones with ``applied_count``.
    """
    none = lambda rows: rows.agg((F.count("*") == 0).alias("holds"))
    retained = decisions.where("decision = 'retained'")
    years = [y for p in PERIODS.values() for y in p]
    twice = decisions.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    undecided = decisions.where("decision IS NULL")
    apart = lambda a, b: a.join(b, keys, "left_anti").select(*keys).unionByName(b.join(a, keys, "left_anti").select(*keys))
    per = documents.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("word_count").alias("words"))
    declared = turns.join(per, keys, "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("words", F.coalesce("words", F.lit(0)))
    sums = turns.agg(F.coalesce(F.sum("word_count"), F.lit(0)).alias("a")).crossJoin(documents.agg(F.coalesce(F.sum("word_count"), F.lit(0)).alias("b")))  # one row each
    checks = {
        "all_configured_overrides_applied_once": none(overrides.where("applied_count <> 1")), "all_dates_inside_2008_2025": none(decisions.where(~F.col("year").between(min(years), max(years)))),
        "all_document_keys_map_to_retained_source_turn": none(documents.join(turns, keys, "left_anti")), "all_input_turns_have_one_decision": none(undecided),
        "all_parsed_turns_reconcile": decisions.agg((F.count("*") == F.count_if(F.col("decision") == "retained") + F.count_if(F.col("decision") != "retained")).alias("holds")),
        "all_retained_decisions_have_one_source_turn": none(apart(retained, turns)), "all_source_turns_have_declared_document_count": none(declared.where("chunk_count <> n").select(*keys).unionByName(apart(retained, turns))),
        "every_source_turn_has_at_least_one_document": none(turns.where("chunk_count <= 0")), "every_synthetic_separator_follows_policy": none(documents.where("NOT separators_ok")),
        "no_chunk_exceeds_maximum_words": none(documents.where(F.col("word_count") > most)), "no_duplicate_document_ids": none(documents.groupBy("document_id").agg(F.count("*").alias("n")).where("n > 1")),
        "no_duplicate_source_turn_decisions": none(twice), "no_retained_family_outside_allowed_set": none(retained.where(~F.coalesce("speaker_family", F.lit("")).isin(*allowed))),
        "no_retained_turn_below_minimum_words": none(retained.where(F.col("word_count") < minimum)), "retained_reconstructed_word_totals_match_chunks": sums.select((F.col("a") == F.col("b")).alias("holds")),
    }
    out = None
    for name, one in checks.items():
        row = one.select(F.lit(name).alias("check_name"), "holds")
        out = row if out is None else out.unionByName(row)
    return out


def block_problems(blocks: DataFrame, markers: str = "markers") -> DataFrame:
    """Blocks that speaker turns can't be read from: repeated places, other zones, bad numbers, and markers out of order, out of range or of other text."""
    place = ["source_record_id", "page_number", "reading_order"]
    m = F.col(markers)
    later = F.exists(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(m))), lambda k: (k <= F.size(m)) & (F.try_element_at(m, k.cast("int"))["start"] < F.try_element_at(m, (k - 1).cast("int"))["end"]))
    wrong = lambda test: F.exists(m, test)
    tests = {
        "repeated page and order": F.count("*").over(W.partitionBy(*place)) > 1, "not in the proceedings": F.col("structural_zone") != "proceedings", "page below 1": F.col("page_number") < 1, "order below 1": F.col("reading_order") < 1,
        "marker out of range": wrong(lambda x: ~((x["start"] >= 0) & (x["start"] < x["end"]) & (x["end"] <= F.length("text")))), "markers overlap": later,
        "marker of other text": wrong(lambda x: F.substring(F.col("text"), x["start"] + 1, x["end"] - x["start"]) != x["raw_marker"]),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), name) for name, test in tests.items()]))
    return blocks.select(*place, found.alias("_p")).select(*place, F.explode("_p").alias("problem")).distinct()


def count_differences(parsed: DataFrame, stored: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """``measure``, and both counts, wherever what was parsed and what was stored differ; a missing row counts 0."""
    a, b = (rows.groupBy(*keys).agg(*[F.sum(c).alias(f"{side}_{c}") for c in counts]) for side, rows in (("a", parsed), ("b", stored)))
    both = a.join(b, keys, "full_outer")
    each = F.array(*[F.struct(F.lit(c).alias("measure"), F.coalesce(f"a_{c}", F.lit(0)).cast("long").alias("parsed"), F.coalesce(f"b_{c}", F.lit(0)).cast("long").alias("stored")) for c in counts])
    return both.select(*keys, F.explode(each).alias("d")).select(*keys, "d.*").where("parsed <> stored")


def aligned(ids: DataFrame, embeddings: DataFrame, key: str, vector: str, tolerance: float = 1e-3) -> DataFrame:
    """Ids with their vector by key, never by position: ``problem`` says what is missing, not finite, or not of length one."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    problem = F.when(v.isNull(), "no vector").when(bad, "not finite").when(F.abs(length - 1) > tolerance, "length is not one")
    return ids.join(embeddings.select(key, vector), key, "left").withColumn("problem", problem)
