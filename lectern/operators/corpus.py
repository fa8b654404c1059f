"""From speaker turns to documents: decisions, overrides, bounded chunks, ledgers, counters and checks."""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as X

#: Analytical periods.
PERIODS = {"2008-2011": (2008, 2011), "2012-2015": (2012, 2015), "2016-2019": (2016, 2019), "2020-2023": (2020, 2023), "2024-2025": (2024, 2025)}
ALLOWED_FAMILIES = ("named_or_role_unspecified", "executive_official")
MINIMUM_WORDS, MAXIMUM_CHUNK_WORDS = 25, 300


def period_of(year: Column, periods: dict[str, tuple[int, int]] = PERIODS, strict: bool = False) -> Column:
    """Label of the closed period that holds a year; beyond all of them null, or an error if ``strict``."""
    out = F.raise_error(F.concat(F.lit("year beyond all periods: "), year.cast("string"))).cast("string") if strict else F.lit(None).cast("string")
    for label, (first, last) in reversed(periods.items()):
        out = F.when(year.between(first, last), label).otherwise(out)
    return out


def document_id(source: Column, turn: Column, chunk: Column) -> Column:
    return F.format_string("%s__turn_%06d__chunk_%03d", source, turn.cast("int"), chunk.cast("int"))


def turn_id(source: Column, turn: Column) -> Column:
    return F.format_string("%s__turn_%06d", source, turn.cast("int"))


def turn_key(source: Column, turn: Column) -> Column:
    return F.format_string("%s::turn_%06d", source, turn.cast("int"))


def with_decision(turns: DataFrame, words: str = "word_count", family: str = "speaker_family", excluded: str | None = None, allowed: tuple[str, ...] = ALLOWED_FAMILIES, minimum: int = MINIMUM_WORDS) -> DataFrame:
    """First rule that applies: override, no speech, family, too short; else retained.  A null family is not allowed."""
    rules = [(F.col(words) == 0, "excluded_zero_speech", "no_spoken_content"), (~F.coalesce(F.col(family), F.lit("")).isin(*allowed), "excluded_speaker_family", "speaker_family_not_in_modeling_scope"), (F.col(words) < minimum, "excluded_below_minimum_words", f"fewer_than_{minimum}_words")]
    if excluded:
        rules.insert(0, (F.coalesce(F.col(excluded), F.lit(False)), "excluded_by_override", "override"))
    decision, reason = F.lit("retained"), F.lit("meets_modeling_corpus_policy")
    for rule, d, r in reversed(rules):
        decision, reason = F.when(rule, d).otherwise(decision), F.when(rule, r).otherwise(reason)
    return turns.withColumn("decision", decision).withColumn("decision_reason", reason)


def apply_overrides(turns: DataFrame, overrides: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Left join of manual overrides.

    ``exclude_turn`` marks a turn; ``retain_from_anchor`` keeps the text from the
    first place of ``start_anchor`` on, takes the given family and label, and keeps
    the cut-off start in ``discarded_prefix``.  ``anchor_ok`` is false where the
    anchor doesn't occur as often as expected.
    """
    own = overrides.select(*keys, "action", "start_anchor", "expected_anchor_occurrences", F.col("speaker_family").alias("override_family"))
    out = turns.join(own, keys, "left")
    body, anchor = F.col(text), F.col("start_anchor")
    times = (F.length(body) - F.length(F.replace(body, anchor, F.lit("")))) / F.length(anchor)
    at = F.instr(body, anchor)
    cut = (F.col("action") == "retain_from_anchor") & (at > 0)
    return (
        out.withColumn("excluded_by_override", F.coalesce(F.col("action") == "exclude_turn", F.lit(False)))
        .withColumn("anchor_ok", F.when(F.col("action") == "retain_from_anchor", times == F.col("expected_anchor_occurrences")).otherwise(F.lit(True)))
        .withColumn("discarded_prefix", F.when(cut, F.substring(body, F.lit(1), at - 1)))
        .withColumn("speaker_family", F.coalesce("override_family", "speaker_family"))
        .withColumn(text, F.when(cut, F.substring(body, at, F.length(body))).otherwise(body))
        .drop("override_family")
    )


def override_ledger(overrides: DataFrame, turns: DataFrame, keys: list[str]) -> DataFrame:
    """How often each override applied; each has to apply once."""
    hits = overrides.join(turns.select(*keys, F.lit(1).alias("hit")), keys, "left")
    return hits.groupBy(*keys).agg(F.count("hit").alias("applied_count")).withColumn("applied_once", F.col("applied_count") == 1)


# Chunks.  A cut goes after a word; ends of paragraphs, sentences and clauses are preferred.

_WORD = re.compile(r"\S+")
_SENTENCE = re.compile(r"[.!?¡¿…]+[\"')\]}»]*$")
_CLAUSE = re.compile(r"[,;:][\"')\]}»]*$")


def chunk_bounds(text: str, most: int = MAXIMUM_CHUNK_WORDS) -> list[tuple[int, int]]:
    """Start and end of chunks of ``most`` words at most that make up the text.

    Each chunk ends after one of the next ``most`` words, where the next word
    begins.  In the last quarter of that window the best kind of boundary wins, and
    of its places the last; failing that, in the last half the last boundary of any
    kind; failing that, the window's end.
    """
    spans = [m.span() for m in _WORD.finditer(text)]
    n = len(spans)
    if not n:
        return []
    places: list[list[int]] = [[], [], []]  # by kind: how many words lie before each possible cut
    for k in range(1, n):
        word = text[slice(*spans[k - 1])]
        tests = (text.count("\n", spans[k - 1][1], spans[k][0]) > 1, _SENTENCE.search(word), _CLAUSE.search(word))
        for kind, hit in enumerate(tests):
            if hit:
                places[kind].append(k)

    def last(kind: int, low: int, high: int) -> int:
        i = bisect_left(places[kind], high + 1)
        return places[kind][i - 1] if i and places[kind][i - 1] >= low else 0

    cuts, done = [0], 0
    while n - done > most:
        high = done + most
        quarter, half = (max(done + 1, high - max(1, most // part) + 1) for part in (4, 2))
        ranked = [last(kind, quarter, high) for kind in range(3)]
        best = next(filter(None, ranked), 0) or max(last(kind, half, high) for kind in range(3)) or high
        cuts.append(spans[best][0])
        done = best
    cuts.append(len(text))
    return list(zip(cuts, cuts[1:]))


_CHUNKS = "array<struct<chunk_index:int,start:int,end:int,word_count:int,text:string>>"


def chunks(turns: DataFrame, text: str = "text", most: int = MAXIMUM_CHUNK_WORDS) -> DataFrame:
    """One row for each chunk: the turn's columns without the text, then index (from 1), bounds, words and text."""

    @F.pandas_udf(_CHUNKS)
    def split(x: pd.Series) -> pd.Series:
        return x.map(lambda t: [] if t is None else [{"chunk_index": k, "start": a, "end": b, "word_count": len(t[a:b].split()), "text": t[a:b]} for k, (a, b) in enumerate(chunk_bounds(t, most), 1)])

    kept = [c for c in turns.columns if c not in (text, "chunk_index", "start", "end", "word_count")]
    return turns.withColumn("_c", F.explode(split(F.col(text)))).select(*kept, "_c.*")


def modeling_documents(turns: DataFrame, source: str, turn: str, text: str = "text", most: int = MAXIMUM_CHUNK_WORDS) -> DataFrame:
    """Documents of retained turns: identifiers, exact text, its hash and the collapsed modelling text."""
    out = chunks(turns, text, most).withColumn("document_id", document_id(F.col(source), F.col(turn), F.col("chunk_index")))
    body = X.collapse(F.col("text"))
    return out.withColumn("content_hash", F.sha2("text", 256)).withColumn("modeling_text", body).withColumn("modeling_word_count", F.size(X.words(body)).cast("long"))


def slice_fragments(fragments: Column, start: Column, end: Column) -> Column:
    """Fragments (``start``, ``end``, ``source``) clipped to [start, end) and counted from ``start``."""
    inside = F.filter(fragments, lambda f: (f["end"] > start) & (f["start"] < end))
    return F.transform(inside, lambda f: F.struct((F.greatest(f["start"], start) - start).alias("start"), (F.least(f["end"], end) - start).alias("end"), f["source"].alias("source")))


def export_counts(turns: DataFrame, documents: DataFrame, group: str) -> DataFrame:
    """Turns, documents and words by group, from the turn and the document grain."""
    a = turns.groupBy(group).agg(F.count("*").alias("source_turn_count"))
    b = documents.groupBy(group).agg(F.count("*").alias("document_count"), F.coalesce(F.sum("word_count"), F.lit(0)).cast("long").alias("word_total"))
    return a.join(b, group, "full_outer").select(group, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("source_turn_count", "document_count", "word_total")])


def export_counters(turns: DataFrame, documents: DataFrame, groups: list[str], category: str = "session_category", main: str = "legislative_debate") -> DataFrame:
    """``export_counts`` for several groupings in long form, and for the main category against all others (``roll_up``)."""
    side = F.when(F.col(category) == main, main).otherwise("other")
    out = None
    for g in [*groups, "roll_up"]:
        a, b = (rows.withColumn("roll_up", side) if g == "roll_up" else rows for rows in (turns, documents))
        one = export_counts(a, b, g).withColumn("group_name", F.lit(g)).withColumn("group_value", F.col(g).cast("string")).drop(g)
        out = one if out is None else out.unionByName(one)
    return out.select("group_name", "group_value", "source_turn_count", "document_count", "word_total")


def override_problems(turns: DataFrame, overrides: DataFrame, keys: list[str]) -> DataFrame:
    """Overrides that apply not exactly once, or to a turn of another date or word count than they expect."""
    own = overrides.select(*keys, F.col("session_date").alias("_day"), F.col("expected_speech_word_count").alias("_words"))
    met = own.join(turns.select(*keys, "session_date", "word_count"), keys, "left")
    each = met.groupBy(*keys, "_day", "_words").agg(F.count("word_count").alias("n"), F.first("session_date").alias("day"), F.first("word_count").alias("words"))
    found = F.array_compact(F.array(
        F.when(F.col("n") != 1, F.concat(F.lit("applied "), F.col("n").cast("string"), F.lit(" times"))), F.when(F.col("day") != F.col("_day"), "another date"), F.when(F.col("words") != F.col("_words"), "another word count"),
    ))
    return each.select(*keys, F.explode(found).alias("problem"))


def decision_statistics(decisions: DataFrame, keys: list[str]) -> DataFrame:
    """For each reason: turns, keys that have several decisions, and the least, most and sum of words."""
    per = decisions.groupBy(*keys).agg(F.count("*").alias("n"), F.first("decision_reason").alias("decision_reason"))
    again = per.groupBy("decision_reason").agg(F.count_if(F.col("n") > 1).alias("repeated_keys"))
    out = decisions.groupBy("decision_reason").agg(F.count("*").alias("turns"), F.min("word_count").alias("least_words"), F.max("word_count").alias("most_words"), F.sum("word_count").alias("word_total"))
    return out.join(again, "decision_reason", "left").withColumn("repeated_keys", F.coalesce("repeated_keys", F.lit(0)))


def export_checks(decisions: DataFrame, retained: DataFrame, documents: DataFrame, keys: list[str], most: int = MAXIMUM_CHUNK_WORDS) -> DataFrame:
    """Named integrity checks of an export, one row each."""
    kept = decisions.where("decision = 'retained'").select(*keys)
    holds = lambda name, frame: frame.agg((F.count("*") == 0).alias("holds")).select(F.lit(name).alias("check_name"), "holds")
    declared = retained.select(*keys, "chunk_count").join(documents.groupBy(*keys).agg(F.count("*").alias("n"), F.max("chunk_index").alias("top"), F.sum("word_count").alias("words")), keys, "left")
    words = retained.select(*keys, "word_count").join(documents.groupBy(*keys).agg(F.sum("word_count").alias("words")), keys, "left")
    checks = [
        holds("decision_keys_unique", decisions.groupBy(*keys).count().where("count > 1")),
        holds("retained_keys_match_decisions", kept.exceptAll(retained.select(*keys)).union(retained.select(*keys).exceptAll(kept))),
        holds("documents_have_a_retained_turn", documents.join(retained, keys, "left_anti")),
        holds("declared_chunk_counts", declared.where("chunk_count <> coalesce(n, 0)")),
        holds("chunk_indexes_contiguous", declared.where("top <> n")),
        holds("words_preserved", words.where("word_count <> coalesce(words, 0)")),
        holds("chunks_within_limit", documents.where(F.col("word_count") > most)),
        holds("document_ids_unique", documents.groupBy("document_id").count().where("count > 1")),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out
