"""The document scan, exports, reconciliation, alignment and the data of reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import corpus as C
from lectern.operators import documents as D
from lectern.operators import prevalence as V
from lectern.operators import reports as R
from lectern.operators import topics as T
from lectern.plans.base import query, table
from lectern.plans.topic_queries import _COMPONENTS, _E, components, levels
from lectern.sources import sinks
from lectern.sources.scratch import materialise, shared_dir

_WORDS = "len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))"
_PERIOD = "CASE WHEN year BETWEEN 2008 AND 2011 THEN '2008-2011' WHEN year BETWEEN 2012 AND 2015 THEN '2012-2015' WHEN year BETWEEN 2016 AND 2019 THEN '2016-2019' WHEN year BETWEEN 2020 AND 2023 THEN '2020-2023' WHEN year BETWEEN 2024 AND 2025 THEN '2024-2025' END"
_RECORDS = f"""r AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS document_id, CASE WHEN source = 'src3' THEN ' ' ELSE source END AS source_record_id, text AS modeling_text, doc_id % 301 - 1 AS turn_index, doc_id % 7 AS chunk_index, {_WORDS} AS word_count, 2006 + doc_id % 20 AS year,
 CASE WHEN doc_id % 13 = 0 THEN '2019-02-30' ELSE CAST(2006 + (doc_id - CAST(doc_id % 17 = 0 AS INT)) % 20 AS VARCHAR) || '-03-04' END AS session_date, CASE WHEN lang = 'de' THEN 'chair' ELSE 'named_or_role_unspecified' END AS speaker_family, {_WORDS} + CAST(doc_id % 19 = 0 AS INT) AS modeling_word_count FROM documents),
s AS (SELECT *, CASE WHEN doc_id % 23 = 0 THEN 'other' ELSE {_PERIOD} END AS temporal_period, try_cast(session_date AS DATE) AS day FROM r)"""


def _records(spark, sf_dir):
    """Documents as a modelling corpus, with faults made from their numbers."""
    i, year = F.col("doc_id"), (F.lit(2006) + F.col("doc_id") % 20)
    words = F.size(X.words(F.col("text"))).cast("long")
    dated = F.when(i % 13 == 0, "2019-02-30").otherwise(F.concat((F.lit(2006) + (i - (i % 17 == 0).cast("int")) % 20).cast("string"), F.lit("-03-04")))
    return table(spark, sf_dir, "documents").select(
        i.cast("string").alias("document_id"), F.when(F.col("source") == "src3", " ").otherwise(F.col("source")).alias("source_record_id"), F.col("text").alias("modeling_text"), (i % 301 - 1).alias("turn_index"), (i % 7).alias("chunk_index"),
        words.alias("word_count"), year.alias("year"), dated.alias("session_date"), F.lit("legislative_debate").alias("session_category"), F.when(F.col("lang") == "de", "chair").otherwise("named_or_role_unspecified").alias("speaker_family"),
        (words + (i % 19 == 0).cast("int")).alias("modeling_word_count"), F.when(i % 23 == 0, "other").otherwise(C.period_of(year)).alias("temporal_period"),
    )


_BROKEN = [
    ("source_record_id", "required value is blank", "trim(coalesce(source_record_id, '')) = ''"), ("modeling_text", "required value is blank", "trim(coalesce(modeling_text, '')) = ''"), ("temporal_period", "required value is blank", "temporal_period IS NULL"),
    ("turn_index", "below 0", "turn_index < 0"), ("chunk_index", "below 1", "chunk_index < 1"), ("word_count", "outside 1 to 300", "word_count NOT BETWEEN 1 AND 300"), ("speaker_family", "value is not allowed", "speaker_family = 'chair'"),
    ("session_date", "not an ISO date", "day IS NULL"), ("year", "not the year of the date", "year(day) <> year"), ("temporal_period", "not the period of the year", f"temporal_period IS DISTINCT FROM ({_PERIOD})"), ("modeling_word_count", "not the word count", "modeling_word_count <> word_count"),
]
_FOUND = " UNION ALL ".join(f"SELECT document_id AS line, '{c}' AS \"column\", 'error' AS severity, '{m}' AS message FROM s WHERE {t}" for c, m, t in _BROKEN)


@query(f"WITH {_RECORDS} {_FOUND}")
def document_violations(spark, sf_dir):
    return D.document_violations(_records(spark, sf_dir))


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_index FROM documents")
def document_row_index(spark, sf_dir):
    return D.numbered(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])


@query("WITH n AS (SELECT source, lang, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents), f AS (SELECT source, lang, min(i) AS first_row_index, count(*) AS rows FROM n GROUP BY source, lang) SELECT *, row_number() OVER (ORDER BY first_row_index) - 1 AS key_index FROM f")
def first_appearance(spark, sf_dir):
    rows = D.numbered(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), ["doc_id"])
    return D.first_appearance(rows, ["source", "lang"])


@query("WITH s AS (SELECT label AS topic, vec_id, round(list_max(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS score FROM embeddings WHERE label <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, vec_id) - 1 AS rank FROM s) SELECT topic, rank, vec_id, score, replace(substring(text, 1, 500), chr(10), ' ') AS text_excerpt, sha256(text) AS full_document_sha256 FROM r LEFT JOIN documents ON doc_id = vec_id WHERE rank < 5")
def representatives_by_score(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("topic"), "vec_id", "embedding")
    top = D.first_by_score(e, "topic", F.round(F.array_max(F.transform("embedding", lambda x: x.cast("double"))), 6), "vec_id", 5, outlier=0).drop("embedding")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.replace(F.substring("text", 1, 500), F.lit("\n"), F.lit(" ")).alias("text_excerpt"), F.sha2("text", 256).alias("full_document_sha256"))
    return top.join(d, "vec_id", "left").select("topic", "rank", "vec_id", "score", "text_excerpt", "full_document_sha256")


def _decided(spark, sf_dir):
    from lectern.plans.quality_queries import _decided as decided

    return decided(spark, sf_dir)


_DECIDED = f"""t AS (SELECT conv_id, turn, CASE WHEN conv_id % 9 = 0 THEN NULL ELSE role END AS speaker_family, CASE WHEN turn % 13 = 0 THEN '' ELSE text END AS text FROM conversations), w AS (SELECT *, {_WORDS} AS word_count FROM t),
e AS (SELECT *, CASE WHEN conv_id % 17 = 3 THEN 'override' WHEN word_count = 0 THEN 'no_spoken_content' WHEN coalesce(speaker_family, '') NOT IN ('user', 'assistant') THEN 'speaker_family_not_in_modeling_scope' WHEN word_count < 25 THEN 'fewer_than_25_words' ELSE 'meets_modeling_corpus_policy' END AS reason FROM w)"""


@query(f"WITH {_DECIDED}, x AS (SELECT conv_id, turn, 'source_turn' AS unit, reason AS exclusion_reason, text AS x FROM e WHERE reason <> 'meets_modeling_corpus_policy' UNION ALL SELECT conv_id, turn, 'override_prefix', 'discarded_before_anchor', substring(text, 1, 10) FROM e WHERE conv_id % 10 = 1 AND length(text) > 0) SELECT conv_id, turn, unit, exclusion_reason, x AS exact_text, len(list_filter(string_split_regex(x, '\\s+'), lambda w: w <> '')) AS word_count FROM x")
def exclusion_ledger(spark, sf_dir):
    cut = F.when((F.col("conv_id") % 10 == 1) & (F.length("text") > 0), F.substring("text", 1, 10))
    return D.exclusion_ledger(_decided(spark, sf_dir).withColumn("discarded_prefix", cut), ["conv_id", "turn"])


def _export(spark, sf_dir):
    """Decisions, retained turns, their documents and the overrides of an export."""
    decided = _decided(spark, sf_dir).withColumn("year", F.lit(2008) + F.col("conv_id") % 18)
    kept = decided.where("decision = 'retained'").withColumn("source", F.format_string("%020d", "conv_id"))
    docs = C.modeling_documents(kept.select("conv_id", "turn", "text", "source"), "source", "turn", most=40).select("conv_id", "turn", "chunk_index", "document_id", F.col("word_count").cast("long").alias("word_count"), F.lit(True).alias("separators_ok"))
    turns = kept.select("conv_id", "turn", "word_count").join(docs.groupBy("conv_id", "turn").agg(F.count("*").alias("chunk_count")), ["conv_id", "turn"])
    overrides = decided.where("conv_id % 17 = 3 AND turn = 0").select("conv_id", "turn", F.lit(1).alias("applied_count"))
    return decided, turns, docs, overrides


_CHECKS = ["all_configured_overrides_applied_once", "all_dates_inside_2008_2025", "all_document_keys_map_to_retained_source_turn", "all_input_turns_have_one_decision", "all_parsed_turns_reconcile", "all_retained_decisions_have_one_source_turn", "all_source_turns_have_declared_document_count", "every_source_turn_has_at_least_one_document", "every_synthetic_separator_follows_policy", "no_chunk_exceeds_maximum_words", "no_duplicate_document_ids", "no_duplicate_source_turn_decisions", "no_retained_family_outside_allowed_set", "no_retained_turn_below_minimum_words", "retained_reconstructed_word_totals_match_chunks"]
_KEPT = f"WITH {_DECIDED}, k AS (SELECT * FROM e WHERE reason = 'meets_modeling_corpus_policy')"
#: What the faults of ``reconciliation_of_faults`` break, as questions to the tables.
_FAULTS = {
    "all_configured_overrides_applied_once": "(SELECT count(*) FROM conversations WHERE conv_id % 17 = 3 AND turn = 0) = 0", "all_dates_inside_2008_2025": "(SELECT count(*) FROM conversations WHERE conv_id = 4) = 0",
    "all_source_turns_have_declared_document_count": "(SELECT count(*) FROM k WHERE conv_id % 6 = 0) = 0", "no_duplicate_source_turn_decisions": "(SELECT count(*) FROM conversations WHERE conv_id = 5) = 0",
    "no_chunk_exceeds_maximum_words": "(SELECT count(*) FROM k) = 0", "retained_reconstructed_word_totals_match_chunks": "(SELECT count(*) FROM k WHERE conv_id % 6 = 0) = 0", "no_retained_turn_below_minimum_words": "(SELECT count(*) FROM k WHERE word_count < 30) = 0", "every_synthetic_separator_follows_policy": "(SELECT count(*) FROM k WHERE turn = 2 AND conv_id % 6 > 0) = 0",
}


@query(" UNION ALL ".join(f"SELECT '{c}' AS check_name, true AS holds" for c in _CHECKS))
def reconciliation(spark, sf_dir):
    decided, turns, docs, overrides = _export(spark, sf_dir)
    return D.reconciliation(decided, turns, docs, overrides, ["conv_id", "turn"], allowed=("user", "assistant"), most=40)


@query(_KEPT + " " + " UNION ALL ".join(f"SELECT '{c}' AS check_name, {_FAULTS.get(c, 'true')} AS holds" for c in _CHECKS))
def reconciliation_of_faults(spark, sf_dir):
    """The same checks on an export with faults: lost documents, repeated decisions, overrides applied twice, a late year."""
    decided, turns, docs, overrides = _export(spark, sf_dir)
    decided = decided.withColumn("year", F.when(F.col("conv_id") == 4, 2026).otherwise(F.col("year"))).unionByName(decided.where("conv_id = 5"))
    docs = docs.where("conv_id % 6 > 0").withColumn("separators_ok", F.col("turn") != 2)
    return D.reconciliation(decided, turns, docs, overrides.withColumn("applied_count", F.lit(2)), ["conv_id", "turn"], allowed=("user", "assistant"), minimum=30, most=1)


@query("""WITH b AS (SELECT printf('s%03d', conv_id % 50) AS source_record_id, conv_id // 50 AS page_number, turn AS reading_order, CASE WHEN conv_id % 12 = 0 THEN 'preliminary' ELSE 'proceedings' END AS zone, length(text) AS n, conv_id FROM conversations),
p AS (SELECT *, 'not in the proceedings' AS problem FROM b WHERE zone <> 'proceedings' UNION ALL SELECT *, 'page below 1' FROM b WHERE page_number < 1 UNION ALL SELECT *, 'order below 1' FROM b WHERE reading_order < 1 UNION ALL SELECT *, 'marker out of range' FROM b WHERE conv_id % 5 = 0 AND n < 80 UNION ALL SELECT *, 'markers overlap' FROM b WHERE conv_id % 5 = 1 UNION ALL SELECT *, 'marker of other text' FROM b WHERE conv_id % 5 = 2)
SELECT DISTINCT source_record_id, page_number, reading_order, problem FROM p""")
def block_problems(spark, sf_dir):
    c, k = table(spark, sf_dir, "conversations"), F.col("conv_id") % 5
    mark = lambda a, b, text: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), text.alias("raw_marker"))
    own = lambda a, b: mark(a, b, F.substring("text", a + 1, b - a))
    markers = F.when(k == 0, F.array(own(0, 80))).when(k == 1, F.array(own(0, 2), own(1, 3))).when(k == 2, F.array(mark(0, 2, F.lit("#!")))).otherwise(F.array(own(0, 1), own(1, 2)))
    b = c.where(F.length("text") >= 3).unionByName(c.where(F.length("text") < 3)).select(F.format_string("s%03d", F.col("conv_id") % 50).alias("source_record_id"), F.floor(F.col("conv_id") / 50).alias("page_number"), F.col("turn").alias("reading_order"), F.when(F.col("conv_id") % 12 == 0, "preliminary").otherwise("proceedings").alias("structural_zone"), "text", markers.alias("markers"))
    return D.block_problems(b)


@query(f"WITH c AS (SELECT conv_id, role, {_WORDS} AS words FROM conversations), a AS (SELECT conv_id, count(*) AS turns, sum(words) AS words FROM c GROUP BY conv_id), b AS (SELECT conv_id, count(*) AS turns, sum(words) AS words FROM c WHERE role <> 'system' AND words > 20 GROUP BY conv_id), j AS (SELECT conv_id, a.turns AS ta, coalesce(b.turns, 0) AS tb, a.words AS wa, coalesce(b.words, 0) AS wb FROM a LEFT JOIN b USING (conv_id)) SELECT conv_id, 'turns' AS measure, ta AS parsed, tb AS stored FROM j WHERE ta <> tb UNION ALL SELECT conv_id, 'words', CAST(wa AS BIGINT), CAST(wb AS BIGINT) FROM j WHERE wa <> wb")
def count_differences(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "role", F.lit(1).alias("turns"), F.size(X.words(F.col("text"))).alias("words"))
    return D.count_differences(c, c.where("role <> 'system' AND words > 20"), ["conv_id"], ["turns", "words"])


@query("SELECT doc_id, CASE WHEN e.vec_id IS NULL THEN 'no vector' WHEN abs(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) - 1) > 0.001 THEN 'length is not one' END AS problem FROM documents LEFT JOIN embeddings e ON vec_id = doc_id")
def aligned_embeddings(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return D.aligned(table(spark, sf_dir, "documents").select("doc_id"), e, "doc_id", "embedding").select("doc_id", "problem")


@query("""WITH u AS (SELECT conv_id, turn, length(text) AS n FROM conversations WHERE length(text) > 0), f AS (SELECT *, [{'s': 0, 'e': 40, 'o': 1}, {'s': 40, 'e': 90, 'o': 2}, {'s': 90, 'e': 100000000, 'o': 3}] AS fr FROM u)
SELECT conv_id, turn, 1 AS chunk_count_for_turn, array_to_string(list_transform(list_filter(fr, lambda f: f.s < n), lambda f: f.o), ',') AS source_pages_covered, CAST(list_sum(list_transform(list_filter(fr, lambda f: f.s < n), lambda f: least(f.e, n) - f.s)) AS BIGINT) AS covered FROM f WHERE n > 0""")
def document_records(spark, sf_dir):
    """Whole turns as documents, so that the twin needs no chunks; provenance is of three pages."""
    t = table(spark, sf_dir, "conversations").where(F.length("text") > 0)
    whole = t.select("conv_id", F.col("conv_id").cast("string").alias("source_record_id"), F.col("turn").alias("turn_index"), F.lit(1).alias("chunk_index"), F.lit(0).alias("start"), F.length("text").alias("end"), "text", F.size(X.words(F.col("text"))).alias("word_count"))
    made = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(p).alias("source")) for a, b, p in ((0, 40, 1), (40, 90, 2), (90, 100_000_000, 3))])
    r = D.document_records(whole, made, ["conv_id"])
    covered = F.aggregate("provenance", F.lit(0).cast("long"), lambda s, f: s + f["end"] - f["start"])
    return r.select("conv_id", F.col("turn_index").alias("turn"), F.col("chunk_count_for_turn").cast("int").alias("chunk_count_for_turn"), F.array_join(F.col("source_pages_covered").cast("array<string>"), ",").alias("source_pages_covered"), covered.alias("covered"))


# The data of reports.

_ANNUAL = f"{_E}, v AS (SELECT 'document' AS level, topic, year, round(avg(w), 8) AS share FROM dt GROUP BY ALL UNION ALL SELECT 'source_turn', topic, year, round(avg(w), 8) FROM tt GROUP BY ALL UNION ALL SELECT 'session', topic, year, round(avg(w), 8) FROM st GROUP BY ALL)"


@query(f"WITH {_ANNUAL} SELECT topic, year, round(max(share) FILTER (WHERE level = 'document') * 100, 6) AS document, round(max(share) FILTER (WHERE level = 'source_turn') * 100, 6) AS source_turn, round(max(share) FILTER (WHERE level = 'session') * 100, 6) AS session FROM v GROUP BY topic, year")
def robustness_table(spark, sf_dir):
    return R.robustness(V.prevalence(levels(spark, sf_dir), "year"))


@query(f"WITH {_ANNUAL} SELECT topic, year, round(share * 100, 6) AS percent FROM v WHERE level = 'source_turn'")
def topic_lines(spark, sf_dir):
    return R.topic_lines(V.prevalence(levels(spark, sf_dir), "year"), "source_turn")


@query(f"""WITH {_COMPONENTS}, mw AS (SELECT topic, round(avg(weight), 6) AS mean_weight FROM kr GROUP BY topic), b AS (SELECT max(mean_weight) AS m FROM mw) SELECT topic AS k, mean_weight AS value, round(m - mean_weight, 6) AS below_best, mean_weight = m AS selected FROM mw, b""")
def selection_curve(spark, sf_dir):
    k = components(spark, sf_dir)[0].groupBy(F.col("topic").alias("k")).agg(F.round(F.avg("weight"), 6).alias("value"))
    return R.selection_curve(k, "k", "value")


@query(f"WITH {_COMPONENTS}, i AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx, df, round(ln((1 + (SELECT n FROM n)) / (1 + df)) + 1, 8) AS idf FROM v) SELECT topic, rank, term, idx, df, idf, weight FROM top JOIN i USING (term)")
def stored_model(spark, sf_dir):
    """Vocabulary and components written as tables and read back; the ten first terms of each topic."""
    k, own = components(spark, sf_dir)
    at = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    sinks.save_model(own.vocab, k, own.n, at)
    words, weights = sinks.load_model(spark, at)
    return T.top_terms(weights.join(words, "idx"), 10).select("topic", "rank", "term", "idx", "df", F.round("idf", 8).alias("idf"), "weight")


_TERMS = "w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS t FROM documents)"


@query(f"""WITH {_COMPONENTS}, {_TERMS}, u AS (SELECT DISTINCT term FROM top), s AS (SELECT doc_id, unnest(t) AS term FROM w), seen AS (SELECT doc_id, term FROM s JOIN u USING (term)), f AS (SELECT term, count(*) AS df FROM seen GROUP BY term), co AS (SELECT x.term AS a, y.term AS b, count(*) AS co FROM seen x JOIN seen y ON x.doc_id = y.doc_id AND x.term <> y.term GROUP BY ALL),
q AS (SELECT a.topic, a.term AS a, b.term AS b FROM top a JOIN top b ON a.topic = b.topic AND a.rank < b.rank), p AS (SELECT q.topic, co / m AS pab, fa.df / m AS pa, fb.df / m AS pb FROM q JOIN co USING (a, b) JOIN f fa ON fa.term = a JOIN f fb ON fb.term = b, (SELECT CAST(n AS DOUBLE) AS m FROM n)), t2 AS (SELECT topic, avg(ln(pab / (pa * pb)) / -ln(pab)) AS c FROM p WHERE pab < 1 GROUP BY topic)
SELECT round(avg(c), 4) AS mean, round(median(c), 4) AS median, round(min(c), 4) AS least FROM t2""")
def word_npmi(spark, sf_dir):
    """The benchmark's coherence: single words only, pairs that never meet are left out, and the mean, median and least of topics."""
    k, own = components(spark, sf_dir)
    top, n = materialise(T.top_terms(k, 10), "top"), own.n
    known = [r.term for r in top.select("term").distinct().collect()]  # topics x n terms
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda t: t.isin(known)))
    seen = T.term_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), words, most=1, vocab=top.select("term").distinct())
    pairs = T.pair_counts(seen, top, n).where("co > 0 AND co < documents")
    each = pairs.groupBy("topic").agg(F.avg(F.ln((F.col("co") / F.col("documents")) / (F.col("df_a") / F.col("documents") * F.col("df_b") / F.col("documents"))) / -F.ln(F.col("co") / F.col("documents"))).alias("c"))
    return each.agg(F.round(F.avg("c"), 4).alias("mean"), F.round(F.median("c"), 4).alias("median"), F.round(F.min("c"), 4).alias("least"))


_CLAIMED = 14


@query(
    f"WITH {_ANNUAL}, t AS (SELECT topic, max(share) * 100 AS peak, arg_max(year, (share, -year)) AS peak_year FROM v WHERE level = 'source_turn' AND topic < {_CLAIMED} GROUP BY topic), "
    "c AS (SELECT 'topic_' || topic || '_peak' AS claim_id, round(peak, 6) AS raw_value, printf('%.6f%%', round(peak, 6)) AS display_value, 'percent' AS unit FROM t UNION ALL SELECT 'topic_' || topic || '_peak_year', peak_year::DOUBLE, printf('%.0f', peak_year::DOUBLE), 'year' FROM t) "
    "SELECT claim_id, raw_value, display_value, unit, sha256(claim_id || '|' || display_value || '|' || unit) AS evidence_hash FROM c"
)
def topic_claims(spark, sf_dir):
    """Twenty-eight claims: each topic's highest share among years, and the earliest year that has it; each has to be one row."""
    own = V.prevalence({"source_turn": levels(spark, sf_dir)["source_turn"]}, "year").where(F.col("topic") < _CLAIMED)
    peaks = materialise(own.groupBy("topic").agg(F.round(F.max("prevalence_share") * 100, 6).alias("peak"), F.max_by("year", F.struct("prevalence_share", (-F.col("year")).alias("y"))).cast("double").alias("peak_year")), "peaks")
    parts = {}
    for t in range(_CLAIMED):
        parts[f"topic_{t}_peak"] = (R.exactly_one(peaks, F.col("topic") == t, "peak"), "percent", "%.6f%%")
        parts[f"topic_{t}_peak_year"] = (R.exactly_one(peaks, F.col("topic") == t, "peak_year"), "year", "%.0f")
    return R.claims(parts)
