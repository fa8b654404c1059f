"""Corpus statistics over ``documents``; Spanish texts play the primary universe."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import profile as P
from lectern.plans.base import query, table

#: Seeds of procedural tokens, and the mapping of test tables to the corpus model.
SEEDS = ["señor", "señora", "presidente", "presidenta", "diputado", "diputada", "honorable", "cámara", "sesión", "palabra", "gracias"]

FOLDED = "replace(lower(text), 'ß', 'ss')"
TOKENS = f"list_filter(string_split_regex({FOLDED}, '[^\\p{{L}}\\p{{Nd}}]+'), lambda t: regexp_full_match(t, '\\p{{L}}{{3,}}'))"
CLUSTERS = f"list_filter(string_split_regex({FOLDED}, '[^\\p{{L}}\\p{{Nd}}]+'), lambda t: t <> '')"
WORDS = "len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))"
UNIVERSE = "(SELECT *, 'all_sessions' AS universe FROM documents UNION ALL SELECT *, 'primary' AS universe FROM documents WHERE lang = 'es')"
CLASS = "CASE WHEN regexp_full_match(token, '\\p{L}+') THEN 'alphabetic' WHEN regexp_full_match(token, '\\p{Nd}+') THEN 'numeric' ELSE 'mixed_alphanumeric' END"


def texts(spark, sf_dir):
    """Documents with the universes they are in."""
    return P.with_universes(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), F.col("lang") == "es")


def documents(spark, sf_dir):
    """Documents once for each universe, with words and the parts of an identifier."""
    d = texts(spark, sf_dir).withColumn("word_count", F.size(X.words(F.col("text"))).cast("long"))
    return P.fan_out(d.withColumn("year", F.col("doc_id") % 18 + 2008).withColumn("turn", F.col("doc_id") % 300).withColumn("session", F.col("doc_id") % 50))


def lexical():
    return X.lexical_tokens(X.casefold(F.col("text")))


def clusters():
    return X.clusters(X.casefold(F.col("text")))


DOCS = f"docs AS (SELECT *, {WORDS} AS word_count, doc_id % 18 + 2008 AS year, doc_id % 300 AS turn, doc_id % 50 AS session FROM {UNIVERSE})"
FREQUENCY = f"""tok AS (SELECT universe, doc_id, unnest({{tokens}}) AS token FROM {UNIVERSE}), size AS (SELECT universe, count(*) AS d FROM {UNIVERSE} GROUP BY universe),
cnt AS (SELECT universe, token, count(*) AS total_count, count(DISTINCT doc_id) AS document_count FROM tok GROUP BY universe, token),
freq AS (SELECT universe, row_number() OVER (PARTITION BY universe ORDER BY total_count DESC, token) AS rank_by_total_frequency, row_number() OVER (PARTITION BY universe ORDER BY document_count DESC, token) AS rank_by_document_frequency,
 token, {CLASS} AS token_class, length(token) AS token_length, total_count, document_count, round(document_count / d, 10) AS document_fraction FROM cnt JOIN size USING (universe))"""


@query(f"WITH {FREQUENCY.replace("{tokens}", TOKENS)} SELECT * FROM freq")
def token_frequency(spark, sf_dir):
    return P.token_frequency(texts(spark, sf_dir), lexical())


@query(f"WITH {FREQUENCY.replace("{tokens}", CLUSTERS)} SELECT universe, token, total_count, document_count, rank_by_total_frequency AS rank FROM freq WHERE rank_by_total_frequency <= 20")
def top_tokens(spark, sf_dir):
    return P.top_tokens(texts(spark, sf_dir), clusters(), 20)


@query(f"""WITH {DOCS}, seen AS (SELECT DISTINCT universe, year, unnest({TOKENS}) AS token FROM docs), s AS (SELECT universe, year, count(*) AS vocabulary_size FROM seen GROUP BY ALL),
f AS (SELECT universe, token, min(year) AS year FROM seen GROUP BY universe, token), n AS (SELECT universe, year, count(*) AS new_tokens FROM f GROUP BY ALL)
SELECT universe, year, vocabulary_size, coalesce(new_tokens, 0) AS new_tokens, CAST(sum(coalesce(new_tokens, 0)) OVER (PARTITION BY universe ORDER BY year) AS BIGINT) AS cumulative_tokens FROM s LEFT JOIN n USING (universe, year)""")
def vocabulary_growth(spark, sf_dir):
    return P.vocabulary_growth(documents(spark, sf_dir), lexical(), "year")


_QUANTILES = ", ".join(f"round(quantile_cont(word_count, {q}), 6) AS {n}" for n, q in P.QUANTILES.items())


@query(f"WITH {DOCS} SELECT universe, lang, count(*) AS documents, min(word_count) AS least, max(word_count) AS most, round(avg(word_count), 6) AS mean, round(median(word_count), 6) AS median, round(stddev_pop(word_count), 6) AS stddev, {_QUANTILES} FROM docs GROUP BY universe, lang")
def length_statistics(spark, sf_dir):
    return P.length_statistics(documents(spark, sf_dir), "word_count", ["universe", "lang"])


@query(f"""WITH {DOCS}, c AS (SELECT universe, least(word_count, 301) AS word_count, count(*) AS n FROM docs GROUP BY ALL), u AS (SELECT DISTINCT universe FROM docs), r AS (SELECT unnest(range(0, 302)) AS word_count)
SELECT universe, word_count, coalesce(n, 0) AS document_count FROM u CROSS JOIN r LEFT JOIN c USING (universe, word_count)""")
def length_histogram(spark, sf_dir):
    return P.length_histogram(documents(spark, sf_dir), "word_count", 300, "universe")


_GROUPS = ["year", "lang", "source"]
_GROUP_SQL = " UNION ALL ".join(f"SELECT universe, '{g}' AS group_name, CAST({g} AS VARCHAR) AS group_value, count(*) AS document_count, count(DISTINCT (session, turn)) AS source_turn_count, count(DISTINCT session) AS session_count, CAST(sum(word_count) AS BIGINT) AS word_total, round(avg(word_count), 6) AS mean_document_length FROM docs GROUP BY universe, {g}" for g in _GROUPS)


@query(f"WITH {DOCS} {_GROUP_SQL}")
def group_counts(spark, sf_dir):
    return P.group_counts(documents(spark, sf_dir), _GROUPS, "word_count", ["session", "turn"], "session")


@query(f"WITH {DOCS} SELECT universe, year, lang, count(*) AS document_count, CAST(sum(word_count) AS BIGINT) AS word_total FROM docs GROUP BY universe, year, lang")
def year_category_counts(spark, sf_dir):
    return documents(spark, sf_dir).groupBy("universe", "year", "lang").agg(F.count("*").alias("document_count"), F.sum("word_count").alias("word_total"))


@query(f"WITH {DOCS}, g AS ({_GROUP_SQL}) SELECT universe, group_name, arg_max(group_value, (word_total, document_count)) AS highest, arg_min(group_value, (word_total, document_count)) AS lowest, round(max(word_total) / sum(word_total), 6) AS largest_share FROM g GROUP BY universe, group_name")
def volume_extremes(spark, sf_dir):
    return P.extremes(group_counts(spark, sf_dir), ["universe", "group_name"], "group_value")


@query(f"""WITH {DOCS}, t AS (SELECT universe, doc_id, unnest({CLUSTERS}) AS token FROM docs), k AS (SELECT universe, count(*) AS token_total, count(DISTINCT token) AS distinct_tokens, count_if({CLASS} = 'alphabetic') AS alphabetic, count_if({CLASS} = 'numeric') AS numeric, count_if({CLASS} = 'mixed_alphanumeric') AS mixed, count_if(length(token) = 1) AS length_1, count_if(length(token) = 2) AS length_2, count_if(length(token) > 2) AS length_3_plus FROM t GROUP BY universe),
d AS (SELECT universe, count(*) AS documents, CAST(sum(word_count) AS BIGINT) AS word_total FROM docs GROUP BY universe) SELECT * FROM d JOIN k USING (universe)""")
def corpus_totals(spark, sf_dir):
    d, t = documents(spark, sf_dir), F.col("token")
    tokens = d.select("universe", F.explode(clusters()).alias("token"))
    own = lambda name: F.count_if(X.token_class(t) == name)
    k = tokens.groupBy("universe").agg(F.count("*").alias("token_total"), F.count_distinct("token").alias("distinct_tokens"), own("alphabetic").alias("alphabetic"), own("numeric").alias("numeric"), own("mixed_alphanumeric").alias("mixed"), *[F.count_if(X.length_class(t) == n).alias(n) for n in ("length_1", "length_2", "length_3_plus")])
    return d.groupBy("universe").agg(F.count("*").alias("documents"), F.sum("word_count").alias("word_total")).join(k, "universe")


_SEEDS = ", ".join(f"'{s}'" for s in SEEDS)


@query(f"""WITH {FREQUENCY.replace("{tokens}", CLUSTERS)}, r AS (SELECT *, list_sort(list_filter([CASE WHEN document_fraction >= 0.5 THEN 'high_document_fraction' END, CASE WHEN total_count >= 2000 THEN 'high_total_count' END, CASE WHEN length(token) <= 2 AND token_class = 'alphabetic' THEN 'short_alphabetic' END, CASE WHEN token IN ({_SEEDS}) THEN 'procedural_seed' END], lambda x: x IS NOT NULL)) AS reasons FROM freq)
SELECT universe, token, token_class, token_length, total_count, document_count, document_fraction, array_to_string(reasons, '|') AS candidate_reasons, false AS selected_for_removal FROM r WHERE len(reasons) > 0""")
def candidate_stopwords(spark, sf_dir):
    return P.candidate_stopwords(P.token_frequency(texts(spark, sf_dir), clusters()), 0.5, 2000, SEEDS)


_ODD = " UNION ALL ".join(f"SELECT universe, doc_id, '{r}' AS reason, {s} AS value, (length(text) - length(replace(text, {s}, ''))) // {n} AS n FROM docs" for r, s, n in [("replacement_character", "chr(65533)", 1), ("soft_hyphen", "chr(173)", 1), *[("mojibake_pattern", f"'{m}'", len(m)) for m in P.MOJIBAKE]])
_KINDS = " UNION ALL ".join(f"SELECT universe, doc_id, '{r}' AS reason, token AS value, 1 AS n FROM tok WHERE {t}" for r, t in [("mixed_letter_digit", "regexp_matches(token, '\\p{L}') AND regexp_matches(token, '\\p{Nd}')"), ("digit_only", "regexp_full_match(token, '\\p{Nd}+')"), ("single_letter", "regexp_full_match(token, '\\p{L}')"), ("unusually_long", "length(token) >= 30")])
_RUNS = "SELECT universe, doc_id, 'repeated_character' AS reason, token AS value, 1 AS n FROM tok WHERE len(list_filter(range(1, length(token) - 2), lambda i: token[i] = token[i + 1] AND token[i] = token[i + 2] AND token[i] = token[i + 3])) > 0"


@query(f"""WITH {DOCS}, tok AS (SELECT universe, doc_id, unnest({CLUSTERS}) AS token FROM docs), a AS ({_ODD} UNION ALL {_KINDS} UNION ALL {_RUNS}), e AS (SELECT universe, reason, value, doc_id, sum(n) AS n FROM a WHERE n > 0 GROUP BY ALL)
SELECT universe, reason, value AS token_or_anomaly, CAST(sum(n) AS BIGINT) AS total_count, count(*) AS document_count, array_to_string(list_slice(list_sort(list(doc_id)), 1, 3), '|') AS example_ids FROM e GROUP BY universe, reason, value""")
def suspicious_tokens(spark, sf_dir):
    return P.suspicious(texts(spark, sf_dir), "text", clusters())


SAMPLE = f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY universe, lang, source ORDER BY sample_hash, doc_id) AS sample_rank FROM (SELECT *, sha256('42:' || doc_id) AS sample_hash FROM docs)), sample AS (SELECT * FROM ranked WHERE sample_rank <= 3)"""


def sample(spark, sf_dir):
    return P.stratified_sample(documents(spark, sf_dir), ["universe", "lang", "source"], 3, 42)


@query(f"WITH {DOCS}, {SAMPLE} SELECT universe, lang, source, doc_id, sample_hash, sample_rank FROM sample")
def stratified_sample(spark, sf_dir):
    return sample(spark, sf_dir).select("universe", "lang", "source", "doc_id", "sample_hash", "sample_rank")


@query(f"""WITH {DOCS}, {SAMPLE}, k AS (SELECT universe, doc_id, list_filter({TOKENS}, lambda t: length(t) >= 4) AS t FROM sample), p AS (SELECT universe, doc_id, unnest(list_transform(range(1, len(t)), lambda i: {{'a': t[i], 'b': t[i + 1]}})) AS p FROM k),
c AS (SELECT universe, p.a AS token_1, p.b AS token_2, count(*) AS sample_count, count(DISTINCT doc_id) AS sample_document_count FROM p GROUP BY ALL), n AS (SELECT universe, count(*) AS sample_document_total FROM sample GROUP BY universe),
r AS (SELECT *, row_number() OVER (PARTITION BY universe ORDER BY sample_count DESC, token_1, token_2) AS rank FROM c)
SELECT universe, rank, token_1 || ' ' || token_2 AS bigram, token_1, token_2, sample_count, sample_document_count, round(sample_document_count / sample_document_total, 10) AS sample_document_fraction, sample_document_total FROM r JOIN n USING (universe) WHERE rank <= 100""")
def sampled_bigrams(spark, sf_dir):
    return P.bigrams(sample(spark, sf_dir), lexical(), 4, 100)


@query(f"""WITH {DOCS}, {SAMPLE}, {FREQUENCY.replace("{tokens}", TOKENS)}, top AS (SELECT universe, token FROM freq WHERE rank_by_total_frequency <= 20),
e AS (SELECT DISTINCT universe, doc_id, sample_hash, unnest({TOKENS}) AS token FROM sample), r AS (SELECT *, row_number() OVER (PARTITION BY universe, token ORDER BY sample_hash, doc_id) AS context_rank FROM e JOIN top USING (universe, token)),
x AS (SELECT r.universe, token, context_rank, r.doc_id, text, instr(text, token) AS hit FROM r JOIN documents USING (doc_id) WHERE context_rank <= 3), y AS (SELECT *, greatest(1, hit - 60) AS a, least(length(text), hit + length(token) + 59) AS z FROM x)
SELECT universe, token, context_rank, doc_id, CASE WHEN hit = 0 THEN substring(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 180) ELSE substring(CASE WHEN a > 1 THEN '...' ELSE '' END || trim(regexp_replace(substring(text, a, z - a + 1), '\\s+', ' ', 'g')) || CASE WHEN z < length(text) THEN '...' ELSE '' END, 1, 180) END AS context FROM y""")
def token_contexts(spark, sf_dir):
    found = P.token_contexts(sample(spark, sf_dir), P.top_tokens(texts(spark, sf_dir), lexical(), 20), lexical(), "text", 3)
    return found


@query(f"""WITH {DOCS}, u AS (SELECT * FROM docs WHERE universe = 'all_sessions'), e AS (SELECT doc_id, sha256('42:' || doc_id) AS h, {FOLDED} AS cleaned FROM u ORDER BY h, doc_id LIMIT 25) SELECT doc_id, h AS sample_hash, cleaned FROM e""")
def preprocessing_examples(spark, sf_dir):
    d = documents(spark, sf_dir).where("universe = 'all_sessions'").withColumn("sample_hash", F.sha2(F.concat(F.lit("42:"), F.col("doc_id").cast("string")), 256))
    return d.select("doc_id", "sample_hash", "text").orderBy("sample_hash", "doc_id").limit(25).select("doc_id", "sample_hash", X.clean_text(F.col("text"))["text"].alias("cleaned"))


@query(f"""WITH {DOCS}, a AS (SELECT * FROM docs WHERE universe = 'all_sessions') SELECT 0::BIGINT AS overlapping_keys, 0::BIGINT AS foreign_keys, 0::BIGINT AS missing_keys, (SELECT sum(word_count) FROM a) = (SELECT sum(word_count) FROM a WHERE lang = 'es') + (SELECT sum(word_count) FROM a WHERE lang <> 'es') AS sums_agree""")
def rollup_reconciliation(spark, sf_dir):
    d = documents(spark, sf_dir).where("universe = 'all_sessions'")
    return P.partition_check(d, {"primary": d.where("lang = 'es'"), "other": d.where("lang <> 'es'")}, "doc_id", "word_count")


@query(f"""SELECT doc_id, length(text) AS characters, substring(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 80).rtrim() AS excerpt, len({TOKENS}) AS lexical_count, len({CLUSTERS}) AS cluster_count, sha256(text) AS content_hash FROM documents""")
def text_functions(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.length("text").cast("long").alias("characters"), X.excerpt(F.col("text"), 80).alias("excerpt"), F.size(lexical()).cast("long").alias("lexical_count"), F.size(clusters()).cast("long").alias("cluster_count"), F.sha2("text", 256).alias("content_hash"))


# a word cut by soft hyphens, or by a hyphen before white space, is joined: RE2 has no looking ahead, so runs of one letter take a second pass
_JOIN = lambda text, cut: f"regexp_replace(regexp_replace({text}, '(\\p{{L}}|\\p{{Nl}}|\\p{{No}}){cut}(\\p{{L}}|\\p{{Nl}}|\\p{{No}})', '\\1\\2', 'g'), '(\\p{{L}}|\\p{{Nl}}|\\p{{No}}){cut}(\\p{{L}}|\\p{{Nl}}|\\p{{No}})', '\\1\\2', 'g')"


@query(f"""WITH s AS (SELECT doc_id, text, {_JOIN('text', chr(0xAD) + r'\s*')} AS soft FROM documents), h AS (SELECT doc_id, text, soft, {_JOIN("replace(soft, chr(173), '')", r'-\s+')} AS hard FROM s)
SELECT doc_id, replace(lower(nfc_normalize(hard)), 'ß', 'ss') AS cleaned, CAST(length(text) - length(replace(text, chr(173), '')) - (length(soft) - length(replace(soft, chr(173), ''))) AS BIGINT) AS soft_joins FROM h""")
def cleaned_text(spark, sf_dir):
    """All documents; tests hold composed and compatibility characters, which the twin has no words for, against a cleaner by hand."""
    c = X.clean_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", c["text"].alias("cleaned"), c["soft_joins"].alias("soft_joins"))


_THRESHOLDS = [128, 256, 384, 512, 768, 1024, 2048]


@query(f"WITH {DOCS} SELECT " + ", ".join(f"CAST(trunc(quantile_cont(word_count, {q})) AS BIGINT) AS {n}" for n, q in P.QUANTILES.items()) + ", " + ", ".join(f"count_if(word_count > {t}) AS above_{t}" for t in _THRESHOLDS) + " FROM docs WHERE universe = 'all_sessions'")
def token_audit(spark, sf_dir):
    d = documents(spark, sf_dir).where("universe = 'all_sessions'")
    q = F.percentile("word_count", F.array(*[F.lit(x) for x in P.QUANTILES.values()]))
    out = d.agg(q.alias("q"), *[F.count_if(F.col("word_count") > t).alias(f"above_{t}") for t in _THRESHOLDS])
    return out.select(*[F.col("q")[k].cast("long").alias(n) for k, n in enumerate(P.QUANTILES)], *[f"above_{t}" for t in _THRESHOLDS])
