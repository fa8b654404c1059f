"""Topics: weights from ``embeddings``, terms from ``documents``; ``lang`` plays the topic where terms are needed."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import clusters as K
from lectern.operators import nmf as N
from lectern.operators import prevalence as V
from lectern.operators import terms as C
from lectern.operators import topics as T
from lectern.plans.profile_queries import TOKENS
from lectern.plans.base import query, table
from lectern.sources.scratch import materialise

_E = """emb AS (SELECT vec_id, label, vec_id % 100 AS turn, vec_id % 20 AS session, 2008 + (vec_id % 20) % 18 AS year, list_transform(embedding, lambda x: greatest(CAST(x AS DOUBLE), 0)) AS raw FROM embeddings),
wts AS (SELECT *, CASE WHEN list_sum(raw) > 0 THEN list_transform(raw, lambda x: x / list_sum(raw)) ELSE raw END AS w FROM emb),
dt AS (SELECT vec_id, label, turn, session, year, unnest(range(0, len(w))) AS topic, unnest(w) AS w FROM wts), tt AS (SELECT turn, session, year, topic, avg(w) AS w FROM dt GROUP BY ALL), st AS (SELECT session, year, topic, avg(w) AS w FROM tt GROUP BY ALL)"""


def weights(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("turn", F.col("vec_id") % 100).withColumn("session", F.col("vec_id") % 20).withColumn("year", F.lit(2008) + F.col("session") % 18)
    return e.select("vec_id", "label", "turn", "session", "year", V.normalised(F.col("embedding")).alias("w"))


def levels(spark, sf_dir):
    d = weights(spark, sf_dir)
    document = d.select("vec_id", "turn", "session", "year", F.posexplode("w").alias("topic", "w")).withColumn("topic", F.col("topic").cast("long"))
    turn = V.mean_weights(d, ["turn", "session", "year"])
    return {"document": document, "source_turn": turn, "session": V.mean_of_means(turn, ["session", "year"])}


@query(f"WITH {_E} SELECT vec_id, topic, round(w, 8) AS w FROM dt")
def row_normalise(spark, sf_dir):
    return levels(spark, sf_dir)["document"].select("vec_id", "topic", F.round("w", 8).alias("w"))


@query(f"WITH {_E} SELECT vec_id, list_position(w, list_max(w)) - 1 AS dominant_topic, round(list_max(w), 6) AS dominant_weight, round(-list_sum(list_transform(w, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END)) / ln(len(w)), 6) AS entropy FROM wts")
def dominant_topic(spark, sf_dir):
    w = F.col("w")
    return weights(spark, sf_dir).select("vec_id", V.dominant(w).alias("dominant_topic"), F.round(F.array_max(w), 6).alias("dominant_weight"), F.round(V.entropy(w), 6).alias("entropy"))


@query(f"WITH {_E} SELECT count(*) AS documents, round(avg(list_max(w)), 6) AS mean_dominant_weight, round(avg(-list_sum(list_transform(w, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END)) / ln(len(w))), 6) AS mean_entropy FROM wts WHERE list_sum(w) > 0")
def topic_concentration(spark, sf_dir):
    w = F.col("w")
    return weights(spark, sf_dir).where(V.total(w) > 0).agg(F.count("*").alias("documents"), F.round(F.avg(F.array_max(w)), 6).alias("mean_dominant_weight"), F.round(F.avg(V.entropy(w)), 6).alias("mean_entropy"))


@query(f"WITH {_E} SELECT turn, session, topic, round(w, 8) AS w FROM tt")
def source_turn_topics(spark, sf_dir):
    return levels(spark, sf_dir)["source_turn"].select("turn", "session", "topic", F.round("w", 8).alias("w"))


@query(f"WITH {_E} SELECT session, year, topic, round(w, 8) AS w FROM st")
def session_topics(spark, sf_dir):
    return levels(spark, sf_dir)["session"].select("session", "year", "topic", F.round("w", 8).alias("w"))


_PREVALENCE = " UNION ALL ".join(f"SELECT '{n}' AS aggregation_level, {{time}}, topic, round(avg(w), 8) AS prevalence_share, count(*) AS denominator_unit_count FROM {t} GROUP BY ALL" for n, t in (("document", "dt"), ("source_turn", "tt"), ("session", "st")))
_PERIOD = "CASE WHEN year <= 2011 THEN '2008-2011' WHEN year <= 2015 THEN '2012-2015' WHEN year <= 2019 THEN '2016-2019' WHEN year <= 2023 THEN '2020-2023' ELSE '2024-2025' END"


@query(f"WITH {_E} {_PREVALENCE.replace('{time}', 'year')}")
def prevalence_by_year(spark, sf_dir):
    return V.prevalence(levels(spark, sf_dir), "year")


@query(f"WITH {_E} {_PREVALENCE.replace('{time}', _PERIOD + ' AS temporal_period')}")
def prevalence_by_period(spark, sf_dir):
    from lectern.operators.corpus import period_of

    return V.prevalence({n: f.withColumn("temporal_period", period_of(F.col("year"))) for n, f in levels(spark, sf_dir).items()}, "temporal_period")


@query(f"WITH {_E}, p AS (SELECT year, topic, round(avg(w), 8) * CASE WHEN year = 2010 THEN 1.5 ELSE 1 END AS share FROM dt GROUP BY year, topic), s AS (SELECT year, sum(share) AS s FROM p GROUP BY year) SELECT 'document' AS aggregation_level, year, round(s, 5) AS s FROM s WHERE abs(s - 1) > 1e-5")
def share_check(spark, sf_dir):
    """Years whose shares don't sum to one: one year's are made too large."""
    shares = V.prevalence({"document": levels(spark, sf_dir)["document"]}, "year").withColumn("prevalence_share", F.col("prevalence_share") * F.when(F.col("year") == 2010, 1.5).otherwise(1.0))
    return V.share_check(shares, ["aggregation_level", "year"]).withColumn("s", F.round("s", 5))


@query(f"""WITH {_E}, y AS (SELECT unnest(range(2008, 2026)) AS year), c AS (SELECT year, count_if(vec_id % 37 > 0) AS d, count(DISTINCT CASE WHEN vec_id % 37 > 0 THEN turn END) AS t, count(DISTINCT CASE WHEN vec_id % 37 > 0 THEN session END) AS s, CAST(sum(CASE WHEN vec_id % 37 > 0 THEN label ELSE 0 END) AS BIGINT) AS w, count_if(vec_id % 37 = 0) AS z FROM emb GROUP BY year)
SELECT year, coalesce(d, 0) AS modeled_documents, coalesce(t, 0) AS modeled_turns, coalesce(s, 0) AS modeled_sessions, coalesce(w, 0) AS word_total, coalesce(z, 0) AS zero_documents FROM y LEFT JOIN c USING (year)""")
def denominators(spark, sf_dir):
    d = weights(spark, sf_dir).withColumn("zero", F.col("vec_id") % 37 == 0).withColumn("label", F.col("label").cast("long"))
    return V.denominators(d, (2008, 2025), "year", "turn", "session", "label", "zero")


@query(f"""WITH {_E}, a AS (SELECT topic, year, round(avg(w), 8) AS share FROM tt GROUP BY ALL), p AS (SELECT topic, {_PERIOD} AS period, round(avg(w), 8) AS share FROM tt GROUP BY ALL), s AS (SELECT *, share - lag(share) OVER (PARTITION BY topic ORDER BY year) AS change FROM a),
y AS (SELECT topic, arg_max(year, (share, -year)) AS peak_year, arg_min(year, (share, year)) AS trough_year, arg_max(year, (change, -year)) FILTER (WHERE change IS NOT NULL) AS rise_year, arg_min(year, (change, year)) FILTER (WHERE change IS NOT NULL) AS fall_year, round(max(change), 6) AS largest_rise, round(min(change), 6) AS largest_fall FROM s GROUP BY topic)
SELECT y.*, round(b.share - a.share, 6) AS absolute_change, CASE WHEN a.share > 0 THEN round((b.share - a.share) / a.share, 6) END AS relative_change FROM y LEFT JOIN p a ON a.topic = y.topic AND a.period = '2008-2011' LEFT JOIN p b ON b.topic = y.topic AND b.period = '2024-2025'""")
def topic_change(spark, sf_dir):
    from lectern.operators.corpus import period_of

    turn = levels(spark, sf_dir)["source_turn"]
    annual = turn.groupBy("topic", "year").agg(F.round(F.avg("w"), 8).alias("share"))
    periods = turn.groupBy("topic", period_of(F.col("year")).alias("period")).agg(F.round(F.avg("w"), 8).alias("share"))
    return V.change_summary(annual, periods, "2008-2011", "2024-2025")


@query(f"WITH {_E}, r AS (SELECT *, row_number() OVER (PARTITION BY topic, turn ORDER BY w DESC, vec_id) AS rn FROM dt), b AS (SELECT topic, vec_id, turn, row_number() OVER (PARTITION BY topic ORDER BY CAST(rn > 1 AS INT), w DESC, vec_id) AS rank FROM r) SELECT * FROM b WHERE rank <= 5")
def representatives(spark, sf_dir):
    return V.representatives(levels(spark, sf_dir)["document"], 5, "turn", "vec_id").select("topic", "vec_id", "turn", "rank")


_CENTROID = "x AS (SELECT vec_id, label, unnest(range(0, len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), m AS (SELECT label, pos, avg(x) AS m FROM x GROUP BY ALL), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY label)"


@query(f"WITH {_CENTROID}, s AS (SELECT x.label, vec_id, round(sum(x * m / n), 6) AS similarity FROM x JOIN m USING (label, pos) JOIN n USING (label) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS rank FROM s) SELECT label, rank, vec_id, similarity FROM r WHERE rank <= 5")
def centroid_topk(spark, sf_dir):
    return K.nearest_members(table(spark, sf_dir, "embeddings"), "label", "embedding", "vec_id", 5)


@query("""WITH s AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), o AS (SELECT * FROM s WHERE label <> 0) SELECT CAST((SELECT sum(n) FROM s) AS BIGINT) AS documents, CAST(sum(n) AS BIGINT) AS assigned, CAST((SELECT sum(n) FROM s) - sum(n) AS BIGINT) AS outliers, round(1 - sum(n) / (SELECT sum(n) FROM s), 6) AS outlier_fraction, count(*) AS topic_count, max(n) AS largest, CAST(median(n) AS DOUBLE) AS median_size,
round((SELECT sum(n) FROM (SELECT n FROM o ORDER BY n DESC LIMIT 5)) / sum(n), 6) AS top_share, round(-sum(n / (SELECT sum(n) FROM o) * ln(n / (SELECT sum(n) FROM o))) / ln(count(*)), 6) AS normalised_entropy FROM o""")
def cluster_coverage(spark, sf_dir):
    return K.coverage(table(spark, sf_dir, "embeddings"), "label", 0)


@query("SELECT vec_id FROM embeddings WHERE abs(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) - 1) > 0.001")
def norm_violations(spark, sf_dir):
    return K.norm_check(table(spark, sf_dir, "embeddings"), "embedding").select("vec_id")


# Terms.  Stop words stand in for the frozen list; pairs bridge them, for they are taken out first.

STOP = ["the", "and", "that", "der", "die", "und", "que", "los", "las", "les", "des", "est"]
_STOP = ", ".join(f"'{w}'" for w in STOP)
MIN_DF, MAX_DF, FEATURES = 3, 0.95, 2000
_TOK = f"d AS (SELECT doc_id, lang, list_filter({TOKENS}, lambda t: t NOT IN ({_STOP})) AS t FROM documents)"
_TERMS = "g AS (SELECT doc_id, lang, unnest(t || CASE WHEN len(t) > 1 THEN list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) ELSE [] END) AS term FROM d), c AS (SELECT doc_id, lang, term, count(*) AS n FROM g GROUP BY ALL)"
_VOCAB = f"n AS (SELECT count(*) AS n FROM documents), v AS (SELECT term, count(*) AS df, CAST(sum(c.n) AS BIGINT) AS tf FROM c GROUP BY term HAVING count(*) >= {MIN_DF} AND count(*) <= {MAX_DF} * (SELECT n FROM n) ORDER BY tf DESC, term LIMIT {FEATURES})"
_TFIDF = "x AS (SELECT doc_id, lang, term, c.n, df, (1 + ln(c.n)) * (ln((1 + (SELECT n FROM n)) / (1 + df)) + 1) AS x FROM c JOIN v USING (term)), l AS (SELECT doc_id, sqrt(sum(x * x)) AS l FROM x GROUP BY doc_id), t AS (SELECT doc_id, lang, term, n, df, x / l AS w FROM x JOIN l USING (doc_id))"
_PRE = f"{_TOK}, {_TERMS}, {_VOCAB}"


def _terms(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return d, F.filter(X.lexical_tokens(X.casefold(F.col("text"))), lambda t: ~t.isin(*STOP))


def corpus(spark, sf_dir):
    """Documents as counts of the vocabulary's terms."""
    d, tokens = _terms(spark, sf_dir)
    return C.Corpus(d, tokens, ["doc_id", "lang"], MIN_DF, MAX_DF, FEATURES)


@query(f"WITH {_PRE} SELECT term, df, tf FROM v")
def document_frequency(spark, sf_dir):
    return corpus(spark, sf_dir).vocab


@query(f"WITH {_PRE}, {_TFIDF}, r AS (SELECT doc_id, term, n, df, round(w, 8) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY round(w, 8) DESC, term) AS rank FROM t) SELECT * FROM r WHERE rank <= 10")
def tfidf_topk(spark, sf_dir):
    w = corpus(spark, sf_dir).tfidf().drop("lang").withColumn("w", F.round("w", 8))
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("w"), "term"))
    return w.withColumn("rank", rank.cast("long")).where("rank <= 10")


@query(f"WITH {_PRE}, {_TFIDF} SELECT doc_id, len(d.t) AS tokens FROM d WHERE doc_id NOT IN (SELECT doc_id FROM t)")
def zero_vector_docs(spark, sf_dir):
    d, tokens = _terms(spark, sf_dir)
    return T.zero_vectors(d, corpus(spark, sf_dir).weights()).select("doc_id", F.size(tokens).cast("long").alias("tokens"))


_COMPONENTS = f"{_PRE}, {_TFIDF}, k AS (SELECT lang AS topic, term, sum(w) AS weight FROM t GROUP BY ALL), kr AS (SELECT topic, term, round(weight, 6) AS weight, row_number() OVER (PARTITION BY topic ORDER BY round(weight, 6) DESC, term) AS rank FROM k), top AS (SELECT * FROM kr WHERE rank <= 10)"


def components(spark, sf_dir):
    """Each language's summed weights: components that both engines compute alike; and the corpus."""
    own = corpus(spark, sf_dir)
    k = own.summed("lang").select(F.col("lang").alias("topic"), "term", F.round("weight", 6).alias("weight"))
    return materialise(k, "components"), own  # topics x terms


@query(f"WITH {_COMPONENTS} SELECT topic, term, weight, rank FROM top")
def topic_terms(spark, sf_dir):
    return T.top_terms(components(spark, sf_dir)[0], 10)


@query(f"WITH {_COMPONENTS} SELECT round(count(DISTINCT term) / count(*), 6) AS diversity FROM top")
def topic_diversity(spark, sf_dir):
    return T.diversity(T.top_terms(components(spark, sf_dir)[0], 10))


@query(f"WITH {_COMPONENTS}, s AS (SELECT topic, term, weight, rank, sum(weight) OVER (PARTITION BY term) AS a FROM kr) SELECT topic, round(avg(CASE WHEN a > 0 THEN weight / a ELSE 0 END), 6) AS exclusivity FROM s WHERE rank <= 10 GROUP BY topic")
def topic_exclusivity(spark, sf_dir):
    return T.exclusivity(components(spark, sf_dir)[0], 10)


@query(f"WITH {_COMPONENTS}, n2 AS (SELECT topic, sqrt(sum(weight * weight)) AS l FROM kr GROUP BY topic), u AS (SELECT topic, term, weight / l AS u FROM kr JOIN n2 USING (topic)), pr AS (SELECT a.topic AS topic_a, b.topic AS topic_b FROM n2 a JOIN n2 b ON a.topic < b.topic), dd AS (SELECT a.topic AS topic_a, b.topic AS topic_b, sum(a.u * b.u) AS dot FROM u a JOIN u b ON a.term = b.term AND a.topic < b.topic GROUP BY ALL) SELECT topic_a, topic_b, round(coalesce(dot, 0), 6) AS cosine FROM pr LEFT JOIN dd USING (topic_a, topic_b)")
def topic_redundancy(spark, sf_dir):
    return T.redundancy(components(spark, sf_dir)[0])


_PAIRS = f"{_COMPONENTS}, q AS (SELECT a.topic, a.term AS a, b.term AS b FROM top a JOIN top b ON a.topic = b.topic AND a.rank < b.rank), seen AS (SELECT DISTINCT doc_id, term FROM c WHERE term IN (SELECT term FROM top)), f AS (SELECT term, count(*) AS df FROM seen GROUP BY term), co AS (SELECT x.term AS a, y.term AS b, count(*) AS co FROM seen x JOIN seen y ON x.doc_id = y.doc_id AND x.term <> y.term GROUP BY ALL), pp AS (SELECT q.topic, q.a, q.b, coalesce(co, 0) AS co, fa.df AS df_a, fb.df AS df_b, (SELECT n FROM n) AS documents FROM q LEFT JOIN co ON co.a = q.a AND co.b = q.b JOIN f fa ON fa.term = q.a JOIN f fb ON fb.term = q.b)"
_NPMI = "CASE WHEN co = 0 THEN -1.0 WHEN co = documents THEN CASE WHEN df_a = documents AND df_b = documents THEN 1.0 ELSE 0.0 END ELSE least(greatest(ln((co / documents) / (df_a / documents * df_b / documents)) / -ln(co / documents), -1.0), 1.0) END"


@query(f"WITH {_PAIRS} SELECT topic, a, b, co, df_a, df_b, documents FROM pp")
def pair_counts(spark, sf_dir):
    k, own = components(spark, sf_dir)
    return T.pair_counts(own.counts(), T.top_terms(k, 10), own.n).withColumn("documents", F.col("documents").cast("long"))


@query(f"WITH {_PAIRS} SELECT topic, round(avg({_NPMI}), 6) AS npmi, count(*) AS pairs FROM pp GROUP BY topic")
def npmi_coherence(spark, sf_dir):
    k, own = components(spark, sf_dir)
    return T.coherence(T.pair_counts(own.counts(), T.top_terms(k, 10), own.n))


@query(f"WITH {_PAIRS} SELECT topic, round(avg({_NPMI}), 6) AS npmi, count(*) AS pairs FROM pp WHERE co > 0 GROUP BY topic")
def npmi_benchmark(spark, sf_dir):
    k, own = components(spark, sf_dir)
    return T.coherence(T.pair_counts(own.counts(), T.top_terms(k, 10), own.n), skip_zero=True)


@query(f"WITH {_COMPONENTS}, z AS (SELECT term, count(*) AS k FROM top GROUP BY term) SELECT topic, round(avg(1 / z.k), 6) AS set_exclusivity FROM top JOIN z USING (term) GROUP BY topic")
def set_exclusivity(spark, sf_dir):
    return T.set_exclusivity(T.top_terms(components(spark, sf_dir)[0], 10))


@query(f"WITH {_COMPONENTS} SELECT a.topic AS topic_a, b.topic AS topic_b, round(count(*) / 10, 6) AS overlap FROM top a JOIN top b ON a.term = b.term AND a.topic < b.topic GROUP BY ALL")
def set_redundancy(spark, sf_dir):
    return T.set_redundancy(T.top_terms(components(spark, sf_dir)[0], 10))


@query(f"WITH {_TOK}, {_TERMS}, s AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS tf FROM c GROUP BY ALL), z AS (SELECT lang, sum(tf) AS words FROM s GROUP BY lang), e AS (SELECT term, sum(tf) AS f FROM s GROUP BY term), r AS (SELECT lang, term, round(tf / words * ln(1 + (SELECT avg(words) FROM z) / f), 8) AS weight FROM s JOIN z USING (lang) JOIN e USING (term)), k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY weight DESC, term) AS rank FROM r) SELECT lang, term, weight, rank FROM k WHERE rank <= 10")
def class_tfidf(spark, sf_dir):
    d, tokens = _terms(spark, sf_dir)
    return K.class_terms(d, tokens, "lang", 10)


@query("SELECT lang, CASE WHEN count_if(source = 'src0') / count(*) > 0.45 AND (count_if(source = 'src0') - count_if(source = 'src1')) / count(*) >= 0.05 THEN 'fallback' ELSE 'primary' END AS choice FROM documents GROUP BY lang")
def configuration_choice(spark, sf_dir):
    share = lambda s: F.count_if(F.col("source") == s) / F.count("*")
    d = table(spark, sf_dir, "documents").groupBy("lang").agg(share("src0").alias("a"), share("src1").alias("b"))
    return d.select("lang", T.choose_configuration(F.col("a"), F.col("b")).alias("choice"))


#: Sweeps that the reference allows a fit; one that needs more fails.
MOST_SWEEPS = 400


def _factorised(spark, sf_dir):
    rows, terms = corpus(spark, sf_dir).rows()
    rows = materialise(rows, "rows")
    model = N.fit(rows, terms, 4, most_iter=MOST_SWEEPS)
    if not model.converged:
        raise RuntimeError(f"the factorisation hasn't converged: {N.metrics(model)}")
    return rows, model


@query()
def nmf_components(spark, sf_dir):
    """No SQL form: tests check falling errors, signs, and planted topics."""
    _, model = _factorised(spark, sf_dir)
    return T.top_terms(N.components(spark, model), 10)


@query()
def nmf_prevalence(spark, sf_dir):
    rows, model = _factorised(spark, sf_dir)
    w = N.transform(rows, model).withColumn("w", V.normalised(F.col("w")))
    return w.select("doc_id", V.dominant(F.col("w")).alias("dominant_topic"), F.array_max("w").alias("dominant_weight"))


@query()
def nmf_grid(spark, sf_dir):
    """A fit for each number of topics of a grid, without its run time; none may be unfinished."""
    rows, terms = corpus(spark, sf_dir).rows()
    _, record = N.grid(materialise(rows, "rows"), terms, [2, 3, 4], most_iter=MOST_SWEEPS)
    return record.select("k", "n_iter", "converged", F.round("error", 6).alias("error"))


@query()
def nmf_comparison(spark, sf_dir):
    """Prevalence of topics from the stored components against that of the fit's own last weights."""
    rows, model = _factorised(spark, sf_dir)
    own = N.transform(rows.where("size(idx) > 0"), model)
    again = N.transform(rows, N.Factorisation(model.terms, model.h.astype("float32").astype(float)))
    return N.prevalence_differences(N.prevalence(own), N.prevalence(again)).select("topic", "within")


@query()
def density_clusters(spark, sf_dir):
    """No SQL form: tests check planted clusters."""
    return K.density_clusters(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 15, 5)


@query()
def merged_topics(spark, sf_dir):
    c = K.centroids(table(spark, sf_dir, "embeddings"), "label", "embedding")
    sizes = table(spark, sf_dir, "embeddings").groupBy("label").count()
    got = c.join(sizes, "label").select("label", "centroid", "count").collect()  # one row for each topic
    mapping = K.merge_topics({r.label: r.centroid for r in got}, {r.label: r["count"] for r in got}, 5, outlier=0)
    return spark.createDataFrame(sorted(mapping.items()), "old_topic int, new_topic int")
