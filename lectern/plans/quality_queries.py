"""Data quality, joins on validity, manifests and exports over the star schema, events and conversations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import corpus as C
from lectern.operators import intervals as I
from lectern.operators import manifest as M
from lectern.operators import quality as Q
from lectern.plans.base import query, table


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey IS NOT NULL)")
def fk_violations(spark, sf_dir):
    parent = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'")
    return Q.orphans(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", parent, "o_orderkey")


@query("WITH r AS (SELECT doc_id, row_number() OVER w AS copy, first_value(doc_id) OVER w AS first FROM documents WINDOW w AS (PARTITION BY text, lang ORDER BY doc_id)) SELECT doc_id, copy, first FROM r WHERE copy > 1")
def duplicate_rows(spark, sf_dir):
    # by digest: a window over whole texts would shuffle them
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), "lang")
    return Q.duplicate_rows(d, ["digest", "lang"], "doc_id").select("doc_id", "copy", "first")


@query("SELECT user_id, event_type, count(*) AS times FROM events GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return Q.duplicate_keys(table(spark, sf_dir, "events"), ["user_id", "event_type"])


@query("""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderpriority END AS priority, CASE WHEN o_orderkey % 11 = 0 THEN '2020-02-30' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS valid_from, strftime(o_orderdate - INTERVAL (o_orderkey % 3 - 1) DAY, '%Y-%m-%d') AS valid_to, o_orderstatus AS status FROM orders),
v AS (SELECT o_orderkey AS line, 'priority' AS "column", 'required value is blank' AS message FROM o WHERE priority = '' UNION ALL SELECT o_orderkey, 'valid_from', 'not an ISO date' FROM o WHERE try_cast(valid_from AS DATE) IS NULL
UNION ALL SELECT o_orderkey, 'valid_to', 'interval ends before it starts' FROM o WHERE try_cast(valid_from AS DATE) > try_cast(valid_to AS DATE) UNION ALL SELECT o_orderkey, 'status', 'value is not allowed' FROM o WHERE status NOT IN ('O', 'F'))
SELECT line, "column", 'error' AS severity, message FROM v""")
def rule_violations(spark, sf_dir):
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.col("o_orderpriority")).alias("priority"), F.when(F.col("o_orderkey") % 11 == 0, "2020-02-30").otherwise(day("o_orderdate")).alias("valid_from"), day(F.date_sub("o_orderdate", (F.col("o_orderkey") % 3 - 1).cast("int"))).alias("valid_to"), F.col("o_orderstatus").alias("status"))
    return Q.violations(o, "o_orderkey", [Q.required("priority"), Q.iso_date("valid_from"), Q.iso_date("valid_to"), Q.ordered("valid_from", "valid_to"), Q.member("status", ["O", "F"])])


_INTERVALS = "iv AS (SELECT o_custkey AS k, o_orderkey AS i, CAST(o_orderdate AS DATE) AS f, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 AS INTEGER) END AS t, o_orderstatus AS v FROM orders)"


def _intervals(spark, sf_dir):
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("i"), day.alias("f"), F.when(F.col("o_orderkey") % 5 != 0, F.date_add(day, (F.col("o_orderkey") % 400).cast("int"))).alias("t"), F.col("o_orderstatus").alias("v"))


@query(f"WITH {_INTERVALS} SELECT a.k, a.i AS first_id, b.i AS second_id, CASE WHEN a.v = b.v THEN 'warning' ELSE 'error' END AS severity FROM iv a JOIN iv b ON a.k = b.k AND a.i < b.i AND a.f <= coalesce(b.t, DATE '9999-12-31') AND b.f <= coalesce(a.t, DATE '9999-12-31')")
def interval_overlaps(spark, sf_dir):
    return Q.overlaps(_intervals(spark, sf_dir), ["k"], "f", "t", "i", "v")


@query(f"WITH {_INTERVALS}, c AS (SELECT c_custkey AS k, DATE '1997-06-30' AS at FROM customer) SELECT c.k, c.at, iv.i, iv.f, iv.t, iv.v FROM c LEFT JOIN iv ON c.k = iv.k AND iv.f <= c.at AND c.at <= coalesce(iv.t, DATE '9999-12-31')")
def asof_membership(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.to_date(F.lit("1997-06-30")).alias("at"))
    return I.as_of(c, _intervals(spark, sf_dir), ["k"], "at", "f", "t")


@query(f"""WITH {_INTERVALS}, c AS (SELECT c_custkey AS k, DATE '1997-06-30' AS at, upper(substring(c_name, 18, 1)) AS ini FROM customer), j AS (SELECT c.k, ini, CASE WHEN iv.i IS NOT NULL THEN CAST(iv.i % 10 AS VARCHAR) || iv.v END AS name FROM c LEFT JOIN iv ON c.k = iv.k AND iv.f <= c.at AND c.at <= iv.t),
g AS (SELECT k, count(DISTINCT name) AS names, count(DISTINCT CASE WHEN ini <> '' AND starts_with(upper(name), ini) THEN name END) AS fitting, max(CASE WHEN ini <> '' AND starts_with(upper(name), ini) THEN name END) AS by_initials, max(name) AS any_name FROM j GROUP BY k)
SELECT k, CASE WHEN names = 1 OR fitting = 1 THEN 'match_unico' WHEN names > 1 THEN 'ambiguo' ELSE 'sin_match' END AS match, CASE WHEN fitting = 1 THEN by_initials WHEN names = 1 THEN any_name END AS matched_name FROM g""")
def people_match(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.to_date(F.lit("1997-06-30")).alias("at"), F.upper(F.substring("c_name", 18, 1)).alias("ini"))
    held = I.as_of(c, _intervals(spark, sf_dir), ["k"], "at", "f", "t", open_end=False).withColumn("name", F.when(F.col("i").isNotNull(), F.concat((F.col("i") % 10).cast("string"), "v")))
    return I.match_people(held, "k", "name", "ini")


@query("SELECT match, n, round(n / sum(n) OVER () * 100, 6) AS percent FROM (SELECT o_orderpriority AS match, count(*) AS n FROM orders GROUP BY ALL)")
def value_counts(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("match")).agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.round(F.col("n") / F.sum("n").over(W.partitionBy()) * 100, 6))  # a row for each value


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS year, CASE WHEN year(o_orderdate) BETWEEN 1995 AND 1996 THEN '1995-1996' WHEN year(o_orderdate) BETWEEN 1997 AND 1999 THEN '1997-1999' WHEN year(o_orderdate) BETWEEN 2000 AND 2001 THEN '2000-2001' END AS period FROM orders")
def period_bins(spark, sf_dir):
    y = F.year("o_orderdate").cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", y.alias("year"), C.period_of(y, {"1995-1996": (1995, 1996), "1997-1999": (1997, 1999), "2000-2001": (2000, 2001)}).alias("period"))


@query("""WITH t AS (SELECT conv_id, turn, CASE WHEN conv_id % 9 = 0 THEN NULL ELSE role END AS speaker_family, CASE WHEN turn % 13 = 0 THEN '' ELSE text END AS text FROM conversations), w AS (SELECT *, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS word_count FROM t)
SELECT conv_id, turn, word_count, CASE WHEN conv_id % 17 = 3 THEN 'excluded_by_override' WHEN word_count = 0 THEN 'excluded_zero_speech' WHEN coalesce(speaker_family, '') NOT IN ('user', 'assistant') THEN 'excluded_speaker_family' WHEN word_count < 25 THEN 'excluded_below_minimum_words' ELSE 'retained' END AS decision,
CASE WHEN conv_id % 17 = 3 THEN 'override' WHEN word_count = 0 THEN 'no_spoken_content' WHEN coalesce(speaker_family, '') NOT IN ('user', 'assistant') THEN 'speaker_family_not_in_modeling_scope' WHEN word_count < 25 THEN 'fewer_than_25_words' ELSE 'meets_modeling_corpus_policy' END AS decision_reason FROM w""")
def turn_decisions(spark, sf_dir):
    return _decided(spark, sf_dir).select("conv_id", "turn", "word_count", "decision", "decision_reason")


def _decided(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").withColumn("speaker_family", F.when(F.col("conv_id") % 9 != 0, F.col("role"))).withColumn("text", F.when(F.col("turn") % 13 == 0, "").otherwise(F.col("text")))
    t = t.withColumn("word_count", F.size(X.words(F.col("text"))).cast("long")).withColumn("off", F.col("conv_id") % 17 == 3)
    return C.with_decision(t, excluded="off", allowed=("user", "assistant"))


@query()
def turn_chunks(spark, sf_dir):
    """Chunks have no SQL form; tests hold them against their rules."""
    t = _decided(spark, sf_dir).where("decision = 'retained'").select("conv_id", "turn", "text", F.format_string("%020d", "conv_id").alias("source"))
    return C.modeling_documents(t, "source", "turn", most=40)


@query()
def document_chunks(spark, sf_dir):
    return C.chunks(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "chunk_index", "start", "end", "word_count", F.sha2("text", 256).alias("content_hash"))


@query("""WITH w AS (SELECT *, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS n FROM conversations) SELECT role, count(*) AS source_turn_count, CAST(count_if(n > 0) AS BIGINT) AS document_count, CAST(sum(n) AS BIGINT) AS word_total FROM w GROUP BY role""")
def export_counts(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    return C.export_counts(t, C.chunks(t, most=1_000_000), "role")


@query("SELECT unnest(['decision_keys_unique', 'retained_keys_match_decisions', 'documents_have_a_retained_turn', 'declared_chunk_counts', 'chunk_indexes_contiguous', 'words_preserved', 'chunks_within_limit', 'document_ids_unique']) AS check_name, true AS holds")
def export_checks(spark, sf_dir):
    keys = ["conv_id", "turn"]
    decided = _decided(spark, sf_dir)
    kept = decided.where("decision = 'retained'")
    docs = C.modeling_documents(kept.withColumn("source", F.format_string("%020d", "conv_id")), "source", "turn", most=40)
    counts = docs.groupBy(*keys).agg(F.count("*").alias("chunk_count"))
    return C.export_checks(decided, kept.select(*keys, "word_count").join(counts, keys), docs, keys, 40)


@query("""WITH o AS (SELECT conv_id, turn, 'exclude_turn' AS action FROM conversations WHERE conv_id % 5 = 0 AND turn = 1) SELECT t.conv_id, t.turn, coalesce(o.action = 'exclude_turn', false) AS excluded_by_override,
CASE WHEN t.turn = 0 AND t.conv_id % 4 = 1 AND contains(t.text, ' ') THEN substring(t.text, 1, instr(t.text, ' ') - 1) END AS discarded_prefix, CASE WHEN t.turn = 0 AND t.conv_id % 4 = 1 AND contains(t.text, ' ') THEN 'chair' ELSE t.role END AS speaker_family FROM conversations t LEFT JOIN o USING (conv_id, turn)""")
def override_join(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").withColumnRenamed("role", "speaker_family")
    drop = t.where("conv_id % 5 = 0 AND turn = 1").select("conv_id", "turn", F.lit("exclude_turn").alias("action"), F.lit(None).cast("string").alias("start_anchor"), F.lit(None).cast("long").alias("expected_anchor_occurrences"), F.lit(None).cast("string").alias("speaker_family"))
    cut = t.where("conv_id % 4 = 1 AND turn = 0 AND contains(text, ' ')").select("conv_id", "turn", F.lit("retain_from_anchor"), F.lit(" "), F.lit(1).cast("long"), F.lit("chair"))
    return C.apply_overrides(t, drop.union(cut), ["conv_id", "turn"]).select("conv_id", "turn", "excluded_by_override", "discarded_prefix", "speaker_family")


@query("SELECT doc_id, printf('%020d', doc_id) || '__turn_' || printf('%06d', doc_id % 300) || '__chunk_' || printf('%03d', doc_id % 7) AS document_id, printf('%020d', doc_id) || '::turn_' || printf('%06d', doc_id % 300) AS turn_key, sha256(text) AS content_hash FROM documents")
def ids_and_hashes(spark, sf_dir):
    s, t = F.format_string("%020d", "doc_id"), F.col("doc_id") % 300
    return table(spark, sf_dir, "documents").select("doc_id", C.document_id(s, t, F.col("doc_id") % 7).alias("document_id"), C.turn_key(s, t).alias("turn_key"), F.sha2("text", 256).alias("content_hash"))


_FOLDED = "trim(regexp_replace(upper(o_orderpriority), '[^A-Z0-9]+', ' ', 'g'))"


@query(f"SELECT o_orderkey, substring(sha256('deputies|period=' || (o_orderkey % 150) || '|date=' || strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 3 > 0 THEN '|meeting=' || (o_orderkey % 40) ELSE '|title=' || {_FOLDED} END), 1, 20) AS source_record_id FROM orders")
def session_ids(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    meeting = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 40)
    return o.select("o_orderkey", M.source_record_id(F.col("o_orderkey") % 150, F.to_date("o_orderdate"), meeting, X.fold_for_matching(F.col("o_orderpriority"))).alias("source_record_id"))


_KINDS = ["Sesión", "Asamblea Legislativa", "Sesión preparatoria", "Homenaje a Güemes", "Sesión informativa", "Presentación de presupuesto", "Expresiones en minoría", "Otra cosa", "Reunión ordinaria"]
_EXTRAS = ["", "ordinaria", "ordinaria de prórroga", "extraordinaria especial", "(no efectuada)", "extraordinaria (fracasada)", "PRÓRROGA - no efectuada"]
_list = lambda x: "[" + ", ".join(f"'{v}'" for v in x) + "]"
_TITLE_SQL = f"{_list(_KINDS)}[event_id % {len(_KINDS)} + 1] || ' ' || {_list(_EXTRAS)}[event_id // {len(_KINDS)} % {len(_EXTRAS)} + 1]"


@query(f"""WITH t AS (SELECT event_id AS e_id, user_id % 4 > 0 AS pdf, trim(regexp_replace(upper(strip_accents({_TITLE_SQL})), '[^A-Z0-9]+', ' ', 'g')) AS f FROM events),
c AS (SELECT *, CASE WHEN contains(f, 'ASAMBLEA LEGISLATIVA') THEN 'assembly' WHEN contains(f, 'PRESENTACION DE PRESUPUESTO') THEN 'budget_presentation' WHEN contains(f, 'EXPRESIONES EN MINORIA') THEN 'expressions_in_minority' WHEN contains(f, 'PREPARATORIA') THEN 'preparatory' WHEN contains(f, 'HOMENAJE') THEN 'homage' WHEN contains(f, 'INFORMATIVA') THEN 'informative' WHEN contains(f, 'SESION') OR contains(f, 'ORDINARIA') THEN 'legislative_debate' ELSE 'other' END AS category FROM t)
SELECT e_id, category, CASE WHEN category IN ('assembly', 'budget_presentation') THEN 'unknown' WHEN contains(f, 'PRORROGA') THEN 'extension' WHEN contains(f, 'EXTRAORDINARIA') THEN 'extraordinary' WHEN contains(f, 'ORDINARIA') THEN 'ordinary' ELSE 'unknown' END AS term, CASE WHEN contains(f, 'NO EFECTUADA') THEN 'not_held' WHEN contains(f, 'FRACASADA') THEN 'failed' WHEN pdf THEN 'held' ELSE 'unknown' END AS event_status FROM c""")
def session_classes(spark, sf_dir):
    pick = lambda values, k: F.element_at(F.array(*[F.lit(t) for t in values]), (k % len(values) + 1).cast("int"))
    title = F.concat(pick(_KINDS, F.col("event_id")), F.lit(" "), pick(_EXTRAS, F.floor(F.col("event_id") / len(_KINDS))))
    f = table(spark, sf_dir, "events").select(F.col("event_id").alias("e_id"), (F.col("user_id") % 4 > 0).alias("pdf"), X.fold_for_matching(title).alias("f"))
    c = M.category(F.col("f"))
    return f.select("e_id", c.alias("category"), M.term(F.col("f"), c).alias("term"), M.event_status(F.col("f"), F.col("pdf")).alias("event_status"))


@query("SELECT count(*) AS sessions, count(DISTINCT year(o_orderdate)) AS periods, min(CAST(o_orderdate AS DATE)) AS first_date, max(CAST(o_orderdate AS DATE)) AS last_date, count_if(o_totalprice > 100000) AS with_pdf, count_if(o_orderstatus = 'O') AS debates FROM orders")
def manifest_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("period"), F.to_date("o_orderdate").alias("session_date"), (F.col("o_totalprice") > 100000).alias("has_pdf"), F.when(F.col("o_orderstatus") == "O", "legislative_debate").otherwise("other").alias("category"))
    return M.summary(o)


@query("WITH s AS (SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem) SELECT s.o_orderkey, o_orderpriority, CASE WHEN o.o_orderkey IS NULL THEN 'not in the manifest' WHEN trim(o_orderpriority) = '' THEN 'o_orderpriority is blank' END AS problem FROM s LEFT JOIN (SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O') o USING (o_orderkey)")
def ordered_selection(spark, sf_dir):
    """The orders of all items, looked up among those that are open."""
    chosen = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return M.select_in_order(chosen, table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_orderpriority"), "o_orderkey", "o_orderpriority")


@query("WITH i AS (SELECT page_id, regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1) AS e FROM pages), u AS (SELECT page_id, unnest(range(1, len(e) + 1)) AS source_entry_position, unnest(e) AS entry FROM i) SELECT page_id, source_entry_position::INTEGER AS source_entry_position, source_entry_position::INTEGER AS period_entry_position, array_to_string(list_filter(string_split_regex(regexp_replace(entry, '<[^>]*>', '', 'g'), '\\s+'), lambda w: w <> ''), ' ') AS title, CAST(NULL AS INTEGER) AS period FROM u")
def html_index(spark, sf_dir):
    """Entries of every list in a page, in order; pages without periods are one stretch."""
    from lectern.sources.readers import html_entries

    return html_entries(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", "source_entry_position", "period_entry_position", "title", "period")


@query("SELECT conv_id, turn, fragments, coalesce(covered_or_null, 0) AS covered FROM (SELECT conv_id, turn, list_filter([{'s': 0, 'e': 10, 'o': 'a'}, {'s': 10, 'e': 12, 'o': 'b'}, {'s': 12, 'e': 40, 'o': 'c'}], lambda f: f.e > turn AND f.s < turn + 8).len() AS fragments, list_sum(list_transform(list_filter([{'s': 0, 'e': 10}, {'s': 10, 'e': 12}, {'s': 12, 'e': 40}], lambda f: f.e > turn AND f.s < turn + 8), lambda f: least(f.e, turn + 8) - greatest(f.s, turn)))::BIGINT AS covered_or_null FROM conversations)")
def fragment_slices(spark, sf_dir):
    made = F.array(*[F.struct(F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end"), F.lit(s).alias("source")) for a, b, s in ((0, 10, "a"), (10, 12, "b"), (12, 40, "c"))])
    cut = C.slice_fragments(made, F.col("turn"), F.col("turn") + 8)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(cut).cast("long").alias("fragments"), F.aggregate(cut, F.lit(0).cast("long"), lambda a, f: a + f["end"] - f["start"]).alias("covered"))


@query("""WITH s AS (SELECT conv_id, turn, turn * 10 AS a, turn * 10 + 5 AS b FROM conversations), g AS (SELECT conv_id, turn AS segment_index, turn * 10 AS ga, turn * 10 + CASE WHEN turn % 2 = 0 THEN 9 ELSE 3 END AS gb FROM conversations)
SELECT s.conv_id, a AS start, b AS "end", count(ga) AS segment_count, min(segment_index) AS segment_index FROM s LEFT JOIN g ON s.conv_id = g.conv_id AND ga <= a AND b <= gb GROUP BY s.conv_id, a, b""")
def containment_join(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    spans = c.select("conv_id", (F.col("turn") * 10).alias("start"), (F.col("turn") * 10 + 5).alias("end"))
    segments = c.select("conv_id", F.col("turn").alias("segment_index"), (F.col("turn") * 10).alias("start"), (F.col("turn") * 10 + F.when(F.col("turn") % 2 == 0, 9).otherwise(3)).alias("end"))
    return I.contained(spans, segments, ["conv_id"])


_FOLD = lambda of, into, value: f"SELECT {of} // 4096 AS {into}, sha256(string_agg({value}, chr(10) ORDER BY {of})) AS digest"


@query(f"WITH k AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)), a AS ({_FOLD('doc_id', 'a', 'CAST(doc_id AS VARCHAR)')} FROM k GROUP BY a), b AS ({_FOLD('a', 'b', 'digest')} FROM a GROUP BY b), c AS ({_FOLD('b', 'c', 'digest')} FROM b GROUP BY c) SELECT (SELECT count(*) FROM k) AS documents, sha256(string_agg(digest, chr(10) ORDER BY c)) AS ordered_digest FROM c")
def corpus_digest(spark, sf_dir):
    kept = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_anti")
    return Q.ordered_digest(kept, "doc_id").withColumnRenamed("rows", "documents")


@query("WITH e AS (SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 3 = 0), n AS (SELECT c_custkey, 'REPLACED' AS c_mktsegment FROM customer WHERE c_custkey % 15 = 0) SELECT * FROM n UNION ALL SELECT * FROM e WHERE c_custkey NOT IN (SELECT c_custkey FROM n)")
def row_upsert(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    new = c.where("c_custkey % 15 = 0").withColumn("c_mktsegment", F.lit("REPLACED"))
    return new.unionByName(c.where("c_custkey % 3 = 0").join(new, "c_custkey", "left_anti"))


@query("WITH p AS (PIVOT (SELECT o_orderpriority AS priority, 'y' || year(o_orderdate) AS y, o_totalprice FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 1998) ON y IN ('y1995', 'y1996', 'y1997', 'y1998') USING round(avg(o_totalprice), 4) GROUP BY priority) SELECT * FROM p")
def pivot_year(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority"), F.concat(F.lit("y"), F.year("o_orderdate").cast("string")).alias("y"), "o_totalprice")
    return o.groupBy("priority").pivot("y", ["y1995", "y1996", "y1997", "y1998"]).agg(F.round(F.avg("o_totalprice"), 4))


@query("WITH v AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS year, o_orderpriority AS topic, o_totalprice AS share FROM orders), e AS (SELECT * FROM (VALUES ('first', 1995), ('second', 1996), ('third', 1999)) t(event, y)) SELECT event, topic, round(avg(share), 6) AS mean_value, count(*) AS n FROM v JOIN e ON year BETWEEN y AND y + 1 GROUP BY event, topic")
def event_windows(spark, sf_dir):
    v = table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("long").alias("year"), F.col("o_orderpriority").alias("topic"), F.col("o_totalprice").alias("share"))
    e = spark.createDataFrame([("first", 1995), ("second", 1996), ("third", 1999)], "event string, event_year long")
    return I.event_windows(v, e, "year", 1, "share", ["topic"])


@query("SELECT conv_id, role, count(*) AS turn_count, min(turn) AS first_turn FROM conversations GROUP BY conv_id, role")
def speaker_inventory(spark, sf_dir):
    from lectern.operators import speakers

    return speakers.inventory(table(spark, sf_dir, "conversations"), ["conv_id", "role"], "turn")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) SELECT user_id, event_id, event_type FROM r WHERE rn = 1")
def first_record(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return e.groupBy("user_id").agg(F.min_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("r")).select("user_id", "r.event_id", "r.event_type")
