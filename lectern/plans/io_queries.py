"""Round trips through writers and strict readers, and the checks of turns, overrides and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import corpus as C
from lectern.operators import intervals as I
from lectern.operators import layout as L
from lectern.operators import manifest as M
from lectern.operators import prevalence as V
from lectern.operators import quality as Q
from lectern.operators import topics as T
from lectern.plans.base import query, table
from lectern.plans.speech_queries import _ORDERED, _blocks, _segments
from lectern.sources import readers, sinks
from lectern.sources.scratch import shared_dir

_WORDS = "len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))"


def _place(spark, what):
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


@query("SELECT conv_id, turn, role, text FROM conversations")
def jsonl_round_trip(spark, sf_dir):
    """Written with sorted keys, read with a declared schema."""
    at, c = _place(spark, "jsonl"), table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    sinks.write_jsonl(c, at)
    return readers.strict_jsonl(spark, at, "conv_id long, role string, text string, turn long").select("conv_id", "turn", "role", "text")


@query("SELECT o_orderkey, o_totalprice, o_orderstatus = 'F' AS finished, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 1000 END AS part FROM orders")
def csv_round_trip(spark, sf_dir):
    """Written as text, read as text, then typed; what is no number becomes null."""
    at, o = _place(spark, "csv"), table(spark, sf_dir, "orders")
    flag = F.when(F.col("o_orderstatus") == "F", "True").otherwise("False")
    part = F.when(F.col("o_orderkey") % 5 > 0, (F.col("o_orderkey") % 1000).cast("string")).otherwise("n/a")
    columns = ["o_orderkey", "o_totalprice", "finished", "day", "part"]
    sinks.write_csv(o.select("o_orderkey", F.col("o_totalprice").cast("string").alias("o_totalprice"), flag.alias("finished"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), part.alias("part")), columns, at)
    kinds = {"o_orderkey": "long", "o_totalprice": "double", "finished": "boolean", "day": "date", "part": "long"}
    return readers.string_csv(spark, at, columns).select(*[readers.typed(F.col(c), k).alias(c) for c, k in kinds.items()])


_BASE = "SELECT DISTINCT lower(source) AS term FROM documents WHERE trim(source) <> ''"


@query(f"{_BASE} UNION SELECT unnest(['uno', 'dos'])")
def stop_word_list(spark, sf_dir):
    """A word list with comments and blank lines, read as a set, and additions to it."""
    at, d = _place(spark, "words"), table(spark, sf_dir, "documents")
    own = d.select(F.explode(F.array(F.concat(F.lit("  "), F.upper("source"), F.lit(" ")), F.lit("# note"), F.lit(""))).alias("value"))
    own.where("value IS NOT NULL").write.text(at)
    return readers.stop_words(readers.line_set(spark, at, F.lower("term")), ["uno", "dos"], ["nunca"], F.lower)


@query("SELECT 'orders' AS name, count(*) AS rows, true AS reusable, 0::BIGINT AS problems FROM orders UNION ALL SELECT 'customer', count(*), true, 0 FROM customer")
def committed_run(spark, sf_dir):
    """Two tables that became visible by one pointer, the second time over."""
    runs, inputs = sinks.Runs(spark, _place(spark, "runs")), {"orders": "v1"}
    tables = {n: table(spark, sf_dir, n) for n in ("orders", "customer")}
    runs.commit({"orders": tables["orders"].limit(1)}, "0")
    run = runs.commit(tables, "1", inputs, force=True)
    problems = sinks.lineage_problems(run, "1", inputs, {n: r["rows"] for n, r in run["tables"].items()})
    out = None
    for name in tables:
        one = runs.read(name).agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows", F.lit(runs.reusable("1", inputs)).alias("reusable"), F.lit(len(problems)).cast("long").alias("problems"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS entry_date, (o_orderkey % 90 + 1)::BIGINT AS meeting, CASE WHEN o_orderkey % 4 = 0 THEN 'Sesión ' || (o_orderkey % 90 + 1) || 'ª Reunión' ELSE (o_orderkey % 90 + 1) || 'ª Reunión' END AS title FROM orders")
def entry_fields(spark, sf_dir):
    """Date, meeting and title from the printed line of an index."""
    n = (F.col("o_orderkey") % 90 + 1).cast("string")
    title = F.concat(F.when(F.col("o_orderkey") % 4 == 0, "Sesión ").otherwise(""), n, F.lit("ª Reunión"))
    line = F.concat(title, F.lit(" ("), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(")"))
    e = table(spark, sf_dir, "orders").select("o_orderkey", line.alias("l"))
    return e.select("o_orderkey", M.entry_date(F.col("l")).alias("entry_date"), M.number_before(F.col("l"), "Reunión").alias("meeting"), M.without_date(F.col("l")).alias("title"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_mktsegment END AS surname, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE substring(c_name, 1, 2) END AS initials FROM customer")
def split_labels(spark, sf_dir):
    label = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.concat("c_mktsegment", F.lit(" ("), F.substring("c_name", 1, 2), F.lit(") ")))
    surname, initials = I.split_label(F.col("label"))
    return table(spark, sf_dir, "customer").select("c_custkey", label.alias("label")).select("c_custkey", surname.alias("surname"), initials.alias("initials"))


@query("SELECT vec_id, CASE vec_id % 4 WHEN 1 THEN 'not_finite' WHEN 2 THEN 'negative' WHEN 3 THEN 'zero_sum' END AS problem FROM embeddings")
def weight_problems(spark, sf_dir):
    """Rows of weights that can't be normalised: faults are put into three rows of four."""
    size, x = F.transform("embedding", lambda x: F.abs(x.cast("double")) + 1.0), F.col("vec_id") % 4
    fault = lambda value: F.concat(F.slice(size, 1, 3), F.array(F.lit(value).cast("double")))
    w = F.when(x == 1, fault(float("nan"))).when(x == 2, fault(-0.5)).when(x == 3, F.transform("embedding", lambda _: F.lit(0.0))).otherwise(size)
    return table(spark, sf_dir, "embeddings").select("vec_id", V.row_check(w).alias("problem"))


@query("SELECT source, count(DISTINCT lang) AS variants FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1")
def inconsistent_metadata(spark, sf_dir):
    return V.inconsistent(table(spark, sf_dir, "documents").where("lang IS NOT NULL"), ["source"], ["lang"])


@query("WITH c AS (SELECT lang, count(*) AS documents, CAST(count_if(length(text) < 40) AS BIGINT) AS zeros FROM documents GROUP BY lang) SELECT lang, documents, zeros, zeros <= 3 AND zeros <= 0.25 * documents AS allowed FROM c")
def zero_rows_allowed(spark, sf_dir):
    c = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("documents"), F.count_if(F.length("text") < 40).alias("zeros"))
    return c.withColumn("allowed", T.zero_policy(F.col("zeros"), F.col("documents"), 3, 0.25))


@query(f"WITH {_ORDERED}, o AS (SELECT z.*, text, row_number() OVER (PARTITION BY z.source_record_id, z.page_number ORDER BY zone, CASE WHEN zone = 1 THEN band ELSE 0 END, side, y0, x0, raw_block_number) AS r FROM z JOIN conversations ON printf('s%03d', conv_id % 50) = z.source_record_id AND CAST(conv_id // 50 AS INTEGER) = z.page_number AND turn = raw_block_number), ps AS (SELECT source_record_id, page_number, count(*) AS text_block_count, string_agg(text, chr(10) || chr(10) ORDER BY r) AS text FROM o GROUP BY ALL) SELECT source_record_id, page_number, text_block_count, sha256(text) AS text_sha256, length(text)::INTEGER AS character_count, {_WORDS}::INTEGER AS word_count, length(text) = 0 AS is_empty, length(text) < 50 AS is_thin FROM ps")
def page_statistics(spark, sf_dir):
    p = L.page_statistics(L.reading_order(_blocks(spark, sf_dir)))
    return p.withColumn("text_sha256", F.sha2("text", 256)).drop("text")


@query("SELECT 'customer' AS \"table\", c_custkey AS line, 'c_mktsegment' AS \"column\", 'error' AS severity, 'value is not allowed' AS message FROM customer WHERE trim(c_mktsegment) <> '' AND c_mktsegment NOT IN ('BUILDING', 'MACHINERY') UNION ALL SELECT 'supplier', s_suppkey, 's_name', 'error', 'required value is blank' FROM supplier WHERE s_suppkey % 3 = 0")
def violation_report(spark, sf_dir):
    """Violations of several tables in one."""
    c = Q.violations(table(spark, sf_dir, "customer"), "c_custkey", [Q.member("c_mktsegment", ["BUILDING", "MACHINERY"]), Q.required("c_name")])
    s = table(spark, sf_dir, "supplier").withColumn("s_name", F.when(F.col("s_suppkey") % 3 > 0, F.col("s_name")))
    return Q.report({"customer": c, "supplier": Q.violations(s, "s_suppkey", [Q.required("s_name")])}).select("table", "line", "column", "severity", "message")


_SIDES = {"session_category": "CASE WHEN conv_id % 3 = 0 THEN 'legislative_debate' WHEN conv_id % 3 = 1 THEN 'homage' ELSE 'informative' END", "speaker_family": "role", "temporal_period": "CASE WHEN conv_id % 2 = 0 THEN '2008-2011' ELSE '2012-2015' END", "year": "CAST(2008 + conv_id % 8 AS VARCHAR)", "roll_up": "CASE WHEN conv_id % 3 = 0 THEN 'legislative_debate' ELSE 'other' END"}


@query(f"WITH c AS (SELECT *, {_WORDS} AS n, " + ", ".join(f"{e} AS {c}" for c, e in _SIDES.items() if c != "turn") + " FROM conversations) " + " UNION ALL ".join(f"SELECT '{c}' AS group_name, {c} AS group_value, count(*) AS source_turn_count, CAST(count_if(n > 0) AS BIGINT) AS document_count, CAST(sum(n) AS BIGINT) AS word_total FROM c GROUP BY {c}" for c in _SIDES))
def export_counters(spark, sf_dir):
    """Turns, documents and words by category, family, period, year, and debates against all else."""
    k = F.col("conv_id")
    t = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "text", F.when(k % 3 == 0, "legislative_debate").when(k % 3 == 1, "homage").otherwise("informative").alias("session_category"), F.col("role").alias("speaker_family"),
        F.when(k % 2 == 0, "2008-2011").otherwise("2012-2015").alias("temporal_period"), (F.lit(2008) + k % 8).cast("string").alias("year"),
    )
    return C.export_counters(t, C.chunks(t, most=1_000_000), ["session_category", "speaker_family", "temporal_period", "year"])


@query(f"""WITH t AS (SELECT conv_id, turn, {_WORDS} AS n, CAST(2008 + conv_id % 8 AS VARCHAR) || '-01-01' AS day FROM conversations), o AS (SELECT conv_id, turn, CASE WHEN conv_id % 5 = 1 THEN '2001-01-01' ELSE CAST(2008 + conv_id % 8 AS VARCHAR) || '-01-01' END AS day, {_WORDS} + CAST(conv_id % 7 = 1 AS INT) AS n FROM conversations WHERE turn = 0 UNION ALL SELECT -1, 0, '2008-01-01', 1),
j AS (SELECT o.conv_id, o.turn, t.n AS found, t.day AS found_day, o.day, o.n FROM o LEFT JOIN t USING (conv_id, turn)) SELECT conv_id, turn, 'applied 0 times' AS problem FROM j WHERE found IS NULL UNION ALL SELECT conv_id, turn, 'another date' FROM j WHERE found_day <> day UNION ALL SELECT conv_id, turn, 'another word count' FROM j WHERE found <> n""")
def override_problems(spark, sf_dir):
    """Overrides that don't meet the turn they were written for."""
    day = F.concat((F.lit(2008) + F.col("conv_id") % 8).cast("string"), F.lit("-01-01"))
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", day.alias("session_date"), F.size(X.words(F.col("text"))).cast("long").alias("word_count"))
    o = t.where("turn = 0").select("conv_id", "turn", F.when(F.col("conv_id") % 5 == 1, "2001-01-01").otherwise(F.col("session_date")).alias("session_date"), (F.col("word_count") + (F.col("conv_id") % 7 == 1).cast("int")).alias("expected_speech_word_count"))
    lost = spark.createDataFrame([(-1, 0, "2008-01-01", 1)], o.schema)
    return C.override_problems(t, o.unionByName(lost), ["conv_id", "turn"])


@query(f"WITH t AS (SELECT conv_id, turn, role, {_WORDS} AS n FROM conversations), s AS (SELECT *, CASE WHEN role IN ('user', 'assistant') THEN n ELSE 0 END AS speech FROM t) SELECT conv_id, count(*) AS turn_count, CAST(count_if(speech = 0) AS BIGINT) AS zero_speech_turn_count, CAST(sum(speech) AS BIGINT) AS speech_word_count, CAST(max(speech) AS BIGINT) AS longest_speech, count(*) AS editorial_note_spans FROM s GROUP BY conv_id")
def document_statistics(spark, sf_dir):
    """Statistics of turns, rolled up to their document."""
    from lectern.operators import turncontent

    s = turncontent.turn_statistics(turncontent.content_spans(_segments(spark, sf_dir)), ["conv_id", "turn"])
    return turncontent.document_statistics(s, ["conv_id"]).select("conv_id", "turn_count", "zero_speech_turn_count", "speech_word_count", "longest_speech", "editorial_note_spans")


@query(f"WITH t AS (SELECT conv_id, turn, CASE WHEN conv_id % 9 = 0 THEN NULL ELSE role END AS f, CASE WHEN turn % 13 = 0 THEN '' ELSE text END AS text FROM conversations), w AS (SELECT *, {_WORDS} AS n FROM t), e AS (SELECT *, CASE WHEN conv_id % 17 = 3 THEN 'override' WHEN n = 0 THEN 'no_spoken_content' WHEN coalesce(f, '') NOT IN ('user', 'assistant') THEN 'speaker_family_not_in_modeling_scope' WHEN n < 25 THEN 'fewer_than_25_words' ELSE 'meets_modeling_corpus_policy' END AS decision_reason FROM w) SELECT decision_reason, count(*) AS turns, 0::BIGINT AS repeated_keys, CAST(min(n) AS BIGINT) AS least_words, CAST(max(n) AS BIGINT) AS most_words, CAST(sum(n) AS BIGINT) AS word_total FROM e GROUP BY ALL")
def decision_statistics(spark, sf_dir):
    from lectern.plans.quality_queries import _decided

    return C.decision_statistics(_decided(spark, sf_dir), ["conv_id", "turn"])


_TAIL_TEXT = "'(Aplausos.)' || chr(10) || '- Ocupa la Presidencia la señora vicepresidenta' || chr(10) || 'primera de la Honorable Cámara.' || chr(10) || 'Véase el texto en el Apéndice.'"


@query(f"WITH s AS (SELECT conv_id, turn, 0 AS segment_index, coalesce(text, '') AS text FROM conversations UNION ALL SELECT conv_id, turn, 1, {_TAIL_TEXT} FROM conversations) SELECT conv_id, turn, segment_index, length(text) AS character_count, {_WORDS} AS word_count, sha256(text) AS text_sha256 FROM s")
def segment_records(spark, sf_dir):
    from lectern.operators import turncontent

    return turncontent.segment_records(_segments(spark, sf_dir), ["conv_id", "turn"]).withColumn("text_sha256", F.sha2("text", 256)).drop("text").withColumns({c: F.col(c).cast("long") for c in ("character_count", "word_count")})


@query(f"SELECT conv_id, turn, sha256(coalesce(text, '') || {_TAIL_TEXT}) AS text_sha256, length(coalesce(text, '')) + length({_TAIL_TEXT}) AS character_count, true AS counts_agree FROM conversations")
def span_records(spark, sf_dir):
    """Records of a turn's spans: their characters add up to the turn's, and each has as many as its text."""
    from lectern.operators import turncontent

    r = turncontent.span_records(turncontent.content_spans(_segments(spark, sf_dir)), ["conv_id", "turn"])
    parts = F.array_sort(F.collect_list(F.struct("content_span_index", "text")))  # a turn's spans
    out = r.groupBy("conv_id", "turn").agg(parts.alias("p"), F.sum("character_count").alias("character_count"), F.bool_and(F.col("character_count") == F.length("text")).alias("counts_agree"))
    return out.select("conv_id", "turn", F.sha2(F.array_join(F.transform("p", lambda x: x["text"]), ""), 256).alias("text_sha256"), "character_count", "counts_agree")
