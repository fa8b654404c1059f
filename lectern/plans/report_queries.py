"""Report tables over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import reports as R
from lectern.operators import topics as T
from lectern.plans.base import query, table
from lectern.plans.topic_queries import _COMPONENTS, components


@query("SELECT claim_id, raw_value, display_value, unit, sha256(claim_id || '|' || display_value || '|' || unit) AS evidence_hash FROM (SELECT 'orders' AS claim_id, count(*)::DOUBLE AS raw_value, printf('%.0f', count(*)::DOUBLE) AS display_value, 'rows' AS unit FROM orders UNION ALL SELECT 'asia', r_regionkey::DOUBLE, printf('%.2f', r_regionkey::DOUBLE), 'key' FROM region WHERE r_name = 'ASIA')")
def evidence_claims(spark, sf_dir):
    n = table(spark, sf_dir, "orders").agg(F.count("*").alias("value"))
    asia = R.exactly_one(table(spark, sf_dir, "region"), F.col("r_name") == "ASIA", "r_regionkey")
    return R.claims({"orders": (n, "rows", "%.0f"), "asia": (asia, "key", "%.2f")})


@query("WITH m AS (SELECT label, count(*) AS n, round(avg(embedding[1]::DOUBLE), 6) AS x FROM embeddings WHERE label IN (1, 2) GROUP BY label), a AS (SELECT * FROM m WHERE label = 1), b AS (SELECT * FROM m WHERE label = 2) SELECT a.n AS n_first, a.x AS x_first, b.n AS n_second, b.x AS x_second, (b.n - a.n)::DOUBLE AS n_delta, round(b.x - a.x, 6) AS x_delta FROM a, b")
def model_delta(spark, sf_dir):
    m = table(spark, sf_dir, "embeddings").where("label IN (1, 2)").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(F.col("embedding")[0].cast("double")), 6).alias("x"))
    return R.delta(m, "label", 1, 2, ["n", "x"]).withColumn("n_delta", F.col("n_delta").cast("double"))


@query("WITH s AS (SELECT l_returnflag AS model, count(*) AS n FROM lineitem GROUP BY ALL) SELECT model, n FROM s UNION ALL SELECT 'all', count(*) FROM lineitem")
def model_comparison(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_returnflag")
    flags = [r.l_returnflag for r in l.distinct().collect()]  # a closed vocabulary
    return R.compare({**{f: l.where(F.col("l_returnflag") == f).agg(F.count("*").alias("n")) for f in flags}, "all": l.agg(F.count("*").alias("n"))})


@query(f"WITH {_COMPONENTS} SELECT topic, string_agg(term, '|' ORDER BY rank) AS terms, count(*) AS n, true AS ranks_contiguous FROM top GROUP BY topic")
def topic_metadata(spark, sf_dir):
    return R.topic_metadata(T.top_terms(components(spark, sf_dir)[0], 10))


@query("WITH u AS (SELECT o_orderstatus AS s, 'price' AS measure, o_totalprice AS x FROM orders UNION ALL SELECT o_orderstatus, 'customer', o_custkey FROM orders) SELECT measure, round(avg(x) FILTER (WHERE s = 'O'), 6) AS open, round(avg(x) FILTER (WHERE s = 'F'), 6) AS filled FROM u GROUP BY measure")
def family_means(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderstatus", F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("customer"))
    return R.means_by_group(o, "o_orderstatus", {"O": "open", "F": "filled"}, ["price", "customer"])


@query("SELECT conv_id, turn, (sum(length(text) + 1) OVER w - 1 - length(text))::BIGINT AS joined_start, (sum(length(text) + 1) OVER w - 1)::BIGINT AS joined_end FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def joined_offsets(spark, sf_dir):
    return R.joined_offsets(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text").select("conv_id", "turn", "joined_start", "joined_end")


@query("WITH o AS (SELECT conv_id, turn, (sum(length(text) + 1) OVER w - 1 - length(text))::BIGINT AS a, (sum(length(text) + 1) OVER w - 1)::BIGINT AS b FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), m AS (SELECT DISTINCT conv_id, 25::BIGINT AS \"offset\" FROM conversations) SELECT conv_id, \"offset\", min(turn) AS turn, arg_min(\"offset\" - a, turn) AS source_offset FROM m JOIN o USING (conv_id) WHERE a <= \"offset\" AND \"offset\" <= b GROUP BY ALL")
def offset_lookup(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    wanted = c.select("conv_id").distinct().withColumn("offset", F.lit(25).cast("long"))
    return R.source_of_offset(R.joined_offsets(c, ["conv_id"], "turn", "text").select("conv_id", "turn", "joined_start", "joined_end"), wanted, ["conv_id"], "turn")


@query("WITH a AS (SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 2 = 0), b AS (SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 3 = 0) SELECT *, 'first' AS only_in FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'second' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def row_differences(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return R.same_rows(c.where("c_custkey % 2 = 0"), c.where("c_custkey % 3 = 0"))


@query("WITH b AS (SELECT doc_id, count(*) AS n FROM labels GROUP BY doc_id) SELECT doc_id, CASE WHEN n IS NULL THEN 'missing on the right' ELSE 'repeated' END AS problem FROM documents LEFT JOIN b USING (doc_id) WHERE n IS NULL OR n > 1")
def key_problems(spark, sf_dir):
    return R.key_problems(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"), "doc_id")


@query("WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('42:' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n, count(*) OVER () AS a FROM documents) SELECT doc_id, lang FROM r WHERE r <= ceil(n * 50 / a)")
def smoke_sample(spark, sf_dir):
    return R.hash_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", 50, 42, "doc_id")


@query("""WITH x AS (SELECT vec_id % 4 AS t, vec_id % 2 = 0 AS side, unnest(range(0, len(embedding))) AS p, unnest(embedding)::DOUBLE AS x FROM (SELECT vec_id // 2 AS k, * FROM embeddings)), y AS (SELECT vec_id // 2 % 3 AS t, (vec_id % 2)::INTEGER AS side, unnest(range(0, len(embedding))) AS p, unnest(embedding)::DOUBLE AS x FROM embeddings),
m AS (SELECT t, side, p, avg(x) AS m FROM y GROUP BY ALL), n AS (SELECT t, side, sqrt(sum(m * m)) AS n FROM m GROUP BY ALL), u AS (SELECT t, side, p, m / n AS u FROM m JOIN n USING (t, side)) SELECT a.t, 0 AS a, 1 AS b, round(1 - sum(a.u * b.u), 6) AS distance FROM u a JOIN u b ON a.t = b.t AND a.p = b.p AND a.side = 0 AND b.side = 1 GROUP BY a.t""")
def discursive_distance(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select((F.floor(F.col("vec_id") / 2) % 3).alias("t"), (F.col("vec_id") % 2).cast("int").alias("side"), "embedding")
    return R.distance_of_sides(e, "side", "embedding", "t")


@query("""WITH m AS (SELECT user_id AS alias, event_id, ts::DATE AS "at" FROM events), a AS (SELECT DISTINCT user_id AS alias, user_id % 20 AS person FROM events), b AS (SELECT DISTINCT user_id % 20 AS person, 'b' || (user_id % 3) AS bloc FROM events), l AS (SELECT * FROM (VALUES ('b0', 'left', DATE '2024-01-01', DATE '2024-01-10'), ('b0', 'right', DATE '2024-01-11', NULL), ('b1', 'right', DATE '2024-01-05', NULL)) t(bloc, alignment, f, t))
SELECT m.event_id, alias, m."at", a.person, b.bloc, l.alignment FROM m LEFT JOIN a USING (alias) LEFT JOIN b USING (person) LEFT JOIN l ON l.bloc = b.bloc AND l.f <= m."at" AND m."at" <= coalesce(l.t, DATE '9999-12-31')""")
def alignment_chain(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    day = lambda s: F.to_date(F.lit(s))
    always = lambda d: d.withColumn("valid_from", day("1900-01-01")).withColumn("valid_to", F.lit(None).cast("date"))
    person = F.col("user_id") % 20
    mentions = e.select("event_id", F.col("user_id").alias("alias"), F.to_date("ts").alias("at"))
    aliases = always(e.select(F.col("user_id").alias("alias"), person.alias("person")).distinct())
    blocs = always(e.select(person.alias("person"), F.concat(F.lit("b"), (F.col("user_id") % 3).cast("string")).alias("bloc")).distinct())
    sides = spark.createDataFrame([("b0", "left", "2024-01-01", "2024-01-10"), ("b0", "right", "2024-01-11", None), ("b1", "right", "2024-01-05", None)], "bloc string, alignment string, f string, t string")
    return R.alignment_chain(mentions, aliases, blocs, sides.select("bloc", "alignment", F.to_date("f").alias("valid_from"), F.to_date("t").alias("valid_to")))


@query("WITH b AS (SELECT conv_id, (turn % 3 = 0)::INT AS block_type, text FROM conversations) SELECT conv_id, count_if(block_type = 1) AS image_block_count, count_if(block_type = 0) AS text_block_count FROM b GROUP BY conv_id")
def raw_block_counts(spark, sf_dir):
    b = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") % 3 == 0).cast("int").alias("block_type"), "text")
    return R.image_counts(b, ["conv_id"])


@query("SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(regexp_replace(l, '\\s+', ' ', 'g'))), lambda l: l <> ''), chr(10)) AS text FROM conversations WHERE turn % 3 <> 0 AND trim(text) <> ''")
def raw_text_blocks(spark, sf_dir):
    b = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") % 3 == 0).cast("int").alias("block_type"), "text")
    return R.text_blocks(b, X.extracted_text)


@query("SELECT event_type, round(sum(value) FILTER (WHERE extract('day' FROM ts) <= 15), 4) AS first_half, round(sum(value) FILTER (WHERE extract('day' FROM ts) > 15), 4) AS second_half FROM events GROUP BY event_type")
def pivot_period(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.when(F.dayofmonth("ts") <= 15, "first_half").otherwise("second_half").alias("half"), "value")
    return R.pivot_share(e.groupBy("event_type", "half").agg(F.round(F.sum("value"), 4).alias("share")), "event_type", "half", ["first_half", "second_half"], "share")
