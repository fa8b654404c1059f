"""The registered queries ``opN_<name>``: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontaminate, linededup, quality, sharding, simhash, suffixdedup, tokens, tokenstore, topk
from lectern.llm.common import shared_dir, table

#: Vocabulary files are found where they are installed; operators take any path.
RANKS = "byte_bpe_multi_50k.tiktoken"
JSON = "byte_bpe_50k.json"


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = F.size("hit_words").cast("long")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", F.size("removed_lines").cast("long").alias("n_removed"), F.concat_ws(",", F.col("removed_lines").cast("array<string>")).alias("removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = tokens.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(RANKS), decoded="decoded", pattern=public_tokenizers.PATTERN)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.kd_shards(table(spark, sf_dir, "documents"), n_shards=16)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = tokens.count(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(JSON), 1024)
    return done.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"), "cut_bytes")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffixdedup.remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Score from which a document counts as good.
GOOD = 0.3


def held_out(doc_id: str = "doc_id"):
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(documents, table(spark, sf_dir, "labels").where(~held_out()))
    done = quality.score(documents, model)
    return done.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"), F.size("line_scores").alias("n_lines"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    at = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    tokenstore.write(table(spark, sf_dir, "documents"), public_tokenizers.path(JSON), at)
    return tokenstore.read(spark, at).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontaminate, op2_line_dedup, op3_byte_bpe, op4_simhash, op5_kd_shards, op6_token_counts, op7_suffix_dedup, op8_quality, op9_top_k, op10_token_store)
}
#: DuckDB SQL where SQL can say it within a bearable time.
ORACLE: dict[str, str] = {
    "op2_line_dedup": r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
n AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM d),
w AS (SELECT doc_id, i, line, len(regexp_extract_all(line, '[^ \t\n\r\f\v]+')) AS words FROM n),
c AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY doc_id ORDER BY i), 0) AS upto FROM w),
p AS (SELECT a.doc_id, a.i, b.i AS j FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.words >= 50),
r AS (SELECT doc_id, i, min(j) AS j FROM p GROUP BY doc_id, i UNION SELECT doc_id, max(i) AS i, j FROM p GROUP BY doc_id, j),
k AS (SELECT r.*, array_to_string(list_slice(d.l, r.i, r.j), chr(10)) AS run FROM r JOIN d USING (doc_id)),
f AS (SELECT run, min({'d': doc_id, 'i': i}) AS first FROM k GROUP BY run),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS i FROM k JOIN f USING (run) WHERE {'d': doc_id, 'i': i} > first),
out AS (SELECT w.doc_id, count(*) AS n_lines, count(gone.i) AS n_removed, coalesce(string_agg((gone.i - 1)::VARCHAR, ',' ORDER BY gone.i), '') AS removed,
 coalesce(string_agg(w.line, chr(10) ORDER BY w.i) FILTER (WHERE gone.i IS NULL), '') AS kept FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id AND w.i = gone.i GROUP BY w.doc_id)
SELECT doc_id, n_lines, n_removed, removed, sha256(kept) AS kept_sha256 FROM out""",
    "op1_decontaminate": r"""
WITH lowered AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT item_id, least(len(w), 10) AS n, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0),
pat AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS run FROM p),
sizes AS (SELECT DISTINCT n FROM pat),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, sizes WHERE len(w) >= n),
hit AS (SELECT doc_id, item_id, dw.n, i FROM dw JOIN pat ON pat.n = dw.n AND pat.run = array_to_string(list_slice(w, i, i + dw.n - 1), ' ')),
hw AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op7_suffix_dedup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), n AS (SELECT doc_id, h, length(h) // 2 AS n FROM d),
s AS (SELECT doc_id, unnest(range(0, n - 49)) AS i, h FROM n WHERE n >= 50), w AS (SELECT doc_id, i, md5(substring(h, 2 * i + 1, 100)) AS k FROM s),
f AS (SELECT k, min(doc_id) AS least FROM w GROUP BY k HAVING min(doc_id) < max(doc_id)), g AS (SELECT doc_id, i FROM w JOIN f USING (k) WHERE doc_id > least),
e AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, true) AS new FROM g), r AS (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM e),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM r GROUP BY ALL), parts AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
kept AS (SELECT doc_id, string_agg(substring(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS tail, sum(b - a) AS n_removed, count(*) AS n_spans FROM parts JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substring(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256 FROM n LEFT JOIN kept USING (doc_id)""",
    "op9_top_k": r"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM p) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
