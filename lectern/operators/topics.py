"""TF-IDF and measures of topics, as relations ``(doc, term, n)`` and ``(topic, term, weight)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ngrams(tokens: Column, most: int = 2) -> Column:
    """Single tokens and, with ``most`` 2, neighbouring pairs; stop words are taken out before."""
    if most == 1:
        return tokens
    pairs = F.transform(F.sequence(F.lit(1), F.size(tokens) - 1), lambda i: F.concat_ws(" ", F.element_at(tokens, i), F.element_at(tokens, i + 1)))
    return F.concat(tokens, F.when(F.size(tokens) > 1, pairs).otherwise(F.array().cast("array<string>")))


def term_counts(docs: DataFrame, tokens: Column, key: str = "doc_id", most: int = 2, vocab: DataFrame | None = None) -> DataFrame:
    """``key``, ``term`` and ``n``; with ``vocab``, of its terms alone, so that others never reach the shuffle."""
    kept = docs.select(key, tokens.alias("_t"))  # a projection of its own, so that tokens are made once
    each = kept.select(key, F.explode(ngrams(F.col("_t"), most)).alias("term"))
    if vocab is not None:
        each = each.join(F.broadcast(vocab.select("term")), "term", "left_semi")  # max_features terms
    return each.groupBy(key, "term").agg(F.count("*").alias("n"))


def term_totals(docs: DataFrame, tokens: Column, most: int = 2) -> DataFrame:
    """``term``, ``df`` and ``tf`` of all terms: rows of both counts are added up before the shuffle."""
    mark = lambda d, n: lambda t: F.struct(t.alias("term"), F.lit(d).alias("df"), F.lit(n).alias("tf"))
    kept = docs.select(tokens.alias("_t")).select(ngrams(F.col("_t"), most).alias("_g"))
    each = kept.select(F.explode(F.concat(F.transform("_g", mark(0, 1)), F.transform(F.array_distinct("_g"), mark(1, 0)))).alias("t"))
    return each.groupBy("t.term").agg(F.sum("t.df").alias("df"), F.sum("t.tf").alias("tf"))


def vocabulary(totals: DataFrame, documents: int, min_df: int, max_df: float, max_features: int) -> DataFrame:
    """Terms within the document-frequency bounds, the most frequent ones first; ties in the order of terms."""
    bounded = totals.where((F.col("df") >= min_df) & (F.col("df") <= max_df * documents))
    # orderBy + limit keeps max_features rows at each step, however many terms there are
    return bounded.orderBy(F.desc("tf"), "term").limit(max_features)


def tfidf(counts: DataFrame, vocab: DataFrame, documents: int, key: str = "doc_id") -> DataFrame:
    """Sublinear term frequency times smoothed inverse document frequency, rows of length one."""
    idf = F.ln((1 + F.lit(float(documents))) / (1 + F.col("df"))) + 1
    # the vocabulary has max_features rows; a document's terms meet once, for its length
    raw = counts.join(F.broadcast(vocab.select("term", "df")), "term").withColumn("x", (1 + F.ln(F.col("n").cast("double"))) * idf)
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy(key)))
    return raw.select(key, "term", "n", "df", (F.col("x") / norm).alias("w"))


def zero_vectors(docs: DataFrame, weights: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.join(weights.select(key).distinct(), key, "left_anti")


def zero_policy(zeros: Column, documents: Column, most: int = 100, share: float = 0.001) -> Column:
    """Whether so many zero rows may be left out."""
    return (zeros <= most) & (zeros <= share * documents)


def top_terms(components: DataFrame, n: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("topic").orderBy(F.desc("weight"), "term"))
    return components.withColumn("rank", rank.cast("long")).where(F.col("rank") <= n)


def diversity(top: DataFrame) -> DataFrame:
    return top.agg(F.round(F.count_distinct("term") / F.count("*"), 6).alias("diversity"))


def exclusivity(components: DataFrame, n: int) -> DataFrame:
    """Mean share of a topic in all topics' weight of its top terms."""
    share = components.withColumn("all", F.sum("weight").over(W.partitionBy("term")))
    top = top_terms(share, n)
    return top.groupBy("topic").agg(F.round(F.avg(F.when(F.col("all") > 0, F.col("weight") / F.col("all")).otherwise(0.0)), 6).alias("exclusivity"))


def redundancy(components: DataFrame) -> DataFrame:
    """Cosine of every two topics' term weights."""
    length = components.groupBy("topic").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("l"))
    unit = components.join(F.broadcast(length), "topic").select("topic", "term", (F.col("weight") / F.col("l")).alias("u"))  # one row a topic
    a, b = unit.toDF("topic_a", "term", "ua"), unit.toDF("topic_b", "term", "ub")
    dots = a.join(b, "term").where("topic_a < topic_b").groupBy("topic_a", "topic_b").agg(F.sum(F.col("ua") * F.col("ub")).alias("dot"))
    t = components.select("topic").distinct()
    pairs = t.toDF("topic_a").join(t.toDF("topic_b"), F.col("topic_a") < F.col("topic_b"))
    return pairs.join(dots, ["topic_a", "topic_b"], "left").select("topic_a", "topic_b", F.round(F.coalesce("dot", F.lit(0.0)), 6).alias("cosine"))


def npmi(co: Column, left: Column, right: Column, documents: Column) -> Column:
    """Normalised pointwise mutual information from document counts; -1 without co-occurrence."""
    p = co / documents
    value = F.ln(p / (left / documents * right / documents)) / -F.ln(p)
    bounded = F.least(F.greatest(value, F.lit(-1.0)), F.lit(1.0))
    everywhere = F.when((left == documents) & (right == documents), 1.0).otherwise(0.0)
    return F.when(co == 0, -1.0).when(co == documents, everywhere).otherwise(bounded)


def pair_counts(counts: DataFrame, top: DataFrame, documents: int, key: str = "doc_id") -> DataFrame:
    """Document counts of every two top terms of a topic; only rows of top terms are joined."""
    words = top.select("term").distinct()
    seen = counts.join(F.broadcast(words), "term").select(key, "term")  # topics x n terms
    df = seen.groupBy("term").agg(F.count("*").alias("df"))
    a, b = top.select("topic", F.col("term").alias("a"), F.col("rank").alias("ra")), top.select("topic", F.col("term").alias("b"), F.col("rank").alias("rb"))
    pairs = a.join(b, "topic").where("ra < rb").select("topic", "a", "b")
    both = seen.toDF(key, "a").join(seen.toDF(key, "b"), key).where("a <> b").join(F.broadcast(pairs.select("a", "b").distinct()), ["a", "b"]).groupBy("a", "b").agg(F.count("*").alias("co"))
    out = pairs.join(both, ["a", "b"], "left").join(df.toDF("a", "df_a"), "a", "left").join(df.toDF("b", "df_b"), "b", "left")
    return out.select("topic", "a", "b", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("co", "df_a", "df_b")], F.lit(documents).alias("documents"))


def coherence(pairs: DataFrame, skip_zero: bool = False) -> DataFrame:
    """Mean NPMI of a topic's pairs; the benchmark's variant skips pairs that never meet."""
    value = npmi(F.col("co"), F.col("df_a"), F.col("df_b"), F.col("documents"))
    own = pairs.where("co > 0") if skip_zero else pairs
    return own.groupBy("topic").agg(F.round(F.avg(value), 6).alias("npmi"), F.count("*").alias("pairs"))


def set_exclusivity(top: DataFrame) -> DataFrame:
    """Mean of 1 / number of topics that list the term."""
    lists = top.groupBy("term").agg(F.count("*").alias("k"))
    return top.join(lists, "term").groupBy("topic").agg(F.round(F.avg(1 / F.col("k")), 6).alias("set_exclusivity"))


def set_redundancy(top: DataFrame) -> DataFrame:
    """Shared terms of two topics against the shorter list."""
    size = top.groupBy("topic").agg(F.count("*").alias("n"))
    common = top.select(F.col("topic").alias("topic_a"), "term").join(top.select(F.col("topic").alias("topic_b"), "term"), "term").where("topic_a < topic_b").groupBy("topic_a", "topic_b").agg(F.count("*").alias("shared"))
    out = common.join(F.broadcast(size.toDF("topic_a", "na")), "topic_a").join(F.broadcast(size.toDF("topic_b", "nb")), "topic_b")
    return out.select("topic_a", "topic_b", F.round(F.col("shared") / F.least("na", "nb"), 6).alias("overlap"))


def choose_configuration(outliers: Column, fallback_outliers: Column, limit: float = 0.45, gain: float = 0.05) -> Column:
    """``fallback`` only if the first run leaves too many outliers and the second has fewer by the gain."""
    return F.when((outliers > limit) & (outliers - fallback_outliers >= gain), "fallback").otherwise("primary")
