"""Corpus preparation: five stages, each one of the operators in ``lectern.llm``.

    quality      line-field scores; documents under the threshold go
    lines        later copies of repeated line runs go; a document left empty by that goes too
    near_copies  texts whose sets of five-word shingles are similar by 0.8 or more, found by SimHash; the first of each group stays
    benchmark    documents that hold a passage of the benchmark go
    tokens       byte-level BPE ids of what is left, decoded again as a check

A stage takes all that the one before kept, as a Parquet table, and returns the
columns of ``documents`` (the last one: ids).  Rows with a null id are kept by
the stages that compare documents, for they have no place in their order.  A
document is an id and a text: of rows that repeat both, ``near_copies`` keeps
one; texts that share an id are told apart, in the order of their hash.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontaminate, linededup, quality, simhash, tokens
from lectern.llm.common import discard, materialise, table
from lectern.llm.queries import GOOD, RANKS, held_out

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words of a shingle, and the similarity of two sets of them from which texts are near copies.
SHINGLE, SIMILAR = 5, 0.8


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return quality.score(docs.select(COLUMNS), model, lines=False).where(F.col("score") >= GOOD).select(COLUMNS)


def unrepeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = linededup.remove_repeats(docs.select(COLUMNS))
    left = done.where((F.size("removed_lines") == 0) | (F.trim("text") != ""))
    return left.withColumn("n_chars", F.when(F.size("removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = materialise(simhash.near_copies(docs.select(COLUMNS), similarity=SIMILAR, width=SHINGLE), "near")
    key = ["doc_id", "tie"]
    gone = found.where("doc_id <> first.doc_id OR tie <> first.tie").select(key).distinct()
    left = docs.select(COLUMNS).withColumn("tie", F.xxhash64("text")).join(gone, key, "left_anti")
    twice = materialise(found.groupBy(key).count().where("count > 1").select(key), "twice")
    if not twice.isEmpty():
        left = left.join(twice, key, "left_anti").unionByName(left.join(twice, key, "left_semi").dropDuplicates(key))
    return left.select(COLUMNS)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.find(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.where(F.size("items") == 0).select(COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = tokens.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path(RANKS), decoded="decoded", pattern=public_tokenizers.PATTERN)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return done.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), "ids", same.alias("decodes"))


STAGES = [("quality", good_documents), ("lines", unrepeated_lines), ("near_copies", one_of_near_copies), ("benchmark", uncontaminated), ("tokens", token_ids)]

#: A line field, prefix programmes and bit distances of hashes have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
