"""The whole pipeline on the smallest tables against plain statements of its stages, one document at a time."""

import base64
import hashlib
import re

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_corpus_operators import ODD, brute_score

import corpus_pipeline
from lectern.llm import decontaminate, linededup, quality, queries, simhash, topk


def repeated_lines(docs, least=50):
    """Lines of later copies: every two equal places that can't be extended backwards, extended forwards."""
    lines = [(k, n, x) for k, (_, t) in enumerate(docs) for n, x in enumerate((t or "").split("\n") if t is not None else [])]
    text = {k: (t or "").split("\n") for k, (_, t) in enumerate(docs)}
    at, gone = {}, {i: set() for i, _ in docs}
    for k, n, x in lines:
        at.setdefault(x, []).append((k, n))
    for places in at.values():
        for j, (k, n) in enumerate(places):
            for k0, n0 in places[:j]:
                if n and n0 and text[k][n - 1] == text[k0][n0 - 1]:
                    continue
                size = 0
                while n + size < len(text[k]) and n0 + size < len(text[k0]) and text[k][n + size] == text[k0][n0 + size]:
                    size += 1
                if sum(len(x.encode().split()) for x in text[k][n : n + size]) >= least:
                    gone[docs[k][0]] |= {*range(n, n + size)}
    return gone


def near_groups(docs, least=0.8):
    sets = []
    for _, t in docs:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] | sets[j])
            if not both or len(sets[i] & sets[j]) >= least * both:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(k) for k in range(len(docs))]


def holds_item(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own = words(text)
    wanted = {tuple(w[k : k + 10]) for w in map(words, items) if w for k in range(max(1, len(w) - 9))}
    return any(tuple(own[k : k + n]) in wanted for n in {len(w) for w in wanted} for k in range(len(own) - n + 1))


def test_pipeline_matches_plain_stages(spark, sf_dir):
    table = pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()
    model = quality.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet").where(~queries.held_out()))
    docs = [(d["doc_id"], d["text"]) for d in sorted(table, key=lambda d: d["doc_id"])]
    docs = [(i, t) for i, t in docs if brute_score(t, model) >= queries.GOOD]
    gone = repeated_lines(docs)
    cut = [(i, "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i])) for i, t in docs]
    docs = [(i, t) for i, t in cut if not gone[i] or t.strip(" ")]
    groups = near_groups(docs)
    docs = [d for k, d in enumerate(docs) if groups[k] == k]
    items = [b["text"] for b in pq.read_table(f"{sf_dir}/benchmark.parquet").to_pylist() if b["item_id"] is not None]
    docs = [(i, t) for i, t in docs if not holds_item(t, items)]
    with open(public_tokenizers.path(queries.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: hashlib.sha256(",".join(map(str, bpe.encode_ordinary(t))).encode()).hexdigest() for i, t in docs}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {x.doc_id: x.ids_sha256 for x in got} == want and all(x.decodes for x in got)
    assert 0 < len(want) < len(table)


def test_quality_stage_takes_odd_input(spark, sf_dir):
    rows = [(i, t, None, "s", None if t is None else len(t)) for i, t in ODD]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    name, stage = corpus_pipeline.STAGES[0]
    assert name == "quality"
    kept = stage(spark, docs, sf_dir)
    assert kept.columns == corpus_pipeline.COLUMNS and {tuple(x) for x in kept.collect()} <= {tuple(r) for r in rows}
    assert stage(spark, docs.limit(0), sf_dir).count() == 0


@pytest.mark.parametrize("text", ["word and other words " * 250_000, "\n" * 300_000, "x" * 5_000_000], ids=["words", "blank lines", "one word"])
def test_very_long_texts_pass_the_stages(spark, sf_dir, text):
    docs = spark.createDataFrame([(1, text, "en", "s", len(text)), (2, "short and plain text of a few words", "en", "s", 35)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[1:] if "x" in text[:1] else corpus_pipeline.STAGES:
        if name == "tokens" and text[:1] == "x":
            continue  # one piece of five million letters: the tokens test has one of a hundred thousand
        assert stage(spark, docs, sf_dir).count() <= 2, name


def test_names_that_clash(spark):
    """Operators read the columns that they are told to, whatever else is there."""
    d = spark.createDataFrame([(1, "alpha beta gamma delta", "a", 3, 1.0), (2, "alpha beta gamma delta", "b", 4, 2.0), (3, "other words here", "c", 5, 3.0)], "doc_id long, text string, fp string, component_id int, id double")
    d = d.withColumn("tie", F.lit(0)).withColumn("least", F.lit("z")).withColumn("first", F.lit("y")).withColumn("n_words", F.lit(9)).withColumn("removed_runs", F.lit("q")).withColumn("score", F.lit("s")).withColumn("_runs", F.lit(1)).withColumn("doc", F.lit(2))
    assert {x.doc_id: x.component_id for x in simhash.groups(d).collect()} == {1: 1, 2: 1, 3: 3}
    assert {x.doc_id: x["first"].doc_id for x in simhash.near_copies(d).collect()} == {1: 1, 2: 1, 3: 3}
    lines = linededup.remove_repeats(d)
    assert lines.count() == 3 and lines.columns == [*[c for c in d.columns if c != "removed_runs"], "n_lines", "removed_lines", "removed_runs"]
    items = spark.createDataFrame([(1, "other words")], "item_id long, text string")
    assert {x.doc_id: x["items"] for x in decontaminate.find(d, items).collect()} == {1: [], 2: [], 3: ["1"]}
    e = spark.createDataFrame([(50, [1.0], "v", 0.1), (1, [2.0], "w", 0.2)], "vec_id long, embedding array<double>, v string, norm2 double")
    assert [tuple(x) for x in topk.top_k(e, F.col("vec_id") % 50 == 0).collect()] == [(50, 1, 1, 131072)]
