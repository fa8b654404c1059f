"""The k-d tree: against plain recursion, with texts of a common start, and with groups of equal texts."""

import math

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lectern.llm import queries, sharding


def test_sources_with_a_common_start_split(spark):
    rows = [(k, f"text {k:05d} of equal size", "en", f"https://host{k % 8}.example") for k in range(1600)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    shards = {}
    for x in sharding.kd_shards(d, n_shards=8).collect():
        shards.setdefault(x.shard, []).append(x.doc_id % 8)
    assert sorted(map(len, shards.values())) == [200] * 8
    assert all(len(set(s)) == 1 for s in shards.values())  # one source each


def brute_tree(points, count, first=0):
    """Shard of each point ``(id, values, bytes)``: cut the widest dimension at the weighted median, again and again."""
    if count == 1 or not points:
        return {i: first for i, _, _ in points}
    span = [max(v[d] for _, v, _ in points) - min(v[d] for _, v, _ in points) for d in range(len(points[0][1]))]
    d = span.index(max(span))
    own = sorted(points, key=lambda p: p[1][d])
    goal, so_far, k = max(1, math.floor(sum(b for _, _, b in own) * (count // 2 / count))), 0, 0
    while so_far + own[k][2] < goal:
        so_far += own[k][2]
        k += 1
    k += goal - so_far > so_far + own[k][2] - goal
    return brute_tree(own[:k], count // 2, first) | brute_tree(own[k:], count - count // 2, first + count // 2)


@pytest.mark.parametrize("n_shards", [5, 16])
def test_tree_matches_plain_recursion(spark, n_shards):
    r = np.random.default_rng(n_shards)
    x, y = r.permutation(65536)[:700], r.permutation(65536)[:700]
    x[:2], y[:2] = (0, 65535), (0, 65535)
    alone = [k for k in range(700) if (x == x[k]).sum() == 1 and (y == y[k]).sum() == 1]  # no ties, which a hash would settle
    few = r.integers(1, 4, 700)
    rows = [(k + 1000 * c, f"{k:05d} of equal size", float(x[k]), int(y[k])) for k in alone for c in range(few[k])]
    d = spark.createDataFrame(rows, "doc_id long, text string, x double, y long")
    scaled = lambda v, of: math.floor((v - min(of)) / (max(of) - min(of)) * 65535)
    want = brute_tree([(k, (scaled(x[k], x[alone]), scaled(y[k], y[alone])), 20 * int(few[k])) for k in alone], n_shards)
    got = {q.doc_id: q.shard for q in sharding.kd_shards(d, n_shards=n_shards, dimensions=("x", "y")).collect()}
    assert got == {k + 1000 * c: want[k] for k in alone for c in range(few[k])}


@pytest.mark.parametrize("scale", ["0.01"])
def test_equal_texts_share_a_shard(spark, sf_dir, scale):
    at = sf_dir.replace("0.001", scale)
    text = {d["doc_id"]: d["text"] for d in pq.read_table(f"{at}/documents.parquet").to_pylist()}
    total, where, load = sum(len((t or "").encode()) + 1 for t in text.values()), {}, np.zeros(16)
    for x in queries.op5_kd_shards(spark, at).collect():
        where.setdefault(text[x.doc_id], []).append(x)
        load[x.shard] += x.size
    for own in where.values():
        if sum(x.size for x in own) <= total / 16:
            assert len({x.shard for x in own}) == 1
    assert load.max() <= 1.1 * load.mean() + max(len((t or "").encode()) for t in text.values())


def test_group_heavier_than_a_shard_is_split_and_nothing_else(spark):
    rows = [(k, "hot " * 20) for k in range(500)] + [(1000 + k, f"pair {k // 2} " * 8) for k in range(1000)]
    d = spark.createDataFrame([(i, t, "en", "s", 7, 1.5, "x") for i, t in rows], "doc_id long, text string, lang string, source string, size int, shard double, law string")
    got = sharding.kd_shards(d, n_shards=8).collect()
    load = np.bincount([x.shard for x in got], [x.size for x in got], 8)
    assert load.max() <= 1.1 * load.mean() and load.min() >= 0.9 * load.mean()
    pairs = {}
    for x in got:
        if x.doc_id >= 1000:
            pairs.setdefault((x.doc_id - 1000) // 2, set()).add(x.shard)
    assert all(len(s) == 1 for s in pairs.values())
    assert len({x.shard for x in got if x.doc_id < 1000}) > 1
    assert sharding.kd_shards(d.where(F.lit(False)), target_bytes=100).count() == 0
