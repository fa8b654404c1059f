"""Connected components of an edge table, by alternating star operations; nothing is gathered on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import discard, materialise


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each of ``n`` nodes' component, for edges between positions ``a`` and ``b``."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            break
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label != label[label]).any():
            label = label[label]
    return label


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for every node of the edges ``(a, b)``.

    Large star: each node's larger neighbours are tied to its smallest one.  Small
    star: its smaller neighbours are.  Minima are pre-aggregated before the
    shuffle; a node with very many neighbours is one skewed join key, which
    adaptive execution splits.  Rounds grow with the logarithm of the longest
    path, and end when every edge leads from a root to a leaf that has no other;
    if they don't come to that within ``rounds``, an error is raised.

    The result is a table of ``materialise``.
    """
    now = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    for _ in range(rounds):
        below = now.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("n"))
        if below.where("n > 1").isEmpty() and now.join(now.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
            break
        both = now.union(now.select("b", "a")).toDF("u", "v")
        # minima are written first: beside an aggregate, a skewed join could not be split
        low = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        # now every edge leads to a smaller node: its smaller neighbours and itself go to the smallest of them
        large = materialise(large, "large")
        least = materialise(large.groupBy("b").agg(F.min("a").alias("m")), "least")
        small = large.join(least, "b").select("m", F.explode(F.array("a", "b")).alias("v"))
        before, now = now, materialise(small.where("m <> v").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct(), "edges")
        discard(before, low, large, least)
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    out = materialise(now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select(F.col("a"), F.col("a")).distinct()), "roots")
    discard(now)
    return out
