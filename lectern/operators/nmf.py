"""Non-negative matrix factorisation over sparse rows.

Documents' weights stay distributed as arrays of (term, value); the components
(topics x vocabulary) are the only shared state, and their size is fixed by
``max_features``.  A sweep is one job: each partition solves its rows of W by
coordinate descent against H, and returns its share of the small sums W'W and
W'X; the driver then updates H by coordinate descent on these sums.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Topics x terms that the driver and each task hold; beyond it, fewer features have to be chosen.
MOST_COMPONENTS = 1 << 25


@dataclass
class Factorisation:
    terms: list[str]
    h: np.ndarray
    errors: list[float] = field(default_factory=list)
    n_iter: int = 0
    converged: bool = False


def rows_of(weights: DataFrame, vocab: DataFrame, key: str = "doc_id") -> tuple[DataFrame, list[str]]:
    """Sparse rows ``key, idx, val`` and the terms in the order of their index."""
    terms = [r.term for r in vocab.select("term").orderBy("term").collect()]  # max_features terms
    index = vocab.sparkSession.createDataFrame([(t, i) for i, t in enumerate(terms)], "term string, i int")
    pairs = weights.join(F.broadcast(index), "term").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", F.col("w").alias("v")))).alias("p"))
    return pairs.select(key, F.transform("p", lambda x: x["i"]).alias("idx"), F.transform("p", lambda x: x["v"]).alias("val")), terms


def solve_rows(idx: list[np.ndarray], val: list[np.ndarray], h: np.ndarray, gram: np.ndarray, sweeps: int = 30) -> tuple[np.ndarray, ...]:
    """Non-negative least squares of rows by coordinate descent; also their products with the components, and each entry's row, term and value."""
    row = np.repeat(np.arange(len(idx)), [len(x) for x in idx])
    i, v = np.concatenate(idx), np.concatenate(val).astype(float)
    goal = np.stack([np.bincount(row, weights=t[i] * v, minlength=len(idx)) for t in h], 1)
    w = np.repeat(goal.sum(1, keepdims=True) / max(gram.sum(), 1e-12), len(gram), 1)
    for _ in range(sweeps):
        moved = 0.0
        for k in range(len(gram)):
            if gram[k, k] > 0:
                new = np.maximum(0.0, w[:, k] + (goal[:, k] - w @ gram[k]) / gram[k, k])
                moved, w[:, k] = max(moved, np.abs(new - w[:, k]).max()), new
        if moved < 1e-9:
            break
    return w, goal, row, i, v


def _column_sums(rows: DataFrame, of, n: int) -> np.ndarray:
    """Sums over all rows of the arrays (columns x n) that ``of`` makes of a batch; added up by column on the executors."""

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for part in parts:
            if len(part):
                own = of(part["idx"].to_list(), part["val"].to_list())
                total = own if total is None else total + own
        if total is not None:
            yield pd.DataFrame({"c": np.arange(len(total)), "x": list(total)})

    def add(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"c": part["c"].iloc[:1], "x": [np.sum(np.stack(part["x"].to_list()), 0)]})

    sums = rows.select("idx", "val").mapInPandas(partial, "c int, x array<double>").groupBy("c").applyInPandas(add, "c int, x array<double>")
    got = sums.orderBy("c").collect()  # as many rows as columns
    return np.array([r.x for r in got]) if got else np.zeros((0, n))


def _projected(idx: list, val: list, q: np.ndarray) -> tuple[np.ndarray, ...]:
    """A batch's rows times the columns of ``q``, and each entry's row, term and value."""
    row = np.repeat(np.arange(len(idx)), [len(x) for x in idx])
    i, v = np.concatenate(idx), np.concatenate(val).astype(float)
    return np.stack([np.bincount(row, weights=t[i] * v, minlength=len(idx)) for t in q.T], 1), row, i, v


def singular_start(rows: DataFrame, terms: list[str], k: int, extra: int = 6, passes: int = 8, seed: int = 42) -> np.ndarray:
    """First components from the leading singular vectors, their larger-signed halves, zeros filled with the mean (NNDSVDa).

    Subspace iteration: a pass is one job that multiplies (terms x columns) numbers
    by the rows' cross products; ``extra`` columns and some passes make the leading
    ones exact enough for a start.
    """
    n = len(terms)
    p = min(n, k + extra)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, p)))[0]
    for _ in range(passes):
        def cross(idx: list, val: list, q: np.ndarray = q) -> np.ndarray:
            y, row, i, v = _projected(idx, val, q)
            return np.stack([np.bincount(i, weights=y[row, c] * v, minlength=n) for c in range(p)])

        z = _column_sums(rows, cross, n)
        if not len(z):
            return np.zeros((k, n))
        small = q.T @ z.T  # p x p: the cross products within the subspace
        value, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-value)
        leading, squares = (q @ turn[:, order]), np.maximum(value[order], 0)
        q = np.linalg.qr(z.T)[0]
    v, s = leading[:, :k], np.sqrt(squares[:k])

    def halves(idx: list, val: list) -> np.ndarray:
        u = _projected(idx, val, v)[0]
        return np.stack([(np.maximum(u, 0) ** 2).sum(0), (np.minimum(u, 0) ** 2).sum(0), np.full(v.shape[1], sum(float(np.sum(x)) for x in val) / v.shape[1]), np.full(v.shape[1], len(idx) / v.shape[1])])

    plus, minus, total, count = _column_sums(rows, halves, v.shape[1])
    h = np.zeros((k, n))
    for c in range(v.shape[1]):
        if s[c] <= 1e-12:
            continue
        sides = [(np.sqrt(plus[c]) / s[c], np.maximum(v[:, c], 0)), (np.sqrt(minus[c]) / s[c], np.maximum(-v[:, c], 0))]
        if c == 0:
            h[0] = np.sqrt(s[0]) * np.abs(v[:, 0])  # the first singular vectors have one sign
            continue
        weight, part = max(sides, key=lambda x: x[0] * np.linalg.norm(x[1]))
        h[c] = np.sqrt(s[c] * weight * np.linalg.norm(part)) * part / max(np.linalg.norm(part), 1e-12)
    h[h < 1e-6] = 0
    h[h == 0] = total.sum() / max(1.0, count.sum() * n)
    return h


def fit(rows: DataFrame, terms: list[str], k: int, most_iter: int = 100, tol: float = 1e-4, seed: int = 42, start: str = "singular") -> Factorisation:
    """Factorise; errors never rise, and the fit has converged when one falls by less than ``tol`` of the first.

    It starts from singular vectors, or with ``start='random'`` from seeded numbers.
    """
    n = len(terms)
    if k * n > MOST_COMPONENTS:
        raise ValueError("topics x vocabulary is beyond what the driver holds; choose fewer features")
    if start == "singular":
        out = Factorisation(terms, singular_start(rows, terms, k, seed=seed))
    else:
        mean = rows.select(F.avg(F.aggregate("val", F.lit(0.0), lambda a, x: a + x))).first()[0] or 0.0
        out = Factorisation(terms, np.random.default_rng(seed).random((k, n)) * np.sqrt(max(mean, 1e-12) / max(n, 1)))
    for step in range(most_iter):
        h = out.h
        gram = h @ h.T

        def sweep(parts: Iterator[pd.DataFrame], h: np.ndarray = h, gram: np.ndarray = gram) -> Iterator[pd.DataFrame]:
            ww, wx, error = np.zeros((k, k)), np.zeros((k, n)), 0.0
            for part in parts:
                if len(part):
                    w, goal, row, i, v = solve_rows(part["idx"].to_list(), part["val"].to_list(), h, gram)
                    ww += w.T @ w
                    for t in range(k):
                        wx[t] += np.bincount(i, weights=w[row, t] * v, minlength=n)
                    error += v @ v - 2 * (w * goal).sum() + ((w @ gram) * w).sum()
            for t in range(k):
                yield pd.DataFrame({"topic": [t], "ww": [ww[t]], "wx": [wx[t]], "error": [error if t == 0 else 0.0]})

        # partial sums of topics x (topics + terms) numbers, added up by topic on the executors
        sums = rows.select("idx", "val").mapInPandas(sweep, "topic int, ww array<double>, wx array<double>, error double")

        def add(part: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"topic": part["topic"].iloc[:1], "ww": [np.sum(np.stack(part["ww"].to_list()), 0)], "wx": [np.sum(np.stack(part["wx"].to_list()), 0)], "error": [part["error"].sum()]})

        got = sums.groupBy("topic").applyInPandas(add, "topic int, ww array<double>, wx array<double>, error double").orderBy("topic").collect()
        ww, wx, error = np.array([r.ww for r in got]), np.array([r.wx for r in got]), sum(r.error for r in got)
        out.errors.append(float(np.sqrt(max(error, 0.0))))
        out.n_iter = step + 1
        if step and out.errors[-2] - out.errors[-1] <= tol * out.errors[0]:
            out.converged = True
            break
        h = h.copy()
        for _ in range(10):
            for t in range(k):
                if ww[t, t] > 0:
                    h[t] = np.maximum(0.0, h[t] + (wx[t] - ww[t] @ h) / ww[t, t])
        out.h = h
    return out


def transform(rows: DataFrame, model: Factorisation, key: str = "doc_id") -> DataFrame:
    """``key`` and ``w``, each row's weights for fixed components."""
    h, gram = model.h, model.h @ model.h.T

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                yield pd.DataFrame({key: part[key], "w": list(solve_rows(part["idx"].to_list(), part["val"].to_list(), h, gram, sweeps=200)[0])})

    return rows.mapInPandas(solve, f"{key} {dict(rows.dtypes)[key]}, w array<double>")


def components(spark, model: Factorisation) -> DataFrame:
    """``topic, term, weight`` of all components that are not zero."""
    t, i = np.nonzero(model.h)
    return spark.createDataFrame(pd.DataFrame({"topic": t.astype(np.int64), "term": [model.terms[x] for x in i], "weight": model.h[t, i]}), "topic long, term string, weight double")


def grid(rows: DataFrame, terms: list[str], ks: list[int], **kwargs) -> tuple[dict[int, Factorisation], DataFrame]:
    """A model for each number of topics, and the record of the runs: ``k``, ``n_iter``, ``converged``, ``error`` and ``seconds``."""
    models, record = {}, []
    for k in ks:
        began = time.monotonic()
        models[k] = fit(rows, terms, k, **kwargs)
        m = metrics(models[k])
        record.append((k, m["n_iter"], m["converged"], float(m["error"]), time.monotonic() - began))
    return models, rows.sparkSession.createDataFrame(record, "k int, n_iter int, converged boolean, error double, seconds double")


def prevalence(weights: DataFrame) -> DataFrame:
    """``topic`` and ``prevalence``, the mean share of each topic over rows that have any weight."""
    total = F.aggregate("w", F.lit(0.0), lambda a, x: a + x)
    own = weights.where(total > 0).select(F.posexplode(F.transform("w", lambda x: x / total)).alias("topic", "share"))
    return own.groupBy("topic").agg(F.avg("share").alias("prevalence"))


def prevalence_differences(one: DataFrame, two: DataFrame, threshold: float = 0.01) -> DataFrame:
    """Both prevalences of each topic, their difference, and whether it is within the threshold."""
    both = one.select("topic", F.col("prevalence").alias("first")).join(two.select("topic", F.col("prevalence").alias("second")), "topic", "full_outer")
    d = F.abs(F.coalesce("first", F.lit(0.0)) - F.coalesce("second", F.lit(0.0)))
    return both.withColumn("difference", d).withColumn("within", d <= threshold)


def metrics(model: Factorisation) -> dict[str, float | int | bool]:
    return {"k": len(model.h), "n_iter": model.n_iter, "converged": model.converged, "error": model.errors[-1] if model.errors else 0.0}
