"""Clustering of voice windows, one call at a time: average linkage, affinity and eigengap."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def distances(x: np.ndarray) -> np.ndarray:
    """Cosine distances, 0 to 2; 1 where a vector is next to zero."""
    n = np.linalg.norm(x, axis=1)
    ok = n >= 1e-6
    y = np.where(ok[:, None], x / np.maximum(n, 1e-6)[:, None], 0.0)
    d = np.clip(1.0 - y @ y.T, 0.0, 2.0)
    d[~ok], d[:, ~ok] = 1.0, 1.0
    np.fill_diagonal(d, 0.0)
    return d


def merges(x: np.ndarray) -> list[tuple[float, int, int]]:
    """Average-linkage merges (distance, a, b) in rising order, a and b being rows of each side.

    Chains of nearest neighbours: n squared time and space.
    """
    n = len(x)
    d = distances(x)
    np.fill_diagonal(d, np.inf)
    size, live, chain, out = np.ones(n), np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(live)[0])]
        while True:
            a = chain[-1]
            row = np.where(live, d[a], np.inf)
            b = int(np.argmin(row))
            if len(chain) > 1 and row[chain[-2]] <= row[b]:
                b = chain[-2]
                break
            chain.append(b)
        out.append((float(d[a, b]), a, b))
        chain = chain[:-2]
        new = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        d[b], d[:, b] = new, new
        d[b, b] = np.inf
        size[b] += size[a]
        live[a] = False
    return sorted(out, key=lambda m: m[0])


def clustered(x: np.ndarray, threshold: float | None = 0.5, target: int | None = None) -> list[int]:
    """Labels by first appearance, after all merges up to ``threshold``, or down to ``target`` clusters."""
    n = len(x)
    if not n:
        return []
    steps = merges(x) if n > 1 else []
    steps = steps[: max(0, n - target)] if target is not None else [m for m in steps if m[0] <= threshold]
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for _, a, b in steps:
        root[find(a)] = find(b)
    names: dict[int, int] = {}
    return [names.setdefault(find(i), len(names)) for i in range(n)]


def refined(x: np.ndarray, keep: float = 0.3) -> np.ndarray:
    """Affinity 1 - distance, each row's largest share kept, made symmetric, spread once, scaled by each row's maximum."""
    a = np.maximum(0.0, 1.0 - distances(x))
    np.fill_diagonal(a, 0.0)
    n = len(a)
    if n < 2:
        return a
    k = min(n, max(1, int(n * keep + 0.5)))
    a = np.where(a < np.sort(a, axis=1)[:, ::-1][:, k - 1][:, None], 0.0, a)
    a = np.maximum(a, a.T)
    y = a @ a
    top = y.max(1, keepdims=True)
    return np.where(top > 1e-6, y / np.maximum(top, 1e-6), y)


def eigengap(x: np.ndarray, ceiling: int = 8, keep: float = 0.3) -> int:
    """How many clusters the normalised Laplacian's spectrum has: the largest jump among its first eigenvalues."""
    n = len(x)
    if n < 2:
        return n
    a = refined(x, keep)
    a = (a + a.T) / 2
    s = 1.0 / np.sqrt(np.maximum(a.sum(1), 1e-9))
    values = np.linalg.eigvalsh(np.eye(n) - s[:, None] * a * s)
    gaps = np.diff(values[: min(ceiling, n - 1) + 1])
    return int(np.argmax(gaps)) + 1


def speaker_count(x: np.ndarray, threshold: float = 0.5, least: int = 12) -> int:
    """The smaller of the eigengap's count and the number of clusters of ``least`` windows or more."""
    large = sum(c >= least for c in np.bincount(clustered(x, threshold))) if len(x) else 0
    return max(1, min(eigengap(x), large or 1))


def by_call(rows: DataFrame, key: str, fit: Callable[..., list[int]], order: str = "id", given: str | None = None) -> DataFrame:
    """A label for each row, clustered within its call; a call's windows are the unit and bounded by its length.

    ``fit`` takes a call's vectors, and the call's value of column ``given`` if one is named.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pd.DataFrame({key: pdf[key], order: pdf[order], "cluster": fit(np.array(pdf["embedding"].tolist(), np.float64), *([pdf[given].iloc[0]] if given else []))})

    kind = dict(rows.dtypes)
    return rows.select(key, order, "embedding", *([given] if given else [])).groupBy(key).applyInPandas(run, f"{key} {kind[key]}, {order} {kind[order]}, cluster int")
