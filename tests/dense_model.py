"""A dense NumPy model of the decomposition semantics, for brute-force checks on
small fixtures.  Written from the definitions in SURVEY section 2 (not from any
other implementation): dense matrices, scan-order DBSCAN, canonical ids."""

from __future__ import annotations

import numpy as np


def call_sim(X: np.ndarray) -> np.ndarray:
    inc = X.sum(axis=0)
    has = inc != 0
    V = np.where(has[None, :], X / np.where(has, inc, 1.0)[None, :], 0.0)
    num = V + V.T
    den = has[None, :].astype(int) + has[:, None].astype(int)
    return np.where(den > 0, num / np.maximum(den, 1), 0.0)


def cousage_sim(X: np.ndarray) -> np.ndarray:
    C = (X.T != 0).astype(int)  # row i: callers of i
    inter = C @ C.T
    n = C.sum(axis=1)
    union = n[:, None] + n[None, :] - inter
    return np.where(union > 0, inter / np.maximum(union, 1), 0.0)


def cosine_sim(F: np.ndarray) -> np.ndarray:
    norm = np.sqrt((F * F).sum(axis=1))
    U = np.where(norm[:, None] > 0, F / np.where(norm > 0, norm, 1.0)[:, None], 0.0)
    return U @ U.T


def dbscan(D: np.ndarray, eps: float, min_samples: int) -> np.ndarray:
    """Scan-order DBSCAN on a dense distance matrix; -1 = noise."""
    n = D.shape[0]
    D = np.round(D, 12)
    nb = [np.where(D[i] <= eps)[0] for i in range(n)]
    core = np.array([len(x) >= min_samples for x in nb], dtype=bool)
    labels = np.full(n, -1)
    k = 0
    for i in range(n):
        if labels[i] != -1 or not core[i]:
            continue
        labels[i] = k
        stack = [i]
        while stack:
            p = stack.pop()
            if not core[p]:
                continue
            for q in nb[p]:
                if labels[q] == -1:
                    labels[q] = k
                    if core[q]:
                        stack.append(q)
        k += 1
    return labels


def canonical(assign: np.ndarray) -> np.ndarray:
    out = np.empty_like(assign)
    for c in np.unique(assign):
        members = np.where(assign == c)[0]
        out[members] = members.min()
    return out


class Dense:
    """One analysis: kind 'call' / 'cousage' / 'terms' / 'sum'."""

    def __init__(self, kind, feats=None, support=None, children=None, weights=None, agg="mean"):
        self.kind, self.feats, self.support = kind, feats, support
        self.children, self.weights, self.agg = children, weights, agg
        if kind == "sum":
            self.support = children[0].support

    def sim(self, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sup = np.asarray(self.support)
        clusters = np.unique(seeds[sup])  # ascending cluster ids
        A = (seeds[sup][:, None] == clusters[None, :]).astype(float)
        if self.kind == "sum":
            sims = [c.sim(seeds)[1] for c in self.children]
            w = self.weights or [1.0 / len(sims)] * len(sims)
            s = sum(wi * si for wi, si in zip(w, sims))
            return clusters, np.minimum(s, 1.0)
        if self.kind in ("call", "cousage"):
            F = A.T @ self.feats[np.ix_(sup, sup)] @ A
            return clusters, (call_sim(F) if self.kind == "call" else cousage_sim(F))
        F = A.T @ self.feats[sup]
        if self.agg == "mean":
            F = F / A.sum(axis=0)[:, None]
        return clusters, cosine_sim(F)

    def step(self, seeds: np.ndarray, eps: float, min_samples: int) -> np.ndarray:
        clusters, s = self.sim(seeds)
        lab = dbscan(np.maximum(0.0, 1.0 - s), eps, min_samples)
        group = {c: (("c", lab[m]) if lab[m] != -1 else ("s", c)) for m, c in enumerate(clusters)}
        keys = [group.get(c, ("s", c)) for c in seeds]
        out = np.empty_like(seeds)
        for key in set(keys):
            mem = [i for i, kk in enumerate(keys) if kk == key]
            out[mem] = min(mem)
        return out


# Radii of the default schedule (step 0.05, maximum 0.65), written out by hand.
DEFAULT_RADII = [
    1e-10, 0.0500000001, 0.1000000001, 0.1500000001, 0.2000000001, 0.2500000001, 0.3000000001, 0.3500000001,
    0.4000000001, 0.4500000001, 0.5000000001, 0.5500000001, 0.6000000001]
DEFAULT_HYBRID_PLAN = [(stage, e) for e in DEFAULT_RADII for stage in (0, 1)]


def run(n: int, stages, plan, min_samples: int):
    seeds = np.arange(n)
    layers = [seeds.copy()]
    for k, e in plan:
        seeds = canonical(stages[k].step(seeds, e, min_samples))
        layers.append(seeds.copy())
    return layers
