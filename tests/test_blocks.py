"""The cosine join by blocks: the pairs of brute force, and no candidate list where prefixes prune little."""

import numpy as np
import pytest

from strata.functions import prefix
from strata.functions.blocks import cosine_by_blocks
from strata.functions.prefix import cosine_at_least
from strata.functions.similarity import _mirror, normalise
from strata.operators.dbscan import dbscan_labels


def vectors(rng, n, terms, frequent):
    """Every node has most of the frequent terms and a few others; some nodes are copies."""
    x = np.where(rng.random((n, terms)) < 0.1, rng.random((n, terms)), 0.0)
    x[:, :frequent] = np.where(rng.random((n, frequent)) < 0.8, 1 + 3 * rng.random((n, frequent)), 0.0)
    x[1::7] = x[0]
    x[2] = 0.0
    return x


def frame(spark, x):
    return spark.createDataFrame([(int(i), f"t{t}", float(x[i, t])) for i, t in zip(*np.nonzero(x))],
                                 "node long, term string, x double").localCheckpoint()


def pairs(x, tau):
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    u = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    sim = u @ u.T
    return {(int(i), int(j)): sim[i, j] for i, j in zip(*np.nonzero(sim >= tau - 1e-9))}


def got(df):
    rows = [((r["i"], r["j"]), r["sim"]) for r in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


@pytest.mark.parametrize("tau", [0.55, 0.9])
@pytest.mark.parametrize("chosen", [None, [0, 3, 8, 11]])
def test_frequent_terms_list_no_candidates(spark, monkeypatch, tau, chosen):
    def refuse(*a, **k):
        raise AssertionError("the candidate join would list most pairs")

    x = vectors(np.random.default_rng(5), 60, 40, 8)
    monkeypatch.setattr(prefix, "pairs_sharing_key", refuse)
    changed = None if chosen is None else spark.createDataFrame([(n,) for n in chosen], "node long")
    out = got(cosine_at_least(frame(spark, x), tau, changed=changed, few_rows=0))
    want = {k: s for k, s in pairs(x, tau).items() if chosen is None or set(k) & set(chosen)}
    assert out.keys() == want.keys() and len(want) > 60 * (chosen is None)
    assert max(abs(out[k] - want[k]) for k in want) < 1e-9


@pytest.mark.parametrize("chosen", [None, list(range(0, 60, 2))])
def test_many_blocks_give_the_pairs_of_one(spark, chosen):
    x = vectors(np.random.default_rng(6), 60, 40, 8)
    changed = None if chosen is None else spark.createDataFrame([(n,) for n in chosen], "node long")
    unit = normalise(frame(spark, x))
    out = got(cosine_by_blocks(unit, 0.7, changed, block_nodes=9, block_entries=80))
    want = {k for k in pairs(x, 0.7) if k[0] <= k[1] and (chosen is None or set(k) & set(chosen))}
    assert out.keys() == want


def test_blocks_are_stored_once_and_not_dealt(spark):
    """Two blocks meet in a product of stored partitions; before, a copy of each vector was shuffled for each block."""
    x = vectors(np.random.default_rng(8), 60, 40, 8)
    out = cosine_by_blocks(normalise(frame(spark, x)), 0.7, block_nodes=9, block_entries=80)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan


def test_nodes_in_several_partitions_make_whole_vectors(spark):
    x = vectors(np.random.default_rng(9), 60, 40, 8)
    unit = normalise(frame(spark, x)).repartition(5, "term").localCheckpoint()
    want = pairs(x, 0.7)
    out = got(cosine_by_blocks(unit, 0.7, block_nodes=9, block_entries=80))
    assert out.keys() == {k for k in want if k[0] <= k[1]}
    assert max(abs(out[k] - want[k]) for k in out) < 1e-9


@pytest.mark.parametrize("k, size", [(2, 45), (4, 10**6)])
def test_enough_pairs_for_clusters(spark, k, size):
    rng = np.random.default_rng(10)
    x = np.abs(rng.normal(size=(2, 12)))[rng.integers(0, 2, 120)] + 0.35 * rng.random((120, 12))
    unit = normalise(frame(spark, x))
    nodes = spark.createDataFrame([(n,) for n in range(120)], "node long")
    for floor in (0.93,):
        every = _mirror(cosine_by_blocks(unit, floor - 1e-9, block_nodes=size)).localCheckpoint()
        some = _mirror(cosine_by_blocks(unit, floor - 1e-9, block_nodes=size, enough=k, reach=1 - floor)).localCheckpoint()
        assert some.exceptAll(every).count() == 0
        assert some.count() < every.count()
        of = [sorted(map(tuple, dbscan_labels(s, nodes, 1 - floor, k).collect())) for s in (every, some)]
        assert of[0] == of[1]


def test_rare_terms_stay_with_prefixes(spark):
    rows = spark.createDataFrame([(f"t{n // 2}", n) for n in range(60)], "k string, node long")
    assert not prefix.lists_most_pairs(rows, 0)
    assert not prefix.lists_most_pairs(rows.selectExpr("'t' as k", "node"), 3600)
    assert prefix.lists_most_pairs(rows.selectExpr("'t' as k", "node"), 3599)


def test_given_pairs_that_are_most_pairs_are_joined_by_term(spark, monkeypatch):
    """Each vector is shuffled once, not once per pair: the pairs' rows are summed by :func:`pairs_sharing_key`."""
    calls = []
    by_term = prefix.pairs_sharing_key
    monkeypatch.setattr(prefix, "pairs_sharing_key", lambda *a, **k: calls.append(1) or by_term(*a, **k))
    x = vectors(np.random.default_rng(7), 40, 30, 8)
    given = [(i, j) for i in range(40) for j in range(i, 40) if (i + j) % 5]
    asked = spark.createDataFrame(given, "i long, j long").localCheckpoint()
    want = {k: s for k, s in pairs(x, -1.0).items() if k in set(given) and s}
    for few, gain, n in [(0, 100.0, 1), (0, 0.0, 1), (10**9, 100.0, 1)]:
        out = got(prefix.cosine_for_pairs(frame(spark, x), asked, few_rows=few, term_gain=gain))
        assert out.keys() == want.keys() and max(abs(out[k] - want[k]) for k in want) < 1e-9
        assert len(calls) == n
