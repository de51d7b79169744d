"""Co-usage above a floor: all callers joined at once or prefixes and a second count, with the same pairs."""

import random

import pytest
from pyspark.sql import functions as F

from strata.functions import similarity
from strata.functions.similarity import cousage_similarity, within


def calls(spark, hub):
    rng = random.Random(3)
    rows = {(rng.randrange(30), 100 + rng.randrange(40)) for _ in range(300)}
    rows |= {(999, 100 + n) for n in range(40)} if hub else set()
    return spark.createDataFrame([(a, b, 1.0) for a, b in rows], "src long, dst long, w double")


def table(df):
    return {(r["i"], r["j"]): r["sim"] for r in df.collect()}


@pytest.mark.parametrize("hub", [False, True])
@pytest.mark.parametrize("reach", [0.95, 0.6])
@pytest.mark.parametrize("gain", [0, similarity.PREFIX_GAIN])
def test_both_routes_give_the_pairs_of_the_full_table(spark, monkeypatch, hub, reach, gain):
    edges = calls(spark, hub)
    full = table(cousage_similarity(edges).where(within(F.col("sim"), reach)))
    monkeypatch.setattr(similarity, "PREFIX_GAIN", gain)
    assert table(cousage_similarity(edges, reach=reach)) == full
    assert table(cousage_similarity(edges, reach=reach, hot_callers=3)) == full


def test_pairs_are_counted_at_once_where_prefixes_are_most_of_the_sets(spark, monkeypatch):
    joined, real = [], similarity.pairs_sharing_key
    monkeypatch.setattr(similarity, "pairs_sharing_key", lambda rows, **k: joined.append(rows.count()) or real(rows, **k))
    edges = calls(spark, hub=False)
    cousage_similarity(edges, reach=0.8)
    assert joined == [edges.count()]


def test_a_hub_stays_out_of_the_join(spark, monkeypatch):
    joined, real = [], similarity.pairs_sharing_key
    monkeypatch.setattr(similarity, "pairs_sharing_key", lambda rows, **k: joined.append(rows.count()) or real(rows, **k))
    rows = [(n // 2, n, 1.0) for n in range(200)] + [(n // 2 + 500, n, 1.0) for n in range(200)] + [(999, n, 1.0) for n in range(200)]
    edges = spark.createDataFrame(rows, "src long, dst long, w double")
    cousage_similarity(edges, reach=0.5)
    assert joined[0] < edges.count()
