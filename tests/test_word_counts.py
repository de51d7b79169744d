"""Word counts by row and TF-IDF by a broadcast vocabulary: the results of a plain count, and no shuffle of the counts."""

import math
import re
from collections import Counter

import pytest

from strata.sources import derive
from strata.sources.derive import tfidf, word_counts

TEXTS = [
    (1, "The cat, the CAT; the dog"), (2, None), (3, ""), (4, "12 \u00e9t\u00e9 x\u00e9y 3z"), (5, "\u212aelvin kelvin \u0130stanbul"),
    (6, "cat"), (7, "cat"), (8, "...;;"), (9, "a" * 70 + " " + "b " * 50), (None, "cat owl"),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)


def expected(rows):
    out = Counter()
    for key, text in rows:
        low = (text or "").lower()
        for word in re.findall("[a-z]+", low):
            out[key, word] += 1
    return out


def got(df):
    rows = [((r["idx"], r["term"]), r["n"]) for r in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("limit", [1, 30, 1 << 20])
@pytest.mark.parametrize("more", [[], [(1, "the owl"), (None, "cat"), (None, None)]])
def test_counts_are_those_of_a_plain_count(spark, monkeypatch, limit, more):
    monkeypatch.setattr(derive, "COUNT_BYTES", limit)
    assert got(word_counts(frame(spark, TEXTS + more), "doc_id", "text")) == expected(TEXTS + more)


def test_rows_with_own_keys_are_not_shuffled(spark):
    assert "Aggregate [" not in plan(word_counts(frame(spark, TEXTS), "doc_id", "text"))
    assert got(word_counts(frame(spark, []), "doc_id", "text")) == {}


@pytest.mark.parametrize("few", [0, 1000])
def test_tfidf_by_either_join(spark, few):
    counts = word_counts(frame(spark, TEXTS[:9]), "doc_id", "text").localCheckpoint()
    weighed = tfidf(counts, max_broadcast_rows=few)
    assert ("BroadcastHashJoin" in weighed._jdf.queryExecution().executedPlan().toString()) or not few
    want = expected(TEXTS[:9])
    df = Counter(term for _, term in want)
    n_docs = len({key for key, _ in want})
    for r in weighed.collect():
        idf = math.log((1 + n_docs) / (1 + df[r["term"]])) + 1
        assert abs(r["x"] - want.pop((r["idx"], r["term"])) * idf) < 1e-12
    assert not want
