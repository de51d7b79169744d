"""Operators over whole tables against brute force: duplicates, search, mixing, revisits, lines, perplexity, pipeline."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strata.llm import prob_minhash
from strata.llm.inverted_multi_index import nearest_cells, search
from strata.llm.kneser_ney import from_steps, pack, perplexity_filter, score_documents, steps, unpack
from strata.llm.line_dedup import SKETCH, _shared_parts, _sketched, drop_repeated_lines, repeated_lines
from strata.llm.mixing import mix_documents, source_targets, word_sizes
from strata.llm.prob_minhash import (
    keep_one_per_class, near_duplicate_classes, probability_jaccard, shingle_sketches, signatures)
from strata.llm.warc_revisits import canonical_url, resolve_revisits

# --- near duplicates -------------------------------------------------------------------------


def shingles(text, size=5):
    w = [x for x in (text or "").replace("\x0b", " ").replace("\x0c", " ").split() if x]
    return Counter(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else Counter()


def plain_jp(x, y):
    every = x.keys() | y.keys()
    return sum(1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in every) for d in x.keys() & y.keys())


class Union:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def plain_classes(texts, threshold=0.8):
    prof, sets, where = {k: shingles(t) for k, t in texts.items()}, Union(texts), defaultdict(list)
    for k, p in prof.items():
        for s in p:
            where[s].append(k)
    pairs = {(a, b) for own in where.values() for a in own for b in own if a < b}
    for a, b in pairs:
        if plain_jp(prof[a], prof[b]) >= threshold - 1e-12:
            sets.join(a, b)
    return {k: sets.find(k) for k in texts}


def variants(seed=3):
    """Groups of near copies around a base, chains, passages shared by unlike texts, repeated shingles."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(5))
    texts, passage = [], [word() for _ in range(60)]
    for _ in range(4):
        base = [word() for _ in range(120)]
        for _ in range(9):
            copy = list(base)
            for _ in range(r.randrange(0, 5)):
                copy[r.randrange(len(copy))] = word()
            texts.append(copy)
    chain = [word() for _ in range(100)]
    for _ in range(8):  # each like the one before, the ends unlike each other
        chain = list(chain)
        chain[r.randrange(len(chain))] = word()
        texts.append(chain)
    texts += [passage + [word() for _ in range(r.randrange(5, 60))] for _ in range(40)]
    texts += [["same", "few", "words", "again", "and"] * n + [word()] for n in (3, 3, 4, 5, 8)]
    texts += [["a", "b"], ["a", "b"], ["a", "c"], [], []]
    r.shuffle(texts)
    return {i: " ".join(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("bands", [24, 2])  # with two bands most links come from the exact step
def test_classes_equal_brute_force(spark, bands):
    texts = variants()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_duplicate_classes(df, bands=bands).collect()}
    want = plain_classes(texts)
    if bands == 24:
        assert got == want
    else:  # only pairs that never share a bucket may be missing, and nothing is joined wrongly
        assert all(want[k] == want[c] for k, c in got.items())


def test_classes_of_given_documents(documents, document_rows):
    got = {r["doc_id"]: r["class_id"] for r in near_duplicate_classes(documents).collect()}
    assert got == plain_classes({r["doc_id"]: r["text"] for r in document_rows})


def test_shingle_sketches_never_count_too_many(spark):
    texts = {k: t for k, t in variants().items() if t}
    texts[10_001], texts[10_002] = "a b c d e f g a b c d e f", "one two"
    rows = spark.createDataFrame(list(texts.items()), "key long, text string")
    got = {r["node"]: r for r in shingle_sketches(rows, 5).collect()}
    sets = {k: shingles(t) for k, t in texts.items()}
    assert set(got) == {k for k, p in sets.items() if max(p.values(), default=1) == 1}
    assert 10_001 not in got and got[10_002]["total"] == 1
    words = [f"s{k}" for k in range(prob_minhash.SKETCH)]
    apart = lambda x, y: sum(bin((got[x][w] ^ got[y][w]) & (2**64 - 1)).count("1") for w in words)
    keys = sorted(got)
    for x in keys:
        assert got[x]["total"] == len(sets[x])
        assert all(apart(x, y) <= len(sets[x].keys() ^ sets[y].keys()) for y in keys[:60])


def test_components_are_joined_by_one_pair_first(spark):
    """Two large components with many links between them: their nodes are not all paired."""
    n = 30
    some = [(i, 1, 0.0, 1e9, None, *([None] * prob_minhash.SKETCH)) for i in range(2 * n)]
    schema = "node long, shingle long, least double, cap double, total long, " + ", ".join(
        f"s{k} long" for k in range(prob_minhash.SKETCH))
    prefix = spark.createDataFrame(some, schema)
    labels = spark.createDataFrame([(i, 0 if i < n else n) for i in range(2 * n)], "node long, label long")
    first = prob_minhash._contested_pairs(prefix, labels, 0.8, one_each=True).collect()
    assert [tuple(r) for r in first] == [(0, n)]
    joined = spark.createDataFrame([(i, 0) for i in range(2 * n)], "node long, label long")
    assert prob_minhash._contested_pairs(prefix, joined, 0.8, one_each=False).count() == 0
    every = prob_minhash._contested_pairs(prefix, labels, 0.8, one_each=False)
    assert every.count() == n * n


def test_a_group_of_copies_meets_two_hubs(spark):
    """Copies that meet under many shingles: pairs linear in the nodes, not all of them."""
    n = 40
    some = [(i, k, 0.0, 1e9, None, *([None] * prob_minhash.SKETCH)) for i in range(n) for k in range(6)]
    schema = "node long, shingle long, least double, cap double, total long, " + ", ".join(
        f"s{k} long" for k in range(prob_minhash.SKETCH))
    prefix = spark.createDataFrame(some, schema)
    labels = spark.createDataFrame([(i, i) for i in range(n)], "node long, label long")
    pairs = {tuple(r) for r in prob_minhash._hub_pairs(prefix, labels, 0.8).collect()}
    assert n - 1 <= len(pairs) <= 2 * n and all(a > b for a, b in pairs)
    assert len({x for p in pairs for x in p}) == n
    one = spark.createDataFrame([(i, 0) for i in range(n)], "node long, label long")
    assert prob_minhash._hub_pairs(prefix, one, 0.8).count() == 0


def test_a_small_edge_list_is_read_in_few_partitions(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = spark.createDataFrame([(i, i + 1) for i in range(30)], "a long, b long")
        labels = spark.createDataFrame([(i, i) for i in range(32)], "node long, label long")
        got = prob_minhash._labelled(labels, edges)
        assert got.rdd.getNumPartitions() == 1
        assert {tuple(r) for r in got.collect()} == {(i, 0) for i in range(31)} | {(31, 31)}
        # components that are known already are one node each
        more = prob_minhash._labelled(got, spark.createDataFrame([(31, 5), (7, 3)], "a long, b long"))
        assert {tuple(r) for r in more.collect()} == {(i, 0) for i in range(32)}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_signature_estimates_similarity():
    r = np.random.default_rng(0)
    a, b = r.integers(1, 1 << 62, 60).astype(np.uint64), r.integers(1, 1 << 62, 60).astype(np.uint64)
    b[:40] = a[:40]
    a, b = np.sort(a), np.sort(b)
    wa, wb = r.integers(1, 5, 60), r.integers(1, 5, 60)
    text = np.repeat([0, 1], 60)
    reg = signatures(text, np.concatenate([a, b]), np.concatenate([wa, wb]), 2, 4096)
    exact = probability_jaccard(a, wa, b, wb)
    x, y = Counter(dict(zip(a.tolist(), wa.tolist()))), Counter(dict(zip(b.tolist(), wb.tolist())))
    assert exact == pytest.approx(plain_jp(x, y))
    assert (reg[0] == reg[1]).mean() == pytest.approx(exact, abs=0.03)


def test_near_duplicates_odd_tables(odd, nothing):
    got = {r["doc_id"]: r["class_id"] for r in near_duplicate_classes(odd).collect()}
    assert set(got) == set(range(1, 10))  # a null key takes no part
    assert got[1] == 1 and got[2] == 2 and got[3] == 3 and got[6] == 5 and got[5] == 5
    left = keep_one_per_class(odd)
    assert left.columns == odd.columns
    assert sorted((r["doc_id"] or 0) for r in left.collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 8, 9]
    assert near_duplicate_classes(nothing).count() == 0 and keep_one_per_class(nothing).count() == 0


# --- search ----------------------------------------------------------------------------------


def plain_search(rows, queries, k=20):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=float)
    out = {}
    for q in queries:
        s = (x * x[ids == q][0]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), s[j]) for j in order]
    return out


def test_search_recall_and_scores(spark, small_dir):
    vectors = spark.read.parquet(f"{small_dir}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    queries = vectors.where("vec_id % 20 = 0")
    got = defaultdict(dict)
    # small enough for the default to visit everything, so ask for a share
    for r in search(vectors, queries, share=0.65, least=0, block_vectors=64, block_queries=8).collect():
        got[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    want = plain_search(rows, [i for i, _ in rows if i % 20 == 0])
    hits = 0
    for q, best in want.items():
        assert sorted(got[q]) == list(range(1, 21))
        hits += len({i for i, _ in best} & {i for i, _ in got[q].values()})
        vec = dict(rows)
        for i, s in got[q].values():
            assert s == pytest.approx(float(np.dot(np.array(vec[q], float), np.array(vec[i], float))), abs=1e-12)
    assert hits / (20 * len(want)) >= 0.9
    exact = defaultdict(list)
    for r in search(vectors, queries, share=1.0).orderBy("query_id", "rank").collect():
        exact[r["query_id"]].append(r["vec_id"])
    assert exact == {q: [i for i, _ in best] for q, best in want.items()}


def test_search_copies_and_odd_vectors(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=5).tolist()) for i in range(60)]
    rows += [(i, rows[3][1]) for i in range(100, 160)]  # one frequent vector
    bad = [(200, None), (201, []), (202, [0.0] * 5), (203, [1.0, None, 1.0, 1.0, 1.0]), (204, [float("nan")] * 5),
           (205, [float("inf")] * 5), (206, [1.0, 2.0]), (None, [1.0] * 5), (0, rows[0][1])]
    schema = "vec_id long, embedding array<double>, v int, class string, rank int"
    df = spark.createDataFrame([(a, b, 1, "c", 2) for a, b in rows + bad], schema)
    want = plain_search(rows, [i for i, _ in rows if i % 20 == 0])
    got = defaultdict(list)
    for x in search(df, df.where("vec_id % 20 = 0"), share=1.0, block_vectors=16).orderBy("query_id", "rank").collect():
        got[x["query_id"]].append(x["vec_id"])
    assert got == {q: [i for i, _ in best] for q, best in want.items()}
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(x) for x in search(few, few.where("vec_id = 0")).collect()] == [(0, 1, 1, 2.0)]
    assert search(df.where("false"), df.where("false")).count() == 0


def test_cells_come_in_order_of_distance():
    r = np.random.default_rng(2)
    d1, d2, held = r.normal(size=6), r.normal(size=6), r.integers(0, 3, 36)
    cells = nearest_cells(d1, d2, held, int(held.sum()))
    total = (d1[:, None] + d2[None, :]).ravel()
    assert cells == [c for c in np.argsort(total, kind="stable") if held[c]]


# --- mixing ----------------------------------------------------------------------------------


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, bound=2):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] >= bound * sizes[s]}
        if not full:
            out |= {s: level * w[s] for s in open_}
            break
        out |= {s: bound * sizes[s] for s in full}
        left -= sum(bound * sizes[s] for s in full)
        open_ -= full
    return out


def test_targets(spark):
    r = random.Random(4)
    for _ in range(3):
        sizes = {s: r.randrange(0, 1000) for s in ("b", "a", "é", "Z", None, "ab", "\U0001f600", "￿")}
        df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, size long, n long")
        got = {x["source"]: x["target"] for x in source_targets(df).collect()}
        assert got == pytest.approx(plain_targets(sizes))


def test_mix(documents, document_rows):
    sized = word_sizes(documents, "text", "size", ["doc_id", "source"])
    mix = lambda **o: {r["doc_id"]: r.asDict() for r in mix_documents(sized, "doc_id", **o).collect()}
    got = mix(shard_rows=5)
    assert len(got) == len(document_rows)
    by = defaultdict(list)
    for r in document_rows:
        g = got[r["doc_id"]]
        assert g["size"] == len((r["text"] or "").split()) and g["taken"] == g["copies"] * g["size"]
        assert 0 <= g["copies"] <= 2
        by[r["source"]].append(g)
    want = plain_targets({s: sum(g["size"] for g in own) for s, own in by.items()})
    for s, own in by.items():
        assert own[0]["target"] == pytest.approx(want[s])
        # rates meet the token constraint, and are tilted exponentially up to the bound
        assert sum(g["rate"] * g["size"] for g in own) == pytest.approx(want[s], rel=1e-6)
        open_ = [(g["size"], math.log(g["rate"])) for g in own if g["size"] and g["rate"] < 2 - 1e-9]
        if len({a for a, _ in open_}) > 1:
            slope = np.array([b / a for a, b in open_])
            assert slope == pytest.approx(np.full(len(slope), slope[0]), rel=1e-6, abs=1e-9)
        assert abs(sum(g["taken"] for g in own) - want[s]) <= max(50, 0.02 * want[s])
    assert mix(shard_rows=5) == got


def test_mix_odd_tables(odd, nothing):
    rows = mix_documents(word_sizes(odd, "text", "words", ["doc_id", "source"]).withColumnRenamed("words", "size"),
                         "doc_id").collect()
    assert len(rows) == 11 and all(0 <= r["copies"] <= 2 for r in rows)
    assert {r["copies"] for r in rows if r["size"] == 0} == {1}
    empty = word_sizes(nothing, "text", "words", ["doc_id", "source"]).withColumnRenamed("words", "size")
    assert mix_documents(empty, "doc_id").count() == 0


# --- archive revisits ------------------------------------------------------------------------

RECORD = "record_id long, kind string, url string, t long, status int, headers map<string,string>, id int, full string"


def records(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], RECORD)
    return df.withColumn("at", F.timestamp_seconds("t")).drop("t")


def test_canonical_urls(spark):
    same = ["http://www.Example.com:80/a/b.html#x", "https://example.com/a/b/", "example.com/a/b?utm_source=q",
            "HTTP://EXAMPLE.com/a/b?ref=1&"]
    other = ["http://example.com/A/b", "http://example.com/a/b?z=1&a=2", "http://m.example.com/a/b", "", "  ", None]
    df = spark.createDataFrame([(u,) for u in same + other], "u string")
    got = [r[0] for r in df.select(canonical_url(F.col("u"))).collect()]
    assert set(got[:4]) == {"example.com/a/b"}
    assert got[4:] == ["example.com/A/b", "example.com/a/b?a=2&z=1", "m.example.com/a/b", None, None, None]


def test_revisits_rules(spark):
    full = {"ETag": '"1"', "Server": "s", "Cache-Control": "a", "Last-Modified": "m"}
    rows = [
        (1, "response", "http://x.org/p", 10, 200, full), (2, "response", "http://x.org/p", 20, 404, full),
        (3, "revisit", "https://www.x.org/p/", 30, 304, {"etag": 'W/"1"', "cache-control": "b", "server": "t"}),
        (4, "revisit", "http://x.org/p", 31, 304, {"Etag": '"2"'}), (5, "revisit", "http://x.org/p", 5, 304, None),
        (6, "revisit", "http://x.org/p", 10, 304, None), (7, "revisit", "http://x.org/p", 32, 304, {"Last-Modified": "m"}),
        (8, "revisit", "http://x.org/p", 33, 304, {}), (9, "revisit", None, 33, 304, {}),
        (10, "revisit", "http://x.org/p", None, 304, {}), (11, "response", "http://x.org/p", 40, 200, None),
        (12, "response", "http://x.org/p", 40, 200, {"etag": "z"}), (13, "revisit", "http://x.org/p", 41, 304, {"etag": "z"}),
        (13, "revisit", "http://x.org/p", 41, 304, {"etag": "z"}), (None, "response", "http://x.org/p", 42, 200, None),
        (14, "revisit", "http://x.org/p", 43, 304, {"etag": "y"}), (15, None, None, None, None, None)]
    got = {r["record_id"]: r for r in resolve_revisits(records(spark, rows)).collect()}
    assert {k: (r["full_id"], r["verdict"]) for k, r in got.items()} == {
        3: (1, "matched"), 4: (1, "mismatched"), 5: (None, "missing"), 6: (None, "missing"), 7: (1, "matched"),
        8: (1, "unchecked"), 9: (None, "missing"), 10: (None, "missing"), 13: (12, "matched"), 14: (12, "mismatched")}
    assert got[3]["headers"] == {"etag": 'W/"1"', "cache-control": "b", "server": "s", "last-modified": "m"}
    assert got[4]["headers"] == {"etag": '"2"'} and got[5]["headers"] == {}
    assert resolve_revisits(records(spark, rows).where("false")).count() == 0


def test_revisits_of_a_hot_url_equal_brute_force(spark):
    r = random.Random(6)
    rows = [(i, r.choice(["response", "revisit"]), "http://x.org/hot", r.randrange(400), 200, None) for i in range(900)]
    rows += [(1000 + i, r.choice(["response", "revisit"]), f"http://x.org/{i % 30}", r.randrange(50), 200, None)
             for i in range(300)]
    got = {x["record_id"]: x["full_id"] for x in resolve_revisits(records(spark, rows), slice_rows=20).collect()}
    for i, kind, url, t, *_ in rows:
        if kind == "revisit":
            best = max(((s, j) for j, k, u, s, *_ in rows if k == "response" and u == url and s < t), default=(0, None))
            assert got[i] == best[1]


# --- lines -----------------------------------------------------------------------------------


def edits_at_most_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain_lines(texts, min_chars):
    """Per key: dropped line numbers and links to other line texts."""
    places = defaultdict(list)
    for key, text in texts.items():
        for i, line in enumerate((text or "").split("\n")):
            line = line.removesuffix("\r")
            if len(line) >= min_chars:
                places[line].append((key, i))
    sets, links = Union(places), Counter()
    every = sorted(places)
    for i, a in enumerate(every):
        for b in every[:i]:
            if edits_at_most_one(a, b):
                sets.join(a, b)
                links[a] += 1
                links[b] += 1
    first = {}
    for line, own in places.items():
        c = sets.find(line)
        first[c] = min([first.get(c, min(own)), *own])
    out = {k: ([], 0) for k in texts}
    for line, own in places.items():
        for key, i in own:
            out[key] = (out[key][0] + [i] * ((key, i) != first[sets.find(line)]), out[key][1] + links[line])
    return {k: (sorted(d), n) for k, (d, n) in out.items()}


def line_texts(seed=8):
    r = random.Random(seed)
    lines = ["".join(r.choice("abcé日 ") for _ in range(r.randrange(5, 30))) for _ in range(25)]
    for line in lines[:20]:
        for _ in range(6):
            i, c = r.randrange(len(line)), r.choice("abxé日")
            lines.append(r.choice([line[:i] + c + line[i:], line[:i] + line[i + 1 :], line[:i] + c + line[i + 1 :]]))
    lines += ["aaaaaaaaaa", "aaaaaaaaaaa", "aaaaaaaaa", "aaaaabaaaa"]
    return {k: "\n".join(r.choice(lines) + r.choice(["", "", "\r"]) for _ in range(r.randrange(0, 9))) for k in range(60)}


@pytest.mark.parametrize("small", [0, 1000])  # both ways to look lines up
def test_lines_equal_brute_force(spark, small):
    texts = line_texts()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["dropped"], r["n_links"]) for r in repeated_lines(df, min_chars=4, small=small).collect()}
    assert got == plain_lines(texts, 4)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_near_lines(texts, min_chars, max_edits):
    """:func:`plain_lines` with an edit bound for lines from ``min_chars``, equality for all others with a word."""
    places = defaultdict(list)
    for key, text in texts.items():
        for i, line in enumerate((text or "").split("\n")):
            line = line.removesuffix("\r")
            if len(line) >= min_chars or line.strip(" \t\v\f\r"):
                places[line].append((key, i))
    sets, links = Union(places), Counter()
    every = sorted(x for x in places if len(x) >= min_chars)
    for i, a in enumerate(every):
        for b in every[:i]:
            if abs(len(a) - len(b)) <= max_edits and edit_distance(a, b) <= max_edits:
                sets.join(a, b)
                links.update((a, b))
    first = {}
    for line, own in places.items():
        c = sets.find(line)
        first[c] = min([first.get(c, min(own)), *own])
    out = {k: ([], 0) for k in texts}
    for line, own in places.items():
        for key, i in own:
            out[key] = (out[key][0] + [i] * ((key, i) != first[sets.find(line)]), out[key][1] + links[line])
    return {k: (sorted(d), n) for k, (d, n) in out.items()}


@pytest.mark.parametrize("max_edits,small", [(1, 1000), (2, 0), (2, 1000), (3, 1000)])
def test_short_lines_and_edit_bounds_equal_brute_force(spark, max_edits, small):
    texts = line_texts()
    r = random.Random(9)
    for k in range(60, 100):  # short and blank lines, and lines of several edits
        lines = (r.choice([*texts.values()]) or "Les.").split("\n")[:3]
        for _ in range(r.randrange(4)):
            i = r.randrange(len(lines[0]) + 1)
            lines[0] = lines[0][:i] + r.choice(["", "x", "é"]) + lines[0][i + r.randrange(2) :]
        texts[k] = "\n".join([*lines, r.choice(["Les.", "日本", "a", " ", "", "\t\r", "b\r"])])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = repeated_lines(df, min_chars=6, small=small, exact_chars=1, max_edits=max_edits).collect()
    assert {r["doc_id"]: (r["dropped"], r["n_links"]) for r in out} == plain_near_lines(texts, 6, max_edits)


def test_line_sketches_keep_near_lines_and_tell_others_apart(spark):
    """Lines around one base with four letters put in somewhere share parts, but are hardly ever joined."""
    rng = random.Random(17)
    letters = "abcdefghijklmnopqrstuvwxyz ,.éß日"
    base = "".join(rng.choice(letters) for _ in range(300))

    def put(line, at, what, gone=0):
        return line[:at] + what + line[at + gone :]

    far = [put(base, rng.randrange(300), "".join(rng.choice(letters[:26]) for _ in range(4))) for _ in range(150)]
    near = []
    for _ in range(300):
        line = rng.choice([*far, "", "ab"])
        for _ in range(2):
            line = put(line, rng.randrange(len(line) + 1), rng.choice(["", *letters]), rng.randrange(2))
        near.append(line)
    starts = [*far, "", "ab"]
    lines = starts + near
    rows = spark.createDataFrame([(i, i, x) for i, x in enumerate(lines)], "id long, h1 long, line string")
    got = {r["id"]: r for r in _sketched(rows).collect()}
    bits = lambda x, y: [bin((got[x][c] ^ got[y][c]) & (2**64 - 1)).count("1") for c in ("parity", *words)]
    words = [f"s{k}" for k in range(SKETCH)]
    passes = lambda x, y: (d := bits(x, y))[0] <= 4 and sum(d[1:]) <= 8

    def edits(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, e in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != e))
        return row[-1]

    some = [(rng.randrange(len(starts)), rng.randrange(len(starts), len(lines))) for _ in range(200)]
    some += [(starts.index(x), len(starts) + k) for k, y in enumerate(near) for x in ("", "ab") if len(y) < 5]
    assert all(passes(x, y) for x, y in some if edits(lines[x], lines[y]) <= 2)
    found = sum(passes(x, y) for x in range(150) for y in range(x))
    assert found < 0.05 * 150 * 149 / 2


def test_shared_parts_of_packed_keys():
    pack = lambda *pairs: np.array(pairs, dtype=np.uint64).tobytes()
    big = 2**64 - 5
    table = pa.table({"own": [pack((1, 7), (2, 7), (3, 7), (big, 9)), b"", pack((1, 7), (3, 8))],
                      "other": [pack((2, 8), (4, 8)), pack((4, 9), (1, 7), (big, 8)), pack((2, 8))]})
    got = sorted(_shared_parts(table).to_pylist(), key=lambda r: (r["part"], r["h1"]))
    signed = big - 2**64
    # 1: one line only; 4: no line's own; a line that has a part twice comes once, as its own if it is
    assert [(r["part"], r["h1"], r["own"]) for r in got] == [
        (signed, 8, False), (signed, 9, True), (2, 7, True), (2, 8, False), (3, 7, True), (3, 8, True)]
    nothing_ = _shared_parts(pa.table({"own": [b""], "other": [b""]}))
    assert nothing_.num_rows == 0 and nothing_.schema.names == ["part", "own", "h1"]


def test_pipeline_drops_short_repeated_lines(spark, small_dir, nothing):
    texts = {1: "Les.\nAll rights reserved.\n\n日本語です。", 2: "Les.\n\nAll rights reserved.\nnew", 3: "日本語です。\n\nLes."}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_stage(spark, df, small_dir).collect()}
    assert left == {1: texts[1], 2: "\nnew"}
    assert repeated_lines(nothing, exact_chars=1, max_edits=2).count() == 0


def test_lines_of_given_documents(documents, document_rows):
    texts = {r["doc_id"]: r["text"] for r in document_rows}
    want = plain_lines(texts, 24)
    got = {r["doc_id"]: (r["dropped"], r["n_links"]) for r in repeated_lines(documents).collect()}
    assert got == want
    rows = drop_repeated_lines(documents)
    assert rows.columns == documents.columns
    left = {r["doc_id"]: r for r in rows.collect()}
    for k, t in texts.items():
        kept = "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in want[k][0])
        if want[k][0] and not kept.split():
            assert k not in left
        else:
            assert left[k]["text"] == kept and (not want[k][0] or left[k]["n_chars"] == len(kept))


def test_lines_odd_tables(odd, nothing):
    got = {r["doc_id"]: r["dropped"] for r in repeated_lines(odd).collect()}
    assert got[1] == [] and got[5] == [] and got[6] == [0] and got[8] == [0] and got[7] == []
    rows = drop_repeated_lines(odd)
    assert rows.columns == odd.columns
    assert sorted((r["doc_id"] or 0) for r in rows.collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 8, 9]
    assert repeated_lines(nothing).count() == 0 and drop_repeated_lines(nothing).count() == 0


# --- perplexity ------------------------------------------------------------------------------


def plain_kneser_ney(trusted_words, order):
    """log p(symbol | symbols before) of the interpolated modified model over words."""
    grams = Counter()
    for w, n in trusted_words.items():
        s = " " + w + "\n"
        for i in range(1, len(s)):
            grams[s[max(0, i + 1 - order) : i + 1]] += n
    tails = {g[-k:] for g in grams for k in range(2, len(g) + 1)}
    a = Counter(t[1:] for t in tails)
    a.update({g: n for g, n in grams.items() if len(g) == order or g[0] == " "})
    of = defaultdict(Counter)
    for g, n in a.items():
        of[len(g)][n] += 1
    d = {}
    for k, t in of.items():
        y = t[1] / (t[1] + 2 * t[2]) if t[1] + t[2] else None
        for i in (1, 2, 3):
            v = i - (i + 1) * y * t[i + 1] / t[i] if y is not None and t[i] else -1
            d[k, i] = v if 0 < v < i else 0.5
    s, lost = Counter(), Counter()
    for g, n in a.items():
        s[g[:-1]] += n
        lost[g[:-1]] += d[len(g), min(n, 3)]
    lower = 1 / (sum(len(g) == 1 for g in a) + 1)

    def p(g):
        if not g:
            return lower
        h = g[:-1]
        if h not in s:
            return p(g[1:])
        own = (a[g] - d[len(g), min(a[g], 3)]) / s[h] if g in a else 0.0
        return own + lost[h] / s[h] * p(g[1:])

    def logp(w):
        line = " " + w + "\n"
        return sum(math.log(p(line[max(0, i + 1 - order) : i + 1])) for i in range(1, len(line)))

    return logp, p, {g[:-1] for g in a}, {g for g in a if len(g) == 1}


@pytest.mark.parametrize("small", [0, 1000])
def test_perplexity_equals_plain_model(documents, document_rows, small):
    trusted = documents.where("doc_id % 3 = 0").select("doc_id")
    got = {r["doc_id"]: r for r in score_documents(documents, trusted, block_bytes=1 << 16, order=4, small=small).collect()}
    assert len(got) == len(document_rows)
    for lang in {r["lang"] for r in document_rows}:
        own = [r for r in document_rows if r["lang"] == lang]
        words = Counter(w for r in own if r["doc_id"] % 3 == 0 for w in r["text"].split())
        logp, p, contexts, symbols = plain_kneser_ney(words, 4)
        known: dict[str, float] = {}
        for r in own[:25]:
            total, n = 0.0, 0
            for w in r["text"].split():
                if w not in known:
                    known[w] = logp(w)
                total, n = total + known[w], n + len(w) + 1
            assert got[r["doc_id"]]["log_prob"] == pytest.approx(total, rel=1e-9)
            assert got[r["doc_id"]]["perplexity"] == pytest.approx(math.exp(-total / n), rel=1e-9)
        for h in ("", " ", "e", " t"):  # the model is a distribution over the symbols and one unseen
            assert sum(p(h + x) for x in symbols) + p(h + "\0") == pytest.approx(1.0)


def test_perplexity_across_words_equals_plain_model(documents, document_rows):
    """Each text is one sequence: for the plain model a single word whose spaces are an ordinary symbol."""
    trusted = documents.where("doc_id % 3 = 0").select("doc_id")
    out = score_documents(documents, trusted, block_bytes=1 << 16, order=4, across=True).collect()
    got = {r["doc_id"]: r for r in out}
    assert len(got) == len(document_rows)
    for lang in {r["lang"] for r in document_rows}:
        own = [(r["doc_id"], "\t".join(r["text"].split())) for r in document_rows if r["lang"] == lang]
        logp, *_ = plain_kneser_ney(Counter(t for k, t in own if k % 3 == 0 and t), 4)
        for k, t in own[:12]:
            assert got[k]["n_symbols"] == (len(t) + 1 if t else 0)
            if t:
                assert got[k]["log_prob"] == pytest.approx(logp(t), rel=1e-9)


def test_perplexity_sees_word_order_and_repetition(spark):
    r = random.Random(4)
    nouns = "time house water street letter music garden winter".split()
    clean = [" ".join(f"the {r.choice(nouns)} of the {r.choice(nouns)}" for _ in range(20)) for _ in range(40)]
    shuffled = clean[0].split()
    r.shuffle(shuffled)
    texts = [*clean, " ".join(["the"] * 100), " ".join(shuffled), "é日 " + clean[0], " \n\t", clean[0].replace(" ", " \n ")]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in perplexity_filter(df, df.where("doc_id < 40").select("doc_id"), quantile=1.0).collect()}
    assert all(got[i]["kept"] for i in range(40))
    assert not got[40]["kept"] and not got[41]["kept"] and not got[42]["kept"]
    assert got[43]["perplexity"] is None and got[43]["kept"]
    assert got[44]["perplexity"] == pytest.approx(got[0]["perplexity"])


def test_packed_runs():
    r = np.random.default_rng(0)
    size = r.integers(0, 5, 50)
    values = np.concatenate([np.sort(r.choice(90_000, k, replace=False)) for k in size]).astype(np.int32)
    text = np.repeat(np.arange(50), size)
    first = np.append(True, text[1:] != text[:-1])
    assert (from_steps(unpack(pack(steps(values, first)), len(values)), size) == values).all()
    assert len(from_steps(unpack(pack(np.zeros(0, np.int32)), 0), np.zeros(3, dtype=int))) == 0


def test_perplexity_finds_labelled_junk(spark, small_dir, documents):
    labels = spark.read.parquet(f"{small_dir}/labels.parquet")
    out = perplexity_filter(documents, labels.where("quality = 1").select("doc_id")).join(labels, "doc_id").collect()
    good = [r["kept"] for r in out if r["quality"] == 1]
    assert sum(good) / len(good) >= 0.95


def test_perplexity_odd_tables(odd, nothing):
    trusted = odd.where("doc_id in (5, 9)").select("doc_id")
    rows = perplexity_filter(odd, trusted).collect()
    assert len(rows) == 11
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["perplexity"] is None and by[1]["kept"] and by[2]["kept"] and by[3]["kept"]
    assert by[5]["perplexity"] == by[6]["perplexity"] and by[5]["trusted"] and not by[6]["trusted"]
    assert by[8]["perplexity"] is None and by[8]["kept"]  # no trusted text in its language
    assert perplexity_filter(nothing, trusted).count() == 0
    assert perplexity_filter(odd, nothing.select("doc_id")).where("kept").count() == 11


# --- pipeline --------------------------------------------------------------------------------


def test_pipeline_stages_take_effect(spark, small_dir, documents):
    docs = documents.where("doc_id < 120")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small_dir)
        assert out.columns == documents.columns
        docs = spark.createDataFrame(out.collect(), documents.schema)
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        assert {k for k, _ in rows} <= set(before)
        if name == "line_dedup":
            assert all(not d for d, _ in plain_lines(dict(rows), 24).values())
        if name == "near_duplicates":
            assert all(k == c for k, c in plain_classes(dict(rows)).items())
        if name == "mixture":
            assert set(Counter(k for k, _ in rows).values()) <= {1, 2}
        before = dict(rows)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, small_dir).collect()
    assert len(last) == docs.count() and all(r["round_trip"] for r in last)


def test_pipeline_odd_tables(spark, small_dir, odd, nothing):
    for table in (odd, nothing):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, table, small_dir).columns == table.columns, name
            stage(spark, table, small_dir).collect()
        assert corpus_pipeline.STAGES[-1][1](spark, table, small_dir).count() == table.count()


@pytest.mark.parametrize("max_edits", [1, 2])
def test_lines_of_repeated_keys(spark, max_edits):
    """One key with two texts: its lines are found by their own text, in any row order; equal rows count once."""
    a, b, near = "a first line of its own", "some line that is near", "some line that is nears"
    for rows in ([(1, a), (1, b), (2, near)], [(1, b), (1, a), (2, near)], [(1, b), (1, b), (2, near)]):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r["doc_id"]: (r["dropped"], r["n_links"]) for r in
               repeated_lines(df, min_chars=4, max_edits=max_edits).collect()}
        assert got == {1: ([], 1), 2: ([0], 1)}
