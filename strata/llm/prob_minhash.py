"""Near-duplicate documents with ProbMinHash (operator 2).

A document is its shingles of five words, weighted by how often they occur (a shorter document
is one shingle of all its words).  Similarity is the probability Jaccard similarity of
the weighted shingles; on documents without repeated shingles it is the Jaccard similarity of sets.

Signatures: every shingle is a Poisson process whose rate is its weight; each arrival hits a random
register, and a register keeps the shingle that arrives first.  A shingle stops as
soon as its next arrival is later than all registers' first ones.  Two documents agree in
a register with the probability of their similarity.  ``bands`` times ``rows`` registers are
hashed band by band: at similarity 0.8 a pair misses all 24 bands of 4 with a probability of 3 in a million.

Classes are the connected components of the links, pairs with an exactly computed similarity of
at least ``threshold``.  Pairs are not listed:

1. Documents with equal shingles and weights are one node (their smallest key).
2. In each band bucket every node is paired with the bucket's hub only, its lightest node, and verified: first
   with the smallest of its partners, then with the others that are not yet in its component.
3. A bucket whose nodes are still in several components is contested: a link may exist between
   nodes other than the hub.  The contested nodes are joined exactly by prefixes: of two linked documents at
   least ``threshold`` of either's weight is on shared shingles, so with shingles in any common order both
   have their first shared shingle among those that make up the first ``1 - threshold`` of their weight.
   The order is by frequency among the contested, so a passage that many documents share comes last;
   a document with more than that weight on shingles of its own drops out at once.  Only pairs from
   different components that pass the size bound at a shingle they meet under are listed and verified; two
   documents without repeated shingles must also differ in no more shingles than their sizes allow, by a sketch that
   never counts too many.  First every node meets two nodes that stand for the shingle, so a large group of copies becomes
   one component by a number of pairs linear in its rows.  Then one node stands for its component under a shingle; all
   nodes follow only for components that this has not joined.

No bucket is capped and no row is dropped; a bucket of any size costs what its rows cost.

Edge cases: a document without words (null, empty, blank) is in a class of its own; rows of a null key get a null class and
no partner; rows that repeat a key are one document if their texts are equal, else each text is
classed and the key's classes meet; ties go to the smaller key; extra columns are carried by :func:`keep_one_per_class`; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.schema_safe import own_name
from strata.llm.text_arrays import Flat, chunks, mix, text_column, window_hash
from strata.operators.components import connected_components
from strata.session import checkpoint_dir, gathered

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
#: Words of 64 bits that hold which classes of shingles occur an odd number of times.
SKETCH = 8
#: Up to so many keys (16 MB) are broadcast to look documents up; more are joined by a shuffle.
SMALL_KEYS = 1_000_000
_ARRIVAL, _REGISTER = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def _kept(df: DataFrame) -> DataFrame:
    if not checkpoint_dir(df.sparkSession):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    return df.checkpoint(eager=True)


def weighted_shingles(flat: Flat, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and count of every distinct shingle, sorted by text and hash."""
    start, end, owner = flat.words()
    word = Flat.span_hash(flat.prefix_hash(), start, end)
    run, at = window_hash(word, owner, size)
    text = owner[at]
    n_words = np.bincount(owner, minlength=flat.n)
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    if len(short):  # one shingle of all words
        first = np.searchsorted(owner, short)
        acc = np.full(len(short), 0x5851F42D4C957F2D, dtype=np.uint64)
        for k in range(size - 1):
            has = n_words[short] > k
            acc[has] = mix(acc[has] + word[first[has] + k] + np.uint64(k + 1))
        run, text = np.concatenate([run, acc]), np.concatenate([text, short])
    if not len(run):
        z = np.zeros(0, np.int64)
        return z, run, z
    order = np.lexsort((run, text))
    run, text = run[order], text[order]
    new = np.ones(len(run), dtype=bool)
    new[1:] = (run[1:] != run[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return text[first], run[first], np.diff(np.append(first, len(run)))


def signatures(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, registers: int) -> np.ndarray:
    """The shingle that arrives first at each register, per text (0 for texts without shingles)."""
    first = np.full(n * registers, np.inf)
    owner = np.zeros(n * registers, dtype=np.uint64)
    has = np.bincount(text, minlength=n) > 0
    t, turn = np.zeros(len(text)), 0
    text, shingle, rate = text.copy(), shingle, 1.0 / weight
    while len(text):
        turn += 1
        step = np.uint64(turn)
        u = (mix(shingle + step * _ARRIVAL) >> np.uint64(11)).astype(np.float64)
        t = t - np.log((u + 1.0) * 2.0**-53) * rate
        register = (mix((shingle ^ _REGISTER) + step * _REGISTER) % np.uint64(registers)).astype(np.int64)
        cell = text * registers + register
        np.minimum.at(first, cell, t)
        hit = first[cell] == t
        owner[cell[hit]] = shingle[hit]
        last = first.reshape(n, registers).max(axis=1)
        open_ = t < last[text]
        text, shingle, rate, t = text[open_], shingle[open_], rate[open_], t[open_]
    out = owner.reshape(n, registers)
    out[~has] = 0
    return out


def sketch_table(docs: DataFrame, key: str, text: str, size: int, bands: int, rows: int) -> DataFrame:
    """``(key, n_shingles, weight, f1, f2, bands)`` per row: a 128-bit print of the weighted shingles, the band hashes."""
    key_type = docs.schema[key].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch, "text")
            for lo, hi in chunks(texts):
                n = hi - lo
                owner, shingle, weight = weighted_shingles(Flat(texts, lo, hi), size)
                count = np.bincount(owner, minlength=n)
                prints = []
                for salt in (1, 2):
                    part = mix(mix(shingle + np.uint64(salt)) * weight.astype(np.uint64) + np.uint64(salt))
                    total = np.concatenate([[np.uint64(0)], np.cumsum(part, dtype=np.uint64)])
                    off = np.concatenate([[0], np.cumsum(count)])
                    prints.append((total[off[1:]] - total[off[:-1]]).view(np.int64))
                reg = signatures(owner, shingle, weight, n, bands * rows).reshape(n, bands, rows)
                band = np.tile(mix(np.arange(1, bands + 1, dtype=np.uint64)), (n, 1))
                for k in range(rows):
                    band = mix(band + reg[:, :, k])
                off = pa.array(np.arange(0, (n + 1) * bands, bands, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n), pa.array(count.astype(np.int64)),
                     pa.array(np.rint(np.bincount(owner, weights=weight, minlength=n)).astype(np.int64)),
                     pa.array(prints[0]), pa.array(prints[1]), pa.ListArray.from_arrays(off, pa.array(band.ravel().view(np.int64)))],
                    names=["key", "n_shingles", "weight", "f1", "f2", "bands"])

    slim = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(sketch, f"key {key_type}, n_shingles long, weight long, f1 long, f2 long, bands array<long>")


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """The probability Jaccard similarity of two weighted sets, exact: sorted distinct hashes with weights.

    The sum over shared d of 1 / (sum over all e of max(a_e / a_d, b_e / b_d)), by prefix sums over e in
    the order of a_e / b_e.
    """
    if not len(a) or not len(b):
        return 0.0
    every = np.union1d(a, b)
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, a)] = wa
    y[np.searchsorted(every, b)] = wb
    both = (x > 0) & (y > 0)
    if not both.any():
        return 0.0
    ratio = np.divide(x, y, out=np.full(len(x), np.inf), where=y > 0)
    order = np.argsort(ratio, kind="stable")
    x, y, ratio, both = x[order], y[order], ratio[order], both[order]
    below_y = np.concatenate([[0.0], np.cumsum(y)])
    from_x = np.concatenate([np.cumsum(x[::-1])[::-1], [0.0]])
    r = ratio[both]
    at = np.searchsorted(ratio, r, side="left")  # entries before have a smaller ratio: the second set's side counts
    return float((x[both] / (from_x[at] + r * below_y[at])).sum())


def _texts_of(docs: DataFrame, key: str, text: str, wanted: DataFrame, small: int) -> DataFrame:
    """``(key, text)`` of the wanted keys, one row each."""
    slim = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    few = wanted.limit(small + 1).count() <= small
    return slim.join(F.broadcast(wanted) if few else wanted, "key", "left_semi").dropDuplicates(["key"])


def verified(pairs: DataFrame, texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """The pairs ``(a, b)`` whose similarity is at least ``threshold``, with it."""
    rows = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
    key_type = pairs.schema["a"].dataType.simpleString()

    def profiles(texts_):
        out = []
        for lo, hi in chunks(texts_):
            owner, shingle, weight = weighted_shingles(Flat(texts_, lo, hi), size)
            off = np.searchsorted(owner, np.arange(hi - lo + 1))
            out += [(shingle[off[i] : off[i + 1]], weight[off[i] : off[i + 1]]) for i in range(hi - lo)]
        return out

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                left, right = profiles(text_column(batch, "text_a")), profiles(text_column(batch, "text_b"))
                sim = np.array([probability_jaccard(*p, *q) for p, q in zip(left, right)])
                good = sim >= threshold - 1e-12
                keep = pa.array(good)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(sim[good])],
                    names=["a", "b", "similarity"])

    return rows.select("a", "b", "text_a", "text_b").mapInArrow(check, f"a {key_type}, b {key_type}, similarity double")


def _labelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``(node, label)`` of all nodes after ``links``: the smallest node of the component.

    Components that ``labels`` holds already are one node each, so only what links join is worked on.
    """
    met = links.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(
        labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
    met = _kept(met.where("la != lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct())
    if met.isEmpty():
        return labels
    found = connected_components(met, "a", "b").select(F.col("node").alias("label"), F.col("label").alias("found"))
    return gathered(_kept(labels.join(found, "label", "left").select("node", F.coalesce("found", "label").alias("label"))))


def shingle_sketches(texts: DataFrame, size: int) -> DataFrame:
    """``(node, total, s0 ...)`` of the documents without repeated shingles: the parities of their shingles' classes.

    Two such documents have at least as many shingles that only one of them has as their sketches differ in bits.
    """
    key_type = texts.schema["key"].dataType.simpleString()
    words = [f"s{k}" for k in range(SKETCH)]
    bit = np.uint64(1) << np.arange(64, dtype=np.uint64)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = text_column(batch, "text")
            for lo, hi in chunks(whole):
                owner, shingle, weight = weighted_shingles(Flat(whole, lo, hi), size)
                off = np.searchsorted(owner, np.arange(hi - lo + 1))
                place = mix(shingle ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(64 * SKETCH)
                cols = []
                for k in range(SKETCH):
                    own = np.where(place >> np.uint64(6) == k, bit[place & np.uint64(63)], np.uint64(0))
                    odd = np.append(np.uint64(0), np.bitwise_xor.accumulate(own))
                    cols.append(pa.array((odd[off[1:]] ^ odd[off[:-1]]).view(np.int64)))
                total = np.bincount(owner, weights=weight, minlength=hi - lo)
                found = pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.rint(total).astype(np.int64)), *cols],
                    names=["node", "total", *words])
                yield found.filter(pa.array(np.diff(off) == np.rint(total)))

    return texts.select("key", "text").mapInArrow(
        sketch, f"node {key_type}, total long, " + ", ".join(f"{w} long" for w in words))


def _may_link(x: str, y: str, threshold: float):
    """Whether two sketches allow a similarity of ``threshold``; true where a side has none.

    Of sets of n and m elements, at most (n + m) (1 - t) / (1 + t) are in one only at a Jaccard similarity of t or more.
    """
    apart = [F.bit_count(F.col(f"s{k}_{x}").bitwiseXOR(F.col(f"s{k}_{y}"))) for k in range(SKETCH)]
    most = (F.col(f"total_{x}") + F.col(f"total_{y}")) * ((1 - threshold) / (1 + threshold)) + 1e-6
    return F.coalesce(sum(apart[1:], apart[0]) <= most, F.lit(True))


def _contested_prefixes(texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """``(node, shingle, least, cap, total, s0 ...)``: the prefix shingles of contested nodes, their bounds and sketches."""
    key_type = texts.schema["key"].dataType.simpleString()

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = text_column(batch, "text")
            for lo, hi in chunks(whole):
                owner, shingle, weight = weighted_shingles(Flat(whole, lo, hi), size)
                total = np.bincount(owner, weights=weight, minlength=hi - lo)
                distinct = np.bincount(owner, minlength=hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).take(pa.array(owner)), pa.array(shingle.view(np.int64)),
                     pa.array(weight.astype(np.int64)), pa.array(total[owner].astype(np.int64)),
                     pa.array(distinct[owner].astype(np.int64))],
                    names=["node", "shingle", "w", "total", "n"])

    rows = texts.select("key", "text").mapInArrow(explode, f"node {key_type}, shingle long, w long, total long, n long")
    often = rows.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    shared = rows.join(often, "shingle")
    every, before = Window.partitionBy("node"), Window.partitionBy("node").orderBy("df", "shingle").rowsBetween(
        Window.unboundedPreceding, -1)
    shared = shared.withColumn("own", F.col("total") - F.sum("w").over(every))
    shared = shared.withColumn("ahead", F.col("own") + F.coalesce(F.sum("w").over(before), F.lit(0)))
    prefix = shared.where(F.col("ahead") <= (1 - threshold) * F.col("total") + 1e-9)
    # Of two documents without repeated shingles that meet under their first shared shingle, at most what follows it is
    # shared, so similarity t needs the other's size to be at most (1 + 1 / t) * (size - ahead) - size.
    plain = F.col("n") == F.col("total")
    cap = (1 + 1 / threshold) * (F.col("total") - F.col("ahead")) - F.col("total") + 1e-6
    prefix = prefix.select("node", "shingle", F.when(plain, F.col("total")).otherwise(0).cast("double").alias("least"),
                           F.when(plain, cap).otherwise(F.lit(float("inf"))).alias("cap"))
    return _kept(prefix.join(shingle_sketches(texts, size), "node", "left"))


def _hub_pairs(prefix: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``(a, b)`` of contested nodes with one of two nodes that stand for their prefix shingle: linear in the rows.

    The two are first and last in an order by hash that is the same under all shingles, so nodes that share many shingles
    mostly meet the same ones.
    """
    prefix = prefix.join(labels, "node")
    place, whole = F.xxhash64("node"), F.struct(*prefix.columns)
    hubs = prefix.groupBy("shingle").agg(
        F.min("label").alias("l"), F.max("label").alias("h"),
        F.min(F.struct(place.alias("place"), whole.alias("hub"))).alias("low"),
        F.max(F.struct(place.alias("place"), whole.alias("hub"))).alias("top")).where("l != h")
    hubs = hubs.select("shingle", F.explode(F.array("low.hub", "top.hub")).alias("hub"))
    hubs = hubs.select("shingle", *[F.col(f"hub.{c}").alias(f"{c}_b") for c in prefix.columns if c != "shingle"])
    met = prefix.select("shingle", *[F.col(c).alias(f"{c}_a") for c in prefix.columns if c != "shingle"]).join(hubs, "shingle")
    met = met.where("label_a != label_b and least_a <= cap_b and least_b <= cap_a").where(_may_link("a", "b", threshold))
    return met.select(F.greatest("node_a", "node_b").alias("a"), F.least("node_a", "node_b").alias("b")).distinct()


def _contested_pairs(prefix: DataFrame, labels: DataFrame, threshold: float, one_each: bool) -> DataFrame:
    """Pairs ``(a, b)`` of contested nodes from different components that share a prefix shingle.

    With ``one_each`` the smallest node stands for its component under a shingle.
    """
    prefix = prefix.join(labels, "node")
    mixed = prefix.groupBy("shingle").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l != h")
    prefix = _kept(prefix.join(mixed.select("shingle"), "shingle", "left_semi"))
    # components that meet under a shingle and may hold a link first, then their nodes: nodes of one component are
    # never paired
    sketched = ["total", *(f"s{k}" for k in range(SKETCH))]
    side = lambda rows, x: rows.select(
        "shingle", *[F.col(c).alias(f"{c}_{x}") for c in rows.columns if c != "shingle"])
    may = "least_a <= cap_b and least_b <= cap_a"
    one = F.count("*") == 1  # the sketch of a component with one node here
    met = prefix.groupBy("shingle", "label").agg(
        F.min("least").alias("least"), F.max("cap").alias("cap"), F.min("node").alias("node"),
        *[F.when(one, F.first(c)).alias(c) for c in sketched])
    met = side(met, "a").join(side(met, "b"), "shingle").where(f"label_a < label_b and {may}").where(
        _may_link("a", "b", threshold))
    if one_each:
        return met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    met = met.select("shingle", "label_a", "label_b", *[
        F.col(f"{c}_b").alias(f"{c}_lb") for c in ("least", "cap", *sketched)])
    pairs = met.join(side(prefix, "a"), ["shingle", "label_a"]).where("least_a <= cap_lb and least_lb <= cap_a").where(
        _may_link("a", "lb", threshold))
    pairs = pairs.drop(*[f"{c}_lb" for c in ("least", "cap", *sketched)]).join(side(prefix, "b"), ["shingle", "label_b"])
    return pairs.where(may).where(_may_link("a", "b", threshold)).select(
        F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def near_duplicate_classes(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    size: int = SHINGLE,
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
    small: int = SMALL_KEYS,
) -> DataFrame:
    """``(key, copy_of, class_id, n_shingles)`` per key: the smallest key of its exact copies and of its class."""
    sketches = _kept(sketch_table(docs, key, text, size, bands, rows))
    full = sketches.where("n_shingles > 0")
    copies = _kept(full.groupBy("f1", "f2").agg(F.min("key").alias("node"), F.first("weight").alias("weight"),
                                                   F.first("bands").alias("bands")))
    in_band = copies.select("node", "weight", F.explode("bands").alias("band"))
    buckets = in_band.groupBy("band").agg(
        F.min(F.struct("weight", "node")).alias("least"), F.min("node").alias("low"), F.max("node").alias("top"))
    buckets = buckets.where("low != top").select("band", F.col("least.node").alias("hub"))
    member = _kept(in_band.select("node", "band").join(buckets, "band"))
    pairs = member.where("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    nodes = member.select("node").distinct()
    texts = _kept(_texts_of(docs, key, text, nodes.select(F.col("node").alias("key")), small))

    def joined(labels: DataFrame, found: DataFrame) -> DataFrame:
        return _labelled(labels, verified(found, texts, size, threshold).select("a", "b"))

    first = pairs.groupBy("a").agg(F.min("b").alias("b"))
    labels = joined(_kept(nodes.select("node", F.col("node").alias("label"))), first)
    ends = lambda df: df.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(
        labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b").where("la != lb")
    labels = joined(labels, ends(pairs.join(first, ["a", "b"], "left_anti")).select("a", "b"))

    seen = member.join(labels, "node")
    contested = seen.groupBy("band").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l != h")
    open_nodes = _kept(seen.join(contested.select("band"), "band", "left_semi").select("node").distinct())
    if not open_nodes.isEmpty():
        open_texts = texts.join(open_nodes.withColumnRenamed("node", "key"), "key", "left_semi")
        prefix = _contested_prefixes(open_texts, size, threshold)
        labels = joined(labels, _hub_pairs(prefix, labels, threshold))
        some = _kept(_contested_pairs(prefix, labels, threshold, one_each=True))
        labels = joined(labels, some)
        more = _contested_pairs(prefix, labels, threshold, one_each=False)
        labels = joined(labels, more.join(some, ["a", "b"], "left_anti"))

    out = sketches.select("key", "n_shingles", "f1", "f2").join(copies.select("f1", "f2", "node"), ["f1", "f2"], "left")
    out = out.withColumn("node", F.when(F.col("n_shingles") > 0, F.col("node")))
    out = out.join(labels, "node", "left").select(
        "key", F.coalesce("node", "key").alias("copy_of"), F.coalesce("label", "node", "key").alias("class_id"),
        "n_shingles")
    out = out.groupBy("key").agg(F.min("copy_of").alias("copy_of"), F.min("class_id").alias("class_id"),
                                 F.max("n_shingles").alias("n_shingles"))
    return out.withColumnRenamed("key", key)


def keep_one_per_class(
    docs: DataFrame, key: str = "doc_id", text: str = "text", small: int = SMALL_KEYS, **options
) -> DataFrame:
    """``docs`` without the documents of a class other than the one of the smallest key."""
    classes = near_duplicate_classes(docs, key, text, small=small, **options)
    gone = classes.where(F.col(key) != F.col("class_id")).select(F.col(key).alias("gone_key"))
    gone = _kept(gone)
    (own,) = own_name(docs, "gone_key")
    gone = gone.withColumnRenamed("gone_key", own)
    few = gone.limit(small + 1).count() <= small
    return docs.join(F.broadcast(gone) if few else gone, F.col(key) == F.col(own), "left_anti")
