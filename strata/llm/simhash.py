"""SimHash near-duplicates (operator 13): fingerprints linked by multi-index hashing.

A text's fingerprint has a bit set where more than half of its word shingles have that bit in
their XXH64 hash.  Fingerprints that differ in at most ``MAX_BITS`` bits are linked, and the
connected components of the links are the classes.

Links are found without comparing all fingerprints (Norouzi, Punjani, Fleet: "Fast search in
Hamming space with multi-index hashing", 2012).  Two fingerprints within 4 bits differ by at most
2 in one of the two 32-bit segments, so the balls of radius 1 around that segment meet.  Every
distinct fingerprint is entered in the table of each segment under the 33 values of its ball;
entries under one value are compared over all 64 bits.

A value under which very many fingerprints stand (thousands of near copies of one text) would
give as many comparisons as pairs.  Two steps keep the work in proportion to the entries, and
lose no link:

* first, fingerprints whose balls of radius 1 over *all* bits meet are linked: they differ in two
  bits at most, so everything entered under one value is linked to its smallest member, without
  listing pairs.  Comparisons are then only needed between different components;
* a value whose cross-component pairs outnumber ``CROWD`` times its entries is not compared.  Its
  entries are *crowded*: they are entered under all values within 2 bits of the whole fingerprint.
  Two fingerprints within 4 bits have such a value in common, and all that share one are within 4
  bits of each other, so again each is linked to the smallest one only.

Rows: 65 + 66 for a fingerprint, and 2,081 for a crowded one.

Edge cases: a null, empty or white-space text has the fingerprint 0 and is linked like any other;
a text of fewer words than a shingle is one shingle; rows that repeat a key are each fingerprinted
and share their key's class, so they connect what either of them is linked to; a null key is an
ordinary row, whose class is the smallest non-null key reachable (null if there is none); an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.schema_safe import own_name
from strata.llm.text_arrays import Flat, chunks, text_column
from strata.operators.components import connected_components
from strata.session import cut, spread

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
#: Cross-component pairs per entry above which a table value is not compared but refined.
CROWD = 8
#: Shingles longer than this are hashed one by one: the array version runs as many rounds as the longest needs.
LONG_BYTES = 256

# The primes of XXH64 (fixed values of the public algorithm).
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579,
                           2870177450012600261))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of every span ``data[start:end]``, all spans at once."""
    out = np.empty(len(start), dtype=np.uint64)
    size = end - start
    for i in np.flatnonzero(size > LONG_BYTES):
        out[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes(), seed)
    some = np.flatnonzero(size <= LONG_BYTES)
    if not len(some):
        return out
    # unaligned words of 8 and 4 bytes at every position
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    four = np.ndarray(shape=(len(data) + 1,), dtype="<u4", buffer=padded, strides=(1,))
    order = some[np.argsort(-size[some], kind="stable")]  # longest first: the rounds work on shrinking heads
    at, n = start[order].copy(), size[order]
    s = np.uint64(seed)
    with np.errstate(over="ignore"):
        h = np.full(len(order), s + _P5, dtype=np.uint64)
        wide = int(np.searchsorted(-n, -32, side="right"))
        if wide:
            lanes = [np.full(wide, v, dtype=np.uint64) for v in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            stripes = n[:wide] // 32
            for k in range(int(stripes[0])):
                m = int(np.searchsorted(-stripes, -k, side="left"))
                for j in range(4):
                    lanes[j][:m] = _round(lanes[j][:m], eight[at[:m] + 8 * j])
                at[:m] += 32
            acc = _rotl(lanes[0], 1) + _rotl(lanes[1], 7) + _rotl(lanes[2], 12) + _rotl(lanes[3], 18)
            for lane in lanes:
                acc = (acc ^ _round(np.zeros(wide, np.uint64), lane)) * _P1 + _P4
            h[:wide] = acc
        h += n.astype(np.uint64)
        left = n % 32
        for _ in range(3):
            m = np.flatnonzero(left >= 8)
            h[m] = _rotl(h[m] ^ _round(np.zeros(len(m), np.uint64), eight[at[m]]), 27) * _P1 + _P4
            at[m] += 8
            left[m] -= 8
        m = np.flatnonzero(left >= 4)
        h[m] = _rotl(h[m] ^ (four[at[m]].astype(np.uint64) * _P1), 23) * _P2 + _P3
        at[m] += 4
        left[m] -= 4
        for _ in range(3):
            m = np.flatnonzero(left >= 1)
            h[m] = _rotl(h[m] ^ (data[at[m]].astype(np.uint64) * _P5), 11) * _P1
            at[m] += 1
            left[m] -= 1
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        h ^= h >> np.uint64(32)
    out[order] = h
    return out


def _joined_words(flat: Flat) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words in lower case (A-Z only), one space behind each: bytes, start, end and text of every word."""
    start, end, owner = flat.words()
    size = end - start
    at = np.zeros(len(start) + 1, dtype=np.int64)
    np.cumsum(size + 1, out=at[1:])
    out = np.full(int(at[-1]), 0x20, dtype=np.uint8)
    source = np.arange(int(size.sum())) + np.repeat(start - (at[:-1] - np.arange(len(start))), size)
    ink = flat.buf[source]
    upper = (ink >= 0x41) & (ink <= 0x5A)
    out[source - np.repeat(start - at[:-1], size)] = np.where(upper, ink | 0x20, ink)
    return out, at[:-1], at[:-1] + size, owner


def fingerprints(texts: pa.LargeStringArray, lo: int, hi: int, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The fingerprint of each of the texts ``lo:hi``."""
    flat = Flat(texts, lo, hi)
    data, start, end, owner = _joined_words(flat)
    n = np.bincount(owner, minlength=flat.n)
    out = np.zeros(flat.n, dtype=np.uint64)
    first = np.cumsum(n) - n
    # one shingle from every word that has enough behind it; a shorter text is one shingle
    per = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(flat.n), per)
    head = np.repeat(first, per) + (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per))
    tail = np.minimum(head + words, first[doc] + n[doc]) - 1
    h = xxh64_spans(data, start[head], end[tail])
    # 64 counts per text, in blocks of shingles so that the unpacked bits stay small
    counts = np.zeros((flat.n, 64), dtype=np.int64)
    for a in range(0, len(h), 1 << 16):
        part = doc[a : a + (1 << 16)]
        bits = np.unpackbits(h[a : a + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        counts[part[edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int64)
    set_bits = (counts * 2 > per[:, None]).astype(np.uint8)
    out[:] = np.packbits(set_bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def simhash(docs: DataFrame, text: str = "text", carry: list[str] | None = None, out: str = "print",
            words: int = SHINGLE_WORDS) -> DataFrame:
    """The columns ``carry`` of ``docs`` (default: all but the text) and ``out``, the fingerprint as a signed long."""
    keep = [c for c in docs.columns if c != text] if carry is None else list(carry)
    keep = [c for c in keep if c.lower() != out.lower()]
    (sent,) = own_name(docs, "whole_text")
    at = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch, batch.schema.names[at])
            for lo, hi in chunks(texts):
                value = fingerprints(texts, lo, hi, words).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(lo, hi - lo) for i in range(at)] + [pa.array(value, pa.int64())],
                    names=keep + [out])

    slim = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(sent))
    return slim.mapInArrow(run, slim.select(*[F.col(f"`{c}`") for c in keep]).schema.add(out, "long"))


def _ball(value: Column, width: int, most: int) -> Column:
    """Every value within ``most`` (1 or 2) of the lowest ``width`` bits of ``value``, as rows."""
    second = "sequence(b, {0})" if most == 2 else "array(b)"  # b with itself flips one bit
    flips = F.expr(
        f"concat(array(0L), flatten(transform(sequence(0, {width - 1}), b -> transform({second.format(width - 1)}, "
        "c -> shiftleft(1L, b) | shiftleft(1L, c)))))")
    return F.explode(F.transform(flips, lambda f: value.bitwiseXOR(f)))


def _differ(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _stars(prints: DataFrame, most: int) -> DataFrame:
    """Links ``(a, b)`` of fingerprints within ``2 * most`` bits, each to the smallest that shares a ball value.

    ``prints(p)`` are distinct, so a value is entered by a ball's size of them at most, whatever the input.  The smallest is
    found in the order of the values, without a join: a planner takes a side of exploded rows to be as
    small as what it was exploded from, and would send millions of ball values to the driver.
    """
    entered = prints.select("p", _ball(F.col("p"), 64, most).alias("value"))
    hub = F.min("p").over(Window.partitionBy("value"))
    return entered.select("p", hub.alias("hub")).where("p != hub").select(F.col("hub").alias("a"), F.col("p").alias("b")).distinct()


def linked_prints(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links ``(a, b)`` that connect exactly what the links of distance ``MAX_BITS`` or less connect.

    ``prints(p)``: distinct fingerprints, materialised.  Every row is itself a link within ``MAX_BITS``.
    """
    near = cut(_stars(prints, 1))
    label = connected_components(near, "a", "b").withColumnRenamed("node", "p")
    known = cut(prints.join(label, "p", "left").select("p", F.coalesce("label", "p").alias("label")))
    low, high = F.col("p").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("p", 32)
    table = known.select("p", "label", F.lit(0).alias("segment"), _ball(low, 32, 1).alias("value")).unionByName(
        known.select("p", "label", F.lit(1).alias("segment"), _ball(high, 32, 1).alias("value")))
    share = table.groupBy("segment", "value", "label").agg(F.count(F.lit(1)).alias("k"))
    mixed = share.groupBy("segment", "value").agg(
        F.sum("k").alias("n"), ((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2).alias("pairs")
    ).where("pairs > 0").select("segment", "value", (F.col("pairs") > crowd * F.col("n")).alias("crowded"))
    # merge joins: ball values are never sent to the driver, however few fingerprints they come from
    entries = cut(table.join(mixed.hint("merge"), ["segment", "value"]))
    few = entries.where("NOT crowded")
    pairs = few.select("segment", "value", F.col("p").alias("a"), F.col("label").alias("la")).join(
        few.select("segment", "value", F.col("p").alias("b"), F.col("label").alias("lb")).hint("merge"), ["segment", "value"]
    ).where((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & (_differ("a", "b") <= MAX_BITS))
    dense = _stars(entries.where("crowded").select("p").distinct(), MAX_BITS // 2)
    return near.unionByName(pairs.select("a", "b").distinct()).unionByName(dense)


def simhash_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, fingerprint, component_id)`` of every row: 16 hex digits and the smallest key reachable."""
    (value,) = own_name(docs, "print")
    rows = cut(simhash(spread(docs), text, [key], value).select(F.col(f"`{key}`").alias("k"), F.col(value).alias("p")))
    prints = cut(rows.select("p").distinct())
    links = linked_prints(prints)
    # rows that repeat a key tie its fingerprints together: each to the key's smallest
    repeated = rows.where("k IS NOT NULL").groupBy("k").agg(F.min("p").alias("a"), F.max("p").alias("z")).where("a != z")
    tied = rows.join(repeated.select("k", "a"), "k").where("p != a").select("a", F.col("p").alias("b"))
    label = connected_components(links.unionByName(tied), "a", "b").withColumnRenamed("node", "p")
    placed = rows.groupBy("p").agg(F.min("k").alias("least")).join(label, "p", "left").withColumn(
        "label", F.coalesce("label", "p"))
    smallest = placed.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = placed.join(smallest, "label").select("p", "component_id")
    return rows.join(classes, "p").select(
        F.col("k").alias(key), F.lpad(F.lower(F.hex("p")), 16, "0").alias("fingerprint"), "component_id")
