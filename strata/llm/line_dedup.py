r"""Line deduplication with a deletion-neighbourhood join (operator 9).

Lines of all documents that are equal, or at most ``max_edits`` edits (a code point inserted, deleted or replaced) apart,
form classes; of each class the earliest occurrence stays, by document key, then line number.

One edit:

A line emits its variants within the bound, itself and the line without each of its code
points, as hashed keys.  Two lines are one edit apart if and only if they give the same
variant by a deletion at the same place (a replacement), or a deletion of one gives the
other (an insertion); so variants are joined under (variant, place) and under (variant, line).  The lines
that share a (variant, place) differ pairwise in that one code point, so a star around the
smallest finds every link's class without listing pairs.  Joined lines are verified by their edit distance.

Only lines with a partner are worth their variants: of two lines one edit apart the half
before or the half behind the edit is equal, so a line whose both half keys
(for its own length and for one less) occur on no other line has no partner.  This
filter is exact.  It also says in which half a line needs variants.

More edits: a line is split into ``max_edits + 1`` parts, and of two lines within the bound one part of the shorter
stands unchanged in the longer, shifted by no more than the edits before and behind it allow (Li, Deng,
Wang, Feng: "Pass-Join", 2011).  Lines whose part keys occur on no other line have no partner, which is exact again.
Part keys are packed and dealt by key, and a task looks up the repeated ones among its own.  Lines that share a key
become a pair if the parities of their code points (64 classes) differ in at most two classes an edit and those of their
neighbouring code points (256 classes) in at most four, and a link if their edit distance says so.  Links are listed, as
they are counted.

Lines are compared as they are, without a trailing \r.  Lines of at least ``min_chars`` code points are compared with the
edit bound; shorter ones with a word, of at least ``exact_chars`` code points, for equality only (None: not at all).
Lines without a word that are shorter than ``min_chars`` are left alone.  Line identity is a hash of 128 bits.

Edge cases: a null text has no lines to compare and stays null; documents of a null key are neither compared nor changed;
rows that repeat a key and text count as one document, rows that repeat a key with other texts as one
document too, earliest line number first; ties cannot occur between keys; extra columns are carried by :func:`drop_repeated_lines`;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.schema_safe import own_name
from strata.llm.text_arrays import SPACE, Flat, chunks, mix, text_column
from strata.operators.components import connected_components
from strata.session import checkpoint_dir

#: What the query and the pipeline ask for.
MAX_EDITS = 2
EXACT_CHARS = 1
MIN_CHARS = 24
#: Up to so many occurrences to look up (16 MB) are broadcast; more are joined by a shuffle.
SMALL_LOOKUP = 400_000
#: Part keys packed at once by a task; text whose part keys a task looks up at once.
PACKED_KEYS = 1 << 20
BUCKET_BYTES = 8 << 20
#: Words of 64 bits that hold the parities of neighbouring code points.
SKETCH = 4
HALVES = ("p0", "s0", "p1", "s1")  # front and rear half, for pairs whose shorter line has this length, or one less


def _kept(df: DataFrame) -> DataFrame:
    if not checkpoint_dir(df.sparkSession):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    return df.checkpoint(eager=True)


class Lines:
    """The comparable lines of one chunk of texts: hashes, half or part keys, place."""

    def __init__(self, flat: Flat, min_chars: int, exact_chars: int | None):
        start, end, owner = flat.lines()
        first = np.searchsorted(owner, np.arange(flat.n))
        number = np.arange(len(owner)) - first[owner] if len(owner) else owner
        carriage = (end > start) & (flat.buf[np.maximum(end - 1, 0)] == 0x0D) if len(flat.buf) else end > start
        end = end - carriage
        points = flat.code_points()
        size = points[end] - points[start]
        long_enough = size >= max(min_chars, 1)
        near = long_enough
        if exact_chars is not None:
            ink = np.append(0, np.cumsum(~SPACE[flat.buf]))
            long_enough = near | ((size >= exact_chars) & (ink[end] > ink[start]))
        #: compared with the edit bound, not for equality only
        self.near = near[long_enough]
        self.start, self.end = start[long_enough], end[long_enough]
        self.owner, self.number = owner[long_enough], number[long_enough]
        self.n_lines = np.bincount(owner, minlength=flat.n) if len(owner) else np.zeros(flat.n, dtype=np.int64)
        self.flat, self.points = flat, points
        self.prefix = flat.prefix_hash()
        self.h1 = Flat.span_hash(self.prefix, self.start, self.end)
        self.h2 = Flat.span_hash(flat.prefix_hash(1), self.start, self.end, 1)

    @cached_property
    def at(self) -> np.ndarray:
        """Byte position of every code point."""
        return np.append(np.flatnonzero((self.flat.buf & 0xC0) != 0x80), len(self.flat.buf))

    def half_keys(self) -> list[np.ndarray]:
        s, e, prefix = self.start, self.end, self.prefix
        c = self.points[s]
        size = self.points[e] - c
        out = []
        for less in (0, 1):
            a = size - less
            front = self.at[c + a // 2]
            rear = self.at[c + size - (a - a // 2)]
            out.append(mix(Flat.span_hash(prefix, s, front) + (4 * a + 1).astype(np.uint64)))
            out.append(mix(Flat.span_hash(prefix, rear, e) + (4 * a + 2).astype(np.uint64)))
        return out


    def part_keys(self, max_edits: int, min_chars: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Of the near lines: their numbers here, the keys of their parts, and of what may be a part of a shorter line."""
        rows = np.flatnonzero(self.near)
        c = self.points[self.start[rows]]
        size = self.points[self.end[rows]] - c
        own, other = [], []
        for less in range(max_edits + 1):
            short = size - less
            for i in range(max_edits + 1):
                lo, hi = i * short // (max_edits + 1), (i + 1) * short // (max_edits + 1)
                rest = max_edits - i
                for shift in range(max(-i, less - rest), min(i, less + rest) + 1):
                    fits = (short >= max(min_chars, 1)) & (lo + shift >= 0) & (hi + shift <= size)
                    a, b = (np.where(fits, c + x + shift, c) for x in (lo, hi))
                    part = Flat.span_hash(self.prefix, self.at[a], self.at[b])
                    part = mix(part + (short * (max_edits + 1) + i).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    (other if less or shift else own).append(np.ma.masked_array(part.view(np.int64), ~fits))
        return rows, own, other


def _print(text: str):
    """Tells apart the texts of rows that repeat a key."""
    return F.xxhash64(F.col(text).cast("string")).alias("print")


def line_table(docs: DataFrame, key: str, text: str, min_chars: int, exact_chars: int | None, halves: bool) -> DataFrame:
    """One row per document: ``(key, print, n_lines, lines)``, ``print`` a hash of the text, lines as structs ``(number, h1, h2)``, and p0, s0, p1, s1."""
    key_type = docs.schema[key].dataType.simpleString()
    names = ["number", "h1", "h2", *(HALVES if halves else ())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch, "text")
            for lo, hi in chunks(texts):
                lines = Lines(Flat(texts, lo, hi), min_chars, exact_chars)
                off = np.zeros(hi - lo + 1, dtype=np.int32)
                np.cumsum(np.bincount(lines.owner, minlength=hi - lo), out=off[1:])
                cols = [pa.array(lines.number.astype(np.int64))]
                cols += [pa.array(x.view(np.int64)) for x in (lines.h1, lines.h2)]
                if halves:
                    cols += [pa.array(x.view(np.int64), mask=~lines.near) for x in lines.half_keys()]
                items = pa.StructArray.from_arrays(cols, names=names)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo),
                     pa.array(lines.n_lines.astype(np.int64)), pa.ListArray.from_arrays(pa.array(off), items)],
                    names=["key", "print", "n_lines", "lines"])

    slim = docs.where(F.col(key).isNotNull()).select(
        F.col(key).alias("key"), F.col(text).cast("string").alias("text"), _print(text))
    fields = ", ".join(f"{n}: bigint" for n in names)
    return slim.mapInArrow(read, f"key {key_type}, print long, n_lines long, lines array<struct<{fields}>>")


def part_table(docs: DataFrame, key: str, text: str, min_chars: int, max_edits: int, buckets: int) -> DataFrame:
    """``(bucket, own, other)``: packed pairs of part key and line hash of every near line, dealt by part key.

    ``own`` holds the parts of a line's own length and place, ``other`` what may be a part of a shorter line.
    """

    def packed(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.BinaryArray:
        part, line = (np.concatenate(x) for x in zip(*held))
        bucket = part % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        off = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64)).astype(np.int32) * 16
        pairs = np.stack([part[order], line[order]], axis=1)
        return pa.BinaryArray.from_buffers(pa.binary(), buckets, [None, pa.py_buffer(off), pa.py_buffer(pairs)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])

        def flushed() -> pa.RecordBatch:
            columns = [pa.array(np.arange(buckets)), *map(packed, held)]
            held[0].clear(), held[1].clear()
            return pa.RecordBatch.from_arrays(columns, names=["bucket", "own", "other"])

        for batch in batches:
            texts = text_column(batch, "text")
            for lo, hi in chunks(texts):
                lines = Lines(Flat(texts, lo, hi), min_chars, None)
                rows, *kinds = lines.part_keys(max_edits, min_chars)
                # a line that repeats within the chunk is sent once
                once = np.unique(lines.h1[rows], return_index=True)[1]
                line = lines.h1[rows][once]
                for keys, of in zip(kinds, held):
                    table = np.ma.stack([x[once] for x in keys], axis=1)
                    fits = ~np.ma.getmaskarray(table)
                    of.append((table.data[fits].view(np.uint64), np.repeat(line, fits.sum(axis=1))))
                if sum(len(x) for of in held for x, _ in of) >= PACKED_KEYS:
                    yield flushed()
        if held[0]:
            yield flushed()

    slim = docs.where(F.col(key).isNotNull()).select(F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(read, "bucket long, own binary, other binary").where(
        (F.octet_length("own") > 0) | (F.octet_length("other") > 0))


def _shared_parts(table: pa.Table) -> pa.Table:
    """``(part, own, h1)`` of the parts that two lines or more have, one of them as its own; each line once a part."""
    own, other = (np.frombuffer(b"".join(table[c].to_pylist()), np.uint64).reshape(-1, 2) for c in ("own", "other"))
    part, line = np.concatenate([own, other]).T
    mine = np.arange(len(part)) < len(own)
    order = np.argsort(part)
    again = part[order][1:] == part[order][:-1]
    at = order[np.append(again, False) | np.append(False, again)] if len(order) else order
    part, line, mine = part[at], line[at], mine[at]
    order = np.lexsort((~mine, line, part))
    part, line, mine = part[order], line[order], mine[order]
    new = np.ones(len(part), dtype=bool)
    new[1:] = (part[1:] != part[:-1]) | (line[1:] != line[:-1])
    part, line, mine = part[new], line[new], mine[new]
    first = np.ones(len(part), dtype=bool)
    first[1:] = part[1:] != part[:-1]
    start = np.flatnonzero(first)
    n = np.diff(np.append(start, len(part)))
    shared = np.repeat((n > 1) & np.logical_or.reduceat(mine, start), n) if len(start) else first
    return pa.table({"part": pa.array(part[shared].view(np.int64)), "own": pa.array(mine[shared]),
                     "h1": pa.array(line[shared].view(np.int64))})


def _sketched(lines: DataFrame) -> DataFrame:
    """``(id, h1, parity, s0 ...)``: which classes of code points, and of neighbours, occur an odd number of times in a line.

    An edit changes two classes of code points at most, and four of neighbours.
    """
    bit = np.uint64(1) << np.arange(64, dtype=np.uint64)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch, "line")
            for lo, hi in chunks(texts):
                whole = texts.slice(lo, hi - lo).to_pylist()
                code = np.frombuffer("".join(whole).encode("utf-32-le"), np.uint32).astype(np.uint64)
                end = np.cumsum([len(x) for x in whole])
                start = np.append(0, end)[:-1]

                def odd(bits: np.ndarray) -> pa.Array:
                    total = np.append(np.uint64(0), np.bitwise_xor.accumulate(bits))
                    return pa.array((total[end] ^ total[start]).view(np.int64))

                two = mix((code << np.uint64(32)) + np.append(code[1:], np.uint64(0))) % np.uint64(64 * SKETCH)
                inner = np.ones(len(code), dtype=bool)
                inner[end[end > start] - 1] = False
                cols = [odd(bit[code & np.uint64(63)])] + [
                    odd(np.where(inner & (two >> np.uint64(6) == k), bit[two & np.uint64(63)], np.uint64(0)))
                    for k in range(SKETCH)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(lo, hi - lo) for i in (0, 1)] + cols,
                    names=["id", "h1", "parity", *(f"s{k}" for k in range(SKETCH))])

    return lines.select("id", "h1", "line").mapInArrow(
        sketch, "id long, h1 long, parity long, " + ", ".join(f"s{k} long" for k in range(SKETCH)))


def near_pairs(
    docs: DataFrame, distinct: DataFrame, key: str, text: str, min_chars: int, max_edits: int, small: int
) -> DataFrame:
    """``(a, b, group)``: every two distinct lines at most ``max_edits`` edits apart, verified; ``group`` is null."""
    total = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    buckets = max(4 * docs.sparkSession.sparkContext.defaultParallelism, math.ceil(total / BUCKET_BYTES))
    parts = part_table(docs, key, text, min_chars, max_edits, buckets)
    live = _kept(parts.groupBy("bucket").applyInArrow(_shared_parts, "part long, own boolean, h1 long"))
    wanted = _kept(distinct.join(live.select("h1").distinct(), "h1").select("id", "h1", "first"))
    lines = _texts(docs, wanted, key, text, small)
    live = live.join(_sketched(lines), "h1").drop("h1")
    words = ["parity", *(f"s{k}" for k in range(SKETCH))]
    left = live.where("own").select("part", F.col("id").alias("a"), *[F.col(w).alias(f"{w}_a") for w in words])
    right = live.select("part", F.col("id").alias("b"), *[F.col(w).alias(f"{w}_b") for w in words])
    apart = [F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b"))) for w in words]
    near = (apart[0] <= 2 * max_edits) & (sum(apart[2:], apart[1]) <= 4 * max_edits)
    pairs = left.join(right, "part").where((F.col("a") != F.col("b")) & near).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return _verified(pairs.withColumn("group", F.lit(None).cast("long")), lines, max_edits)


def _texts(docs: DataFrame, wanted: DataFrame, key: str, text: str, small: int) -> DataFrame:
    """``wanted`` with ``line``, the text of the line that first occurs at ``first`` (key, number, print of the text)."""
    columns = [c for c in wanted.columns if c != "first"]
    wanted = wanted.select("first.key", "first.number", "first.print", *columns)
    per_doc = wanted.groupBy("key", "print").agg(F.collect_list(F.struct("number", *columns)).alias("want"))
    slim = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), _print(text))
    few = wanted.limit(small + 1).count() <= small
    texts = slim.join(F.broadcast(per_doc) if few else per_doc, ["key", "print"])
    lines = texts.withColumn("all", F.split("text", "\n", -1)).select("all", F.explode("want").alias("w"))
    lines = lines.select("w.*", F.regexp_replace(F.get("all", F.col("w.number").cast("int")), "\r$", "").alias("line"))
    return _kept(lines.where("line is not null").dropDuplicates(["id"]).select(*columns, "line"))


def _verified(pairs: DataFrame, lines: DataFrame, max_edits: int) -> DataFrame:
    pairs = pairs.join(lines.select(F.col("id").alias("a"), F.col("line").alias("line_a")), "a").join(
        lines.select(F.col("id").alias("b"), F.col("line").alias("line_b")), "b")
    distance = F.levenshtein("line_a", "line_b", max_edits)  # -1 beyond the bound
    return pairs.where((distance >= 0) & (distance <= max_edits)).select("a", "b", "group")


def _variants(live: DataFrame) -> DataFrame:
    """``(id, variant, place)``: deletions of live lines in the halves asked for (``front``, ``rear``)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch, "line")
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            front, rear = (batch.column(i).to_numpy(zero_copy_only=False).astype(bool) for i in (2, 3))
            for lo, hi in chunks(texts, 1 << 18):
                flat = Flat(texts, lo, hi)
                points, prefix = flat.code_points(), flat.prefix_hash()
                at = np.append(np.flatnonzero((flat.buf & 0xC0) != 0x80), len(flat.buf))
                size = points[flat.off[1:]] - points[flat.off[:-1]]
                line = np.repeat(np.arange(flat.n), size)
                place = np.arange(len(line)) - np.repeat(np.cumsum(size) - size, size)
                # an edit stands in the rear half of a pair that agrees in the front half; halves meet in the middle
                middle = size[line] // 2
                wanted = (front[lo:hi][line] & (place <= middle)) | (rear[lo:hi][line] & (place >= middle - 1))
                point = np.flatnonzero(wanted)
                line, place = line[wanted], place[wanted]
                v = Flat.hash_without(prefix, flat.off[line], at[point], at[point + 1], flat.off[line + 1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[lo:hi][line]), pa.array(v.view(np.int64)), pa.array(place.astype(np.int64))],
                    names=["id", "variant", "place"])

    return live.select("id", "line", "front", "rear").mapInArrow(emit, "id long, variant long, place long")


def near_links(docs: DataFrame, distinct: DataFrame, key: str, text: str, small: int) -> DataFrame:
    """``(a, b, group)``: verified links between distinct lines; lines of one ``group`` are all one edit apart.

    ``distinct`` has one row per distinct line: ``id``, its first occurrence ``(key, number)``, hash and half keys.
    """
    halves = distinct.select("id", F.explode(F.array(*[
        F.struct(F.col(h).alias("half"), F.lit(h[0] == "p").alias("is_front")) for h in HALVES])).alias("x"))
    halves = halves.select("id", "x.half", "x.is_front").where("half is not null")
    shared = halves.groupBy("half").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low != high")
    live = halves.join(shared.select("half"), "half").groupBy("id").agg(
        # equal front halves: the edit is behind
        F.max(F.col("is_front")).alias("rear"), F.max(~F.col("is_front")).alias("front"))
    live = _kept(live.join(distinct.select("id", "h1", "first"), "id"))
    # the texts of the live lines, from their first occurrences
    lines = _texts(docs, live.select("id", "h1", "front", "rear", "first"), key, text, small)

    variants = _variants(lines)
    same = variants.groupBy("variant", "place").agg(F.collect_set("id").alias("ids")).where(F.size("ids") > 1)
    stars = same.select(F.array_min("ids").alias("a"), F.explode("ids").alias("b"),
                        F.xxhash64("variant", "place").alias("group")).where("a != b")
    inserted = variants.join(lines.select(F.col("h1").alias("variant"), F.col("id").alias("a")), "variant").select(
        "a", F.col("id").alias("b"), F.lit(None).cast("long").alias("group")).where("a != b").distinct()
    pairs = stars.unionByName(inserted)
    return _verified(pairs, lines, 1)


def line_classes(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    min_chars: int = MIN_CHARS,
    small: int = SMALL_LOOKUP,
    exact_chars: int | None = None,
    max_edits: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """``(per document line table, repeated lines)``.

    The second has one row per distinct line that occurs more than once or has a link: ``(h1, h2, n, first, n_links,
    id, class)``; ``class`` is the id of its class, ``first`` the earliest occurrence in the class.
    """
    if max_edits < 1:
        raise ValueError("max_edits must be at least 1")
    table = line_table(docs, key, text, min_chars, exact_chars, halves=max_edits == 1)
    flat = table.select("key", "print", F.explode("lines").alias("l")).select("key", "print", "l.*")
    distinct = flat.groupBy("h1", "h2").agg(
        F.min(F.struct("key", "number", "print")).alias("first"), F.count("*").alias("n"),
        *[F.first(h).alias(h) for h in (HALVES if max_edits == 1 else ())])
    distinct = _kept(distinct.withColumn("id", F.xxhash64("h1", "h2")))
    links = _kept(near_links(docs, distinct, key, text, small) if max_edits == 1 else
                  near_pairs(docs, distinct, key, text, min_chars, max_edits, small))
    # in a group of m lines every line has m - 1 links; the star holds the m - 1 others
    grouped = links.where("group is not null")
    ends = grouped.select(F.col("b").alias("id"), "group").unionByName(
        grouped.select(F.col("a").alias("id"), "group").distinct())
    size = grouped.groupBy("group").agg(F.count("*").alias("others"))
    single = links.where("group is null")
    n_links = ends.join(size, "group").select("id", "others").unionByName(
        single.select(F.col("a").alias("id"), F.lit(1).cast("long").alias("others"))).unionByName(
        single.select(F.col("b").alias("id"), F.lit(1).cast("long").alias("others")))
    n_links = n_links.groupBy("id").agg(F.sum("others").alias("n_links"))
    classes = connected_components(links, "a", "b").withColumnRenamed("node", "id").withColumnRenamed("label", "class")
    linked = distinct.join(classes, "id").join(n_links, "id")
    linked = linked.select("h1", "h2", "n", "first", "n_links", "id", "class")
    firsts = linked.groupBy("class").agg(F.min("first").alias("first"))
    linked = linked.drop("first").join(firsts, "class").select("h1", "h2", "n", "first", "n_links", "id", "class")
    alone = distinct.where("n > 1").join(classes, "id", "left_anti").select(
        "h1", "h2", "n", "first", F.lit(0).cast("long").alias("n_links"), "id", F.col("id").alias("class"))
    return table, linked.unionByName(alone)


def repeated_lines(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    min_chars: int = MIN_CHARS,
    small: int = SMALL_LOOKUP,
    exact_chars: int | None = None,
    max_edits: int = 1,
) -> DataFrame:
    """One row per document key: ``(key, n_lines, dropped, n_links, classes)``.

    ``dropped``: numbers (from 0) of the lines that repeat an earlier line of their class, in order; ``n_links``:
    links of its lines to other line texts; ``classes``: the classes of its lines that are shared or linked, in order.
    """
    table, repeated = line_classes(docs, key, text, min_chars, small, exact_chars, max_edits)
    flat = table.select("key", F.explode("lines").alias("l")).select("key", "l.number", "l.h1", "l.h2")
    # rows that repeat a key and its text count once
    hit = flat.join(repeated, ["h1", "h2"]).dropDuplicates(["key", "number", "h1", "h2"])
    stays = (F.col("first.key") == F.col("key")) & (F.col("first.number") == F.col("number"))
    per = hit.groupBy("key").agg(
        F.array_sort(F.array_distinct(F.collect_list(F.when(~stays, F.col("number"))))).alias("dropped"),
        F.sum("n_links").alias("n_links"), F.array_sort(F.collect_set("class")).alias("classes"))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    n_lines = F.octet_length(body) - F.octet_length(F.replace(body, F.lit("\n"), F.lit(""))) + 1
    every = docs.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(
        F.max(n_lines).cast("long").alias("n_lines"))
    none = F.expr("cast(array() as array<bigint>)")
    return every.join(per, "key", "left").select(
        F.col("key").alias(key), "n_lines", F.coalesce("dropped", none).alias("dropped"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("classes", none).alias("classes"))


def drop_repeated_lines(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    min_chars: int = MIN_CHARS,
    small: int = SMALL_LOOKUP,
    exact_chars: int | None = None,
    max_edits: int = 1,
) -> DataFrame:
    """``docs`` without the lines that repeat an earlier one; a document left without a word goes.

    A column ``n_chars`` gets the new number of code points.  A document that had no word before stays.
    """
    found = repeated_lines(docs, key, text, min_chars, small, exact_chars, max_edits).where(F.size("dropped") > 0)
    own_key, own_drop = own_name(docs, "line_key", "line_drop")
    found = found.select(F.col(key).alias(own_key), F.col("dropped").alias(own_drop))
    rows = docs.join(found, F.col(key) == F.col(own_key), "left")
    left = F.array_join(F.filter(F.split(F.col(text), "\n", -1), lambda x, i: ~F.array_contains(own_drop, i.cast("long"))),
                        "\n")
    changed = F.col(own_drop).isNotNull()
    rows = rows.withColumn(text, F.when(changed, left).otherwise(F.col(text)))
    rows = rows.where(~changed | F.col(text).rlike("[^\\x20\\x09-\\x0D]"))
    if "n_chars" in docs.columns:
        count = F.length(text).cast(docs.schema["n_chars"].dataType)
        rows = rows.withColumn("n_chars", F.when(changed, count).otherwise(F.col("n_chars")))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
