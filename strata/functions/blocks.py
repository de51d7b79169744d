"""Exact cosine join above a floor by blocks of nodes, for vectors that share frequent terms.

Where prefixes prune little (long texts of one language), the prefix join lists nearly every pair of nodes,
once per shared prefix term, and shuffles what it lists.  Here the nodes are dealt into blocks, a row each, and a task
takes two of these rows from where they are stored: vectors are shuffled once, whatever the number of blocks, and a pair
that is not in the result never leaves its task.

Inside a task only terms that both blocks hold count, as no other is in a dot product.  Every pair is bounded first: the
heaviest terms have a column each, all others share columns that hold the norm of their terms, so the product of two rows
is at least the dot product (Cauchy-Schwarz per shared column).  Pairs whose bound reaches the floor get their exact dot
product.

The bound is taken for every pair: the work is quadratic in the nodes, one product of two short rows a pair.
Memory is bounded by two blocks.  Weights must not be negative.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, release

# Columns of the bound: terms with one of their own, and columns that the other terms share.  Fixed values.
OWN_COLUMNS, SHARED_COLUMNS = 768, 256
# Nodes and vector entries of a block; rows bounded at once.
BLOCK_NODES, BLOCK_ENTRIES = 1 << 14, 1 << 21
SLAB = 512
# The bound is taken in single precision: its largest rounding error over so many columns, and more.
BOUND_SLACK = 2e-4

# Decimals to which distances are rounded before a test of the radius, as in ``similarity.within``.
DISTANCE_DECIMALS = 12

_SCHEMA = "i long, j long, sim double"
# A block as one row: its nodes, whether they are chosen and how many entries they have; term and weight of each entry; the
# terms by offsets into their letters.
_PARTS = [("node", np.int64), ("c", np.bool_), ("size", np.int64), ("code", np.int32), ("u", np.float64),
          ("offset", np.int32), ("letters", np.uint8)]


def _pack(block_nodes: float, block_entries: float):
    """The rows ``(node, term, u, c)`` of a partition as rows of :data:`_PARTS`, a new one at the first node beyond a limit."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, entries, nodes = [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            entries += batch.num_rows
            nodes += pc.count_distinct(batch.column(0)).as_py()
            if entries > block_entries or nodes > block_nodes:
                rows = pa.Table.from_batches(held)
                node = rows["node"].to_numpy()
                other = np.flatnonzero(node != node[-1])
                last = int(other[-1]) + 1 if len(other) else 0  # the last node may go on
                if last:
                    yield _packed(rows.slice(0, last))
                held, entries, nodes = rows.slice(last).to_batches(), len(rows) - last, 1
        if held:
            yield _packed(pa.Table.from_batches(held))

    return pack


def _packed(rows: pa.Table) -> pa.RecordBatch:
    node, at, size = np.unique(rows["node"].to_numpy(), return_inverse=True, return_counts=True)
    chosen = np.zeros(len(node), dtype=np.bool_)
    chosen[at] = rows["c"].to_numpy()
    order = np.argsort(at, kind="stable")
    coded = rows["term"].combine_chunks().dictionary_encode()
    terms = coded.dictionary.cast(pa.string())
    code = coded.indices.fill_null(-1).to_numpy()[order]  # a null term is in no dot product of two nodes
    _, offset, letters = pa.concat_arrays([terms]).buffers()
    offset = np.frombuffer(offset, np.int32)[: len(terms) + 1]
    letters = np.frombuffer(letters, np.uint8)[: offset[-1]] if letters is not None else np.zeros(0, np.uint8)
    values = [node, chosen, size, code, rows["u"].to_numpy()[order], offset, letters]
    return pa.RecordBatch.from_arrays([pa.array([v.astype(t).tobytes()], pa.binary()) for v, (_, t) in zip(values, _PARTS)],
                                      names=[k for k, _ in _PARTS])


class _Block:
    """A block read back."""

    def __init__(self, batch: pa.RecordBatch, row: int, mark: str = ""):
        for name, kind in _PARTS:
            setattr(self, name, np.frombuffer(batch.column(f"{name}{mark}")[row].as_buffer(), kind))
        self.terms = pa.Array.from_buffers(pa.string(), len(self.offset) - 1,
                                           [None, pa.py_buffer(self.offset), pa.py_buffer(self.letters)])


class _Side:
    """The entries of one block whose terms have a number in ``number``, as flat arrays."""

    def __init__(self, block: _Block, number: np.ndarray):
        t = np.append(number, np.int32(-1))[block.code]
        both = t >= 0
        self.node, self.chosen = block.node, block.c
        of = np.repeat(np.arange(len(block.node)), block.size)[both]
        self.size = np.bincount(of, minlength=len(block.node))
        self.start = np.cumsum(self.size) - self.size
        self.t, self.u = t[both], block.u[both]

    def bound_by(self, slot: np.ndarray, slots: int) -> None:
        self.bound = np.zeros((len(self.node), slots), dtype=np.float32)
        for lo in range(0, len(self.node), SLAB):
            hi = min(lo + SLAB, len(self.node))
            a, b = self.start[lo], self.start[hi - 1] + self.size[hi - 1]
            cell = np.repeat(np.arange(hi - lo) * slots, self.size[lo:hi]) + slot[self.t[a:b]]
            square = np.bincount(cell, weights=self.u[a:b] ** 2, minlength=(hi - lo) * slots)
            self.bound[lo:hi] = np.sqrt(square).reshape(hi - lo, slots)


def _sides(a: _Block, b: _Block) -> tuple[_Side, _Side, int]:
    """Both blocks with the terms that they share numbered alike, and the number of these."""
    there = pc.index_in(a.terms, value_set=b.terms)
    met = np.flatnonzero(there.is_valid().to_numpy(zero_copy_only=False))
    left, right = np.full(len(a.terms), -1, np.int32), np.full(len(b.terms), -1, np.int32)
    left[met] = np.arange(len(met))
    right[there.drop_null().to_numpy()] = np.arange(len(met))
    sides, n = (_Side(a, left), _Side(b, right)), len(met)
    slot, slots = np.arange(n), max(n, 1)
    if n > OWN_COLUMNS:  # own columns for the terms that weigh most on both sides
        mass = np.sqrt(math.prod(np.bincount(x.t, weights=x.u**2, minlength=n) for x in sides))
        slot, slots = OWN_COLUMNS + slot % SHARED_COLUMNS, OWN_COLUMNS + SHARED_COLUMNS
        slot[np.argpartition(-mass, OWN_COLUMNS)[:OWN_COLUMNS]] = np.arange(OWN_COLUMNS)
    for x in sides:
        x.bound_by(slot, slots)
    return *sides, n


def _near(left: _Side, right: _Side, terms: int, floor: float, same: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A node, others and their ``cos >= floor``, slab by slab, each pair of nodes once.

    A pair of two chosen nodes that meet in both orientations (``same``: the blocks hold the same nodes, or ``right``
    has all nodes) is taken where the left node is the smaller.
    """
    weight = np.zeros(terms)
    some = right.size > 0
    for lo in range(0, len(left.node), SLAB):
        reach = left.bound[lo : lo + SLAB] @ right.bound.T >= np.float32(floor - BOUND_SLACK)
        reach &= some[None, :] & (left.size[lo : lo + SLAB, None] > 0)
        if same:
            reach &= ~right.chosen[None, :] | (left.node[lo : lo + SLAB, None] < right.node[None, :])
            reach &= left.node[lo : lo + SLAB, None] != right.node[None, :]
        for row in np.flatnonzero(reach.any(axis=1)).tolist():
            of = slice(left.start[lo + row], left.start[lo + row] + left.size[lo + row])
            weight[left.t[of]] = left.u[of]
            other = np.flatnonzero(reach[row])
            size = right.size[other]
            first = np.cumsum(size) - size
            pos = np.repeat(right.start[other] - first, size) + np.arange(size.sum())
            dot = np.add.reduceat(weight[right.t[pos]] * right.u[pos], first)
            weight[left.t[of]] = 0.0
            hit = dot >= floor
            if hit.any():
                yield left.node[lo + row], right.node[other[hit]], dot[hit]


class _Enough:
    """Of the pairs of one task those that DBSCAN needs (:func:`cosine_by_blocks`), node after node."""

    def __init__(self, nodes: np.ndarray, enough: int, reach: float):
        self.nodes, self.enough, self.reach = np.unique(nodes), enough, reach
        self.n = np.zeros(len(self.nodes), dtype=np.int64)
        self.label = np.arange(len(self.nodes))

    def __call__(self, node: int, others: np.ndarray, sim: np.ndarray) -> np.ndarray:
        """Which pairs of the node to keep."""
        near = np.round(np.maximum(0.0, 1.0 - sim), DISTANCE_DECIMALS) <= round(self.reach, DISTANCE_DECIMALS)
        keep = np.zeros(len(others), dtype=np.bool_)
        at = np.flatnonzero(near)
        if not len(at):
            return keep
        a, b = int(np.searchsorted(self.nodes, node)), np.searchsorted(self.nodes, others[at])
        few = self.n[b] < self.enough
        few[: max(0, self.enough - int(self.n[a]))] = True
        self.n[a] += len(at)
        self.n[b] += 1  # a node's others are different ones
        keep[at[few]] = True
        # both ends of the rest are core: one pair joins two components
        rest = np.flatnonzero(~few)
        new, first = np.unique(self.label[b[rest]], return_index=True)
        fresh = new != self.label[a]
        if fresh.any():
            keep[at[rest[first[fresh]]]] = True
            self.label[np.isin(self.label, new[fresh])] = self.label[a]
        return keep


def _block_join(floor: float, half: bool, enough: int | None, reach: float):
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                left, right, n = _sides(_Block(batch, row), _Block(batch, row, "_"))
                same = not half or batch.column("b")[row].as_py() == batch.column("b_")[row].as_py()
                choose = None if enough is None else _Enough(np.concatenate([left.node, right.node]), enough, reach)
                held, found = [], 0
                for node, others, sim in _near(left, right, n, floor, same):
                    if choose is not None:
                        kept = choose(node, others, sim)
                        others, sim = others[kept], sim[kept]
                    held.append((np.minimum(node, others), np.maximum(node, others), sim))
                    found += len(others)
                    if found >= 1 << 16:
                        yield _batch(held)
                        held, found = [], 0
                if held:
                    yield _batch(held)

    return join


def _batch(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], names=["i", "j", "sim"])


def _diagonal(floor: float):
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = _Block(batch, row)
                sim = np.bincount(np.repeat(np.arange(len(block.node)), block.size), weights=block.u**2)
                hit = sim >= floor
                yield _batch([(block.node[hit], block.node[hit], sim[hit])])

    return own


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield pa.RecordBatch.from_arrays([pa.array(_Block(batch, row).node)], names=["node"])


def _blocks(rows: DataFrame, n: int, partitions: int, block_nodes: int, block_entries: int) -> DataFrame:
    """The ``rows(node, term, u, c)`` as blocks, ``(b, ...)``, a row each, materialised: ``n``, or a few times as many.

    Where no more ``partitions`` than that hold whole nodes, as a scan of texts leaves them, they are packed as they are.  Whether
    they do is seen in the stored blocks: if a node is in two of them, all are dealt by node instead.
    """
    schema = ", ".join(f"{k} binary" for k, _ in _PARTS)
    rows = rows.select(F.col("node").cast("long").alias("node"), F.col("term").cast("string").alias("term"), "u", "c")

    def stored(rows: DataFrame, *limits: float) -> DataFrame:
        packed = rows.mapInArrow(_pack(*limits), schema)
        blocks = cut(packed.select(F.monotonically_increasing_id().alias("b"), "*"))
        release(blocks.sparkSession)
        return blocks

    if partitions <= 2 * n:
        blocks = stored(rows, block_nodes, block_entries)
        if blocks.mapInArrow(_nodes, "node long").groupBy("node").count().where("count > 1").limit(1).count() == 0:
            return blocks
        del blocks
    # the rows of a node lie apart in a partition: one block each
    return stored(rows.repartition(n, "node"), math.inf, math.inf).coalesce(n)


def cosine_by_blocks(unit: DataFrame, floor: float, changed: DataFrame | None = None,
                     block_nodes: int = BLOCK_NODES, block_entries: int = BLOCK_ENTRIES,
                     enough: int | None = None, reach: float = 1.0) -> DataFrame:
    """Half matrix ``(i, j, sim)`` with ``i <= j`` of all pairs with ``cos >= floor > 0``, diagonal included.

    With ``enough`` it has only pairs within the radius ``reach``, and of these as many as DBSCAN at that radius with up to so
    many ``min_samples`` needs for the same clusters: in each task every pair of a node that has fewer there, the
    first ``enough`` of any other, and pairs that join all nodes with more as all their pairs do.  The rows
    then grow with nodes and blocks, not with pairs.

    ``unit(node, term, u)``: unit vectors, from materialised tables.  ``changed(node)`` restricts the result to pairs with
    one of these nodes: their blocks alone stand on the left.
    """
    rows = unit.select("node", "term", "u")
    if changed is None:
        rows = rows.withColumn("c", F.lit(True))
    else:
        mark = changed.select("node").distinct().withColumn("c", F.lit(True))
        rows = rows.join(mark, "node", "left").withColumn("c", F.coalesce("c", F.lit(False)))
    seen = rows.withColumn("at", F.spark_partition_id()).groupBy("c").agg(F.approx_count_distinct("node").alias("n"), F.count(F.lit(1)).alias("entries"),
                                 F.collect_set("at").alias("at")).collect()
    partitions = len({p for r in seen for p in r["at"]})
    size = {r["c"]: (r["n"], r["entries"]) for r in seen}
    some, rest = size.get(True, (0, 0)), size.get(False, (0, 0))
    tasks = 2 * unit.sparkSession.sparkContext.defaultParallelism

    def blocks(n: int, entries: int, least: float) -> int:
        return max(math.ceil(n / block_nodes), math.ceil(entries / block_entries), min(math.ceil(least), n), 1)

    if changed is None:
        left = right = _blocks(rows, blocks(*some, math.sqrt(2 * tasks)), partitions, block_nodes, block_entries)
    else:
        gl = blocks(*some, 1)
        left = _blocks(rows.where("c"), gl, partitions, block_nodes, block_entries)
        right = _blocks(rows, blocks(some[0] + rest[0], some[1] + rest[1], tasks / gl), partitions, block_nodes, block_entries)
    # a product of stored partitions: no block is shuffled or sent to the driver
    other = right.select(*[F.col(c).alias(f"{c}_") for c in right.columns]).hint("shuffle_replicate_nl")
    met = left.join(other, F.col("b") <= F.col("b_")) if changed is None else left.crossJoin(other)
    names = ["b", "b_", *(f"{k}{mark}" for mark in ("", "_") for k, _ in _PARTS)]
    pairs = met.select(*names).mapInArrow(_block_join(floor, changed is None, enough, reach), _SCHEMA)
    return left.mapInArrow(_diagonal(floor), _SCHEMA).unionByName(pairs)
