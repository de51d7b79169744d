r"""Quality by the perplexity of an n-gram language model (operator 10).

An interpolated modified Kneser-Ney model per language is trained on the trusted
documents, whole texts, and gives every document its perplexity; a document is kept if its perplexity is
at most a quantile of that of its language's trusted documents.

The symbols are characters.  A text is one sequence: a start mark, its words with one separator between
two of them (whatever white space stands there), and an end mark; n-grams run across word borders, so
the order of words and their repetition count.  A task works on distinct units: a word, the symbol behind it and
the ``order - 1`` symbols in front of it, which fix all n-grams that end in the word.

With ``across=False`` every word is a sequence of its own between the marks: a bag of words.

A first pass counts the n-grams of all documents, the trusted ones' occurrences apart; from these
counts joins by n-gram give the model's tables and the score of every n-gram of the corpus, length by
length.  A second pass turns blocks of documents of one language into sparse counts (document, n-gram) and
splits them by n-gram into shards; each meets its shard of the scores, and the partial sums of a
document are added up.  Blocks are dealt over ``turns`` copies of the scores, so a task holds a bounded part of both
sides.  Texts are never shuffled, the model is never collected or broadcast, and it is counted over all trusted text.

Model, for n-grams up to ``order``: an n-gram that is as long as ``order`` or begins with the start mark counts its
occurrences; a shorter one counts the distinct symbols in front of it.  With t1 to t4 the numbers
of n-grams of one length that count 1 to 4 and y = t1 / (t1 + 2 t2), the discounts are 1 - 2y t2/t1,
2 - 3y t3/t2 and 3 - 4y t4/t3 (where a t is 0 or a discount falls outside its range, half a count).
The unigrams are interpolated with the uniform distribution over the language's symbols and one more.

Edge cases: a null, empty or blank text has no perplexity and is kept (other rules judge
length); so is a text of fewer than ``min_words`` words, and every document of a
language without trusted text; a null label is no trust; documents with equal
keys are scored row by row; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.quality_rules import language_code
from strata.llm.text_arrays import Flat, chunks, mix, text_column
from strata.session import checkpoint_dir

ORDER = 5
BLOCK_BYTES = 2 << 20
SLICE_WORDS = 1 << 15
#: Text whose sparse counts one task of the second pass takes.
TASK_BYTES = 32 << 20
QUANTILE = 0.995
MIN_WORDS = 20
#: Up to so many trusted keys (16 MB) are broadcast; more are joined by a shuffle.
SMALL_KEYS = 2_000_000
START, END, BETWEEN = " ", "\n", "\t"  # never part of a word


def running(flat: Flat, start: np.ndarray, end: np.ndarray, owner: np.ndarray) -> tuple[Flat, np.ndarray, np.ndarray]:
    """The texts as sequences of their words, marks and separators; where each word starts and ends there."""
    first = np.ones(len(owner), dtype=bool)
    first[1:] = owner[1:] != owner[:-1]
    last = np.append(first[1:], True)[: len(owner)]
    size = end - start
    to = np.cumsum(size + 1 + first) - size - 1
    buf = np.empty(int(to[-1] + size[-1] + 1) if len(to) else 0, dtype=np.uint8)
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    buf[np.repeat(to, size) + within] = flat.buf[np.repeat(start, size) + within]
    buf[to[first] - 1] = ord(START)
    buf[to + size] = np.where(last, ord(END), ord(BETWEEN))
    off = np.zeros(flat.n + 1, dtype=np.int64)
    np.cumsum(np.bincount(owner, weights=size + 1 + first, minlength=flat.n), out=off[1:])
    line = pa.LargeStringArray.from_buffers(flat.n, pa.py_buffer(off), pa.py_buffer(buf))
    return Flat(line), to, to + size


class BlockGrams:
    """Distinct units of the texts of one language and the n-grams that end at each of their symbols.

    A unit is a word with the symbols in front of it that its n-grams reach, and the symbol behind it.
    """

    def __init__(self, texts: pa.LargeStringArray, order: int, across: bool):
        self.doc_words = np.zeros(len(texts), dtype=np.int64)
        heads, owners, spans, fronts = [], [], [], []
        for lo, hi in chunks(texts):
            flat = Flat(texts, lo, hi)
            start, end, owner = flat.words()
            self.doc_words[lo:hi] = np.bincount(owner, minlength=hi - lo)
            front = np.ones(len(start), dtype=np.int64)
            if across:
                flat, start, end = running(flat, start, end, owner)
                points = flat.code_points()
                at = np.flatnonzero((flat.buf & 0xC0) != 0x80)
                front = np.minimum(points[start] - points[flat.off[owner]], order - 1)
                start, end = at[points[start] - front] if len(at) else start, end + 1
            word = Flat.span_hash(flat.prefix_hash(), start, end)
            distinct, first = np.unique(word, return_index=True)
            raw = flat.buf.tobytes()
            spans += [raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())]
            fronts.append(front[first])
            heads.append(distinct)
            owners.append((word, owner + lo))
        every = np.concatenate(heads) if heads else np.zeros(0, np.uint64)
        self.hashes, at = np.unique(every, return_index=True)
        words = [spans[i].decode("utf-8", "replace") for i in at.tolist()]
        words = words if across else [START + w + END for w in words]
        front = np.concatenate(fronts)[at] if fronts else np.zeros(0, np.int64)
        #: (unit number, text) of every word of the block
        self.uses = [(np.searchsorted(self.hashes, w).astype(np.int32), o.astype(np.int32)) for w, o in owners]
        line = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        begins = np.cumsum(sizes) - sizes
        depth = np.arange(len(line)) - np.repeat(begins, sizes)  # symbols of the unit in front
        at = np.flatnonzero(depth >= np.repeat(front, sizes))
        self.n_events = sizes - front
        self.first_event = np.cumsum(self.n_events) - self.n_events
        del words, spans
        grams = np.zeros((len(at), order), dtype=np.uint32)
        for k in range(order):
            has = depth[at] >= k
            grams[has, order - 1 - k] = line[at[has] - k]
        key = np.zeros(len(at), dtype=np.uint64)
        for k in range(order):
            key = key * np.uint64(0x9E3779B97F4A7C15) + grams[:, k].astype(np.uint64) + np.uint64(1)
            key ^= key >> np.uint64(29)
        _, pick, event = np.unique(key, return_index=True, return_inverse=True)
        self.event = event.astype(np.int32)
        chosen = grams[pick]
        del key, grams, line, depth
        # strings pad with zeros behind, so shift the shorter ones to the front
        short = (chosen == 0).sum(axis=1)
        for k in range(1, order):
            rows = short == k
            chosen[rows, : order - k] = chosen[rows, k:]
            chosen[rows, order - k :] = 0
        self.grams = np.ascontiguousarray(chosen).view(f"<U{order}").ravel()

    def counts(self, trusted: np.ndarray) -> np.ndarray:
        """Occurrences of each distinct n-gram in the trusted texts."""
        times = np.zeros(len(self.hashes))
        for word, owner in self.uses:
            times += np.bincount(word[trusted[owner]], minlength=len(times))
        return np.rint(np.bincount(self.event, weights=np.repeat(times, self.n_events),
                                   minlength=len(self.grams))).astype(np.int64)

    def sparse(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, n-gram and count of every pair that occurs, sorted; and the symbols of each text.

        Worked off in slices of whole texts, which bounds the memory by a slice, or the largest text.
        """
        n, wide = len(self.doc_words), max(len(self.grams), 1)
        symbols = np.zeros(n, dtype=np.int64)
        parts = [(np.zeros(0, np.int32),) * 3]
        for word, owner in self.uses:
            symbols += np.rint(np.bincount(owner, weights=self.n_events[word], minlength=n)).astype(np.int64)
            lo = 0
            while lo < len(word):
                # the last text that begins within the slice ends it
                hi = int(np.searchsorted(owner, owner[min(lo + SLICE_WORDS, len(owner) - 1)], side="left"))
                hi = len(word) if lo + SLICE_WORDS >= len(word) else hi
                hi = hi if hi > lo else int(np.searchsorted(owner, owner[lo], side="right"))
                w, o = word[lo:hi], owner[lo:hi]
                size = self.n_events[w]
                at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - self.first_event[w], size)
                pair = np.repeat(o.astype(np.int64) * wide, size) + self.event[at]
                pair, count = np.unique(pair, return_counts=True)
                parts.append(((pair // wide).astype(np.int32), (pair % wide).astype(np.int32), count.astype(np.int32)))
                lo = hi
        return (*(np.concatenate(x) for x in zip(*parts)), symbols)


def pack(x: np.ndarray) -> bytes:
    """Small non-negative 32-bit integers, compressed byte by byte: the high bytes are mostly 0."""
    planes = np.ascontiguousarray(x, dtype="<u4").view(np.uint8).reshape(len(x), 4).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), dtype=np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def steps(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Differences of neighbours; where ``first`` is set, the value itself."""
    out = np.diff(x, prepend=0)
    out[first] = x[first]
    return out


def from_steps(d: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The values of runs of ``size`` whose differences are ``d``."""
    total = np.cumsum(d)
    start = np.cumsum(size) - size
    before = np.where(start > 0, total[np.maximum(start, 1) - 1], 0) if len(total) else start * 0
    return total - np.repeat(before, size)


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[str, pa.Table, pa.LargeStringArray]]:
    """Documents of one language, up to ``limit`` bytes of text (one document at least): code, rows, texts."""
    held: dict[str, list[pa.RecordBatch]] = {}
    size: dict[str, int] = {}

    def take(code):
        size.pop(code)
        pa.default_memory_pool().release_unused()
        table = pa.Table.from_batches(held.pop(code)).combine_chunks()
        return code, table, text_column(table.to_batches()[0], "text")

    for batch in batches:
        texts = text_column(batch, "text")
        for lo, hi in chunks(texts):
            part = batch.slice(lo, hi - lo)
            codes = np.asarray(part.column(part.schema.get_field_index("code")).to_pylist(), dtype=object)
            bytes_ = np.diff(np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset + lo : texts.offset + hi + 1])
            for code in sorted(set(codes)):
                rows = np.flatnonzero(codes == code)
                held.setdefault(code, []).append(part.take(pa.array(rows)))
                size[code] = size.get(code, 0) + int(bytes_[rows].sum())
                if size[code] >= limit:
                    yield take(code)
    for code in sorted(held):
        yield take(code)


def _kept(df: DataFrame) -> DataFrame:
    """``df``, written as Parquet next to the checkpoints and read again: cuts the lineage, compressed."""
    folder = checkpoint_dir(df.sparkSession)
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    path = f"{folder.rstrip('/')}/kneser-ney-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def corpus_grams(rows: DataFrame, keys: DataFrame, order: int, small: int, across: bool) -> DataFrame:
    """``(code, gram, n)``: every n-gram of the corpus and its occurrences in trusted documents.

    ``keys`` marks the trusted documents.  Up to ``small`` keys they are sent to the tasks (the
    bound on what is broadcast); beyond, they are joined by a shuffle.  The result is the same.
    """
    keys = keys.select("key", F.lit(True).alias("trusted"))
    few = keys.limit(small + 1).count() <= small
    marked = rows.join(F.broadcast(keys) if few else keys, "key", "left").select(
        "code", F.coalesce("trusted", F.lit(False)).alias("trusted"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for code, table, texts in _blocks(batches, BLOCK_BYTES):
            grams = BlockGrams(texts, order, across)
            n = len(grams.grams)
            marks = table.column("trusted").to_numpy(zero_copy_only=False).astype(bool)
            yield pa.RecordBatch.from_arrays(
                [pa.array([code] * n, pa.string()), pa.array(grams.grams.astype(object), pa.string()),
                 pa.array(grams.counts(marks), pa.int64())], names=["code", "gram", "n"])

    return marked.mapInArrow(count, "code string, gram string, n long").groupBy("code", "gram").agg(
        F.sum("n").alias("n"))


def gram_scores(counted: DataFrame, order: int) -> DataFrame:
    """``(code, gram, logp)`` of every n-gram of the corpus: its last symbol after the ones before.

    ``a`` is the count of an n-gram in the model, 0 if trusted text has it not.  Lengths are worked off from long to
    short for the counts, from short to long for the probabilities:
    p(g) = max(a - discount, 0) / s(context) + gamma(context) p(g without its first symbol).
    """
    level: dict[int, DataFrame] = {}
    for k in range(order, 0, -1):
        here = counted.where(F.length("gram") == k).select("code", "gram", F.col("n").alias("a"))
        if k < order:
            longer = level[k + 1].groupBy("code", F.expr("substring(gram, 2)").alias("gram")).agg(
                F.sum((F.col("a") > 0).cast("long")).alias("a"))
            here = longer.unionByName(here)
        level[k] = _kept(here)
    seen = level[order].withColumn("k", F.lit(order))
    for k in range(order - 1, 0, -1):
        seen = seen.unionByName(level[k].withColumn("k", F.lit(k)))
    seen = seen.where("a > 0")
    t = seen.groupBy("code", "k").agg(*[
        F.sum((F.col("a") == i).cast("double")).alias(f"t{i}") for i in (1, 2, 3, 4)])
    y = F.try_divide(F.col("t1"), F.col("t1") + 2 * F.col("t2"))

    def discount(i: int):
        d = i - (i + 1) * y * F.try_divide(F.col(f"t{i + 1}"), F.col(f"t{i}"))
        return F.when((d > 0) & (d < i), d).otherwise(F.lit(0.5)).alias(f"d{i}")

    d = _kept(t.select("code", "k", *[discount(i) for i in (1, 2, 3)]))
    cut = F.when(F.col("a") == 0, F.lit(0.0)).when(F.col("a") == 1, F.col("d1")).when(
        F.col("a") == 2, F.col("d2")).otherwise(F.col("d3"))
    h = F.expr("left(gram, length(gram) - 1)").alias("h")
    contexts = _kept(seen.join(d, ["code", "k"]).groupBy("code", h).agg(
        F.sum("a").alias("s"), F.sum(cut).alias("lost")))
    # below the unigrams: uniform over the language's symbols and one more
    below = level[1].where("a > 0").groupBy("code").agg((1 / (F.count("*") + 1)).alias("q"))
    on, scores = ["code"], None
    for k in range(1, order + 1):
        rows = level[k].join(d.where(F.col("k") == k).drop("k"), "code", "left").select(
            "code", "gram", F.expr("substring(gram, 2)").alias("tail"), h, "a", cut.alias("cut"))
        rows = rows.join(contexts, ["code", "h"], "left").join(below, on)
        p = F.when(F.col("s").isNull(), F.col("q")).otherwise(
            F.when(F.col("a") > 0, (F.col("a") - F.col("cut")) / F.col("s")).otherwise(0.0)
            + F.col("lost") / F.col("s") * F.col("q"))
        here = _kept(rows.select("code", "gram", p.alias("p")))
        asked = here if k == order else here.where(F.col("gram").startswith(START))
        scores = asked if scores is None else scores.unionByName(asked)
        below, on = here.select("code", F.col("gram").alias("tail"), F.col("p").alias("q")), ["code", "tail"]
    return scores.select("code", "gram", F.log("p").alias("logp"))


def score_documents(
    docs: DataFrame,
    trusted: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    order: int = ORDER,
    block_bytes: int = BLOCK_BYTES,
    task_bytes: int = TASK_BYTES,
    small: int = SMALL_KEYS,
    across: bool = False,
) -> DataFrame:
    """``(key, code, trusted, n_words, n_symbols, log_prob, perplexity)`` of every document.

    ``trusted`` has a column ``key`` with the keys of the training documents; with ``across``
    n-grams run across word borders, else every word is a sequence of its own.
    """
    key_type = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), language_code(F.col(lang)).alias("code"),
                       F.col(text).cast("string").alias("text"))
    keys = trusted.where(F.col(key).isNotNull()).select(F.col(key).alias("key")).distinct()
    counted = _kept(corpus_grams(rows, keys, order, small, across))
    scores = _kept(gram_scores(counted, order))
    # the square root of the tasks' number for either side keeps what is sent twice small
    total = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    shards = turns = max(1, math.ceil(math.sqrt(total / task_bytes)))

    def shard_of(grams: np.ndarray) -> np.ndarray:
        code = np.ascontiguousarray(grams).view(np.uint32).reshape(len(grams), -1) if len(grams) else np.zeros((0, 1))
        acc = np.zeros(len(grams), dtype=np.uint64)
        for k in range(code.shape[1]):
            acc = mix(acc + code[:, k].astype(np.uint64) + np.uint64(1))
        return (acc % np.uint64(shards)).astype(np.int32)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, (code, table, texts) in enumerate(_blocks(batches, block_bytes)):
            grams = BlockGrams(texts, order, across)
            doc, gram, count, symbols = grams.sparse()
            # the same block has the same id when a task runs again
            print_ = hashlib.blake2b(f"{task} {number} {table.column('key').to_pylist()}".encode(), digest_size=8)
            block = int.from_bytes(print_.digest(), "little", signed=True)
            shard = shard_of(grams.grams)
            out: dict[str, list] = {n: [] for n in ("shard", "grams", "docs", "gram", "n", "size")}
            for s in range(shards):
                own = np.flatnonzero(shard == s)
                local = np.cumsum(shard == s) - 1
                hit = np.flatnonzero(shard[gram] == s)
                text, slot = doc[hit], local[gram[hit]]
                begins = np.ones(len(hit), dtype=bool)
                begins[1:] = text[1:] != text[:-1]
                out["shard"].append(s)
                out["grams"].append(grams.grams[own].tolist())
                out["docs"].append(pack(np.bincount(text, minlength=len(table))))
                out["gram"].append(pack(steps(slot, begins)))
                out["n"].append(pack(count[hit]))
                out["size"].append(len(hit))
            first = [s == 0 for s in out["shard"]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([code] * shards, pa.string()), pa.array(out["shard"], pa.int32()),
                 pa.array([block % turns] * shards, pa.int32()), pa.array([block] * shards, pa.int64()),
                 pa.array([len(table)] * shards, pa.int64()), pa.array(out["size"], pa.int64()),
                 pa.array(out["grams"], pa.list_(pa.string())), pa.array(out["docs"], pa.binary()),
                 pa.array(out["gram"], pa.binary()), pa.array(out["n"], pa.binary()),
                 pa.array([table.column("key").to_pylist() if f else None for f in first],
                          pa.list_(table.schema.field("key").type)),
                 pa.array([grams.doc_words.tolist() if f else None for f in first], pa.list_(pa.int64())),
                 pa.array([symbols.tolist() if f else None for f in first], pa.list_(pa.int64()))],
                names=["code", "shard", "turn", "block", "rows", "size", "grams", "docs", "gram", "n", "keys", "words",
                       "symbols"])

    sparse = rows.mapInArrow(
        spread, "code string, shard int, turn int, block long, rows long, size long, grams array<string>, docs binary, "
                f"gram binary, n binary, keys array<{key_type}>, words array<long>, symbols array<long>")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = np.array(batch.column(1).to_pylist(), dtype=f"<U{order}")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard_of(texts))],
                                             names=["code", "gram", "logp", "shard"])

    model = scores.select("code", "gram", "logp").mapInArrow(
        number, "code string, gram string, logp double, shard int")
    model = model.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))

    def add(mine: pa.Table, known: pa.Table) -> pa.Table:
        have = known.column("gram").combine_chunks()
        logp = np.append(known.column("logp").to_numpy(), np.nan)
        out: dict[str, list] = {n: [] for n in ("block", "row", "log_prob", "key", "n_words", "n_symbols")}
        for r in mine.to_pylist():
            n = r["rows"]
            size = unpack(r["docs"], n)
            gram, count = from_steps(unpack(r["gram"], r["size"]), size), unpack(r["n"], r["size"])
            at = pc.index_in(pa.array(r["grams"], pa.string()), value_set=have).fill_null(len(have)).to_numpy()
            value = logp[at][gram] * count if len(gram) else np.zeros(0)
            out["block"].append(np.full(n, r["block"]))
            out["row"].append(np.arange(n))
            out["log_prob"].append(np.bincount(np.repeat(np.arange(n), size), weights=value, minlength=n))
            out["key"] += r["keys"] or [None] * n
            out["n_words"] += r["words"] or [None] * n
            out["n_symbols"] += r["symbols"] or [None] * n
        flat = lambda x, kind: pa.array(np.concatenate(x) if x else np.zeros(0), kind)
        code = mine.column("code")[0].as_py() if len(mine) else None
        return pa.table({
            "block": flat(out["block"], pa.int64()), "row": flat(out["row"], pa.int64()),
            "code": pa.array([code] * len(out["key"]), pa.string()),
            "key": pa.array(out["key"], mine.schema.field("keys").type.value_type),
            "n_words": pa.array(out["n_words"], pa.int64()), "n_symbols": pa.array(out["n_symbols"], pa.int64()),
            "log_prob": flat(out["log_prob"], pa.float64())})

    place = ["code", "shard", "turn"]
    parts = sparse.groupBy(*place).cogroup(model.groupBy(*place)).applyInArrow(
        add, f"block long, row long, code string, key {key_type}, n_words long, n_symbols long, log_prob double")
    whole = parts.groupBy("block", "row").agg(
        F.first("code", True).alias("code"), F.first("key", True).alias("key"), F.max("n_words").alias("n_words"),
        F.max("n_symbols").alias("n_symbols"), F.sum("log_prob").alias("sum"), F.count("*").alias("n_parts"))
    checked = F.when(F.col("n_parts") == shards, F.col("sum")).otherwise(
        F.raise_error(F.lit("a document lost a part: its block was built twice from different rows")).cast("double"))
    fine = (F.col("n_symbols") > 0) & ~F.isnan(checked)
    whole = whole.select("key", "code", "n_words", "n_symbols", F.when(fine, checked).alias("log_prob"))
    whole = whole.join(keys.select(F.col("key"), F.lit(True).alias("trusted")), "key", "left")
    return whole.select(
        F.col("key").alias(key), "code", F.coalesce("trusted", F.lit(False)).alias("trusted"), "n_words", "n_symbols",
        "log_prob", F.exp(-F.col("log_prob") / F.col("n_symbols")).alias("perplexity"))


def perplexity_filter(
    docs: DataFrame,
    trusted: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    order: int = ORDER,
    quantile: float = QUANTILE,
    min_words: int = MIN_WORDS,
    block_bytes: int = BLOCK_BYTES,
    across: bool = True,
) -> DataFrame:
    """:func:`score_documents`, by default across word borders, with the language's ``threshold`` and ``kept``.

    The threshold is the ``quantile`` of the perplexities of the language's trusted documents of
    at least ``min_words`` words (a mergeable sketch with relative rank error 1e-4).
    """
    scored = _kept(score_documents(docs, trusted, key, text, lang, order, block_bytes, across=across))
    long_enough = F.col("n_words") >= min_words
    limits = scored.where(F.col("trusted") & long_enough & F.col("perplexity").isNotNull()).groupBy("code").agg(
        F.percentile_approx("perplexity", F.lit(quantile), F.lit(10000)).alias("threshold"))
    out = scored.join(limits, "code", "left")
    return out.withColumn("kept", F.coalesce(
        ~(long_enough & (F.col("perplexity") > F.col("threshold"))), F.lit(True)))
