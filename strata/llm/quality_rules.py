"""Quality rules by distribution divergence (operator 7).

A document is compared with the reference of its language in two ways, each with a
guard for short texts:

* the histogram of its character classes, and
* the histogram of the language's most common words (the rest in one bin),

by Jensen-Shannon distance (square root of the divergence in bits, 0 to 1).  The
references are counted over every document that passes the base rules: the words and
classes of all of them, whole texts.

Languages are keyed by code: two or three ASCII letters, lower case; any other value
(null included) counts as ``und``.  There are at most 26**2 + 26**3 + 1 codes, and a
reference is ``COMMON_WORDS`` words and ten class counts, which bounds what reaches the
tasks (under 20 MB); it is the only thing that passes through the driver.

Edge cases: a null text has no words (all counts 0, base rule fails); a text under the
guards is judged by the base rules alone; a language whose reference is empty judges
nothing; repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.schema_safe import own_name
from strata.llm.text_arrays import Flat, chunks, text_column, window_hash

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
COMMON_WORDS = 64
#: Guards: texts below these are not compared.
MIN_CHARS = 300
MIN_COMPARED_WORDS = 100
MAX_CLASS_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.40

#: Symbols counted by the base rules (fixed values).
SYMBOLS = b"#*$%&|<>"
#: Character classes (fixed values): lower, upper, digit, space, stop, symbol, other ASCII,
#: and code points of two, three and four bytes.
N_CLASSES = 10
_CLASS = np.full(256, 6, dtype=np.int64)
_CLASS[list(b"abcdefghijklmnopqrstuvwxyz")] = 0
_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 1
_CLASS[list(b"0123456789")] = 2
_CLASS[list(b" \t\n\v\f\r")] = 3
_CLASS[list(b".,;:!?'\"()-")] = 4
_CLASS[list(SYMBOLS)] = 5
_CLASS[0x80:0xC0] = -1  # inside a code point
_CLASS[0xC0:0xE0] = 7
_CLASS[0xE0:0xF0] = 8
_CLASS[0xF0:] = 9
_IS_SYMBOL = np.zeros(256, dtype=np.int64)
_IS_SYMBOL[list(SYMBOLS)] = 1

REFERENCE_SCHEMA = "code string, kind string, item long, n long"
VERDICT_SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, class_distance double, word_distance double, kept boolean"
)


def language_code(col):
    """Two or three ASCII letters in lower case, else ``und``."""
    low = F.lower(F.trim(col.cast("string")))
    return F.when(low.rlike("^[a-z]{2,3}$"), low).otherwise(F.lit("und"))


def _sum_by(owner: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    if weights is None:
        return np.bincount(owner, minlength=n).astype(np.int64)
    return np.rint(np.bincount(owner, weights=weights, minlength=n)).astype(np.int64)


class Measured:
    """The base counts, class histogram and words of the texts of one chunk."""

    def __init__(self, flat: Flat, window: int, min_words: int, max_repeat_percent: int):
        n = flat.n
        points, prefix = flat.code_points(), flat.prefix_hash()
        start, end, self.word_of = flat.words()
        self.word = Flat.span_hash(prefix, start, end)
        self.n_words = _sum_by(self.word_of, n)
        self.word_chars = _sum_by(self.word_of, n, points[end] - points[start])
        hits = np.zeros(len(flat.buf) + 1, dtype=np.int64)
        np.cumsum(_IS_SYMBOL[flat.buf], out=hits[1:])
        self.n_symbols = hits[flat.off[1:]] - hits[flat.off[:-1]]
        self.n_dup_lines = self._repeated_lines(flat, prefix, start, n)
        self.n_repeat_words = self._repeated_words(window, n)
        self.base_failed = (self.n_words < min_words) | (
            100 * self.n_repeat_words > max_repeat_percent * self.n_words
        )
        kinds = _CLASS[flat.buf]
        real = kinds >= 0
        at = np.repeat(np.arange(n), np.diff(flat.off))[real]
        self.classes = np.bincount(at * N_CLASSES + kinds[real], minlength=n * N_CLASSES).reshape(n, N_CLASSES)

    @staticmethod
    def _repeated_lines(flat: Flat, prefix, word_start, n) -> np.ndarray:
        start, end, owner = flat.lines()
        has_word = np.searchsorted(word_start, end, side="left") > np.searchsorted(word_start, start, side="left")
        start, end, owner = start[has_word], end[has_word], owner[has_word]
        if not len(start):
            return np.zeros(n, dtype=np.int64)
        line = Flat.span_hash(prefix, start, end)
        order = np.lexsort((line, owner))
        same = (line[order][1:] == line[order][:-1]) & (owner[order][1:] == owner[order][:-1])
        return _sum_by(owner[order][1:][same], n)

    def _repeated_words(self, window: int, n: int) -> np.ndarray:
        run, at = window_hash(self.word, self.word_of, window)
        if not len(run):
            return np.zeros(n, dtype=np.int64)
        owner = self.word_of[at]
        # equal runs of one text meet after a sort; runs of other texts differ by the text's salt
        key = run ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        k = key[order]
        same = k[1:] == k[:-1]
        twice = np.zeros(len(run), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover = np.zeros(len(self.word) + 1, dtype=np.int64)
        first = at[twice]
        np.add.at(cover, first, 1)
        np.add.at(cover, first + window, -1)
        inside = np.cumsum(cover[:-1]) > 0
        return _sum_by(self.word_of[inside], n)


def reference_counts(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    window: int = WINDOW,
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
) -> DataFrame:
    """Words and classes of all documents that pass the base rules: ``(code, kind, item, n)``.

    ``kind`` is ``word`` (item: the word's 64-bit hash) or ``class`` (item: its number).
    Each chunk counts its own rows first, so the shuffle carries distinct words only.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list[tuple[np.ndarray, np.ndarray]]] = {}

        def flush():
            for (code, kind), parts in held.items():
                items, inv = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.rint(np.bincount(inv, weights=np.concatenate([p[1] for p in parts]))).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([code] * len(items), pa.string()), pa.array([kind] * len(items), pa.string()),
                     pa.array(items.astype(np.int64)),
                     pa.array(n)], names=["code", "kind", "item", "n"])
            held.clear()

        rows = 0
        for batch in batches:
            texts, codes = text_column(batch, "text"), np.asarray(batch.column(0).to_pylist(), dtype=object)
            for lo, hi in chunks(texts):
                m = Measured(Flat(texts, lo, hi), window, min_words, max_repeat_percent)
                for code in set(codes[lo:hi]):
                    own = (codes[lo:hi] == code) & ~m.base_failed
                    word, n = np.unique(m.word[own[m.word_of]], return_counts=True)
                    held.setdefault((code, "word"), []).append((word.view(np.int64), n))
                    held.setdefault((code, "class"), []).append((np.arange(N_CLASSES), m.classes[own].sum(axis=0)))
                    rows += len(word)
                if rows > 2_000_000:
                    rows = 0
                    yield from flush()
        yield from flush()

    slim = docs.select(language_code(F.col(lang)).alias("code"), F.col(text).cast("string").alias("text"))
    parts = slim.mapInArrow(count, REFERENCE_SCHEMA)
    return parts.groupBy("code", "kind", "item").agg(F.sum("n").alias("n")).where("n > 0")


def references(counts: DataFrame, common: int = COMMON_WORDS) -> dict[str, dict[str, np.ndarray]]:
    """Per language code: the ``common`` most frequent words, their counts with the rest, and the class counts."""
    words = counts.where("kind = 'word'")
    best = _top_words(words, common)
    out: dict[str, dict[str, np.ndarray]] = {}
    for r in best.collect():
        items = np.array([x["item"] for x in r["top"]], dtype=np.int64)
        n = np.array([x["n"] for x in r["top"]], dtype=float)
        order = np.argsort(items)
        out.setdefault(r["code"], {}).update(
            items=items[order], words=np.append(n[order], r["total"] - n.sum()))
    for r in counts.where("kind = 'class'").collect():
        out.setdefault(r["code"], {}).setdefault("classes", np.zeros(N_CLASSES))[r["item"]] = r["n"]
    return out


def _top_words(words: DataFrame, common: int) -> DataFrame:
    """One row per code: its ``common`` most frequent words (ties to the smaller hash) and the count of all."""
    # two ranks: within (code, part) first, so no task sorts a whole language
    parted = words.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(64)))
    by = [F.col("n").desc(), F.col("item")]
    near = parted.withColumn("r", F.row_number().over(Window.partitionBy("code", "part").orderBy(*by))).where(
        F.col("r") <= common)
    top = near.withColumn("r", F.row_number().over(Window.partitionBy("code").orderBy(*by))).where(F.col("r") <= common)
    top = top.groupBy("code").agg(F.collect_list(F.struct("item", "n")).alias("top"))
    total = words.groupBy("code").agg(F.sum("n").alias("total"))
    return top.join(total, "code")


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distance of each row of counts ``p`` from the counts ``q`` (0 for empty rows)."""
    total = p.sum(axis=1, keepdims=True)
    p = p / np.maximum(total, 1)
    q = np.broadcast_to(q / max(q.sum(), 1), p.shape)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl_p = np.where(p > 0, p * np.log2(p / m), 0.0).sum(axis=1)
        kl_q = np.where(q > 0, q * np.log2(q / m), 0.0).sum(axis=1)
    return np.where(total[:, 0] > 0, np.sqrt(np.maximum((kl_p + kl_q) / 2, 0.0)), 0.0)


def quality_rules(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    window: int = WINDOW,
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
    common: int = COMMON_WORDS,
    min_chars: int = MIN_CHARS,
    min_compared_words: int = MIN_COMPARED_WORDS,
    max_class_distance: float = MAX_CLASS_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
    carry: list[str] | None = None,
) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all by default) with the base counts, both distances and ``kept``.

    Added columns are those of ``VERDICT_SCHEMA``; a column of ``docs`` of the same name is
    replaced (its value is not read).  All rows come back, in no order.
    """
    refs = references(reference_counts(docs, text, lang, window, min_words, max_repeat_percent), common)
    added = T._parse_datatype_string(VERDICT_SCHEMA)
    new = {f.name.lower() for f in added}
    if {text.lower(), lang.lower()} & new:
        raise ValueError("the text and language columns may not have the name of a result column")
    keep = [c for c in (docs.columns if carry is None else carry) if c.lower() not in new]
    schema = T.StructType([docs.schema[c] for c in keep] + list(added))
    once = text in keep and isinstance(docs.schema[text].dataType, T.StringType)  # send a text once
    code_at, text_at = len(keep), keep.index(text) if once else len(keep) + 1

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, codes = text_column(batch, batch.schema.names[text_at]), batch.column(code_at).to_pylist()
            for lo, hi in chunks(texts):
                yield _judged(batch, texts, codes, lo, hi)

    def _judged(batch, texts, codes, lo, hi):
        m = Measured(Flat(texts, lo, hi), window, min_words, max_repeat_percent)
        n = hi - lo
        by_class, by_word = np.zeros(n), np.zeros(n)
        own_codes = np.asarray(codes[lo:hi], dtype=object)
        for code in set(codes[lo:hi]):
            ref, rows = refs.get(code, {}), np.flatnonzero(own_codes == code)
            if "classes" in ref and ref["classes"].sum() > 0:
                by_class[rows] = jensen_shannon(m.classes[rows].astype(float), ref["classes"])
            if "items" in ref:
                items, k = ref["items"], len(ref["items"])
                mine = np.zeros(n, dtype=bool)
                mine[rows] = True
                sel = mine[m.word_of]
                word, owner = m.word[sel].view(np.int64), m.word_of[sel]
                at = np.minimum(np.searchsorted(items, word), k - 1)
                slot = np.where(items[at] == word, at, k)
                hist = np.bincount(owner * (k + 1) + slot, minlength=n * (k + 1)).reshape(n, k + 1)
                by_word[rows] = jensen_shannon(hist[rows].astype(float), ref["words"])
        chars = m.classes.sum(axis=1)
        odd = ((chars >= min_chars) & (by_class > max_class_distance)) | (
            (m.n_words >= min_compared_words) & (by_word > max_word_distance))
        cols = [m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, m.base_failed, by_class,
                by_word, ~m.base_failed & ~odd]
        return pa.RecordBatch.from_arrays(
            [batch.column(i).slice(lo, n) for i in range(code_at)] + [pa.array(c) for c in cols],
            names=[f.name for f in schema])

    code_name, text_name = own_name(docs, "code", "whole_text")
    sent = [F.col(f"`{c}`") for c in keep] + [language_code(F.col(lang)).alias(code_name)]
    if not once:
        sent.append(F.col(text).cast("string").alias(text_name))
    return docs.select(*sent).mapInArrow(judge, schema)
