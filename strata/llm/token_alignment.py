"""Cross-tokenizer alignment (operator 12): token groups of two vocabularies as an associative fragment monoid.

Vocabulary A (byte-level BPE, a ``tokenizers`` file) encodes a space and the text, vocabulary B
(``sentencepiece``) encodes the text and adds that space itself, so both cut the same bytes.  Where a
token of A and one of B end at the same byte, a *group* ends.  Tokens of one group are linked.

**Fragments.**  A byte range of a text holds the tokens that end in it.  Its fragment is an *open prefix*
(the tokens up to the first common end, which may belong to a group begun earlier), the *closed groups* that follow
and an *open suffix*; a range without a common end is open as a whole.  Composing two neighbours closes
the group made of the left suffix and the right prefix.  Composition is associative and the empty
fragment is its unit, so the fragments of a very long text are built by different tasks and composed
by a tree reduction (:data:`FAN` neighbours a round); a text of one range is its own tree.

**Encoding.**  A single space between two visible characters is a *safe* cut: the pre-tokenizer of A
begins a token there whatever stands before, and no piece of B holds a space behind another character (checked
when the vocabulary is read; otherwise nothing is cut).  Spans between safe cuts are encoded
once per worker and remembered, up to :data:`REMEMBERED`; beyond, those stay that several blocks asked for.  A byte range ends anywhere, not only at safe cuts: its task
encodes the window up to the next safe cut on either side and keeps the tokens that end in the range.
A range end that has no safe cut within :data:`REACH` bytes is left out.

**Counts over the corpus.**  A pair of ids counts in how many texts it is linked.  Texts are worked off in blocks:
a block is one row that holds the distinct pairs of its texts once and, compressed, which text has
which of them how often.  Only (block, pair) rows are joined with the corpus-wide counts, not (text, pair) rows, and
their counts come back as one array per block, bounded by the block's own bytes.  No pair table is
broadcast or collected.

Edge cases: texts null, empty, or not reproduced byte for byte by either vocabulary (a literal U+2581)
have no tokens: zeros and ``''``; rows that repeat a key or text each count as a text of their own; ties for an id's highest
count are all best; carried columns keep their names, those with the name of a result column are
replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.schema_safe import own_name
from strata.llm.text_arrays import chunks, text_column
from strata.session import cut, spread

#: Bytes of text in a block; bytes of a range; texts over two ranges are cut into ranges.
BLOCK_BYTES = 2 << 20
RANGE_BYTES = 1 << 15
#: How far from a range end a safe cut may be.
REACH = 1 << 12
#: Fragments composed by one task in one round of the tree.
FAN = 8
#: Spans remembered by a worker, and the longest of them.
REMEMBERED = 120_000
LONGEST = 64
#: Spans encoded at once.
RUN_SPANS = 256
#: A pair is one integer: A's id shifted by this, plus B's id.
PAIR_BITS = 20

COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_workers: dict[tuple[str, str], Aligner] = {}


def _group_text(a, b) -> str:
    return f"{','.join(map(str, a))}|{','.join(map(str, b))}"


def _links(a, b) -> list[int]:
    return [(x << PAIR_BITS) | y for x in a for y in b]


@dataclass
class Fragment:
    """Tokens of a byte range: open ``head``, closed groups, open ``tail`` (each a pair of id lists)."""

    closed: bool = False  # holds a common end; otherwise everything is in ``head``
    head: tuple[list[int], list[int]] = field(default_factory=lambda: ([], []))
    tail: tuple[list[int], list[int]] = field(default_factory=lambda: ([], []))
    body: str = ""  # the closed groups behind the head
    n_a: int = 0  # tokens, groups and links of the closed groups
    n_b: int = 0
    n_groups: int = 0
    links: list[int] = field(default_factory=list)
    ok: bool = True

    @classmethod
    def of(cls, a: list[tuple[int, int]], b: list[tuple[int, int]], ok: bool = True) -> Fragment:
        """From the ``(id, end)`` of both vocabularies in a range."""
        groups, i, j, at = [], 0, 0, ([], [])
        while i < len(a) or j < len(b):
            ea = a[i][1] if i < len(a) else None
            eb = b[j][1] if j < len(b) else None
            if eb is None or (ea is not None and ea <= eb):
                at[0].append(a[i][0])
                i += 1
            if ea is None or (eb is not None and eb <= ea):
                at[1].append(b[j][0])
                j += 1
            if ea == eb:
                groups.append(at)
                at = ([], [])
        if not groups:
            return cls(False, at, ok=ok)
        inner = groups[1:]
        return cls(True, groups[0], at, ";".join(_group_text(*g) for g in inner), sum(len(g[0]) for g in inner),
                   sum(len(g[1]) for g in inner), len(inner), [x for g in inner for x in _links(*g)], ok)

    def __add__(self, right: Fragment) -> Fragment:
        ok = self.ok and right.ok
        both = lambda x, y: (x[0] + y[0], x[1] + y[1])
        if not self.closed:
            return Fragment(right.closed, both(self.head, right.head), right.tail, right.body, right.n_a, right.n_b,
                            right.n_groups, right.links, ok)
        if not right.closed:
            return Fragment(True, self.head, both(self.tail, right.head), self.body, self.n_a, self.n_b,
                            self.n_groups, self.links, ok)
        a, b = both(self.tail, right.head)
        body = ";".join(x for x in (self.body, _group_text(a, b), right.body) if x)
        return Fragment(True, self.head, right.tail, body, self.n_a + len(a) + right.n_a, self.n_b + len(b) + right.n_b,
                        self.n_groups + 1 + right.n_groups, [*self.links, *_links(a, b), *right.links], ok)

    def whole(self) -> Fragment:
        """The fragment of a complete text: its start closes the head, its end leaves no tail."""
        return Fragment(True) + self


def compose(parts: list[Fragment]) -> Fragment:
    """Neighbours in order, halves first: the cost of joining bodies stays n log n."""
    if len(parts) < 2:
        return parts[0] if parts else Fragment()
    mid = len(parts) // 2
    return compose(parts[:mid]) + compose(parts[mid:])


def safe_cuts(data: np.ndarray) -> np.ndarray:
    """Positions of single spaces between visible characters (Unicode white space is not visible)."""
    n = len(data)
    if n < 3:
        return np.zeros(0, dtype=np.int64)
    p = np.flatnonzero(data[1:-1] == 0x20) + 1
    left, right = data[p - 1], data[p + 1]
    seen = ((left > 0x20) & (left != 0x7F)) & ((right > 0x20) & (right != 0x7F))
    # white space beyond ASCII begins with one of these bytes (U+0085 to U+3000)
    odd = np.isin(right, (0xC2, 0xE1, 0xE2, 0xE3))
    two, three = data[np.maximum(p - 2, 0)], data[np.maximum(p - 3, 0)]
    odd |= (left >= 0x80) & ((two == 0xC2) | np.isin(three, (0xE1, 0xE2, 0xE3)))
    return p[seen & ~odd]


class Aligner:
    """Both vocabularies and the spans that a worker has aligned so far."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        n_a, n_b = self.a.get_vocab_size(with_added_tokens=True), self.b.get_piece_size()
        if max(n_a, n_b) > 1 << PAIR_BITS:
            raise ValueError(f"a vocabulary has more than {1 << PAIR_BITS} ids")
        byte_of = _byte_alphabet()
        self.bytes_a = [bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()
                        for t in (self.a.id_to_token(i) or "" for i in range(n_a))]
        pieces = [self.b.id_to_piece(i) for i in range(n_b)]
        self.bytes_b = [bytes([int(t[3:5], 16)]) if self.b.is_byte(i) else t.replace("▁", " ").encode()
                        for i, t in enumerate(pieces)]
        self.sizes = [np.array([len(t) for t in table], dtype=np.int64) for table in (self.bytes_a, self.bytes_b)]
        self.cuts = not any("▁" in t.lstrip("▁") for t in pieces)
        self.forget()

    def forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.n_long = 0
        self.text: list[str] = []
        #: per span: tokens of A, tokens of B and groups; whether its bytes are those of the text; blocks that asked for it
        self.counts = np.zeros((0, 3), dtype=np.int64)
        self.good = np.zeros(0, dtype=bool)
        self.asked = np.zeros(0, dtype=np.int64)
        #: the links of all spans, one span behind the other, and where each begins and how many it has
        self.links = np.zeros(0, dtype=np.int64)
        self.start = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)

    def _same(self, spans: list[bytes], flat: list[np.ndarray], n: list[np.ndarray]) -> np.ndarray:
        """Whether the bytes of the ids (``n`` per span) are those of each span and the space before, in both vocabularies."""
        length = np.fromiter(map(len, spans), np.int64, len(spans)) + 1
        same = np.ones(len(spans), dtype=bool)
        for size, ids, k in zip(self.sizes, flat, n):
            total, end = np.append(0, np.cumsum(size[ids])), np.cumsum(k)
            same &= total[end] - total[end - k] == length
        like = np.flatnonzero(same)  # as long as the text; now byte by byte
        text = np.frombuffer(b"".join([b" " + spans[i] for i in like.tolist()]), np.uint8)
        edge = np.cumsum(length[like])
        for table, ids, k in zip((self.bytes_a, self.bytes_b), flat, n):
            raw = b"".join(map(table.__getitem__, ids[np.repeat(same, k)].tolist()))
            wrong = np.flatnonzero(np.frombuffer(raw, np.uint8) != text)
            length[like[np.searchsorted(edge, wrong, side="right")]] = -1
        return same & (length >= 0)

    def _each(self, spans: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Ids of both vocabularies for spans encoded one by one: flat, how many per span; whether bytes agree."""
        texts = [s.decode() for s in spans]
        a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        b = self.b.encode(texts, num_threads=1)
        flat = [np.fromiter(chain.from_iterable(x), np.int64) for x in (a, b)]
        n = [np.fromiter(map(len, x), np.int64, len(spans)) for x in (a, b)]
        return flat, n, self._same(spans, flat, n)

    def _ids(self, spans: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """:meth:`_each`, a run of many spans at once where the spaces that join them are safe cuts of the run.

        The ids of a run fall apart at those cuts, which is checked: a run whose bytes differ from the ids' bytes, or
        which a token crosses, is encoded span by span.
        """
        parts, lo = [], 0
        while lo < len(spans):
            run = spans[lo : lo + RUN_SPANS]
            lo += len(run)
            parts.append(self._run(run) or self._each(run))
        if not parts:
            return self._each([])
        flat, n, same = zip(*parts)
        return [np.concatenate(x) for x in zip(*flat)], [np.concatenate(x) for x in zip(*n)], np.concatenate(same)

    def _run(self, spans: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray] | None:
        if not self.cuts:
            return None
        raw = b" ".join(spans)
        end = np.cumsum(np.fromiter(map(len, spans), np.int64, len(spans)) + 1)  # of the span and the space before it
        if not np.isin(end[:-1] - 1, safe_cuts(np.frombuffer(raw, np.uint8)), assume_unique=True).all():
            return None
        text = raw.decode()
        ids = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, self.b.encode(text)
        flat, n = [], []
        for x, table, size in zip(ids, (self.bytes_a, self.bytes_b), self.sizes):
            if b"".join(map(table.__getitem__, x)) != b" " + raw:
                return None
            flat.append(np.array(x, dtype=np.int64))
            ends = np.cumsum(size[flat[-1]])
            upto = np.searchsorted(ends, end, side="right")
            if (ends[upto - 1] != end).any():
                return None
            n.append(np.diff(upto, prepend=0))
        return flat, n, np.ones(len(spans), dtype=bool)

    def encode(self, spans: list[bytes]) -> list[tuple[list[int], list[int], bool]]:
        """Ids of both vocabularies for the spans (without the space before), and whether their bytes agree."""
        flat, n, same = self._each(spans)
        a, b = ([x.tolist() for x in np.split(ids, np.cumsum(k)[:-1])] if len(k) else [] for ids, k in zip(flat, n))
        return list(zip(a, b, same.tolist()))

    def _ends(self, x: list[int], table: list[bytes], base: int = 0) -> list[tuple[int, int]]:
        out = []
        for t in x:
            base += len(table[t])
            out.append((t, base))
        return out

    def learn(self, spans: list[bytes]) -> np.ndarray:
        """The numbers of the spans; those not seen before are encoded and aligned together."""
        index = self.index
        missing = [s for s in dict.fromkeys(spans) if s not in index]
        if missing:
            flat, n, same = self._ids(missing)
            base = len(self.text)
            self._align([x[np.repeat(same, k)] for x, k in zip(flat, n)], [k[same] for k in n], same)
            index.update(zip(missing, range(base, base + len(missing))))
            self.n_long += sum(len(s) > LONGEST for s in missing)
        numbers = np.fromiter(map(index.__getitem__, spans), np.int64, len(spans))
        self.asked += np.bincount(numbers, minlength=len(self.text)) > 0
        return numbers

    def _align(self, flat: list[np.ndarray], n_ids: list[np.ndarray], same: np.ndarray) -> None:
        """The groups of whole spans, all spans at once: a group ends where the running byte counts meet."""
        ends = [np.cumsum(size[ids]) for size, ids in zip(self.sizes, flat)]
        at = np.searchsorted(ends[1], ends[0])
        common = ends[0][np.append(ends[1], -1)[at] == ends[0]]
        start = [np.concatenate([[0], np.searchsorted(e, common, side="right")]) for e in ends]
        n = [np.diff(x) for x in start]
        # every pair of a group: the k-th link takes A's token k // n_b and B's token k % n_b
        per = n[0] * n[1]
        k = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
        wide = np.repeat(n[1], per)
        links = (flat[0][np.repeat(start[0][:-1], per) + k // np.maximum(wide, 1)] << PAIR_BITS) | flat[1][
            np.repeat(start[1][:-1], per) + k % np.maximum(wide, 1)]
        a, b = (list(map(str, x.tolist())) for x in flat)
        (a0, a1), (b0, b1) = ((x[:-1].tolist(), x[1:].tolist()) for x in start)
        groups = [f"{a[i]}|{b[p]}" if j - i == 1 == q - p else f"{','.join(a[i:j])}|{','.join(b[p:q])}"
                  for i, j, p, q in zip(a0, a1, b0, b1)]
        last = np.searchsorted(start[0], np.cumsum(n_ids[0]), side="left")  # groups up to the end of each span
        first = np.append(0, last)[:-1]
        link_end = np.append(0, np.cumsum(per))
        counts, at, size = np.zeros((len(same), 3), dtype=np.int64), np.zeros(len(same), np.int64), np.zeros(len(same), np.int64)
        counts[same] = np.stack([*n_ids, last - first], axis=1)
        at[same], size[same] = link_end[first] + len(self.links), link_end[last] - link_end[first]
        texts = iter([";".join(groups[i:j]) for i, j in zip(first.tolist(), last.tolist())])
        self.text += [next(texts) if ok else "" for ok in same.tolist()]
        self.counts, self.good = np.concatenate([self.counts, counts]), np.append(self.good, same)
        self.asked = np.append(self.asked, np.zeros(len(same), np.int64))
        self.links = np.concatenate([self.links, links])
        self.start, self.size = np.append(self.start, at), np.append(self.size, size)

    def linked(self, numbers: np.ndarray) -> np.ndarray:
        """The links of the numbered spans, one span behind the other."""
        size = self.size[numbers]
        return self.links[np.repeat(self.start[numbers] - np.cumsum(size) + size, size) + np.arange(size.sum())]

    def trim(self) -> None:
        """Drop the spans that one block alone asked for when there are too many, and the long spans always."""
        if len(self.index) <= REMEMBERED and not self.n_long:
            return
        full = len(self.index) > REMEMBERED
        kept = [(s, k) for s, k in self.index.items() if len(s) <= LONGEST and (not full or self.asked[k] > 1)]
        if len(kept) > REMEMBERED // 2 and full:
            kept = []
        numbers = np.array([k for _, k in kept], dtype=np.int64)
        text, counts, good, asked = self.text, self.counts[numbers], self.good[numbers], self.asked[numbers]
        links, size = self.linked(numbers), self.size[numbers]
        self.forget()
        self.index = dict(zip([s for s, _ in kept], range(len(kept))))
        self.text = [text[k] for _, k in kept]
        # to stay again, a span must be asked for again
        self.counts, self.good, self.asked = counts, good, np.minimum(asked, 1) if full else asked
        self.links, self.size, self.start = links, size, np.cumsum(size) - size

    def spans(self, raw: bytes) -> list[bytes]:
        """The text without the spaces at its safe cuts."""
        if not self.cuts:
            return [raw]
        data = np.frombuffer(raw, np.uint8)
        at = safe_cuts(data)
        if len(at) == np.count_nonzero(data == 0x20):
            return raw.split(b" ")
        at = at.tolist()
        return [raw[a:b] for a, b in zip([0, *(p + 1 for p in at)], [*at, len(raw)])]

    def fragment(self, window: bytes, base: int, lo: int, hi: int) -> Fragment:
        """The tokens of ``window`` (which begins with a safe space, at byte ``base``) that end in ``(lo, hi]``."""
        a, b = [], []
        spans = self.spans(window[1:])
        distinct = list(dict.fromkeys(spans))
        found = dict(zip(distinct, self.encode(distinct)))
        for x, y, same in map(found.__getitem__, spans):
            if not same:
                return Fragment(ok=False)
            ends = self._ends(x, self.bytes_a, base)
            a += [t for t in ends if lo < t[1] <= hi]
            b += [t for t in self._ends(y, self.bytes_b, base) if lo < t[1] <= hi]
            base = ends[-1][1]
        return Fragment.of(a, b)


def _byte_alphabet() -> dict[str, int]:
    """The public byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def _aligner(paths: tuple[str, str]) -> Aligner:
    if paths not in _workers:
        _workers[paths] = Aligner(*paths)
    return _workers[paths]


class _Block:
    """The texts of one block: counts, digests and, per text, which distinct pair occurs how often."""

    def __init__(self, n: int):
        self.counts = np.zeros((n, 4), dtype=np.int64)
        self.sha = [""] * n
        self.groups = [""] * n
        self.owner = np.zeros(0, dtype=np.int64)
        self.links = np.zeros(0, dtype=np.int64)

    def add(self, i: int, body: str, with_groups: bool) -> None:
        self.sha[i] = hashlib.sha256(body.encode()).hexdigest()
        if with_groups:
            self.groups[i] = body

    def row(self, kept: pa.StructArray, with_groups: bool) -> pa.RecordBatch:
        """One row: the texts as structs, the distinct pairs with their numbers of texts, the packed occurrences."""
        pairs, place = np.unique(self.links, return_inverse=True)
        cells, times = np.unique(self.owner * max(1, len(pairs)) + place, return_counts=True)
        doc, place = np.divmod(cells, max(1, len(pairs)))
        packed = np.concatenate([doc, place, times]).astype(np.int32)
        packed[1 : 2 * len(doc)] = np.diff(packed[: 2 * len(doc)])
        blob = zstandard.ZstdCompressor(level=3).compress(packed.tobytes())
        n_texts = np.bincount(place, minlength=len(pairs))
        columns = kept.flatten() + [pa.array(self.counts[:, k]) for k in range(4)] + [pa.array(self.sha, pa.string())]
        names = [f.name for f in kept.type] + [*COUNTS, "groups_sha256"]
        if with_groups:
            columns, names = columns + [pa.array(self.groups, pa.string())], names + ["groups"]
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        return pa.RecordBatch.from_arrays(
            [one(pa.StructArray.from_arrays(columns, names)), one(pa.array(pairs, pa.int64())),
             one(pa.array(n_texts, pa.int64())), pa.array([blob], pa.binary())],
            names=["texts", "pairs", "n_texts", "cells"])


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    packed = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.int32).copy()
    n = len(packed) // 3
    packed[: 2 * n] = np.cumsum(packed[: 2 * n])
    return packed[:n], packed[n : 2 * n], packed[2 * n :]


def _short_blocks(paths: tuple[str, str], with_groups: bool):
    """Blocks of whole texts (last column), each text one fragment made of its spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(paths)
        for batch in batches:
            texts = text_column(batch, batch.schema.names[-1])
            names = batch.schema.names[:-1]
            for lo, hi in chunks(texts, BLOCK_BYTES):
                aligner.trim()
                n = hi - lo
                block = _Block(n)
                split = [aligner.spans(texts[i].as_buffer().to_pybytes()) for i in range(lo, hi)]
                numbers = aligner.learn(list(chain.from_iterable(split)))
                sizes = np.fromiter(map(len, split), np.int64, n)
                owner = np.repeat(np.arange(n), sizes)
                fine = np.bincount(owner[~aligner.good[numbers]], minlength=n) == 0
                fine &= np.array([spans != [b""] for spans in split])
                numbers, owner = numbers[fine[owner]], owner[fine[owner]]
                for k in range(3):
                    block.counts[:, k] = np.rint(np.bincount(owner, weights=aligner.counts[numbers, k], minlength=n))
                block.links, block.owner = aligner.linked(numbers), np.repeat(owner, aligner.size[numbers])
                block.counts[:, 3] = np.bincount(block.owner, minlength=n)
                bodies, at = list(map(aligner.text.__getitem__, numbers.tolist())), 0
                for i in np.flatnonzero(fine).tolist():
                    block.add(i, ";".join(bodies[at : at + len(split[i])]), with_groups)
                    at += len(split[i])
                kept = pa.StructArray.from_arrays([batch.column(k).slice(lo, hi - lo) for k in range(len(names))], names)
                yield block.row(kept, with_groups)

    return run


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns ``mark``, text to one row per byte range with the window that its task has to encode."""
    for batch in batches:
        texts = text_column(batch, batch.schema.names[-1])
        for i, mark in enumerate(batch.column(0).to_pylist()):
            raw = b" " + texts[i].as_buffer().to_pybytes()
            safe = np.concatenate([[0], safe_cuts(np.frombuffer(raw, np.uint8)), [len(raw)]])
            ends = np.arange(RANGE_BYTES, len(raw), RANGE_BYTES)
            before = safe[np.searchsorted(safe, ends, side="right") - 1]
            after = safe[np.searchsorted(safe, ends, side="left")]
            ok = (ends - before <= REACH) & (after - ends <= REACH)
            lo = [0, *ends[ok].tolist()]
            hi = [*ends[ok].tolist(), len(raw)]
            base, stop = [0, *before[ok].tolist()], [*after[ok].tolist(), len(raw)]
            for k in range(len(lo)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], pa.int64()) for v in (mark, k, lo[k], hi[k], base[k])]
                    + [pa.array([raw[base[k] : stop[k]]], pa.binary())],
                    names=["mark", "place", "lo", "hi", "base", "window"])


_FRAGMENT = T.StructType(
    [T.StructField("mark", T.LongType()), T.StructField("place", T.LongType()), T.StructField("closed", T.BooleanType())]
    + [T.StructField(c, T.ArrayType(T.LongType())) for c in ("head_a", "head_b", "tail_a", "tail_b", "links")]
    + [T.StructField("body", T.StringType())]
    + [T.StructField(c, T.LongType()) for c in COUNTS[:3]] + [T.StructField("ok", T.BooleanType())])


def _fragment_row(mark: int, place: int, f: Fragment) -> dict:
    return {"mark": mark, "place": place, "closed": f.closed, "head_a": f.head[0], "head_b": f.head[1],
            "tail_a": f.tail[0], "tail_b": f.tail[1], "links": f.links, "body": f.body, "n_a": f.n_a, "n_b": f.n_b,
            "n_groups": f.n_groups, "ok": f.ok}


def _fragment_back(r: dict) -> Fragment:
    return Fragment(r["closed"], (r["head_a"], r["head_b"]), (r["tail_a"], r["tail_b"]), r["body"], r["n_a"], r["n_b"],
                    r["n_groups"], r["links"], r["ok"])


def _arrow(rows: list[dict]) -> pa.RecordBatch:
    kinds = {T.LongType(): pa.int64(), T.BooleanType(): pa.bool_(), T.StringType(): pa.string()}
    of = lambda t: pa.list_(pa.int64()) if isinstance(t, T.ArrayType) else kinds[t]
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([(f.name, of(f.dataType)) for f in _FRAGMENT]))


def long_fragments(ranges: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """One fragment per marked text: ranges encoded by separate tasks, neighbours composed round by round.

    ``ranges`` is materialised; the number of rounds is the logarithm of the longest text's ranges.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(paths)
        for batch in batches:
            for r in batch.to_pylist():
                yield _arrow([_fragment_row(r["mark"], r["place"],
                                            aligner.fragment(r["window"], r["base"], r["lo"], r["hi"]))])

    def step(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["place"])
        whole = compose([_fragment_back(r) for r in rows])
        return pa.Table.from_batches([_arrow([_fragment_row(rows[0]["mark"], rows[0]["place"] // FAN, whole)])])

    out = ranges.repartition("mark", "place").mapInArrow(encode, _FRAGMENT)
    most = ranges.agg(F.max("place")).first()[0] or 0
    while most > 0:
        out = out.groupBy("mark", F.floor(F.col("place") / FAN).alias("up")).applyInArrow(step, _FRAGMENT)
        most //= FAN
    return out


def _long_blocks(with_groups: bool):
    """A block per long text, from its fragment (columns behind the carried ones)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch.schema.names) - len(_FRAGMENT.names)
            own = pa.RecordBatch.from_arrays(batch.columns[n:], names=_FRAGMENT.names)
            for i in range(batch.num_rows):
                f = _fragment_back(own.slice(i, 1).to_pylist()[0]).whole()
                block = _Block(1)
                if f.ok:
                    block.add(0, f.body, with_groups)
                    block.links = np.array(f.links, dtype=np.int64)
                    block.owner = np.zeros(len(f.links), dtype=np.int64)
                    block.counts[0] = f.n_a, f.n_b, f.n_groups, len(f.links)
                kept = pa.StructArray.from_arrays([batch.column(k).slice(i, 1) for k in range(n)], batch.schema.names[:n])
                yield block.row(kept, with_groups)

    return run


def _with_counts(kept: T.StructType, with_groups: bool):
    """The texts of blocks with ``n_best`` and ``count_sum``, from the corpus-wide counts of their pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                texts = batch.column(0).slice(i, 1).flatten()
                doc, place, times = _unpack(batch.column(1)[i].as_py())
                known = batch.column(2).slice(i, 1).flatten()
                at, count, best = (known.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                counts = np.zeros(len(known), dtype=np.int64)
                top = np.zeros(len(known), dtype=bool)
                counts[at], top[at] = count, best
                total, n_best = (np.zeros(len(texts), dtype=np.int64) for _ in range(2))
                if len(doc):
                    np.add.at(total, doc, counts[place] * times)
                    np.add.at(n_best, doc, top[place] * times)
                columns = texts.flatten()
                m = len(kept.names) + len(COUNTS)
                yield pa.RecordBatch.from_arrays(
                    [*columns[:m], pa.array(n_best), pa.array(total), *columns[m:]],
                    names=[*kept.names, *COUNTS, "n_best", "count_sum", "groups_sha256", *["groups"] * with_groups])

    return run


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, text: str = "text", carry: list[str] | None = None,
                     with_groups: bool = False) -> DataFrame:
    """The columns ``carry`` of ``docs`` (default: all but the text) and the alignment of every text.

    ``n_a``, ``n_b`` (tokens), ``n_groups``, ``n_links``, ``n_best`` (links whose count is the highest of their A id),
    ``count_sum`` (over the links), ``groups_sha256``; ``with_groups`` adds the groups themselves.
    """
    paths = (path_a, path_b)
    made = {*COUNTS, "n_best", "count_sum", "groups_sha256", "groups"}
    keep = [c for c in docs.columns if c != text] if carry is None else list(carry)
    keep = [c for c in keep if c.lower() not in made]
    mark, sent = own_name(docs, "text_mark", "whole_text")
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    slim = spread(docs).select(*[F.col(f"`{c}`") for c in keep], whole.alias(sent))
    kept = slim.drop(sent).schema
    texts = T.StructType(kept.fields + [T.StructField(c, T.LongType()) for c in COUNTS] + [
        T.StructField("groups_sha256", T.StringType())] + [T.StructField("groups", T.StringType())] * with_groups)
    block_row = T.StructType([
        T.StructField("texts", T.ArrayType(texts)), T.StructField("pairs", T.ArrayType(T.LongType())),
        T.StructField("n_texts", T.ArrayType(T.LongType())), T.StructField("cells", T.BinaryType())])
    is_long = F.octet_length(F.col(sent)) > 2 * RANGE_BYTES
    short = slim.where(~is_long).mapInArrow(_short_blocks(paths, with_groups), block_row)
    # the marks tie a long text's ranges to its other columns, so both are written down together
    marked = cut(slim.where(is_long).withColumn(mark, F.monotonically_increasing_id()))
    ranges = cut(marked.select(mark, sent).mapInArrow(
        _ranges, "mark long, place long, lo long, hi long, base long, window binary"))
    found = long_fragments(ranges, paths)
    long = marked.drop(sent).join(found, F.col(mark) == F.col("mark")).select(
        *[F.col(f"`{c}`") for c in keep], *[found[c] for c in _FRAGMENT.names]
    ).mapInArrow(_long_blocks(with_groups), block_row)
    blocks = cut(short.unionByName(long).withColumn("block", F.monotonically_increasing_id()))
    entries = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "n_texts")).alias("at", "e")).select(
        "block", "at", F.col("e.pairs").alias("pair"), F.col("e.n_texts").alias("n"))
    totals = entries.groupBy("pair").agg(F.sum("n").alias("count"))
    id_a = F.shiftright("pair", PAIR_BITS)
    top = totals.groupBy(id_a.alias("a")).agg(F.max("count").alias("most"))
    known = cut(totals.withColumn("a", id_a).join(top, "a").select(
        "pair", "count", (F.col("count") == F.col("most")).alias("best")))
    back = entries.drop("n").join(known, "pair").groupBy("block").agg(
        F.collect_list(F.struct("at", "count", "best")).alias("known"))
    joined = blocks.select("block", "texts", "cells").join(back, "block", "left").select(
        "texts", "cells", F.coalesce("known", F.array().cast("array<struct<at:int,count:bigint,best:boolean>>")).alias("known"))
    result = T.StructType(kept.fields + [T.StructField(c, T.LongType()) for c in (*COUNTS, "n_best", "count_sum")] + [
        T.StructField("groups_sha256", T.StringType())] + [T.StructField("groups", T.StringType())] * with_groups)
    return joined.mapInArrow(_with_counts(kept, with_groups), result)
