"""SentencePiece encoding and decoding with a weighted finite-state transducer (operator 4).

A ``.model`` file is compiled into three transducers:

* the normaliser: a space becomes the meta symbol, which is also put in front of the text;
* the lexicon: a trie whose arcs spell pieces and output ids;
* byte fallback: any other character outputs the ids of its UTF-8 bytes.

They are composed with an input lazily, and the output is the shortest path in the tropical
semiring.  The models here are of the merge kind (BPE), for which a sum of piece scores
does not give the library's result.  So the lexicon is composed with a bigram acceptor over
pieces: an arc from piece a to piece b weighs 0 if merging the characters of "ab" ends
in exactly those two pieces, and infinity otherwise.  A sequence of pieces is the
model's segmentation if and only if every neighbouring pair passes, so a position of an
input is reached by one finite path at most, and the shortest path is the library's answer.  The bigram
weights are computed when first needed and remembered.

Inputs are composed word by word: no piece holds the meta symbol behind another
character, and a newline is no part of a piece, so paths never cross there; nor do they between two
characters that no piece holds side by side, so a word and its last characters (a comma) are composed
apart where that is so.  A worker remembers the paths of recent words (two bounded tables: what is asked for again
moves from the older to the newer one).

Edge cases: a null or empty text encodes to no ids and decodes to the empty text; runs of spaces, leading and trailing
spaces are kept; a literal meta symbol decodes to a space, as in the library; repeated
rows are encoded alike; extra columns are carried; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.schema_safe import own_name
from strata.llm.text_arrays import chunks, text_column

META = "▁"  # fixed value: the symbol that stands for a space
REMEMBERED_WORDS = 200_000
REMEMBERED_PAIRS = 300_000
REMEMBERED_SINGLE = 10_000
#: Piece types of a model file (fixed values).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGE_KIND = 2

_workers: dict[str, Transducer] = {}


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol buffer message."""

    def varint(i):
        value = shift = 0
        while True:
            byte = data[i]
            value |= (byte & 127) << shift
            i, shift = i + 1, shift + 7
            if byte < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        elif key & 7 == 2:
            size, i = varint(i)
            value, i = data[i : i + size], i + size
        else:
            size = 8 if key & 7 == 1 else 4
            value, i = data[i : i + size], i + size
        yield key >> 3, value


class Transducer:
    """The compiled model: ``encode`` a text to ids, ``decode`` ids to a text."""

    def __init__(self, path: str):
        pieces, trainer, normalizer = [], {}, {}
        with open(path, "rb") as f:
            for field, value in _fields(f.read()):
                if field == 1:
                    p = dict(_fields(value))
                    score = struct.unpack("<f", p[2])[0] if 2 in p else 0.0
                    pieces.append((p[1].decode("utf-8"), score, p.get(3, NORMAL)))
                elif field == 2:
                    trainer = dict(_fields(value))
                elif field == 3:
                    normalizer = dict(_fields(value))
        kinds = {k for _, _, k in pieces}
        if trainer.get(3) != MERGE_KIND or not trainer.get(35) or kinds & {USER, UNUSED}:
            raise ValueError("only merge models with byte fallback and without user pieces are compiled")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(3, 1) or not normalizer.get(5, 1):
            raise ValueError("only the identity normaliser with a leading meta symbol is compiled")
        self.ids = {p: i for i, (p, _, k) in enumerate(pieces) if k == NORMAL}
        self.score = {p: s for p, s, k in pieces if k == NORMAL}
        if any(META in p.lstrip(META) for p in self.ids) or any("\n" in p for p in self.ids):
            raise ValueError("pieces may hold the meta symbol in front only, and no newline")
        #: the beginnings of pieces as a tree: by the next character, and under "" the piece that ends here
        self.trie: dict = {}
        for p in self.ids:
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = p
        #: characters side by side in a piece
        self.bonds = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.single: dict[str, tuple[int, ...]] = {}
        if not all(c in self.ids for p in self.ids for c in p):
            raise ValueError("every character of a piece must be a piece")
        self.byte_ids = [0] * 256
        self.out: list[bytes] = []
        for i, (p, _, k) in enumerate(pieces):
            if k == BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
                self.out.append(bytes([int(p[3:5], 16)]))
            else:
                self.out.append({NORMAL: p.replace(META, " "), UNKNOWN: " ⁇ "}.get(k, "").encode())
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0
        self.words = _Words(self)

    def _merged(self, text: str) -> list[str]:
        """The merges of a short string: always the best pair, the leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def finite(self, a: str, b: str) -> bool:
        """Whether the bigram acceptor gives ``b`` after ``a`` (empty: a start) weight 0."""
        row = self.pairs.get(a)
        if row is None:
            row = self.pairs[a] = {}
        known = row.get(b)
        if known is None:
            self.n_pairs += 1
            if self.n_pairs > REMEMBERED_PAIRS:
                self.pairs, self.n_pairs = {}, 0
            known = row[b] = self._merged(a + b) == ([a, b] if a else [b])
        return known

    def _arcs(self, word: str, at: int) -> list[str]:
        """The pieces that start at a position, short to long; an unknown character is an arc of its own."""
        node, out = self.trie, []
        for c in word[at:]:
            node = node.get(c)
            if node is None:
                break
            if "" in node:
                out.append(node[""])
        return out or [word[at]]

    def shortest_path(self, word: str) -> tuple[int, ...]:
        """The ids on the path of weight 0 through a normalised word, long arcs first.

        A position is reached by one path of weight 0 only, so one without a way on is dead for good.
        """
        n, ids, finite, pairs, get_arcs = len(word), self.ids, self.finite, self.pairs, self._arcs
        path: list[str] = []
        opened: list[tuple[int, list[str]]] = []
        dead: set[int] = set()
        at, arcs, before = 0, get_arcs(word, 0), ""
        while at < n:
            row = pairs.get(before)
            while arcs:
                piece = arcs.pop()
                end = at + len(piece)
                if end in dead:
                    continue
                known = row.get(piece) if row is not None else None
                if known is None:
                    known = piece not in ids or finite(before, piece)
                    pairs = self.pairs
                if known:
                    opened.append((at, arcs))
                    path.append(piece)
                    at = end
                    before = piece if piece in ids else ""
                    if at < n:
                        arcs = get_arcs(word, at)
                    break
            else:
                dead.add(at)
                at, arcs = opened.pop()
                path.pop()
                before = path[-1] if path and path[-1] in ids else ""
        out: list[int] = []
        for piece in path:
            if piece in ids:
                out.append(ids[piece])
            else:
                out.extend(self.byte_ids[b] for b in piece.encode("utf-8"))
        return tuple(out)

    def alone(self, character: str) -> tuple[int, ...]:
        """The ids of a character that is in no piece with the one before."""
        path = self.single.get(character)
        if path is None:
            if len(self.single) >= REMEMBERED_SINGLE:
                self.single.clear()
            path = self.single[character] = self.shortest_path(character)
        return path

    def encode(self, text: str) -> Iterator[int]:
        """The ids of a text."""
        if not text:
            return iter(())
        if text[0] in " \n" or text[-1] == " " or "  " in text or " \n" in text or META in text:
            normalised = META + text.replace(" ", META)
            return chain.from_iterable(map(self.words.segment, _SEGMENT.findall(normalised)))
        # every word once, the usual case: words between single spaces, a newline starts a word
        return chain.from_iterable(map(self.words.__getitem__, text.replace("\n", " \n").split(" ")))

    def decode(self, ids) -> str:
        """The text of ids: pieces and bytes joined, meta symbols as spaces, without the leading one."""
        text = b"".join(map(self.out.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_SEGMENT = re.compile(f"{META}*[^{META}\n]+|{META}+|\n")


class _Words(dict):
    """Ids of recent words.  A key without a leading newline follows a space.

    When half of what may be remembered is here, it becomes the older half; a word found there comes back.
    """

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer
        self.older: dict[str, tuple[int, ...]] = {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        fst = self.transducer
        path = self.older.get(word)
        if path is None:
            n = len(word)
            while n > 1 and word[n - 2 : n] not in fst.bonds:
                n -= 1
            if n < len(word):
                return self[word[:n]] + tuple(chain.from_iterable(map(fst.alone, word[n:])))
            path = fst.shortest_path(word if word[:1] == "\n" else META + word)
        if 2 * len(self) >= REMEMBERED_WORDS:
            self.older = dict(self)
            self.clear()
        self[word] = path
        return path

    def segment(self, normalised: str) -> tuple[int, ...]:
        """The ids of a normalised segment, which may have any number of meta symbols in front."""
        if normalised[0] == META and normalised[1:2] not in ("", META, "\n"):
            return self[normalised[1:]]
        return self.transducer.shortest_path(normalised)


def _transducer(path: str) -> Transducer:
    if path not in _workers:
        _workers[path] = Transducer(path)
    return _workers[path]


def encode_decode(
    docs: DataFrame,
    model_path: str,
    text: str = "text",
    carry: list[str] | None = None,
    with_text: bool = False,
) -> DataFrame:
    """The columns ``carry`` of ``docs`` (default: all but the text), the ids and what they decode to.

    Added: ``n_ids`` long, ``ids`` array<int>, ``round_trip`` boolean (the ids decode to the text) and, with
    ``with_text``, ``decoded`` string.  ``model_path`` must name the same file on every
    executor.  A carried column with the name of a result column is replaced.
    """
    added = {"n_ids": "long", "ids": "array<int>", "round_trip": "boolean"} | (
        {"decoded": "string"} if with_text else {})
    keep = [c for c in docs.columns if c != text] if carry is None else list(carry)
    keep = [c for c in keep if c.lower() not in added]
    (sent,) = own_name(docs, "whole_text")
    at = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = _transducer(model_path)
        for batch in batches:
            texts = text_column(batch, batch.schema.names[at])
            for lo, hi in chunks(texts):
                whole = texts.slice(lo, hi - lo).to_pylist()
                ids = [list(fst.encode(t)) for t in whole]
                back = [fst.decode(i) for i in ids]
                off = np.zeros(len(ids) + 1, dtype=np.int32)
                np.cumsum([len(i) for i in ids], out=off[1:])
                flat = pa.array(np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(off[-1])))
                cols = [pa.array(np.diff(off).astype(np.int64)), pa.ListArray.from_arrays(pa.array(off), flat),
                        pa.array([a == b for a, b in zip(back, whole)], pa.bool_())]
                if with_text:
                    cols.append(pa.array(back, pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(lo, hi - lo) for i in range(at)] + cols, names=keep + list(added))

    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema
    schema = T.StructType([*schema, *(T.StructField(n, T._parse_datatype_string(k)) for n, k in added.items())])
    slim = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(sent))
    return slim.mapInArrow(run, schema)
