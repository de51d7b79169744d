"""Fill-in-the-middle over seekable compressed frames (operator 11).

A text is stored as independent zstandard frames of at most ``FRAME_BYTES`` bytes, cut between
code points.  Beside its frames stand the cumulative counts before each of them: bytes, code points
and finished units (lines).  That index answers how many units a text has and which frame holds the
end of a given unit, so choosing a prefix, middle and suffix decompresses the (at most two) frames
that the cuts fall into.  Digests stream the ordered frames through SHA-256, one decompressed frame
at a time; a task never holds more of a text than its compressed frames and one frame.

The rearranged output is built as a stream, too, and framed again: it is what a training job would
read.  Restoring takes nothing but that output and its form: the markers are searched in the stream
of its frames, and the ranges between them are streamed in the order of the text.

* units: lines with their line end, ``[^\\n]*\\n|[^\\n]+``;
* the cuts follow the units given by two hashes of the key modulo ``n + 1``, the smaller first;
* forms: ``psm`` is ``<P>`` prefix ``<S>`` suffix ``<M>`` middle, ``spm`` is ``<S>`` suffix ``<P>``
  prefix ``<M>`` middle, ``plain`` the text as it is.  Plain are empty texts, texts that contain a
  marker, and the share that ``fim_percent`` leaves out.

Edge cases: a null text is empty; a null key is hashed as the empty string; rows that repeat a key get
the same hashes, each with its own text; a text without a line end is one unit; carried columns keep
their names, and one with the name of a result column is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.schema_safe import own_name
from strata.llm.text_arrays import chunks, text_column

FRAME_BYTES = 1 << 16
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
FIM_PERCENT = 100
SPM_PERCENT = 50

#: One row's frames: counts before each frame, and the frame.
FRAMES_TYPE = T.ArrayType(T.StructType(
    [T.StructField(c, T.LongType()) for c in ("units", "chars", "bytes")] + [T.StructField("data", T.BinaryType())]))
_ARROW_FRAME = pa.struct([("units", pa.int64()), ("chars", pa.int64()), ("bytes", pa.int64()), ("data", pa.binary())])
_RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output")

_press = zstandard.ZstdCompressor(level=3)
_unpress = zstandard.ZstdDecompressor()


class Frames:
    """A sequence of bytes in independent compressed frames, read by position."""

    def __init__(self) -> None:
        self.units: list[int] = [0]
        self.chars: list[int] = [0]
        self.bytes: list[int] = [0]
        self.data: list = []
        self._open: tuple[int, bytes] = (-1, b"")

    @classmethod
    def stored(cls, units, chars, ends, data, total: tuple[int, int, int]) -> Frames:
        """Frames read back: the counts before each frame, and those of the whole."""
        out = cls()
        out.units, out.chars, out.bytes = [*units, total[0]], [*chars, total[1]], [*ends, total[2]]
        out.data = data
        return out

    @classmethod
    def of(cls, stream: Iterable[bytes], frame_bytes: int = FRAME_BYTES) -> Frames:
        """Frame a stream of bytes (valid UTF-8 as a whole); holds one frame at a time."""
        out, held = cls(), bytearray()
        for piece in stream:
            held += piece
            at = 0
            while len(held) - at > frame_bytes:
                cut = at + frame_bytes
                while cut > at + 1 and held[cut] & 0xC0 == 0x80:
                    cut -= 1
                out._add(bytes(held[at:cut]))
                at = cut
            del held[:at]
        if held:
            out._add(bytes(held))
        return out

    def _add(self, raw: bytes) -> None:
        self.units.append(self.units[-1] + raw.count(b"\n"))
        self.chars.append(self.chars[-1] + int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
        self.bytes.append(self.bytes[-1] + len(raw))
        self.data.append(_press.compress(raw))

    def __len__(self) -> int:
        return self.bytes[-1]

    def raw(self, f: int) -> bytes:
        """Frame ``f`` decompressed; the last one read is kept."""
        if self._open[0] != f:
            self._open = (f, _unpress.decompress(self.data[f]))
        return self._open[1]

    def units_end(self, k: int, n: int) -> tuple[int, int]:
        """Bytes and code points of the first ``k`` of ``n`` units; opens the frame that holds the cut."""
        if k == 0:
            return 0, 0
        if k >= n:
            return self.bytes[-1], self.chars[-1]
        f = int(np.searchsorted(np.asarray(self.units), k, side="left")) - 1
        raw = np.frombuffer(self.raw(f), np.uint8)
        end = int(np.flatnonzero(raw == 0x0A)[k - self.units[f] - 1]) + 1
        return self.bytes[f] + end, self.chars[f] + int(np.count_nonzero((raw[:end] & 0xC0) != 0x80))

    def stream(self, lo: int, hi: int) -> Iterator[bytes]:
        """The bytes ``lo:hi``, frame by frame."""
        if lo >= hi:
            return
        f = int(np.searchsorted(np.asarray(self.bytes), lo, side="right")) - 1
        while f < len(self.data) and self.bytes[f] < hi:
            raw, base = self.raw(f), self.bytes[f]
            yield raw[max(lo - base, 0) : hi - base]
            f += 1

    def find(self, marker: bytes, start: int) -> int:
        """Position of the first ``marker`` from ``start`` on, frame by frame."""
        tail, at = b"", start
        for piece in self.stream(start, len(self)):
            joined = tail + piece
            k = joined.find(marker)
            if k >= 0:
                return at - len(tail) + k
            tail, at = joined[-(len(marker) - 1) :], at + len(piece)
        raise ValueError(f"no {marker!r} in the output")


def arranged(text: Frames, form: str, a: int, b: int) -> Iterator[bytes]:
    """The output as a stream: ``a`` and ``b`` are the bytes before the middle and before the suffix."""
    n = len(text)
    if form == "plain":
        yield from text.stream(0, n)
        return
    prefix, suffix = (PREFIX.encode(), 0, a), (SUFFIX.encode(), b, n)
    for marker, lo, hi in (prefix, suffix, (MIDDLE.encode(), a, b)) if form == "psm" else (
            suffix, prefix, (MIDDLE.encode(), a, b)):
        yield marker
        yield from text.stream(lo, hi)


def restored(out: Frames, form: str) -> Iterator[bytes]:
    """The text as a stream, from its output and form alone."""
    n = len(out)
    if form == "plain":
        yield from out.stream(0, n)
        return
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    head = len(first.encode())
    at = out.find(second.encode(), head)
    middle = out.find(MIDDLE.encode(), at + len(second.encode()))
    ranges = {first: (head, at), second: (at + len(second.encode()), middle)}
    yield from out.stream(*ranges[PREFIX])
    yield from out.stream(middle + len(MIDDLE.encode()), n)
    yield from out.stream(*ranges[SUFFIX])


def digest(stream: Iterable[bytes]) -> str:
    h = hashlib.sha256()
    for piece in stream:
        h.update(piece)
    return h.hexdigest()


def _frames_array(rows: list[Frames]) -> pa.ListArray:
    flat = [np.concatenate([np.asarray(getattr(r, c)[:-1], dtype=np.int64) for r in rows] or [np.zeros(0, np.int64)])
            for c in ("units", "chars", "bytes")]
    data = pa.array([d for r in rows for d in r.data], pa.binary())
    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r.data) for r in rows], out=offsets[1:])
    values = pa.StructArray.from_arrays([*map(pa.array, flat), data], fields=list(_ARROW_FRAME))
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def frame_texts(docs: DataFrame, text: str = "text", carry: list[str] | None = None,
                frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """The columns ``carry`` of ``docs`` (default: all but the text) and the stored form of the text.

    ``n_units``, ``n_ended`` (units that have a line end), ``n_chars``, ``n_bytes`` count the whole text, ``marked`` says
    that it holds a marker, ``frames`` is :data:`FRAMES_TYPE`.  Store it as a table; every later
    reading needs only the frames that it touches.  A carried column of one of these names is replaced.
    """
    made = ["marked", "n_units", "n_ended", "n_chars", "n_bytes", "frames"]
    keep = [c for c in docs.columns if c != text] if carry is None else list(carry)
    keep = [c for c in keep if c.lower() not in made]
    (sent,) = own_name(docs, "whole_text", *made)[:1]
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    marked = F.contains(whole, F.lit(PREFIX)) | F.contains(whole, F.lit(SUFFIX)) | F.contains(whole, F.lit(MIDDLE))
    slim = docs.select(*[F.col(f"`{c}`") for c in keep], marked.alias("marked"), whole.alias(sent))
    at = len(keep) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch, batch.schema.names[at])
            for lo, hi in chunks(texts):
                rows, units = [], []
                for i in range(lo, hi):
                    raw = memoryview(texts[i].as_buffer())
                    rows.append(Frames.of((raw[k : k + frame_bytes] for k in range(0, len(raw), frame_bytes)), frame_bytes))
                    units.append(rows[-1].units[-1] + (len(raw) > 0 and raw[-1] != 0x0A))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(lo, hi - lo) for i in range(at)]
                    + [pa.array(units, pa.int64()), *[pa.array([getattr(r, c)[-1] for r in rows], pa.int64())
                                                      for c in ("units", "chars", "bytes")], _frames_array(rows)],
                    names=keep + made)

    schema = slim.drop(sent).schema
    for c in made[1:5]:
        schema = schema.add(c, "long")
    return slim.mapInArrow(run, schema.add("frames", FRAMES_TYPE))


def hash_part(key: Column, part: int, seed: int = SEED) -> Column:
    """The ``part``-th (from 1) 8-digit group of the hex SHA-256 of ``seed:key``, as an unsigned integer."""
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(hexed, 8 * part - 7, 8), 16, 10).cast("long")


def plan_cuts(frames: DataFrame, key: str, seed: int = SEED, fim_percent: int = FIM_PERCENT,
              spm_percent: int = SPM_PERCENT) -> DataFrame:
    """``frames`` with ``form``, ``cut_a`` and ``cut_b`` (units before the middle and before the suffix)."""
    h = [hash_part(F.col(f"`{key}`"), i, seed) for i in (1, 2, 3, 4)]
    whole = (F.col("n_bytes") == 0) | F.col("marked") | (h[2] % 100 >= fim_percent)
    form = F.when(whole, "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm")
    ends = [h[i] % (F.col("n_units") + 1) for i in (0, 1)]
    return frames.withColumns({"form": form, "cut_a": F.least(*ends), "cut_b": F.greatest(*ends)})


def fill_in_middle(planned: DataFrame, carry: list[str], with_output: bool = False) -> DataFrame:
    """``carry``, ``n``, ``form``, ``prefix_chars``, ``middle_chars``, ``output_sha256``, ``restored_sha256`` of planned frames.

    ``with_output`` adds the output itself as text.  ``prefix_chars`` and ``middle_chars`` are null in plain rows.
    """
    keep = [c for c in carry if c.lower() not in _RESULTS]
    work = ["form", "cut_a", "cut_b", "n_units", "n_ended", "n_chars", "n_bytes", "frames"]
    slim = planned.select(*[F.col(f"`{c}`") for c in keep], *[F.col(c).alias(f"fim {c}") for c in work])
    base = len(keep)
    names = keep + list(_RESULTS[: 7 if with_output else 6])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            form, a, b, n, ended, n_chars, n_bytes = (batch.column(base + i).to_pylist() for i in range(7))
            lists = batch.column(base + 7)
            edge = lists.offsets.to_numpy()
            units, chars, ends = (lists.values.field(i).to_numpy() for i in range(3))
            data = lists.values.field(3)
            out: list[list] = [[] for _ in range(5)]
            for i in range(batch.num_rows):
                lo, hi = int(edge[i]), int(edge[i + 1])
                text = Frames.stored(units[lo:hi].tolist(), chars[lo:hi].tolist(), ends[lo:hi].tolist(),
                                     [data[k].as_buffer() for k in range(lo, hi)], (ended[i], n_chars[i], n_bytes[i]))
                (at, c_at), (to, c_to) = ((0, None), (0, None)) if form[i] == "plain" else (
                    text.units_end(a[i], n[i]), text.units_end(b[i], n[i]))
                built = Frames.of(arranged(text, form[i], at, to))
                out[0].append(c_at)
                out[1].append(None if c_at is None else c_to - c_at)
                out[2].append(digest(built.stream(0, len(built))))
                out[3].append(digest(restored(built, form[i])))
                if with_output:
                    out[4].append(b"".join(built.stream(0, len(built))).decode())
            columns = [batch.column(i) for i in range(base)] + [batch.column(base + 3), batch.column(base)]
            columns += [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())]
            columns += [pa.array(x, pa.string()) for x in out[2 : 5 if with_output else 4]]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = slim.select(*[F.col(f"`{c}`") for c in keep]).schema.add("n", "long").add("form", "string")
    schema = schema.add("prefix_chars", "long").add("middle_chars", "long")
    for c in names[base + 4 :]:
        schema = schema.add(c, "string")
    return slim.mapInArrow(run, schema)
