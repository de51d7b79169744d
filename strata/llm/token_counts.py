"""Token counts (operator 8): batch encoding in Arrow functions that return lengths only.

Long texts are split at safe boundaries: a space or a newline, which the vocabulary's
pre-tokenizer never crosses and no special token contains.  The pieces of a batch go to
the library together, in calls balanced by bytes, each distinct piece once; a text's
count is the sum over its pieces.  A worker keeps the counts of recent pieces (a bounded
least-recently-used table), so frequent words are encoded once per worker.

The vocabulary is a file of a public tokenizer: ``tokenizers`` reads ``.json``,
``sentencepiece`` reads ``.model``.  No special tokens are added, nothing is truncated.
For a ``.model`` whose pieces may span words the text is encoded whole.

Edge cases: a null or empty text has 0 tokens and 0 bytes; white space alone has 0 tokens
where the vocabulary drops it; repeated rows each get their count; extra columns are
carried as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.schema_safe import own_name
from strata.llm.text_arrays import chunks, text_column

#: Bytes of pieces in one call of the library, and pieces remembered by a worker.
CALL_BYTES = 1 << 20
REMEMBERED = 400_000
LIMIT_TOKENS = 2048

_workers: dict[str, PieceCounter] = {}


class PieceCounter:
    """Token counts of pieces, remembered up to ``REMEMBERED`` pieces (two generations)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.by_piece = path.endswith(".json")
        if self.by_piece:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            self._encode = lambda pieces: [len(e) for e in tok.encode_batch_fast(pieces, add_special_tokens=False)]
        else:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            self._encode = lambda pieces: [len(x) for x in sp.encode(pieces, num_threads=1)]
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def learn(self, pieces: set[str]) -> None:
        """Make the counts of ``pieces`` known, by calls balanced by bytes."""
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        missing = []
        for p in pieces.difference(self.young):
            n = self.old.get(p)
            if n is None:
                missing.append(p)
            else:
                self.young[p] = n
        call, size = [], 0
        for p in missing:
            call.append(p)
            size += len(p)
            if size >= CALL_BYTES:
                self.young.update(zip(call, self._encode(call)))
                call, size = [], 0
        if call:
            self.young.update(zip(call, self._encode(call)))

    def counts(self, texts: list[str]) -> list[int]:
        if not self.by_piece:
            return self._encode(texts)
        split = [t.replace("\n", " ").split(" ") for t in texts]
        self.learn(set().union(*split))
        known = self.young.__getitem__
        return [sum(map(known, s)) for s in split]


def _counter(path: str) -> PieceCounter:
    if path not in _workers:
        _workers[path] = PieceCounter(path)
    return _workers[path]


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    text: str = "text",
    carry: list[str] | None = None,
    n_bytes: str = "n_bytes",
    n_tokens: str = "n_tokens",
) -> DataFrame:
    """The columns ``carry`` of ``docs`` (default: all but the text), UTF-8 bytes and token counts.

    ``tokenizer_path`` must name the same file on every executor (installed package or
    shared folder).  A carried column with the name of a result column is replaced.
    """
    keep = [c for c in docs.columns if c != text] if carry is None else list(carry)
    keep = [c for c in keep if c.lower() not in {n_bytes.lower(), n_tokens.lower()}]
    (sent,) = own_name(docs, "whole_text")
    at = len(keep)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer_path)
        for batch in batches:
            texts = text_column(batch, batch.schema.names[at])
            off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
            for lo, hi in chunks(texts):
                n = counter.counts(texts.slice(lo, hi - lo).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(lo, hi - lo) for i in range(at)]
                    + [pa.array(np.diff(off[lo : hi + 1]), pa.int64()), pa.array(n, pa.int64())],
                    names=keep + [n_bytes, n_tokens])

    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add(n_bytes, "long").add(n_tokens, "long")
    slim = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(sent))
    return slim.mapInArrow(encode, schema)
