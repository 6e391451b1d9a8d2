"""Token counts: batch encoding in Arrow functions that return lengths only.

A text is split at safe boundaries into chunks, each the spaces before a word and the word. No piece of the
vocabulary has a space behind another character, so no merge crosses such a boundary and the chunks' lengths add up
to the text's. Chunks not met before are encoded in batches bounded by bytes; a bounded table remembers those of short
chunks. A text without spaces has no such boundary, as merges may cross any other place, and is one chunk.

Nulls count as empty. Rows are neither merged nor dropped: repeated rows and null ids give a row each. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, ship

#: Bytes of text that one call of the library encodes, and lengths that a worker remembers.
BATCH_BYTES = 1 << 20
REMEMBERED = 400_000
#: Characters up to which a chunk's length is remembered, so that the table has bounded bytes, not only entries.
SHORT = 64

_WORD_MARK = "▁"
_CHUNK = re.compile(" +[^ ]*")


def byte_batches(texts: list[str], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Consecutive texts, together at most limit bytes unless one alone has more."""
    batch, held = [], 0
    for text in texts:
        n = len(text) if text.isascii() else len(text.encode())
        if batch and held + n > limit:
            yield batch
            batch, held = [], 0
        batch.append(text)
        held += n
    if batch:
        yield batch


class PieceCounter:
    """Counts of a sentencepiece model whose pieces have spaces at their start only; others encode whole texts."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.splits = all(_WORD_MARK not in p.lstrip(_WORD_MARK) for p in pieces)
        # Runs of spaces must come through as they are, else chunks are no safe boundary.
        self.splits = self.splits and self.model.decode(self.model.encode(" a  b ")) == " a  b "
        self.lengths: dict[str, int] = {}

    def _lengths(self, texts: list[str]) -> Iterator[int]:
        for batch in byte_batches(texts):
            yield from map(len, self.model.encode(batch, num_threads=1))

    def count(self, texts: list[str | None]) -> list[int]:
        """Number of tokens of each text."""
        parts: list[list[str] | None] = []
        whole: list[str] = []
        fresh: dict[str, None] = {}
        once: dict[str, int] = {}
        if len(self.lengths) > REMEMBERED:
            self.lengths = {}
        known = self.lengths
        for text in texts:
            if not text:
                parts.append([])
            elif not self.splits or _WORD_MARK in text or "\0" in text:
                parts.append(None)
                whole.append(text)
            else:
                chunks = text.split(" ") if "  " not in text and text[0] != " " and text[-1] != " " else [c[1:] for c in _CHUNK.findall(" " + text)]
                parts.append(chunks)
                fresh.update((c, None) for c in chunks if c not in known)
        new = list(fresh)
        for chunk, n in zip(new, self._lengths(new), strict=True):
            (known if len(chunk) <= SHORT else once)[chunk] = n
        if "" in known:
            known[""] = 1  # a last space alone is a token of its own
        rest = self._lengths(whole)
        get = lambda c: known[c] if len(c) <= SHORT else once[c]
        return [next(rest) if p is None else sum(map(get, p)) for p in parts]


class JsonCounter:
    """Counts of a tokenizers file; texts are encoded whole, in batches bounded by bytes."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(file)
        self.model.no_padding()
        self.model.no_truncation()

    def count(self, texts: list[str | None]) -> list[int]:
        """Number of tokens of each text."""
        full = [t or "" for t in texts]
        return [len(x) for batch in byte_batches(full) for x in self.model.encode_batch_fast(batch, add_special_tokens=False)]


@lru_cache(maxsize=4)
def counter(file: str) -> PieceCounter | JsonCounter:
    """A worker's counter for a tokenizer file; it outlives a task."""
    return PieceCounter(file) if file.endswith(".model") else JsonCounter(file)


def token_counts(docs: DataFrame, file: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; over_limit: more than limit tokens."""
    ship(docs.sparkSession)

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(file)
        for batch in byte_slices(batches, 2):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(count.count(batch.column(2).to_pylist()), pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("_text"))
    return rows.mapInArrow(lengths, f"`{id_col}` {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
