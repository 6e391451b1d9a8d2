"""Vector best-fit packing of tokenized documents into training sequences.

Three capacities bind a bin: residual tokens, residual documents and residual attention cost (the sum of squared
piece lengths). A piece goes to the open bin that is best among those it fits under every constraint: the one with
the largest weighted dot product of demand and residual, or the one with the smallest weighted residual norm.

Tokenizing is a narrow pass that returns lengths and checksums only. Pieces that fill a sequence are placed there and
then; the last pieces, one a document, are dealt by a hash of their stored row number to groups of about GROUP pieces,
however often a row repeats, and each group is packed in decreasing length by itself. A group ends with one bin that has
room at most, which costs under a thousandth of the sequences.

Nulls and empty texts give one piece with the end token. Null ids are ids like others. Repeated rows are packed each;
ties are broken by id, then piece, then checksum. Very long texts are tokenized whole, in one worker. An empty table
gives an empty result. Other columns are ignored, and the id column may have any name.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, materialize, ship

GROUP = 2500
#: Words, and tokens, whose ids a worker remembers, and the characters up to which it does: so the tables have bounded
#: bytes. A full table stays as it is, since frequent words come early.
REMEMBERED, SHORT = 600_000, 64

#: The normalizer and the split of a tokenizers file for which a text's ids are its words' ids.
PLAIN_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PLAIN_SPLIT = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

#: Characters on which lower-casing and composing are the identity or one to one, so words made of them need the
#: library's merges only. Words with any other character go through the whole library.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
_SPLITS_ALSO = re.compile("[\x1c-\x1f]")
_ASCII_SPACE = re.compile("[ \t-\r]+")


def _byte_characters() -> dict[int, str]:
    """Characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Ids as little-endian unsigned 32-bit bytes.

    A file with PLAIN_NORMALIZER and PLAIN_SPLIT lower-cases and drops white space. White space ends every match of its
    pattern, so a text's ids are its words' ids one after another, and words met before are looked up. Its added tokens
    must hold no white space, so they stay within a word. With any other file the library encodes texts whole.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(file)
        self.full.no_padding()
        self.full.no_truncation()
        self.merges = self.full.model
        parts = json.loads(self.full.to_str())
        self.plain = parts["normalizer"] == PLAIN_NORMALIZER and parts["pre_tokenizer"] == PLAIN_SPLIT
        self.plain = self.plain and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in parts["added_tokens"])
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        self.marks = {s[0] for s in self.special}
        self.characters = _byte_characters()
        self.words: dict[str, bytes] = {}
        self.tokens: dict[str, bytes] = {}

    def _token(self, token: str) -> bytes:
        shown = token if token.isascii() else token.encode().decode("latin-1").translate(self.characters)
        out = b"".join([t.id.to_bytes(4, "little") for t in self.merges.tokenize(shown)])
        if len(self.tokens) < REMEMBERED and len(token) <= SHORT:
            self.tokens[token] = out
        return out

    def _word(self, word: str) -> bytes:
        if _PLAIN.fullmatch(word) and not (self.marks & set(word) and any(s in word for s in self.special)):
            get = self.tokens.get
            out = b"".join([get(t) or self._token(t) for t in _TOKEN.findall(word.lower())])
        else:
            out = np.array(self.full.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.words) < REMEMBERED and len(word) <= SHORT:
            self.words[word] = out
        return out

    def encode(self, text: str) -> bytes:
        """The text's ids."""
        if not self.plain:
            return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = [w for w in _ASCII_SPACE.split(text) if w] if _SPLITS_ALSO.search(text) else text.split()
        get = self.words.get
        return b"".join([get(w) or self._word(w) for w in words])


@lru_cache(maxsize=4)
def word_encoder(file: str) -> WordEncoder:
    """A worker's encoder for a file; it outlives a task."""
    return WordEncoder(file)


@dataclass(frozen=True)
class Capacities:
    """What a sequence holds at most, and the weights of the three in a bin's score."""

    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    score: str = "norm"


def best_fit(lengths: np.ndarray, cap: Capacities) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, taken in the order given; bins are numbered as they open.

    Full bins leave the table of open bins. Ties go to the bin opened first.
    """
    caps = np.array([cap.tokens, cap.documents, cap.attention], float)
    weights = np.array(cap.weights, float)
    size = 256
    left = np.zeros((3, size))
    name = np.zeros(size, np.int64)
    used = made = 0
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    least = int(lengths.min()) if len(lengths) else 0
    for i, n in enumerate(lengths.tolist()):
        need = np.array([n, 1, n * n], float)
        if (need > caps).any():
            raise ValueError(f"a piece of {n} tokens is over a capacity")
        fits = np.flatnonzero((left[0, :used] >= n) & (left[1, :used] >= 1) & (left[2, :used] >= need[2]))
        if len(fits):
            after = (left[:, fits] - need[:, None]) / caps[:, None]
            if cap.score == "dot":
                at = fits[np.argmax(weights @ (left[:, fits] * need[:, None] / (caps**2)[:, None]))]
            else:
                at = fits[np.argmin(weights @ (after * after))]
        else:
            if used == size:
                size *= 2
                left = np.concatenate([left, np.zeros_like(left)], axis=1)
                name = np.concatenate([name, np.zeros_like(name)])
            at = used
            left[:, at], name[at] = caps, made
            used, made = used + 1, made + 1
        bins[i], offsets[i] = name[at], cap.tokens - left[0, at]
        left[:, at] -= need
        if left[0, at] < least or left[1, at] < 1 or left[2, at] < least * least:
            used -= 1
            left[:, at : used], name[at:used] = left[:, at + 1 : used + 1], name[at + 1 : used + 1]
    return bins, offsets


def pieces(docs: DataFrame, file: str, end_id: int, cap: Capacities, id_col: str, text_col: str) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every document's pieces; only documents over the capacity are cut."""
    ship(docs.sparkSession)
    end, step = end_id.to_bytes(4, "little"), 4 * cap.tokens

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(file)
        for batch in byte_slices(batches, 1):
            row, piece, start, length, crc = [], [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                ids = encoder.encode(text or "") + end
                for p, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    row.append(k)
                    piece.append(p)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            ids_of = batch.column(0).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids_of, pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(cut, f"_id {kind}, piece int, start long, length long, ids_crc32 long")


def _pack_group(cap: Capacities) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = best_fit(group["length"].to_numpy(), cap)
        # A group's bins are numbered within 2^24 of their own, far over what GROUP pieces on average can open.
        return group.assign(sequence_id=(group["_group"].to_numpy() << 24) + bins, offset=offsets).drop(columns="_group")

    return pack


def pack_documents(docs: DataFrame, file: str, end_id: int = 1, cap: Capacities | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document.

    An id column that is named like one of the results is returned with _id after its name.
    """
    cap = cap or Capacities()
    # The row number is part of the stored table, so a task that runs again deals alike.
    cut = pieces(docs, file, end_id, cap, id_col, text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    cut = materialize(cut.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    full = (F.col("length") >= cap.tokens) | (F.col("length") * F.col("length") >= cap.attention)
    loose = cut.filter(~full)
    groups = max(1, -(-loose.count() // GROUP))
    dealt = loose.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)).cast("long")).drop("_row")
    packed = dealt.groupBy("_group").applyInPandas(_pack_group(cap), f"{schema}, sequence_id long, offset long")
    alone = cut.filter(full).drop("_row").withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    every = packed.unionByName(alone)
    rest = [c for c in every.columns if c != "_id"]
    return every.select(F.col("_id").alias(id_col), *rest) if id_col not in rest else every.withColumnRenamed("_id", f"{id_col}_id")
