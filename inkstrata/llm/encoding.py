"""Encoding of whole texts with a public byte-level BPE tokenizer, and decoding.

Overlapping chunk encoding. Every text is laid out in chunks that overlap; the overlap is pre-tokenised from both sides, and
neighbours are stitched at the first pre-token boundary that both see (a pre-token depends only on what follows its start, so from
there on both agree). The pieces between the stitches are encoded on their own, as one flat list for a batch of texts. Texts of all
lengths, repeated and null ids among them, go this one way, in one pass over the input and without a shuffle.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
CHUNK, OVERLAP = 512, 64
#: Fixed value: the pattern of the vocabulary's pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def codec(path: str, pattern: str = PATTERN):
    """The encoder of a rank file and the compiled pattern of its pre-tokens."""
    import regex
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), regex.compile(pattern)


def starts(pattern, text: str, begin: int, end: int, stop: int) -> list[int]:
    """Starts of the pre-tokens of ``text[begin:end]`` from ``begin`` on whose whole match ends before ``end``, or at the text's end.

    A match that touches the chunk's end may be cut short, so neither it nor the boundary behind it counts; only starts below
    ``stop`` are wanted.
    """
    found = []
    for match in pattern.finditer(text, begin, end):
        if match.end() >= end and end < len(text):
            break
        found.append(match.start())
        if match.start() >= stop:
            break
    return found


def stitches(pattern, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Positions, 0 and the text's length among them, at which the text can be cut without changing its pre-tokens.

    A cut lies at a boundary that both neighbouring chunks see, and never behind white space, whose pre-tokens depend on what
    follows. Where an overlap has none, its chunks stay together, and the next one ends twice as far, so that a text without any
    boundary is still read a fixed number of times only.
    """
    cuts, begin, step = [0], chunk, chunk
    while begin < len(text):
        limit = min(len(text), begin + overlap)
        right = set(starts(pattern, text, begin, limit, limit))
        left = pattern.finditer(text, _sure(text, cuts[-1], begin), limit)
        met = next((m.start() for m in left if m.start() in right and not text[m.start() - 1].isspace()), None)
        if met is not None and met > cuts[-1]:
            cuts.append(met)
            step = chunk
        else:
            step *= 2
        begin += step
    return [*cuts, len(text)]


def _sure(text: str, last: int, begin: int) -> int:
    """The nearest place before a chunk's start at which a pre-token begins whatever stands before it, or the last stitch.

    No pre-token goes on from a character that is no white space to a white space, so each such place is sure.
    """
    at = begin
    while at > last and not (text[at] in " \n\t" and not text[at - 1].isspace()):
        at -= 1
    return at


def pieces_of(pattern, text: str | None, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """The pieces of a text that are encoded on their own; none for null and empty texts."""
    if not text:
        return []
    cuts = stitches(pattern, text, chunk, overlap)
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


def encode_text(text: str | None, path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """The ids of a text without special tokens; strings of special tokens in it are ordinary text. Null and empty give no ids."""
    encoder, pattern = codec(path)
    return [i for piece in pieces_of(pattern, text, chunk, overlap) for i in encoder.encode_ordinary(piece)]


def decode_ids(ids: list[int], path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> str:
    """The text of ids: their bytes joined, then read as UTF-8 (incomplete characters become U+FFFD)."""
    return b"".join(codec(path)[0].decode_tokens_bytes(ids)).decode("utf-8", "replace")


def _lists(lengths: list[int], values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths, dtype=np.int64)].astype(np.int32)), pa.array(values))


def _ids(file: str, pattern: str, chunk: int, overlap: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, boundary = codec(SparkFiles.get(file), pattern)
        for batch in batches:
            cut = [pieces_of(boundary, text.as_py(), chunk, overlap) for text in batch.column(1)]
            flat = [encoder.encode_to_numpy(piece, disallowed_special=()) for pieces in cut for piece in pieces]
            sizes = np.array([len(x) for x in flat], np.int64)
            ends = np.r_[0, np.cumsum([len(pieces) for pieces in cut], dtype=np.int64)]
            total = np.r_[0, np.cumsum(sizes)]
            ids = np.concatenate(flat).astype(np.int32) if flat else np.zeros(0, np.int32)
            yield pa.record_batch([batch.column(0), _lists(np.diff(total[ends]), ids), pa.array(np.diff(ends).astype(np.int32))], names=["id", "ids", "pieces"])

    return encode


def encode(df: DataFrame, id_col: str, text_col: str, folder: str = TOKENIZERS, name: str = "byte_bpe_50k", pattern: str = PATTERN, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``id, ids, pieces``: the token ids of every row's text, no special tokens added, and in how many pieces it was encoded.

    Null and empty texts have an empty list and no pieces. Every row gives one row: repeated rows, repeated ids and null ids stay.
    ``folder`` is read by the driver, which sends the rank file to the executors.
    """
    df.sparkSession.sparkContext.addFile(f"{folder}/{name}.tiktoken")
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = df.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(_ids(f"{name}.tiktoken", pattern, chunk, overlap), f"id {kind}, ids array<int>, pieces int")
