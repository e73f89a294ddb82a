"""Oversized texts cut into pieces within a limit, at natural boundaries where there are any, with a fixed overlap.

Pointer doubling. Every position a piece may end at points to the farthest legal end of the piece after it (which begins with the
last ``overlap`` characters of this one). Squaring that table of successors marks all ends of the greedy cut of every text of a
batch at once, in as many steps as the logarithm of the largest number of pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codepoints import decode, flatten, rows_of

#: The marks a piece may end behind, and the closing signs that stay with them.
MARKS = "。！？!?；;"
CLOSERS = "」』”’）)】〕"
#: Code points that are never parted from the one before them: combining marks, joiners, variation selectors.
_CLINGING = ((0x0300, 0x036F), (0x0900, 0x0903), (0x093A, 0x094D), (0x0E31, 0x0E31), (0x0E34, 0x0E3A), (0x0E47, 0x0E4E), (0x200C, 0x200D), (0x20D0, 0x20FF), (0x3099, 0x309A), (0xFE00, 0xFE0F), (0xE0100, 0xE01EF))


def boundaries(points: np.ndarray, offsets: np.ndarray, marks: str = MARKS, closers: str = CLOSERS) -> np.ndarray:
    """Flags, one more than there are code points: whether a boundary lies right before it (or at the end of all)."""
    n = len(points)
    flags = np.zeros(n + 1, bool)
    if not n:
        return flags
    mark, closer = np.isin(points, [ord(c) for c in marks]), np.isin(points, [ord(c) for c in closers])
    rows = rows_of(offsets)
    index = np.arange(n)
    solid = np.maximum.accumulate(np.where(~closer, index, 0))  # the last character that is no closing sign
    ending = mark | (closer & mark[solid] & (rows[solid] == rows))
    follows = np.zeros(n, bool)
    follows[:-1] = closer[1:] & (rows[1:] == rows[:-1])
    line = points == 10
    line[:-1] |= (points[:-1] == 13) & (points[1:] != 10)
    line[-1] |= points[-1] == 13
    flags[1:] = (ending & ~follows) | line
    return flags


def cuts(points: np.ndarray, offsets: np.ndarray, room: np.ndarray, overlap: int, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row and the end of every piece, in order. ``room`` is what each row's pieces may hold, ``flags`` are its boundaries."""
    n, rows = len(points), rows_of(offsets)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Node r + i stands for the end before code point i of row r: every row has one node more than code points.
    base = offsets[:-1] + np.arange(len(offsets) - 1)
    lengths = np.diff(offsets)
    node_row = np.repeat(np.arange(len(lengths)), lengths + 1)
    at = np.arange(n + len(lengths)) - base[node_row]
    size, space = lengths[node_row], room[node_row]
    lap = np.minimum(overlap, space - 1)
    reach = np.where(at > 0, np.maximum(at - lap, 0), 0) + space
    legal = np.zeros(len(at), bool)
    inner = (at > 0) & (at < size)
    legal[inner] = flags[(at + offsets[node_row])[inner]]
    last = np.maximum.accumulate(np.where(legal, np.arange(len(at)), -1))  # the last boundary up to a node
    probe = base[node_row] + np.minimum(reach, size)
    natural = last[probe] - base[node_row]
    forced = np.minimum(reach, size)
    clinging = np.zeros(n, bool)
    for a, b in _CLINGING:
        clinging |= (points >= a) & (points <= b)
    clinging[offsets[:-1][lengths > 0]] = False  # a text's first character begins a sequence
    begins = np.maximum.accumulate(np.where(~clinging, np.arange(n), -1))  # where the sequence of a code point begins
    inside = forced < size
    whole = forced.copy()
    whole[inside] = begins[(forced + offsets[node_row])[inside]] - offsets[node_row[inside]]
    forced = np.where(whole > at, whole, forced)
    end = np.where(reach >= size, size, np.where(natural > at, natural, forced))
    step = base[node_row] + end
    on = np.zeros(len(at), bool)
    on[base] = True
    marked = base
    while True:
        before = len(marked)
        on[step[marked]] = True
        marked = np.flatnonzero(on)
        if len(marked) == before:
            break
        step = step[step]
    ends = marked[at[marked] > 0]
    return node_row[ends], at[ends]


def _pieces(limit: int, overlap: int, marks: str, closers: str):
    schema = ["id", "kind", "piece", "start_at", "end_at", "title", "text"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, offsets = flatten(batch.column(2))
            titles = batch.column(1).to_pylist()
            space = limit - np.array([len(t or "") for t in titles], np.int64)
            room = np.maximum(1, space)
            flags = boundaries(points, offsets, marks, closers)
            stops = flags.copy()
            stops[offsets] = True
            edge = np.flatnonzero(stops)
            stretch = np.diff(edge)
            longest = np.zeros(batch.num_rows, np.int64)
            if len(points):
                np.maximum.at(longest, rows_of(offsets)[edge[:-1]], stretch)
            rows, ends = cuts(points, offsets, room, overlap, flags)
            bare = np.flatnonzero(np.diff(offsets) == 0)  # a title alone is a piece without text
            if len(bare):
                order = np.argsort(np.r_[rows, bare], kind="stable")
                rows, ends = np.r_[rows, bare][order], np.r_[ends, np.zeros(len(bare), np.int64)][order]
            fresh = np.r_[True, rows[1:] != rows[:-1]][: len(rows)]
            lap = np.minimum(overlap, room[rows] - 1)
            starts = np.where(fresh, 0, np.r_[0, np.maximum(ends[:-1], 0)][: len(rows)] - lap)
            starts = np.maximum(starts, 0)
            first = np.flatnonzero(fresh)
            number = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))
            take = pa.array(rows)
            kind = np.where(longest > space, "forced", "natural")
            texts = [decode(points[offsets[r] + a : offsets[r] + b]) for r, a, b in zip(rows, starts, ends)]
            yield pa.record_batch([batch.column(0).take(take), pa.array(kind[rows].tolist(), pa.string()), pa.array(number.astype(np.int32)), pa.array(starts.astype(np.int32)), pa.array(ends.astype(np.int32)), batch.column(1).take(take), pa.array(texts, pa.string())], names=schema)

    return split


def split_oversized(df: DataFrame, id_col: str, title_col: str, text_col: str, limit: int = 240, overlap: int = 20, marks: str = MARKS, closers: str = CLOSERS) -> DataFrame:
    """``id, kind, piece, start_at, end_at, title, text``: the pieces of every record whose title and text exceed ``limit``.

    A piece is its title and ``text[start_at:end_at]``, at most ``limit`` characters together; each but the first begins with the
    last ``overlap`` characters of the one before. A piece ends at the farthest boundary it can reach, else where it is full (but
    not inside a combining sequence). kind is ``forced`` if some stretch between boundaries doesn't fit a piece, else ``natural``.
    A null title is empty. A title that leaves no room still gets pieces of one character (kind ``forced``), or one piece without text
    if the text is empty; where the overlap doesn't fit, it is one character less than the room. Null ids and null texts have no pieces. Repeated rows of one id count once (the greatest).
    """
    chosen = df.select(F.col(id_col).alias("id"), F.col(title_col).alias("title"), F.col(text_col).alias("text"))
    long = chosen.where((F.coalesce(F.char_length("title"), F.lit(0)) + F.char_length("text") > limit) & F.col("id").isNotNull())
    once = long.groupBy("id").agg(F.max(F.struct("text", "title")).alias("row")).select("id", "row.title", "row.text")
    return once.mapInArrow(_pieces(limit, overlap, marks, closers), "id string, kind string, piece int, start_at int, end_at int, title string, text string")
