"""Arrow string columns as flat arrays of Unicode code points."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def flatten(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All code points of a string column in one uint32 array, and the offsets of its rows (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    lengths = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return np.frombuffer("".join(column.to_pylist()).encode("utf-32-le"), np.uint32), offsets


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """For every code point the number of its row."""
    return np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets))


def decode(points: np.ndarray) -> str:
    return points.astype("<u4").tobytes().decode("utf-32-le")


@lru_cache(maxsize=1)
def folded() -> np.ndarray:
    """Code point -> its lower-case code point if it is a letter or a number, else 0.

    Only the first character of a longer lower-case form is kept; the rest is never a letter.
    """
    import unicodedata

    table = np.zeros(0x110000, np.uint32)
    for point in range(0x110000):
        if unicodedata.category(char := chr(point))[0] in "LN":
            table[point] = ord(char.lower()[0])
    return table
