"""Evaluation texts that leak into a corpus.

One Aho-Corasick automaton over the normalised evaluation texts. Of every item the non-overlapping anchors of half the reportable
length go in (a stretch of that length holds one of them whole); every document is read and normalised once, and each hit is extended
on both sides, exactly, to the longest common stretch, whose offsets are mapped back to the original text. An evaluation set too
large for one automaton in memory is cut into several, which run one after the other over the same normalised texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codepoints import decode, flatten, folded, rows_of

#: Characters of normalised evaluation texts in one automaton, about 200 MB of a worker's memory.
AUTOMATON_CHARS = 5_000_000
#: Normalised characters that are held to be scanned by one automaton after the other.
_HELD = 16 << 20


def normalised(text: str) -> str:
    """Lower-case letters and numbers only."""
    points = folded()[flatten(pa.array([text]))[0]]
    return decode(points[points > 0])


@lru_cache(maxsize=1)
def _automaton(items: tuple[tuple[object, str], ...], anchor: int):
    import ahocorasick

    places: dict[str, list[tuple[int, int]]] = {}
    for number, (_, text) in enumerate(items):
        for start in range(0, len(text) - anchor + 1, anchor):
            places.setdefault(text[start : start + anchor], []).append((number, start))
    machine = ahocorasick.Automaton()
    for pattern, where in places.items():
        machine.add_word(pattern, tuple(where))
    if places:
        machine.make_automaton()
    return machine


def spans(text: str, items: tuple[tuple[object, str], ...], least: int) -> list[tuple[int, int, int, int]]:
    """Of a normalised text: item's number, start and end in the text, start in the item, of every maximal common stretch."""
    anchor = least // 2
    machine = _automaton(items, anchor)
    if not len(machine):
        return []
    found, reach = [], {}
    for last, where in machine.iter(text):
        for number, at in where:
            start = last - anchor + 1
            line = (number, start - at)  # stretches of one item on one diagonal don't overlap
            if reach.get(line, -1) >= start:
                continue
            own = items[number][1]
            left = 0
            while start - left > 0 and at - left > 0 and text[start - left - 1] == own[at - left - 1]:
                left += 1
            right = anchor
            while start + right < len(text) and at + right < len(own) and text[start + right] == own[at + right]:
                right += 1
            reach[line] = start + right - 1
            if left + right >= least:
                found.append((number, start - left, start + right, at - left))
    return found


def _scan(shared, least: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = shared.value
        held, chars = [], 0
        for batch in batches:
            points, offsets = flatten(batch.column(1))
            low = folded()[points]
            kept = np.flatnonzero(low)
            rows = rows_of(offsets)[kept]
            # All texts of the batch in one string, a zero between any two.
            breaks = np.searchsorted(rows, np.arange(1, batch.num_rows))
            joined, origin, owner = decode(np.insert(low[kept], breaks, 0)), np.insert(kept, breaks, -1), np.insert(rows, breaks, -1)
            held.append((batch.column(0), offsets, joined, origin, owner))
            chars += len(joined)
            if len(parts) == 1 or chars >= _HELD:
                yield from found(parts, held)
                held, chars = [], 0
        yield from found(parts, held)

    def found(parts, held) -> Iterator[pa.RecordBatch]:
        for items in parts:
            for ids, offsets, joined, origin, owner in held:
                out = [(owner[a], number, origin[a] - offsets[owner[a]], origin[b - 1] + 1 - offsets[owner[a]], b - a) for number, a, b, _ in spans(joined, items, least)]
                rows, numbers, begin, end, size = (np.array(x, np.int64) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 5
                yield pa.record_batch(
                    [ids.take(pa.array(rows)), pa.array([items[n][0] for n in numbers], pa.int64()), pa.array(begin), pa.array(end), pa.array(size)],
                    names=["doc_id", "item_id", "start_at", "end_at", "chars"],
                )

    return scan


def _normal(least: int):
    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [normalised(t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["i", "t"]).filter(pa.array([len(t) >= least for t in texts]))

    return normal


def leaked(docs: DataFrame, doc_id: str, text_col: str, items: DataFrame, item_id: str, item_text: str, least: int = 40, automaton_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """``doc_id, item_id, start_at, end_at, chars``: every maximal stretch of an item in a document.

    Only letters and numbers are compared, in lower case; chars counts them, the offsets are those of the original text. Items of
    fewer than ``least`` such characters and null texts on either side give nothing. The items, the held-out side, are read by the
    driver and sent to every executor; a worker holds one automaton, of up to ``automaton_chars`` characters, at a time.
    """
    held_out = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    parts: list[list[tuple[int, str]]] = [[]]
    size = 0
    for row in held_out.mapInArrow(_normal(least), "i bigint, t string").distinct().orderBy("i", "t").toLocalIterator():
        if size + len(row.t) > automaton_chars and parts[-1]:
            parts.append([])
            size = 0
        parts[-1].append((row.i, row.t))
        size += len(row.t)
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text_col).alias("text")).where(F.char_length("text") >= least)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(map(tuple, parts)))
    return rows.mapInArrow(_scan(shared, least), f"doc_id {kind}, item_id bigint, start_at bigint, end_at bigint, chars bigint")
