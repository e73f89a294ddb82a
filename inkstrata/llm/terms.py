"""Frequency of every distinct term: occurrences, document frequency and marks for useless terms.

Vertical layout: every term owns compressed bitmaps of record numbers, cut into containers of 65,536 records, with a counter of
its occurrences beside each. Records are numbered through all tasks without gaps but for repeated rows, so a container holds records
of neighbouring tasks; its parts are merged by union and the document frequency is read from their cardinality. No group is ever
larger than one container, whatever the term.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkstrata.session import shuffle_width

from .codepoints import flatten, rows_of

#: The ideograph blocks (unified, extension A, extension B), ends included.
IDEOGRAPHS = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2A6DF))

CONTAINER_BITS = 16
_HELD = 1 << 22  # (term, record) pairs held before they are handed on
_ARRAY_MOST = 4096  # above that many records a container is smaller as plain bits
_LAYOUT = "term string, container bigint, bitmap binary, occurrences bigint"


def pack(records: np.ndarray) -> bytes:
    """A container's sorted distinct record numbers (below 65,536) as bytes: a list of numbers, or 65,536 bits."""
    if len(records) <= _ARRAY_MOST:
        return b"\0" + records.astype("<u2").tobytes()
    bits = np.zeros(1 << CONTAINER_BITS, np.uint8)
    bits[records] = 1
    return b"\1" + np.packbits(bits, bitorder="little").tobytes()


def unpack(container: bytes) -> np.ndarray:
    if container[0] == 0:
        return np.frombuffer(container, "<u2", offset=1).astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(container, np.uint8, offset=1), bitorder="little"))


def cardinality(container: bytes) -> int:
    if container[0] == 0:
        return (len(container) - 1) // 2
    return int(np.bitwise_count(np.frombuffer(container, np.uint8, offset=1)).sum())


def union(containers: list[bytes | None]) -> bytes:
    """One container of all records; the row that only counts records has none."""
    if containers[0] is None:
        return pack(np.zeros(0, np.int64))
    if len(containers) == 1:
        return containers[0]
    return pack(np.unique(np.concatenate([unpack(c) for c in containers])))


def _bitmaps(ranges: tuple[tuple[int, int], ...], firsts: dict[int, int]):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        following = dict(firsts)  # the next record number of each slot
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = records = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for container, parts in held.items():
                keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
                order = np.argsort(keys, kind="stable")
                keys, counts = keys[order], counts[order]
                points, low = keys >> CONTAINER_BITS, keys & ((1 << CONTAINER_BITS) - 1)
                starts = np.flatnonzero(np.r_[True, points[1:] != points[:-1]])
                bitmaps = [pack(low[a:b]) for a, b in zip(starts, np.r_[starts[1:], len(points)])]
                terms = [chr(p) for p in points[starts]]
                yield pa.record_batch([pa.array(terms, pa.string()), pa.array(np.full(len(starts), container, np.int64)), pa.array(bitmaps, pa.binary()), pa.array(np.add.reduceat(counts, starts))], names=["term", "container", "bitmap", "occurrences"])

        for batch in batches:
            slots = batch.column(0).to_numpy(zero_copy_only=False)
            number = np.empty(len(slots), np.int64)
            for slot in np.unique(slots).tolist():
                mine = np.flatnonzero(slots == slot)
                number[mine] = following[slot] + np.arange(len(mine))
                following[slot] += len(mine)
            records += len(slots)
            points, offsets = flatten(batch.column(1))
            points, rows = points.astype(np.int64), rows_of(offsets)
            wanted = np.zeros(len(points), bool)
            for first, last in ranges:
                wanted |= (points >= first) & (points <= last)
            points, own = points[wanted], number[rows[wanted]]
            for container in np.unique(own >> CONTAINER_BITS).tolist():
                here = own >> CONTAINER_BITS == container
                keys = (points[here] << CONTAINER_BITS) | (own[here] & ((1 << CONTAINER_BITS) - 1))
                held.setdefault(container, []).append(np.unique(keys, return_counts=True))
                size += len(held[container][-1][0])
            if size >= _HELD:
                yield from flush()
                held.clear()
                size = 0
        yield from flush()
        # the records of this task, those without any term included
        yield pa.record_batch([pa.array([None], pa.string()), pa.array([-1]), pa.array([None], pa.binary()), pa.array([records])], names=["term", "container", "bitmap", "occurrences"])

    return build


def term_bitmaps(df: DataFrame, id_col: str, text_col: str, ranges: tuple[tuple[int, int], ...] = IDEOGRAPHS) -> DataFrame:
    """The vertical layout ``term, container, bitmap, occurrences`` of the characters in ``ranges``; a container may come in parts.

    Rows of one id count once (of differing texts the greatest counts); rows with a null id are left out; a null or empty text is
    a record without terms. A row with a null term holds a task's number of records in ``occurrences``.
    """
    width = shuffle_width(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null").withColumn("slot", F.pmod(F.xxhash64("id"), F.lit(width)).cast("int"))
    # A slot's numbers begin behind the rows of the slots before it, repeated ones included: one count for each slot comes to the driver.
    sizes = {r.slot: r["count"] for r in rows.groupBy("slot").count().collect()}
    firsts, total = {}, 0
    for slot in sorted(sizes):
        firsts[slot] = total
        total += sizes[slot]
    records = rows.repartitionById(width, F.col("slot")).groupBy("slot", "id").agg(F.max("text").alias("text"))
    return records.select("slot", "text").mapInArrow(_bitmaps(ranges, firsts), _LAYOUT)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unions the containers of one (term, container), which come one behind the other."""
    key, held, total = None, [], 0

    def rows(batch: pa.RecordBatch):
        return zip(*(batch.column(i).to_pylist() for i in range(4)))

    out: list[tuple] = []
    for batch in batches:
        for term, container, bitmap, occurrences in rows(batch):
            if (term, container) != key:
                if held:
                    out.append((key[0], cardinality(union(held)), total))
                key, held, total = (term, container), [], 0
            held.append(bitmap)
            total += occurrences
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64()))], names=["term", "records", "occurrences"])
            out = []
    if held:
        out.append((key[0], cardinality(union(held)), total))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64()))], names=["term", "records", "occurrences"])


def term_frequencies(df: DataFrame, id_col: str, text_col: str, ranges: tuple[tuple[int, int], ...] = IDEOGRAPHS, rare_most: int = 2, common_share: float = 0.15) -> DataFrame:
    """``term, occurrences, records, total_records, mark`` of every distinct term.

    mark is ``rare`` for terms of at most ``rare_most`` records, ``common`` for those of more than ``common_share`` of all
    records, else null; rare goes before common. An empty table gives no rows.
    """
    bitmaps = term_bitmaps(df, id_col, text_col, ranges)
    merged = bitmaps.repartition("term", "container").sortWithinPartitions("term", "container").mapInArrow(_merged, "term string, records bigint, occurrences bigint")
    counted = merged.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    # The number of all records comes along under the null term; a window over the terms, of which there are as many as characters, hands it on.
    everything = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = counted.withColumn("total_records", F.max(F.when(F.col("term").isNull(), F.col("occurrences"))).over(everything)).where("term is not null")
    mark = F.when(F.col("records") <= rare_most, "rare").when(F.col("records") > common_share * F.col("total_records"), "common")
    return known.select("term", "occurrences", "records", "total_records", mark.alias("mark"))
