"""Long exact spans shared between records of different groups.

Fixed-block anchors. A span of at least ``span`` code points contains, in each record that holds it, a whole aligned block of
``span // 2`` of them. So the non-overlapping blocks of every record are indexed, every rolling window of that length probes the
index, and the hits are extended: the ``span``-long windows around a hit are compared by their characters, and those met in more
than one group are true repeats, whose runs are the maximal ones.

Records are dealt out evenly to slots by their ids. A slot sends each of its distinct block hashes once for each group at most two
of which matter, packed as numpy arrays; the index answers with the hashes that are hits, slot by slot; only around these are
windows made. So a text or window that stands in a third of all records is sent once by each slot, is never gathered in one task,
and no pairs are formed before a whole span is known to be shared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkstrata.session import checkpointed, shuffle_width

from .codepoints import decode, flatten, rows_of

_FLUSH = 1 << 21  # windows held before they are handed on; bounds a task's memory
#: Bytes of input whose windows make one part of the index, which is sorted in memory: about 30 MB of windows.
PART_INPUT = 8 << 20
_SLOTS = 4  # slots in a partition of records: smaller groups, and partitions of even size
#: Odd multiplier of the rolling hash.
_M1 = np.uint64(0x9E3779B97F4A7C15)


def _mixed(points: np.ndarray, multiplier: np.uint64) -> np.ndarray:
    x = (points.astype(np.uint64) + np.uint64(1)) * multiplier
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def rolling(points: np.ndarray, width: int, multiplier: np.uint64 = _M1) -> np.ndarray:
    """A 64-bit hash of every window of ``width`` code points, made by doubling."""
    if len(points) < width:
        return np.zeros(0, np.uint64)
    power, length, result, done = np.array([multiplier]), 1, None, 0  # arrays wrap around without a warning
    doubled = _mixed(points, multiplier)
    rest = width
    while rest:
        if rest & 1:  # append a stretch of this length to what there is
            part = doubled[done : done + len(points) - width + 1]
            result = part.copy() if result is None else result * power + part
            done += length
        rest >>= 1
        if rest:
            doubled = doubled[:-length] * power + doubled[length:] if len(doubled) > length else doubled[:0]
            power, length = power * power, length * 2
    result ^= result >> np.uint64(31)
    result *= np.uint64(0x94D049BB133111EB)
    return result ^ (result >> np.uint64(30))


def _inside(rows: np.ndarray, width: int) -> np.ndarray:
    """Which windows of ``width`` lie within one row."""
    count = len(rows) - width + 1
    return rows[:count] == rows[width - 1 :] if count > 0 else np.zeros(0, bool)


def _parts(df: DataFrame) -> int:
    """Parts of the index: as many as shuffle partitions, and more if the input's known size would make one larger than a task should hold."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(shuffle_width(df.sparkSession), size // PART_INPUT if size < 1 << 55 else 0)


def packed_hashes(hashes: np.ndarray, groups: np.ndarray) -> bytes:
    """Hashes with their groups, these as numbers into the list of the distinct ones."""
    names, code = np.unique(groups, return_inverse=True)
    width = 1 if len(names) <= 1 << 8 else 2 if len(names) <= 1 << 16 else 4
    sizes = np.array([len(hashes), len(names), width], np.int64)
    return sizes.tobytes() + hashes.tobytes() + names.tobytes() + code.astype(f"<u{width}").tobytes()


def unpacked_hashes(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, k, width = np.frombuffer(body, "<i8", 3).tolist()
    names = np.frombuffer(body, "<i8", k, 24 + 8 * n)
    return np.frombuffer(body, "<u8", n, 24), names[np.frombuffer(body, f"<u{width}", n, 24 + 8 * (n + k))]


def _distinct(hashes: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each hash (without its lowest bit, which is set if any of its has it) the least and the greatest group."""
    plain, block = hashes >> np.uint64(1), hashes & np.uint64(1)
    order = np.lexsort((groups, plain))
    plain, groups, block = plain[order], groups[order], block[order]
    starts = np.flatnonzero(np.r_[True, plain[1:] != plain[:-1]])
    ends = np.r_[starts[1:], len(plain)] - 1
    marked = (plain[starts] << np.uint64(1)) | np.maximum.reduceat(block, starts)
    more = groups[starts] != groups[ends]
    return np.r_[marked, marked[more]], np.r_[groups[starts], groups[ends][more]]


def _probes(block: int, parts: int):
    """Packs the distinct window hashes of a slot for each part of the index; the lowest bit tells an indexed block from a mere probe."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for slot, pieces in held.items():
                hashes, groups = _distinct(*(np.concatenate(x) for x in zip(*pieces)))
                part = ((hashes >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
                order = np.argsort(part, kind="stable")
                part, hashes, groups = part[order], hashes[order], groups[order]
                starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                bodies = [packed_hashes(hashes[a:b], groups[a:b]) for a, b in zip(starts, np.r_[starts[1:], len(part)])]
                yield pa.record_batch([pa.array(part[starts]), pa.array(np.full(len(starts), slot, np.int32)), pa.array(bodies, pa.binary())], names=["part", "slot", "body"])

        for batch in batches:
            slots, names = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            points, offsets = flatten(batch.column(2))
            rows = rows_of(offsets)
            at = np.flatnonzero(_inside(rows, block))
            marked = (rolling(points, block)[at] & ~np.uint64(1)) | ((at - offsets[rows[at]]) % block == 0).astype(np.uint64)
            for slot in np.unique(slots).tolist():
                mine = slots[rows[at]] == slot
                if mine.any():
                    held.setdefault(slot, []).append((marked[mine], names[rows[at][mine]]))
            count += len(at)
            if count >= _FLUSH:
                yield from flush()
                held.clear()
                count = 0
        yield from flush()

    return pack


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One part of the index: to each slot those of its hashes that stand in more than one group and are somewhere an indexed block."""
    slots, hashes, groups = [], [], []
    for batch in batches:
        for slot, body in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            own, names = unpacked_hashes(body)
            slots.append(np.full(len(own), slot, np.int32))
            hashes.append(own)
            groups.append(names)
    if not slots:
        return
    slot, marked, group = np.concatenate(slots), np.concatenate(hashes), np.concatenate(groups)
    plain = marked >> np.uint64(1)
    order = np.argsort(plain, kind="stable")
    plain, slot, group, block = plain[order], slot[order], group[order], (marked[order] & np.uint64(1)).astype(np.int8)
    starts = np.flatnonzero(np.r_[True, plain[1:] != plain[:-1]])
    good = (np.maximum.reduceat(block, starts) > 0) & (np.minimum.reduceat(group, starts) < np.maximum.reduceat(group, starts))
    keep = np.repeat(good, np.diff(np.r_[starts, len(plain)]))
    slot, plain = slot[keep], plain[keep]
    order = np.argsort(slot, kind="stable")
    slot, plain = slot[order], plain[order]
    starts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]]) if len(slot) else np.zeros(0, np.int64)
    bodies = [np.unique(plain[a:b]).tobytes() for a, b in zip(starts, np.r_[starts[1:], len(slot)])]
    yield pa.record_batch([pa.array(slot[starts]), pa.array(bodies, pa.binary())], names=["slot", "hits"])


_LAYOUT = pa.schema([("id", pa.string()), ("grp", pa.string()), ("start", pa.int32()), ("key", pa.string())])


def _around(block: int, span: int):
    """Of one slot: the span-long windows that hold a hit, with their characters."""

    def widen(records: pa.Table, answers: pa.Table) -> pa.Table:
        bodies = answers.column("hits").to_pylist()
        if not bodies:
            return _LAYOUT.empty_table()
        wanted = np.unique(np.concatenate([np.frombuffer(x, "<u8") for x in bodies]))
        sizes = np.cumsum(records.column("size").to_numpy())
        cuts = [0, *np.searchsorted(sizes, np.arange(_FLUSH, sizes[-1], _FLUSH)).tolist(), len(sizes)] if len(sizes) else [0]
        out = [found(records.slice(a, b - a), wanted) for a, b in zip(cuts, cuts[1:]) if b > a]
        return pa.concat_tables(out) if out else _LAYOUT.empty_table()

    def found(records: pa.Table, wanted: np.ndarray) -> pa.Table:
        points, offsets = flatten(records.column("text"))
        rows = rows_of(offsets)
        hashes = rolling(points, block) >> np.uint64(1)
        at = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
        hit = np.flatnonzero((wanted[at] == hashes) & _inside(rows, block))
        steps = np.zeros(len(points) + 1, np.int32)  # which starts lie at most span - block before a hit
        np.add.at(steps, np.maximum(hit - (span - block), 0), 1)
        np.add.at(steps, hit + 1, -1)
        inside = _inside(rows, span)
        starts = np.flatnonzero(inside & (np.cumsum(steps)[: len(inside)] > 0))
        text = decode(points)
        owner = pa.array(rows[starts])
        return pa.table([records.column("id").take(owner), records.column("grp").take(owner), pa.array((starts - offsets[rows[starts]]).astype(np.int32)), pa.array([text[a : a + span] for a in starts.tolist()], pa.string())], schema=_LAYOUT)

    return widen


def _candidates(df: DataFrame, id_col: str, group_col: str, text_col: str, span: int) -> DataFrame:
    """``id, grp, start, key``, written: every window of ``span`` code points that may stand in another group as well; key is its text."""
    block, parts = span // 2, _parts(df)
    text = F.col(text_col)
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(group_col).cast("string").alias("grp"), text.alias("text")).where((F.char_length(text) >= span) & F.col("id").isNotNull() & F.col("grp").isNotNull())
    slot = F.pmod(F.xxhash64("id"), F.lit(_SLOTS * parts)).cast("int")
    once = rows.withColumn("slot", slot).repartition(parts, "slot").groupBy("slot", "id").agg(F.max(F.struct("text", "grp")).alias("r"))
    records = once.select("slot", F.xxhash64("r.grp").alias("name"), "r.text", "id", "r.grp", F.char_length("r.text").alias("size"))
    index = records.mapInArrow(_probes(block, parts), "part int, slot int, body binary").repartitionById(parts, F.col("part"))
    hits = index.mapInArrow(_answers, "slot int, hits binary")
    return checkpointed(records.groupBy("slot").cogroup(hits.groupBy("slot")).applyInArrow(_around(block, span), "id string, grp string, start int, key string"))


def shared_windows(df: DataFrame, id_col: str, group_col: str, text_col: str, span: int = 24) -> DataFrame:
    """``id, grp, start, key``: every window of ``span`` code points that also stands, character for character, in a record of another group.

    Rows with a null id, group or text, and texts shorter than ``span``, have none. Repeated rows of one id count once (of
    differing ones the greatest).
    """
    windows = _candidates(df, id_col, group_col, text_col, span)
    shared = windows.groupBy("key").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo < hi").select("key")
    return windows.join(shared, "key", "left_semi").select("id", "grp", "start", "key")


def shared_spans(df: DataFrame, id_col: str, group_col: str, text_col: str, span: int = 24) -> DataFrame:
    """Per record with any: ``id, shared_chars, total_chars, share`` and ``spans`` (the maximal ``[start, end)`` stretches)."""
    windows = shared_windows(df, id_col, group_col, text_col, span)
    starts = windows.groupBy("id").agg(F.array_sort(F.collect_set("start")).alias("starts"))  # at most the length of one text
    heads = F.expr(f"filter(starts, (x, i) -> i = 0 or x > starts[i - 1] + {span})")
    tails = F.expr(f"filter(starts, (x, i) -> i = size(starts) - 1 or starts[i + 1] > x + {span})")
    spans = F.zip_with(heads, tails, lambda a, b: F.struct(a.alias("start"), (b + span).alias("end")))
    lengths = df.where(F.col(text_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.char_length(text_col)).alias("total_chars"))
    found = starts.select("id", spans.alias("spans")).withColumn("shared_chars", F.expr("aggregate(spans, 0, (n, s) -> n + s.end - s.start)"))
    return found.join(lengths, "id").select("id", "shared_chars", "total_chars", (F.col("shared_chars") / F.col("total_chars")).alias("share"), "spans")


def shared_pairs(df: DataFrame, id_col: str, group_col: str, text_col: str, span: int = 24) -> DataFrame:
    """``id_a, id_b`` (id_a < id_b) of records of different groups that share a stretch of at least ``span`` code points.

    Only the first window of a maximal stretch forms pairs: a window is passed over if the one before it, in the same record, has
    the very same partners one place earlier (as many, and two 64-bit marks of the set alike).
    """
    windows = _candidates(df, id_col, group_col, text_col, span)
    marks = lambda start: (F.bit_xor(F.xxhash64("id", start)), F.bit_xor(F.xxhash64(start, F.lit("second"), "id")))
    (here1, here2), (before1, before2) = marks(F.col("start")), marks(F.col("start") - 1)
    groups = windows.groupBy("key").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"), F.struct(F.count("*"), here1, here2).alias("here"), F.struct(F.count("*"), before1, before2).alias("before")).where("lo < hi")
    line = Window.partitionBy("id").orderBy("start")
    led = windows.join(groups.select("key", "here", "before"), "key").select("*", F.lag("start").over(line).alias("s0"), F.lag("here").over(line).alias("h0"))
    heads = led.where("not (s0 is not null and s0 = start - 1 and h0 = before)").select("key", "id", "grp")
    # Group by group, so that records of one group, however many share a window, are never set against each other.
    named = heads.select("key", "grp").distinct()
    met = named.withColumnRenamed("grp", "grp_a").join(named.withColumnRenamed("grp", "grp_b"), "key").where("grp_a < grp_b")
    a, b = heads.withColumnsRenamed({"id": "a", "grp": "grp_a"}), heads.withColumnsRenamed({"id": "b", "grp": "grp_b"})
    pairs = met.join(a, ["key", "grp_a"]).join(b, ["key", "grp_b"])
    return pairs.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()
