"""Global ordinals, positional postings and their ranks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkstrata.functions import text as T

from .numbering import place_within


def distinct_passages(passages: DataFrame) -> DataFrame:
    """Every passage once: a repeated delivery differs in its time of ingestion only."""
    return passages.select("id", "book_id", "work_id", "chapter_id", "work_title", "chapter_title", "ord", "text", "normalized_text", "source_url", "verification_url").distinct()


def ordinals(passages: DataFrame) -> DataFrame:
    """``id, book_ord, work_ord, passage_ord``, 0-based, in the order (book_id, ord, id); works by first appearance."""
    rows = place_within(passages.select("id", "book_id", "work_id", "ord"), [], [F.asc("book_id"), F.asc("ord"), F.asc("id")], "p")
    works = place_within(rows.groupBy("book_id", "work_id").agg(F.min("p").alias("first")), [], [F.asc("first")], "w")
    books = rows.select("book_id").distinct().withColumn("b", F.row_number().over(Window.orderBy("book_id")))  # one row for each book
    return rows.join(works, ["book_id", "work_id"]).join(books, "book_id").select("id", (F.col("b") - 1).alias("book_ord"), (F.col("w") - 1).alias("work_ord"), (F.col("p") - 1).alias("passage_ord"))


def _places(text_at: int, units: frozenset[str] | None):
    """Every distinct character of a text with its places, made in the row: nothing is exploded and nothing shuffled."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        if units is not None:
            known = np.zeros(0x110000, bool)
            known[[ord(u) for u in units if len(u) == 1]] = True
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
            lengths = np.array([len(t) for t in texts], np.int64)
            rows = np.repeat(np.arange(len(lengths)), lengths)
            place = np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            if known is not None:
                at = np.flatnonzero(known[points])
                points, rows, place = points[at], rows[at], place[at]
            key = (rows << 21) | points
            order = np.argsort(key, kind="stable")
            key, place = key[order], place[order]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            owner = pa.array(key[starts] >> 21)
            made = [pa.array([chr(p) for p in (key[starts] & 0x1FFFFF).tolist()], pa.string()), pa.ListArray.from_arrays(pa.array(np.r_[starts, len(key)].astype(np.int32)), pa.array(place.astype(np.int32)))]
            kept = [i for i in range(batch.num_columns) if i != text_at]
            yield pa.record_batch([*made, *[batch.column(i).take(owner) for i in kept]], names=["unit", "positions", *[batch.schema.names[i] for i in kept]])

    return build


def postings(passages: DataFrame, units: frozenset[str] | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """``unit, id, positions`` over normalized_text; only those of ``units`` if given (at most as many as there are characters).

    ``carry`` names columns of a passage that go with its postings, so that nothing is joined to the many rows.
    """
    rows = passages.where("normalized_text <> ''").select("normalized_text", "id", *carry)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    found = rows.mapInArrow(_places(0, units), f"unit string, positions array<int>, {kept}")
    return found.select("unit", "id", "positions", *carry)


def ranked_passages(passages: DataFrame) -> DataFrame:
    """Passages with their ordinals and evidence rank."""
    rank = T.evidence_rank(F.col("text"), F.coalesce("normalized_text", F.lit("")))
    return passages.join(ordinals(passages), "id").withColumn("rank", rank)


def posting_ranks(passages: DataFrame) -> DataFrame:
    """``unit, passage_ord, rank, place``: postings of a unit in the order evidence is looked at."""
    units = postings(ranked_passages(passages), carry=("passage_ord", "rank"))
    return place_within(units.select("unit", "passage_ord", "rank"), ["unit"], [F.asc("rank"), F.asc("passage_ord")])


def alias_pairs(passages: DataFrame, aliases: DataFrame) -> DataFrame:
    """Aliases of characters that occur in the passages: ``raw, normalized``."""
    seen = passages.select(F.explode(T.characters(F.col("text"))).alias("raw")).distinct()
    return aliases.where("raw <> normalized").join(seen, "raw", "left_semi").select("raw", "normalized").distinct()


def bucket_histogram(passages: DataFrame) -> DataFrame:
    """``bucket, units, occurrences`` of the index shards."""
    counted = passages.where("normalized_text <> ''").select(F.explode(T.characters(F.col("normalized_text"))).alias("unit")).groupBy("unit").agg(F.count("*").alias("n"))
    return counted.groupBy(T.bucket_of(F.col("unit")).alias("bucket")).agg(F.count("*").alias("units"), F.sum("n").alias("occurrences"))
