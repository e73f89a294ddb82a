"""Sinks: sized text shards, bucketed index shards, gated and atomic publication."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from inkstrata.functions import jsontext
from inkstrata.functions import text as T

TARGET = 700 * 1024


def packed(rows: DataFrame, group: str, order: list[str], target: int = TARGET) -> DataFrame:
    """``rows`` with the number of their shard: next fit by JSON bytes, in order, within a group.

    The fill of a shard depends on all rows before it, so a sorted partition is read on once, holding one number for its group.
    """
    sized = rows.withColumn("bytes", F.octet_length(F.to_json(F.struct(*[c for c in rows.columns if c != group])))).repartition(group).sortWithinPartitions(group, *order)
    schema = StructType([*sized.schema.fields, StructField("part", IntegerType())])

    def fill(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, part, used = None, 0, 0
        for frame in parts:
            numbers = []
            for key, size in zip(frame[group], frame["bytes"]):
                if key != current:
                    current, part, used = key, 0, 0
                elif used + size + 1 > target:
                    part, used = part + 1, 0
                used += size + 1
                numbers.append(part)
            frame["part"] = pd.Series(numbers, index=frame.index, dtype="int32")
            yield frame

    return sized.mapInPandas(fill, schema)


def uneven_sources(passages: DataFrame) -> DataFrame:
    """Books whose passages have more than one pair of URLs, which a shard can't hoist."""
    pairs = passages.select("book_id", F.struct("source_url", "verification_url").alias("urls")).distinct()
    return pairs.groupBy("book_id").count().where("count > 1").select("book_id")


def write_text_shards(passages: DataFrame, path: str, target: int = TARGET) -> None:
    """Shards of a book's passages under ``book_id=…/part=…``."""
    columns = ["book_id", "id", "work_id", "chapter_id", "work_title", "chapter_title", "ord", "text", "normalized_text"]
    shards = packed(passages.select(*columns), "book_id", ["ord", "id"], target).drop("bytes")
    shards.repartition("book_id", "part").sortWithinPartitions("book_id", "part", "ord").write.mode("overwrite").partitionBy("book_id", "part").json(path)


def write_index(postings: DataFrame, path: str) -> None:
    """Postings under ``bucket=…``, so that a unit is read with its bucket's files only."""
    bucketed = postings.withColumn("bucket", T.bucket_of(F.col("unit")))
    bucketed.repartition("bucket", "unit").sortWithinPartitions("bucket", "unit").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_units(spark, path: str, units: list[str]) -> DataFrame:
    """Postings of some units; only their buckets are listed and read."""
    buckets = sorted({f"{ord(u) >> 8:03x}" for u in units})
    return spark.read.option("basePath", path).schema("unit string, id string, positions array<int>, bucket string").parquet(path).where(F.col("bucket").isin(buckets) & F.col("unit").isin(units))


def too_large(artifacts: DataFrame, limits: dict[str, int], default: int = 1 << 20) -> DataFrame:
    """``name, bytes`` of artifacts (name, content) beyond their limit; to be empty before anything old is removed."""
    limit = F.lit(default)
    for name, most in limits.items():
        limit = F.when(F.col("name") == name, most).otherwise(limit)
    return artifacts.select("name", F.octet_length("content").alias("bytes"), limit.alias("most")).where("bytes > most").select("name", "bytes")


def publish_json(spark, path: str, value, validate: Callable) -> None:
    """Writes a small JSON artifact whole or not at all: validated, written beside its place, read and validated again, renamed over what was there.

    Content that looks like a secret is refused. Works on any file system Spark knows.
    """
    text = json.dumps(validate(value), ensure_ascii=False, indent=2) + "\n"
    row = spark.range(1).select(F.lit(text).alias("t"))
    if row.where(jsontext.holds_secret(F.col("t"))).count():
        raise ValueError("refusing to write what looks like a secret")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    to = jvm.org.apache.hadoop.fs.Path(path)
    beside = jvm.org.apache.hadoop.fs.Path(to.getParent(), f".{uuid.uuid4().hex}.tmp")
    files = to.getFileSystem(conf)
    out = files.create(beside, True)
    try:
        out.write(bytearray(text.encode()))
        out.close()
        validate(json.loads(_read(files, beside, jvm)))
        overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.makeQualified(to).toUri(), conf).rename(files.makeQualified(beside), files.makeQualified(to), overwrite)
    finally:
        files.delete(beside, False)


def _read(files, path, jvm) -> str:
    """A small file's text; Spark's own readers pass over names that begin with a dot."""
    stream = files.open(path)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
