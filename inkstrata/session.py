"""Session helpers: table access, shared checkpoints and a local session for tests and the bench."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: The tables written by ``checkpointed`` and not yet removed, by path.
_WRITTEN: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``.

    Only in local mode, where driver and executors are one process, a temporary one takes its place; on a cluster an unset folder raises.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="inkstrata-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared folder, and read from there: its lineage is cut.

    The table outlives lost executors and is read by columns. It is removed by ``discard``, at the end of a ``scratch``, or when
    the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, at = _files(spark, path)
    files.deleteOnExit(at)
    _WRITTEN[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables made by ``checkpointed`` that nothing reads any more; other frames are left alone."""
    for df in tables:
        _remove(getattr(df, "_table_path", None))


@contextmanager
def scratch() -> Iterator[None]:
    """Removes at its end every table written within it, so the results must have been written or collected by then."""
    before = set(_WRITTEN)
    try:
        yield
    finally:
        for path in set(_WRITTEN) - before:
            _remove(path)


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _remove(path: str | None) -> None:
    if (spark := _WRITTEN.pop(path, None)) is not None:
        files, at = _files(spark, path)
        files.delete(at, True)
        files.cancelDeleteOnExit(at)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def local_session(cpus: str = "8", name: str = "inkstrata") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
