"""A selection in which no contributor has more than its share, the best records of each staying.

The limit comes from water-filling over the sorted histogram of the contributors' counts (at most the root of twice the number of rows
long), whether the share is one of the input or of the output; the ranks within a contributor come from one range partitioning by (contributor, quality), so a contributor with a third
of all rows is spread over as many tasks as its rows fill.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstrata.session import checkpointed


def water_level(counts: np.ndarray, owners: np.ndarray, share: float, most: int | None = None, total: float | None = None) -> int:
    """The largest cap under which nobody keeps more than ``share`` of all kept records.

    ``owners[i]`` contributors have ``counts[i]`` records each. A cap c leaves T(c) = sum of min(count, c) records, and fits if
    min(c, greatest count) <= share * T(c). As T(c) / c falls with c, the caps that fit are those up to a level, which is found by
    halving over the sorted counts with their running sums. Further limits go in as constraints on the same level: ``total``, if given,
    takes the place of T(c) (a share of a fixed number of records), and ``most`` is a greatest count. With fewer than 1 / share
    contributors no cap above 0 fits: the level is 0.
    """
    if not len(counts):
        return 0
    order = np.argsort(counts)
    counts, owners = np.asarray(counts)[order].astype(np.int64), np.asarray(owners)[order].astype(np.int64)
    rows, behind = np.r_[0, np.cumsum(counts * owners)], np.r_[np.cumsum(owners[::-1])[::-1], 0]

    def fits(cap: int) -> bool:
        below = np.searchsorted(counts, cap, side="right")
        kept = int(rows[below]) + cap * int(behind[below])
        return cap <= share * (kept if total is None else total) + 1e-9

    low, high = 0, int(counts[-1]) if most is None else max(0, min(int(counts[-1]), most))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if fits(middle) else (low, middle - 1)
    return low


def _cap(counts: DataFrame, share: float | None, most: int | None, basis: str) -> int:
    bins = counts.groupBy("n").agg(F.count("*").alias("owners")).toPandas()  # one row for each distinct count
    total = int((bins.n * bins.owners).sum()) if basis == "input" else None
    return water_level(bins.n.to_numpy(), bins.owners.to_numpy(), math.inf if share is None else share, most, total)


def normal_owner(column: str | Column) -> Column:
    """A contributor's name without letter case and outer white space."""
    return F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", ""))


def capped(df: DataFrame, id_col: str, owner_col: str, score_col: str, share: float | None = 0.02, most: int | None = None, basis: str = "input") -> DataFrame:
    """``id, owner, score, place, kept``: every record taking part and whether it stays.

    Each owner keeps at most ``share`` of all records taking part (``basis`` "input", rounded down) or of all kept records
    ("output"), and at most ``most``; all three go into one water level. Where no cap fits (fewer than 1 / share owners with basis
    "output", or a share of less than one record) nothing is kept, and every row says so. The best scores stay; null and NaN lie below every number; equal scores go by smaller
    id. Rows with a null id or owner take no part; an owner of white space only is the owner "". Repeated rows of one id count
    once (of differing ones the greatest score).
    """
    score = F.when(~F.isnan(score_col), F.col(score_col).cast("double"))
    rows = df.select(F.col(id_col).alias("id"), normal_owner(F.col(owner_col)).alias("owner"), score.alias("score")).where("id is not null and owner is not null")
    best = F.max(F.struct("score", "owner"))
    once = rows.groupBy("id").agg(best.alias("row")).select("id", "row.owner", "row.score")
    order = [F.asc("owner"), F.desc_nulls_last("score"), F.asc("id")]
    spread = checkpointed(once.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    parts = spread.groupBy("owner", "part").agg(F.count("*").alias("n"))
    cap = _cap(parts.groupBy("owner").agg(F.sum("n").alias("n")), share, most, basis)
    earlier = Window.partitionBy("owner").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part of an owner
    shift = parts.select("owner", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("owner", "part").orderBy(*order[1:]))
    placed = spread.join(shift, ["owner", "part"]).withColumn("place", F.col("before") + local)
    return placed.select("id", "owner", "score", "place", (F.col("place") <= cap).alias("kept"))
