"""Candidate pools: merging by precedence, scores, ranks, side-by-side comparison, lists and scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstrata.functions import text as T

from .numbering import place_within


def merge_by_name(sources: list[DataFrame], key: str = "name") -> DataFrame:
    """One row for each name, from the last source that has it (within a source by smallest id), with all citations.

    Sources have ``name, id, passage_id`` and the same further columns. Rows are reduced before they are moved, and so are citations.
    """
    tagged = [s.withColumn("rank", F.lit(-i)) for i, s in enumerate(sources)]
    rows = tagged[0]
    for other in tagged[1:]:
        rows = rows.unionByName(other, allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in (key, "rank", "id", "passage_id")]
    cited = rows.select(key, "passage_id").where("passage_id is not null").distinct().groupBy(key).agg(F.array_sort(F.collect_list("passage_id")).alias("citations"))
    best = rows.groupBy(key).agg(F.min(F.struct("rank", "id", *rest)).alias("k")).select(key, (-F.col("k.rank")).alias("source"), "k.id", *[f"k.{c}" for c in rest])
    return best.join(cited, key, "left").withColumn("citations", F.coalesce("citations", F.array().cast("array<string>")))


def competition_rank(df: DataFrame, score: str) -> DataFrame:
    """1 + the number of greater scores; null where the score is 0.

    Equal scores are counted before anything is ordered, so the ordering runs over distinct scores only.
    """
    distinct = df.where(F.col(score) != 0).groupBy(score).agg(F.count("*").alias("n"))
    greater = Window.orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
    ranks = distinct.select(score, (F.coalesce(F.sum("n").over(greater), F.lit(0)) + 1).alias("rank"))
    return df.join(ranks, score, "left")


def weighted_score(parts: dict[str, float], keep: Column) -> Column:
    """A weighted sum rounded to one digit; 0 for rows that don't count."""
    total = F.lit(0.0)
    for name, weight in parts.items():
        total = total + F.coalesce(F.col(name), F.lit(0.0)) * weight
    return F.when(keep, T.round_half_up(total, 1)).otherwise(0.0)


def unit_interval(value: Column) -> Column:
    """A feature within [0, 1]; missing and infinite ones are 0."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(finite, F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))).otherwise(0.0)


def features(candidates: DataFrame) -> DataFrame:
    """``item, features``: the 13 values in [0, 1] of a mined candidate, from its scores (0 to 5, family 0 to 2) and grade."""
    f, r, u = (F.col(c) / 5 for c in ("feminine", "rarity", "usability"))
    exact = F.when(F.col("grade") == "A", 1.0).otherwise(0.35)
    values = [F.lit(0.9), f, f * 0.45 + 0.35, u * 0.45 + 0.25, r * 0.5 + 0.25, F.lit(0.15), F.lit(0.5), u, u, r, F.col("family_score") / 2, exact, F.lit(0.0)]
    return candidates.select(F.col("given_name").alias("item"), F.array(*[unit_interval(v) for v in values]).alias("features"))


def compare(candidates: DataFrame, chosen: list[str], attributes: list[str]) -> DataFrame:
    """A row for every attribute, a column for every chosen name (at most four): a pivot of named columns only."""
    rows = candidates.where(F.col("given_name").isin(chosen[:4]) | F.col("full_name").isin(chosen[:4]))
    tall = rows.select("given_name", F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes])).alias("x")).select("given_name", "x.*")
    return tall.groupBy("attribute").pivot("given_name", sorted(chosen[:4])).agg(F.max("value"))


def scenarios(spark, first: str, last: str, slots: int = 12) -> DataFrame:
    """Every day of a range, both ends included, with every slot of two hours: ``id, day, slot, begins, ends`` (hours)."""
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("day"))
    each = days.select("day", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    number = F.datediff("day", F.to_date(F.lit(first))) * slots + F.col("slot") + 1
    return each.select(F.format_string("SCN-%03d", number).alias("id"), "day", "slot", ((F.col("slot") * 2 + 23) % 24).alias("begins"), ((F.col("slot") * 2 + 1) % 24).alias("ends"))


def recent(events: DataFrame, n: int = 6) -> DataFrame:
    """The last ``n`` items of each user by first reaction: ``user, item, back`` (1 is the last)."""
    first = events.groupBy("user", "item").agg(F.min(F.struct("at", "seq")).alias("k"))
    return first.withColumn("back", F.row_number().over(Window.partitionBy("user").orderBy(F.desc("k")))).where(F.col("back") <= n).select("user", "item", "back")


def toggled(events: DataFrame) -> DataFrame:
    """Items that are on after an odd number of toggles: ``user, item``."""
    return events.groupBy("user", "item").agg(F.count("*").alias("n")).where("n % 2 = 1").select("user", "item")


def without(candidates: DataFrame, excluded: DataFrame) -> DataFrame:
    """Candidates whose given and full name are both not in ``excluded`` (name)."""
    return candidates.join(excluded.select(F.col("name").alias("given_name")), "given_name", "left_anti").join(excluded.select(F.col("name").alias("full_name")), "full_name", "left_anti")


def pointers(wanted: DataFrame, passages: DataFrame) -> DataFrame:
    """``passage_id, place`` resolved to ``unit`` and ``occurrence`` (how often the unit stood before); null unit if out of range."""
    rows = wanted.join(passages.select(F.col("id").alias("passage_id"), "normalized_text"), "passage_id", "left")
    chars = T.characters(F.col("normalized_text"))
    out = rows.withColumn("chars", chars).withColumn("unit", F.get("chars", "place"))
    before = F.size(F.filter(F.slice("chars", F.lit(1), F.col("place")), lambda c: c == F.col("unit")))
    return out.select(*wanted.columns, "unit", F.when(F.col("unit").isNotNull(), before).alias("occurrence"))


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, as ``order``, and how many there were; reduced before the shuffle."""
    grouped = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("k"), F.count("*").alias("dropped_and_kept"))
    return grouped.select(*keys, *[f"k.{c}" for c in order], "dropped_and_kept")


def best_kept(df: DataFrame, key: str, order: list[Column], id_col: str = "id") -> DataFrame:
    """All rows, the best of each key marked ``kept``, the others with the id they lost to as ``reason``."""
    placed = place_within(df, [key], order)
    best = placed.where("place = 1").select(key, F.col(id_col).alias("_best"))
    return placed.join(best, key).withColumn("kept", F.col("place") == 1).withColumn("reason", F.when(F.col("place") > 1, F.concat(F.lit("weaker than "), "_best"))).drop("_best", "place")


def by_either_name(named: DataFrame, candidates: DataFrame) -> DataFrame:
    """``named`` (with ``name``) joined to candidates by given or by full name: two equi-joins, not one with an or."""
    keys = candidates.select("id", F.explode(F.array_distinct(F.array("given_name", "full_name"))).alias("name"))
    return named.join(keys, "name")
