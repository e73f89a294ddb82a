"""Preference profiles as versioned JSON: written, and read with every field checked by itself."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .preference import BOUND

VERSION, PROGRESS = 2, 8


def to_text(weights: Column, explicit: Column, events: Column) -> Column:
    """``weights`` and ``explicit`` are maps by name."""
    return F.to_json(F.struct(F.lit(VERSION).alias("version"), weights.alias("weights"), F.coalesce(explicit, F.create_map().cast("map<string,double>")).alias("explicitFeedback"), F.least(events, F.lit(PROGRESS)).cast("int").alias("calibrationProgress")))


def _number(map_column: Column, key: str, default: float) -> Column:
    value = F.try_element_at(map_column, F.lit(key)).try_cast("double")
    return F.coalesce(F.when(~F.isnan(value), value), F.lit(default))


def parsed(text: Column, keys: list[str], default: float = 0.0) -> Column:
    """A struct of weights (in the order of the keys), explicit and progress.

    A field of another type takes its default and leaves the others alone: weights are bounded, feedback outside [-1, 1] is
    dropped, progress is kept within its range. Texts of version 1 have their weights at the top. Null and broken texts give the defaults.
    """
    raw = F.from_json(text, "version string, weights map<string,string>, explicitFeedback map<string,string>, calibrationProgress string")
    top = F.from_json(text, "map<string,string>")
    own = F.when(raw.version == "1", top).otherwise(raw.weights)
    weights = F.array(*[F.least(F.lit(BOUND), F.greatest(F.lit(-BOUND), _number(own, k, default))) for k in keys])
    numbers = F.transform_values(F.coalesce(raw.explicitFeedback, F.create_map().cast("map<string,string>")), lambda _, v: v.try_cast("double"))
    explicit = F.map_filter(numbers, lambda _, v: v.isNotNull() & v.between(-1, 1))
    progress = F.greatest(F.lit(0), F.least(F.lit(PROGRESS), F.coalesce(raw.calibrationProgress.try_cast("int"), F.lit(0))))
    return F.struct(weights.alias("weights"), explicit.alias("explicit"), progress.alias("progress"))
