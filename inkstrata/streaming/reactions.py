"""The reaction fold as a stateful stream, and its replay from a table."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from inkstrata.operators.preference import BOUND, ONLINE_RATE, SIGNALS
from inkstrata.session import shared_folder

_OUT = "user bigint, weights array<double>, events int"
_STATE = "weights array<double>, last string, events int"


def _step(weights: np.ndarray, delta: float, features: np.ndarray) -> np.ndarray:
    moved = np.clip(weights + ONLINE_RATE * delta * (features - 0.5), -BOUND, BOUND)
    return np.floor(moved * 1e12 + 0.5) / 1e12


def _update(size: int):
    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        weights, last, events = state.get if state.exists else ([0.0] * size, "{}", 0)
        w, seen = np.array(weights), json.loads(last)
        rows = pd.concat(list(parts)).sort_values(["at", "seq"], kind="stable")
        for row in rows.itertuples(index=False):
            worth = SIGNALS.get(row.reaction, 0.0)
            w = _step(w, worth - seen.get(row.item, 0.0), np.asarray(row.features))
            seen[row.item] = worth
            events += 1
        state.update((w.tolist(), json.dumps(seen), events))
        yield pd.DataFrame({"user": [key[0]], "weights": [w.tolist()], "events": [events]})

    return update


def weights(events: DataFrame, features: DataFrame, size: int) -> DataFrame:
    """The state of every user that has new reactions, after each micro-batch.

    ``events``: a stream of user, item, reaction, at, seq. Within a batch events are applied in order of time; the state is the
    weights and the last signal of each item the user reacted to, so a batch later than its successor isn't undone.
    """
    known = events.join(features, "item")
    return known.groupBy("user").applyInPandasWithState(_update(size), _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def replay(spark: SparkSession, events: DataFrame, features: DataFrame, size: int, slices: int = 3) -> DataFrame:
    """Streams a table of events through ``weights``, slice by slice of time, and returns the last state of every user.

    Each slice is a run of its own that takes up the state the one before left in the checkpoint, as after a restart. The slices are
    of about equal numbers of events; their bounds come from approximate quantiles, so nothing is ordered for it.
    """
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    second = F.col("at").cast("timestamp").cast("double")
    bounds = events.select(second.alias("s")).approxQuantile("s", [k / slices for k in range(1, slices)], 0.01)
    edges = [None, *sorted(set(bounds)), None]
    number = 0

    def keep(batch: DataFrame, _: int) -> None:
        nonlocal number
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{at}/out/n={number}")
        number += 1

    for low, high in zip(edges, edges[1:]):
        rule = F.lit(True)
        if low is not None:
            rule = rule & (second >= low)
        if high is not None:
            rule = rule & (second < high)
        events.where(rule).write.mode("append").parquet(f"{at}/events")
        source = spark.readStream.schema(events.schema).parquet(f"{at}/events")
        run = weights(source, features, size).writeStream.outputMode("update").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(keep).start()
        run.awaitTermination()
        if run.exception():
            raise run.exception()
    out = spark.read.parquet(f"{at}/out")
    return out.groupBy("user").agg(F.max_by(F.struct("weights", "events"), "batch").alias("s")).select("user", "s.weights", "s.events")
