"""Preferences learnt from ordered events: folds in batch, utilities and reasons."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a reaction is worth, and the constants of the updates.
SIGNALS = {"love": 1.0, "like": 0.45, "dislike": -1.0, "skip": 0.0}
ONLINE_RATE, PAIR_RATE, SHRINKAGE, EXPLICIT, BOUND, BOTH_DISLIKED = 0.55, 0.4, 0.015, 1.25, 3.0, -0.75


def signal(reaction: Column) -> Column:
    value = F.lit(0.0)
    for name, worth in SIGNALS.items():
        value = F.when(reaction == name, worth).otherwise(value)
    return value


def steady(value: Column) -> Column:
    """A weight within its bounds, rounded to 12 digits."""
    return F.floor(F.least(F.lit(BOUND), F.greatest(F.lit(-BOUND), value)) * 1e12 + 0.5) / 1e12


def sigmoid(x: Column) -> Column:
    return F.when(x >= 36, 1.0).when(x <= -36, 0.0).otherwise(1 / (1 + F.exp(-x)))


def _composed(size: int):
    """Of every run of one user's rows in a sorted partition: the steps composed into one, ``w -> min(high, max(low, w + shift))``."""

    def compose(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, first, n = None, None, 0
        shift, low, high = np.zeros(size), np.full(size, -BOUND), np.full(size, BOUND)

        def row():
            return (user, *first, n, shift.tolist(), low.tolist(), high.tolist())

        for part in parts:
            out = []
            for step in part.itertuples(index=False):
                if step.user != user:
                    if user is not None:
                        out.append(row())
                    user, first, n = step.user, (step.at, step.seq), 0
                    shift, low, high = np.zeros(size), np.full(size, -np.inf), np.full(size, np.inf)
                moved = ONLINE_RATE * step.delta * (np.asarray(step.features) - 0.5)
                shift = shift + moved
                low, high = np.clip(low + moved, -BOUND, BOUND), np.clip(high + moved, -BOUND, BOUND)
                n += 1
            if out:
                yield pd.DataFrame(out, columns=["user", "at", "seq", "n", "shift", "low", "high"])
        if user is not None:
            yield pd.DataFrame([row()], columns=["user", "at", "seq", "n", "shift", "low", "high"])

    return compose


def reaction_weights(events: DataFrame, features: DataFrame, size: int) -> DataFrame:
    """``user, weights, events`` after all reactions of a user in order.

    ``events``: user (a number), item, reaction, at, seq. A step adds the change of the item's signal times its centred features
    and is bounded by itself, so the order matters. Bounded steps compose into one bounded step, so range partitions of
    (user, at, seq) are folded side by side, a user of many events among them, and a user's few partial steps in order after that.
    """
    line = Window.partitionBy("user", "item").orderBy("at", "seq")
    worth = signal(F.col("reaction"))
    deltas = events.withColumn("delta", worth - F.coalesce(F.lag(worth).over(line), F.lit(0.0))).join(features, "item")
    ordered = deltas.select("user", "at", "seq", "delta", "features").repartitionByRange("user", "at", "seq").sortWithinPartitions("user", "at", "seq")
    runs = ordered.mapInPandas(_composed(size), "user bigint, at timestamp, seq bigint, n int, shift array<double>, low array<double>, high array<double>")
    steps = runs.groupBy("user").agg(F.array_sort(F.collect_list(F.struct("at", "seq", "shift", "low", "high"))).alias("steps"), F.sum("n").alias("events"))  # at most one for each partition
    clamp = lambda w, s: F.transform(w, lambda x, i: F.least(F.get(s.high, i), F.greatest(F.get(s.low, i), x + F.get(s["shift"], i))))
    fold = F.aggregate("steps", F.array_repeat(F.lit(0.0), size), clamp)
    return steps.select("user", F.transform(fold, steady).alias("weights"), "events")


def explicit_feedback(events: DataFrame) -> DataFrame:
    """``user, item, signal``: the last reaction of each pair, without those worth nothing."""
    last = events.groupBy("user", "item").agg(F.max(F.struct("at", "seq", "reaction")).alias("e"))
    return last.select("user", "item", signal(F.col("e.reaction")).alias("signal")).where("signal <> 0")


def disliked(choices: DataFrame) -> DataFrame:
    """``profile, item, signal``: both items of every ``both-dislike`` of a profile count -0.75. ``choices`` as of ``pairwise_weights``."""
    both = choices.where("choice = 'both-dislike'").select("profile", F.explode(F.array("left", "right")).alias("item")).distinct()
    return both.select("profile", "item", F.lit(BOTH_DISLIKED).alias("signal"))


def exposure_counts(shown: DataFrame, events: DataFrame) -> DataFrame:
    """``user, item, shown``: showings and reactions count 1, an ``undo`` of a reaction takes 1 back; items with none are left out.

    ``events`` as of ``reaction_weights``, to whose fold an undo is a reaction worth nothing. An undo without a reaction before it
    doesn't count.
    """
    line = Window.partitionBy("user", "item").orderBy("at", "seq")
    before = F.lag("reaction").over(line)
    step = F.when(F.col("reaction") != "undo", 1).when(before.isNotNull() & (before != "undo"), -1).otherwise(0)
    steps = events.withColumn("n", step).select("user", "item", "n").unionByName(shown.select("user", "item", F.lit(1).alias("n")))
    return steps.groupBy("user", "item").agg(F.sum("n").alias("shown")).where("shown > 0")


def reacted_in_order(events: DataFrame) -> DataFrame:
    """``user, item, at, seq``: items with a reaction that isn't undone, by their first reaction since the last undo."""
    last = events.where("reaction = 'undo'").groupBy("user", "item").agg(F.max(F.struct("at", "seq")).alias("u"))
    rows = events.where("reaction <> 'undo'").join(last, ["user", "item"], "left").where(F.col("u").isNull() | (F.struct("at", "seq") > F.col("u")))
    return rows.groupBy("user", "item").agg(F.min(F.struct("at", "seq")).alias("k")).select("user", "item", "k.at", "k.seq")


def list_states(events: DataFrame, compared: int = 4) -> DataFrame:
    """``user, favourites, rejected, compared, explicit`` (items in the order they were added; item=signal) after all toggles in order.

    ``events``: user (a number), item, list (favourite, reject or compare), at, seq. A favourite is no longer rejected, a rejected item
    neither favourite nor compared; a full comparison takes no more. An added item has feedback 1, -1 or 0.25, a removed one none. The
    fold is sequential in a user, streamed in sorted order; it holds that user's lists.
    """
    ordered = events.select("user", "item", "list", "at", "seq").repartition("user").sortWithinPartitions("user", "at", "seq")
    names = ("favourite", "reject", "compare")
    worth = dict(zip(names, (1.0, -1.0, 0.25)))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, lists, explicit = None, {}, {}

        def row():
            return (user, *[list(lists[n]) for n in names], [f"{k}={v:g}" for k, v in sorted(explicit.items())])

        for part in parts:
            out = []
            for event in part.itertuples(index=False):
                if event.user != user:
                    if user is not None:
                        out.append(row())
                    user, lists, explicit = event.user, {n: {} for n in names}, {}
                own, item = lists[event.list], event.item
                if item in own:
                    del own[item]
                    explicit.pop(item, None)
                else:
                    if event.list != "compare" or len(own) < compared:
                        own[item] = None
                    explicit[item] = worth[event.list]
                for other in {"favourite": ("reject",), "reject": ("favourite", "compare"), "compare": ()}[event.list]:
                    lists[other].pop(item, None)
            if out:
                yield pd.DataFrame(out, columns=["user", "favourites", "rejected", "compared", "explicit"])
        if user is not None:
            yield pd.DataFrame([row()], columns=["user", "favourites", "rejected", "compared", "explicit"])

    return ordered.mapInPandas(run, "user bigint, favourites array<string>, rejected array<string>, compared array<string>, explicit array<string>")


def exposures(events: DataFrame) -> DataFrame:
    """``user, item, shown, penalty``."""
    counted = events.groupBy("user", "item").agg(F.count("*").alias("shown"))
    return counted.withColumn("penalty", F.least(F.lit(0.48), F.log1p(F.col("shown").cast("double")) * 0.1))


def utility(weights: Column, features: Column, explicit: Column) -> Column:
    terms = F.zip_with(weights, features, lambda w, f: w * (f - 0.5))
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) + F.coalesce(explicit, F.lit(0.0)) * EXPLICIT


def fits(users: DataFrame, features: DataFrame, explicit: DataFrame) -> DataFrame:
    """``user, item, fit`` of every user with every item (the output is that product)."""
    signals = explicit.groupBy("user").agg(F.map_from_entries(F.collect_list(F.struct("item", "signal"))).alias("signals"))
    rows = users.select("user", "weights").join(signals, "user", "left").crossJoin(F.broadcast(features))
    return rows.select("user", "item", sigmoid(utility(F.col("weights"), F.col("features"), F.try_element_at("signals", F.col("item")))).alias("fit"))


def fit_of(weights: np.ndarray, features: np.ndarray, explicit: np.ndarray) -> np.ndarray:
    """The same for one user over a matrix of features, added up in the same order."""
    u = np.zeros(len(features))
    for k, w in enumerate(weights):
        u += w * (features[:, k] - 0.5)
    u += explicit * EXPLICIT
    return np.where(u >= 36, 1.0, np.where(u <= -36, 0.0, 1 / (1 + np.exp(-np.clip(u, -36, 36)))))


def states(users: DataFrame, events: DataFrame, recent: DataFrame, shown: DataFrame) -> DataFrame:
    """``user, weights, reacted, signals, recent, shown, penalties``: one row for each of ``users`` (user, weights).

    The lists have each item once: those reacted to with their signals beside them, the recent ones, those shown with their penalties.
    """
    last = events.groupBy("user", "item").agg(F.max(F.struct("at", "seq", "reaction")).alias("e")).select("user", "item", signal(F.col("e.reaction")).alias("value"))
    listed = lambda df, items, values: df.groupBy("user").agg(F.collect_list(F.struct("item", "value")).alias("x")).select("user", F.col("x.item").alias(items), F.col("x.value").alias(values))
    rows = users.select("user", "weights").join(listed(last, "reacted", "signals"), "user", "left").join(recent.groupBy("user").agg(F.collect_list("item").alias("recent")), "user", "left")
    rows = rows.join(listed(exposures(shown).withColumn("value", F.col("penalty")), "shown", "penalties"), "user", "left")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    return rows.select("user", "weights", *[empty(c, "string") for c in ("reacted", "recent", "shown")], *[empty(c, "double") for c in ("signals", "penalties")])


def reasons(users: DataFrame, features: DataFrame, wanted: DataFrame | None, keys: list[str], most: int = 3) -> DataFrame:
    """``user, item, reasons``: up to ``most`` features that add more than 0.04, greatest first, then in the order of the keys.

    Of the wanted (user, item) rows; without these of every user with every item (the output is that product).
    """
    own = users.select("user", "weights")
    rows = own.crossJoin(F.broadcast(features)) if wanted is None else wanted.join(own, "user").join(features, "item")
    names = F.array(*[F.lit(k) for k in keys])
    parts = F.zip_with("weights", "features", lambda w, f: w * (f - 0.5))
    listed = F.transform(parts, lambda v, i: F.struct((-v).alias("v"), i.alias("i")))
    top = F.slice(F.array_sort(F.filter(listed, lambda x: x.v < -0.04)), 1, most)
    return rows.select("user", "item", F.transform(top, lambda x: F.get(names, x.i)).alias("reasons"))


def pairwise_weights(choices: DataFrame, features: DataFrame, prior: list[float]) -> DataFrame:
    """``profile, weights, progress`` after all decided comparisons of a profile in order.

    ``choices``: profile, left, right, choice, at, seq. ``left`` and ``right`` move the weights, ``both-dislike`` counts as
    progress only (at most 8), anything else is no event. The fold is sequential in a profile; it gets only that profile's rows,
    streamed in sorted order, never a whole group at once.
    """
    start = np.array(prior)
    named = lambda side: features.select(F.col("item").alias(side), F.col("features").alias(f"f_{side}"))
    rows = choices.where("choice in ('left', 'right', 'both-dislike')").join(named("left"), "left").join(named("right"), "right")
    ordered = rows.select("profile", "choice", "at", "seq", "f_left", "f_right").repartition("profile").sortWithinPartitions("profile", "at", "seq")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        profile, w, progress = None, start, 0
        for part in parts:
            out = []
            for row in part.itertuples(index=False):
                if row.profile != profile:
                    if profile is not None:
                        out.append((profile, w.tolist(), min(8, progress)))
                    profile, w, progress = row.profile, start, 0
                progress += 1
                if row.choice != "both-dislike":
                    left, right = np.asarray(row.f_left), np.asarray(row.f_right)
                    gap = left - right if row.choice == "left" else right - left
                    lead = min(700.0, max(-700.0, float(w @ gap)))
                    scale = PAIR_RATE * (1 - 1 / (1 + np.exp(-lead)))
                    w = np.clip(start + (w + scale * gap - start) * (1 - SHRINKAGE), -BOUND, BOUND)
            if out:
                yield pd.DataFrame(out, columns=["profile", "weights", "progress"])
        if profile is not None:
            yield pd.DataFrame([(profile, w.tolist(), min(8, progress))], columns=["profile", "weights", "progress"])

    return ordered.mapInPandas(run, "profile string, weights array<double>, progress int")
