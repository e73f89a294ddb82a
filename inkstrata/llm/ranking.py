"""One global ranking from pairwise comparisons.

The comparisons form a weighted graph over the items. The weighted least-squares potentials of the log-odds margins on its edges
solve the graph's Laplacian system, which conjugate gradient does; what no potentials can explain, the cycles, is their residual.
Log-odds of a handful of votes are biased, so for the strengths the margins and weights are renewed at the current strengths and the
system is solved again, which turns the first least-squares answer into the maximum-likelihood one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstrata.session import checkpointed, discard

#: Up to that many distinct pairs of items the vectors are in the driver's memory (24 bytes a pair), beyond it tables. Both stop alike.
LOCAL_EDGES = 1_000_000
#: The first system has finite margins, so it only needs to tell apart what no comparison links.
FIRST_RIDGE = 1e-9
#: A system is solved once its residual is that small against its right side (squares of the norms); strengths are settled once none moves more.
SOLVED, SETTLED = 1e-18, 1e-9


def _limit(n: int) -> int:
    """Steps within which conjugate gradient must solve a system of n items; in exact arithmetic n would do."""
    return 10 * n + 10


def comparisons(df: DataFrame, key: str, left: str, right: str, choice: str, names: DataFrame) -> DataFrame:
    """``winner, loser`` of every decided comparison.

    ``names`` has ``name, item``; both sides must be names of two different items. Only ``left`` and ``right`` decide, whatever
    their case and outer blanks. Repeated rows of one ``key`` count once (of differing ones the smallest); null keys are left out.
    """
    item = names.where("name is not null and name <> '' and item is not null").groupBy("name").agg(F.min("item").alias("item"))
    row = F.struct(F.col(left).alias("l"), F.col(right).alias("r"), F.lower(F.trim(F.regexp_replace(choice, r"^\s+|\s+$", ""))).alias("c"))
    votes = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(row).alias("v")).select("v.*").where("c in ('left', 'right')")
    sides = votes.join(item.withColumnsRenamed({"name": "l", "item": "a"}), "l").join(item.withColumnsRenamed({"name": "r", "item": "b"}), "r").where("a <> b")
    won = F.col("c") == "left"
    return sides.select(F.when(won, F.col("a")).otherwise(F.col("b")).alias("winner"), F.when(won, F.col("b")).otherwise(F.col("a")).alias("loser"))


def edges(votes: DataFrame) -> DataFrame:
    """``i, j, wins, losses`` with i < j, one row for each pair of items that met; counted before anything is moved."""
    swapped = F.col("winner") > F.col("loser")
    return votes.groupBy(F.least("winner", "loser").alias("i"), F.greatest("winner", "loser").alias("j")).agg(F.count_if(~swapped).cast("double").alias("wins"), F.count_if(swapped).cast("double").alias("losses"))


def _refined(wins, losses, gap, first: bool, smooth: float):
    """Weight and margin of an edge: the empirical log-odds first, later those at the current gap of strengths."""
    if first:
        w, l = wins + smooth, losses + smooth
        return 1 / (1 / w + 1 / l), np.log(w / l)
    p = 1 / (1 + np.exp(-np.clip(gap, -12, 12)))
    n = wins + losses
    weight = n * p * (1 - p)
    return weight, gap + (wins - n * p) / weight


def _solve_local(i: np.ndarray, j: np.ndarray, wins: np.ndarray, losses: np.ndarray, n: int, ridge: float, rounds: int, smooth: float) -> tuple[np.ndarray, np.ndarray]:
    """The potentials of the first system, and the strengths."""
    strength, potential = np.zeros(n), np.zeros(n)
    for turn in range(rounds):
        own = ridge if turn else FIRST_RIDGE
        weight, margin = _refined(wins, losses, strength[i] - strength[j], turn == 0, smooth)

        def laplacian(x):
            flow = weight * (x[i] - x[j])  # noqa: B023
            return np.bincount(i, flow, n) - np.bincount(j, flow, n) + own * x  # noqa: B023

        pull = weight * margin
        target = np.bincount(i, pull, n) - np.bincount(j, pull, n)
        diagonal = np.bincount(i, weight, n) + np.bincount(j, weight, n) + own
        x = strength.copy()
        r = target - laplacian(x)
        z = r / diagonal
        p, rz = z.copy(), r @ z
        for _ in range(_limit(n)):
            if rz < SOLVED * max(1.0, target @ target):
                break
            ap = laplacian(p)
            step = rz / (p @ ap)
            x += step * p
            r -= step * ap
            z = r / diagonal
            rz, old = r @ z, rz
            p = z + (rz / old) * p
        else:
            raise RuntimeError(f"conjugate gradient didn't solve the system of {n} items")
        moved, strength = np.abs(x - strength).max(initial=0), x
        if turn == 0:
            potential = x
        elif moved < SETTLED:
            break
    return potential, strength


def _solve_spread(graph: DataFrame, ridge: float, rounds: int, smooth: float) -> DataFrame:
    """``item, potential, strength``: the same with vectors and edges as tables; one join and one aggregation for each product with the Laplacian."""
    both = checkpointed(graph.unionByName(graph.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("losses").alias("wins"), F.col("wins").alias("losses"))))
    strength = checkpointed(both.select(F.col("i").alias("item")).distinct().withColumn("x", F.lit(0.0)))
    potential, n = strength, strength.count()
    other = lambda v, c: v.select(F.col("item").alias("j"), F.col(c).alias("other"))
    for turn in range(rounds):
        added = ridge if turn else FIRST_RIDGE
        gap = both.join(strength.select(F.col("item").alias("i"), F.col("x").alias("own")), "i").join(other(strength, "x"), "j").withColumn("gap", F.greatest(F.lit(-12.0), F.least(F.lit(12.0), F.col("own") - F.col("other"))))
        if turn == 0:
            w, l = F.col("wins") + smooth, F.col("losses") + smooth
            system = gap.select("i", "j", (1 / (1 / w + 1 / l)).alias("weight"), F.log(w / l).alias("margin"))
        else:
            votes, p = F.col("wins") + F.col("losses"), 1 / (1 + F.exp(-F.col("gap")))
            system = gap.withColumn("weight", votes * p * (1 - p)).select("i", "j", "weight", (F.col("own") - F.col("other") + (F.col("wins") - votes * p) / F.col("weight")).alias("margin"))
        system = checkpointed(system)

        def product(vector: DataFrame, column: str) -> DataFrame:
            """The vector with ``image``: the Laplacian (with ridge) applied to a column."""
            flow = system.join(other(vector, column), "j").groupBy(F.col("i").alias("item")).agg(F.sum(F.col("weight") * F.col("other")).alias("pulled"), F.sum("weight").alias("total"))  # noqa: B023
            return vector.join(flow, "item").withColumn("image", F.col("total") * F.col(column) - F.col("pulled") + added * F.col(column))  # noqa: B023

        target = system.groupBy(F.col("i").alias("item")).agg(F.sum(F.col("weight") * F.col("margin")).alias("target"))
        start = product(strength, "x").join(target, "item").select("item", "x", (F.col("target") - F.col("image")).alias("r"), (F.col("total") + added).alias("d"))
        state = checkpointed(start.withColumn("p", F.col("r") / F.col("d")))
        size = max(1.0, target.agg(F.sum(F.col("target") * F.col("target"))).first()[0] or 0)
        rz = state.agg(F.sum(F.col("r") * F.col("r") / F.col("d"))).first()[0] or 0.0
        for _ in range(_limit(n)):
            if rz < SOLVED * size:
                break
            image = checkpointed(product(state, "p").select("item", "x", "r", "d", "p", "image"))
            step = rz / image.agg(F.sum(F.col("p") * F.col("image"))).first()[0]
            moved = image.select("item", (F.col("x") + step * F.col("p")).alias("x"), (F.col("r") - step * F.col("image")).alias("r"), "d", "p")
            old, rz = rz, moved.agg(F.sum(F.col("r") * F.col("r") / F.col("d"))).first()[0]
            after = checkpointed(moved.withColumn("p", F.col("r") / F.col("d") + (rz / old) * F.col("p")))
            discard(state, image)
            state = after
        else:
            raise RuntimeError(f"conjugate gradient didn't solve the system of {n} items")
        shift = state.join(strength.select("item", F.col("x").alias("was")), "item").agg(F.max(F.abs(F.col("x") - F.col("was")))).first()[0] or 0.0
        discard(system)
        if strength is not potential:
            discard(strength)
        strength = state
        if turn == 0:
            discard(potential)
            potential = state
        elif shift < SETTLED:
            break
    discard(both)
    return potential.select("item", F.col("x").alias("potential")).join(strength.select("item", F.col("x").alias("strength")), "item")


def rank_items(votes: DataFrame, items: DataFrame, ridge: float = 1e-3, rounds: int = 12, smooth: float = 0.5, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``item, strength, comparisons, wins, potential, residual, position`` of every item.

    ``votes`` has winner and loser, ``items`` has ``item``. potential is the least-squares answer to the log-odds (counts enlarged by
    ``smooth``), residual the root of the mean squared part of these log-odds (by weight) on an item's pairs that the potentials
    leave unexplained: 0 where the comparisons have no cycle, null without comparisons. strength goes on from there. The ridge pulls
    all strengths slightly to 0, so an item without comparisons (strength 0), one that never lost, and groups that never met others
    all have a finite one. Equal strengths go by smaller item. The result doesn't depend on the order of the votes.
    """
    spark = votes.sparkSession
    graph = checkpointed(edges(votes))
    count = graph.count()
    if count <= local_edges:
        rows = graph.orderBy("i", "j").toPandas()
        found = np.unique(np.concatenate([rows.i, rows.j])) if count else np.array([], object)
        i, j = np.searchsorted(found, rows.i), np.searchsorted(found, rows.j)
        potential, strength = _solve_local(i, j, rows.wins.to_numpy(), rows.losses.to_numpy(), len(found), ridge, rounds, smooth)
        solved = spark.createDataFrame(list(zip(found.tolist(), potential.tolist(), strength.tolist())), f"item {graph.schema['i'].dataType.simpleString()}, potential double, strength double")
    else:
        solved = _solve_spread(graph, ridge, rounds, smooth)
    a, b = solved.select(F.col("item").alias("i"), F.col("potential").alias("ui")), solved.select(F.col("item").alias("j"), F.col("potential").alias("uj"))
    w, l = F.col("wins") + smooth, F.col("losses") + smooth
    off = F.log(w / l) - (F.col("ui") - F.col("uj"))
    each = graph.join(a, "i").join(b, "j").withColumn("weight", 1 / (1 / w + 1 / l)).withColumn("square", F.col("weight") * off * off)
    sides = each.select(F.col("i").alias("item"), "wins", "losses", "weight", "square").unionByName(each.select(F.col("j").alias("item"), F.col("losses").alias("wins"), F.col("wins").alias("losses"), "weight", "square"))
    totals = sides.groupBy("item").agg(F.sum(F.col("wins") + F.col("losses")).cast("bigint").alias("comparisons"), F.sum("wins").cast("bigint").alias("wins"), F.sqrt(F.sum("square") / F.sum("weight")).alias("residual"))
    ranked = items.select("item").where("item is not null").distinct().join(solved, "item", "left").join(totals, "item", "left")
    zero = lambda c, kind: F.coalesce(c, F.lit(0).cast(kind)).alias(c)
    return _positions(ranked.select("item", zero("strength", "double"), zero("comparisons", "bigint"), zero("wins", "bigint"), zero("potential", "double"), "residual"))


def _positions(ranked: DataFrame) -> DataFrame:
    """Positions by strength without a window over all rows: range partitions are numbered on their own and shifted by those before."""
    from pyspark.sql import Window

    sorted_ = checkpointed(ranked.repartitionByRange(F.desc("strength"), F.asc("item")).withColumn("part", F.spark_partition_id()))
    sizes = sorted_.groupBy("part").count()
    total = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    shift = sizes.select("part", F.coalesce(F.sum("count").over(total), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("strength"), F.asc("item")))
    return sorted_.join(F.broadcast(shift), "part").select("item", "strength", "comparisons", "wins", "potential", "residual", (own + F.col("before")).cast("bigint").alias("position"))
