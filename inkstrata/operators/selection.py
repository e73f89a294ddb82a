"""Greedy and diversity-aware selection. The loops are sequential by nature and run over bounded pools only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .preference import fit_of

#: The shares of a similarity, of a relevance score, and the cycle of selection modes.
SIMILARITY = {"style": 0.45, "character": 0.2, "sound": 0.15, "book": 0.1, "relation": 0.1}
RELEVANCE, DIVERSITY = 0.75, 0.25
MODES = ("fit", "fit", "diverse", "fit", "explore")
STYLES = 6


def cosine(a: Column, b: Column) -> Column:
    """Over the first six features; 0 if either side has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(F.slice(x, 1, STYLES), F.slice(y, 1, STYLES), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    size = dot(a, a) * dot(b, b)
    return F.when(size > 0, dot(a, b) / F.sqrt(size)).otherwise(0.0)


def similarity(x: str, y: str) -> Column:
    """Similarity of two rows whose columns have the prefixes ``x`` and ``y``: features, name, sound, book, relation."""
    both = lambda c: (F.col(f"{x}{c}"), F.col(f"{y}{c}"))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    name, sound, book, relation = both("name"), both("sound"), both("book"), both("relation")
    shared = F.arrays_overlap(F.split(name[0], ""), F.split(name[1], ""))
    return (
        cosine(*both("features")) * SIMILARITY["style"]
        + flag(shared) * SIMILARITY["character"]
        + flag((sound[0] != "") & (sound[0] == sound[1])) * SIMILARITY["sound"]
        + flag(book[0] == book[1]) * SIMILARITY["book"]
        + flag(relation[0] == relation[1]) * SIMILARITY["relation"]
    )


def _style(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    size = np.sqrt((a[:, :STYLES] ** 2).sum(1) * (b[:STYLES] ** 2).sum())
    return np.divide((a[:, :STYLES] * b[:STYLES]).sum(1), size, out=np.zeros(len(a)), where=size > 0)


class Items:
    """The item dimension as arrays in the order of ``item``: a few hundred bytes an item, held by every task.

    Equal values of a column have equal codes; null (of sounds the empty one too) equals nothing and has -1.
    """

    def __init__(self, items: pd.DataFrame) -> None:
        items = items.sort_values("item", kind="stable")
        self.item = items["item"].to_numpy()
        self.at = {x: k for k, x in enumerate(self.item)}
        self.features = np.stack(items.features.to_numpy()) if len(items) else np.zeros((0, STYLES))
        names = [sorted(set(x or "")) for x in items.name]
        known = {c: k for k, c in enumerate(sorted(set().union(*names)))}
        self.units = len(known)
        self.letters = np.full((len(items), max([1, *map(len, names)])), self.units)  # padded with a unit that doesn't count
        for k, x in enumerate(names):
            self.letters[k, : len(x)] = [known[c] for c in x]
        self.sound = pd.factorize(items.sound.where(items.sound != "", None))[0]
        self.book, self.relation, self.category, self.style = (pd.factorize(items[c])[0] for c in ("book", "relation", "category", "style"))

    def places(self, items: np.ndarray) -> list[int]:
        return [self.at[x] for x in items if x in self.at]

    def spread(self, items: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The values at the places of their items, 0 elsewhere."""
        out = np.zeros(len(self.item))
        for x, v in zip(items, values):
            if x in self.at:
                out[self.at[x]] = v
        return out

    @staticmethod
    def same(codes: np.ndarray, i: int) -> np.ndarray:
        return (codes == codes[i]) & (codes >= 0)

    def alike(self, i: int) -> np.ndarray:
        """Similarity of every item with one."""
        own = np.zeros(self.units + 1, bool)
        own[self.letters[i]] = True
        own[self.units] = False
        out = _style(self.features, self.features[i]) * SIMILARITY["style"] + own[self.letters].any(1) * SIMILARITY["character"]
        for codes, share in ((self.sound, "sound"), (self.book, "book"), (self.relation, "relation")):
            out = out + self.same(codes, i) * SIMILARITY[share]
        return out

    def count(self, codes: np.ndarray, chosen: list[int]) -> np.ndarray:
        """How many of the chosen items have each item's value."""
        return sum((self.same(codes, i).astype(int) for i in chosen), np.zeros(len(codes), int))

    def crowd(self, chosen: list[int]) -> np.ndarray:
        """How many of the chosen items have the one of each item's characters that most of them have."""
        met = np.bincount(self.letters[chosen].ravel(), minlength=self.units + 1) if chosen else np.zeros(self.units + 1, int)
        met[self.units] = 0
        return met[self.letters].max(1) if len(self.item) else np.zeros(0, int)


def _score(mode: str, fit: np.ndarray, closest: np.ndarray, penalty: np.ndarray, bonus: np.ndarray) -> np.ndarray:
    diversity = 1 - closest
    if mode == "explore":
        return (1 - np.abs(fit - 0.5) * 2) * 0.5 + diversity * 0.3 + fit * 0.2 - penalty
    return fit * RELEVANCE + diversity * DIVERSITY + (bonus if mode == "diverse" else 0.0) - penalty


def _next(d: Items, row) -> tuple | None:
    free = np.ones(len(d.item), bool)
    free[d.places(row.reacted)] = False
    if not free.any():
        return None
    recent, mode = d.places(row.recent), MODES[len(row.reacted) % len(MODES)]
    fit, penalty = fit_of(row.weights, d.features, d.spread(row.reacted, row.signals)), d.spread(row.shown, row.penalties)
    closest = np.max([d.alike(i) for i in recent], axis=0) if recent else np.zeros(len(d.item))
    sounds, categories, relations, styles, crowd = *(d.count(c, recent) for c in (d.sound, d.category, d.relation, d.style)), d.crowd(recent)
    level = np.select([(sounds == 0) & (categories < 3) & (crowd < 2), (sounds == 0) & (crowd < 2), (sounds == 0) & (crowd < 3)], [0, 1, 2], 3)
    score = _score(mode, fit, closest, penalty, (styles == 0) * 0.18 + (relations == 0) * 0.12 + (categories == 0) * 0.08)
    left = np.flatnonzero(free & (level == level[free].min()))
    best = int(left[np.argmax(score[left])])  # of equal ones the first: the smaller item
    return row.user, mode, int(level[best]), d.item[best], float(score[best])


def next_items(items: DataFrame, users: DataFrame) -> DataFrame:
    """``user, mode, level, item, score``: the next item of each user, chosen among all items that the user didn't react to.

    ``items``: item, name, features, sound, book, relation, category, style; it goes to every task as arrays. ``users``: as of
    ``preference.states``. An item that was shown has a penalty and may still be chosen.
    """
    d = Items(items.toPandas())

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([x for row in part.itertuples(index=False) if (x := _next(d, row))], columns=["user", "mode", "level", "item", "score"])

    return users.mapInPandas(run, "user bigint, mode string, level int, item string, score double")


def _greedy(d: Items, fit: np.ndarray, penalty: np.ndarray, size: int) -> list[tuple[int, str, float]]:
    """Place in ``d``, mode and score of each item of a batch, in the order of choice."""
    n = len(fit)
    want = min(size, n)
    fit_n = min(want, -(-want * 7 // 12))
    explore_n = min(want - fit_n, want * 2 // 12)
    plan = ["fit"] * fit_n + ["diverse"] * (want - fit_n - explore_n) + ["explore"] * explore_n
    closest, left, picked, out = np.zeros(n), np.ones(n, bool), [], []
    sounds, categories, relations, styles = (np.zeros(n, int) for _ in range(4))
    for mode in plan:
        crowd = d.crowd(picked)
        for allowed in (left & (sounds == 0) & (categories < 3) & (crowd < 2), left & (sounds == 0) & (crowd < 2), left & (sounds == 0) & (crowd < 3), left):
            if allowed.any():
                break
        score = _score(mode, fit, closest, penalty, (styles == 0) * 0.18 + (relations == 0) * 0.12 + (categories == 0) * 0.08)
        best = int(np.flatnonzero(allowed)[np.argmax(score[allowed])])
        picked.append(best)
        left[best] = False
        out.append((best, mode, float(score[best])))
        for counts, codes in ((sounds, d.sound), (categories, d.category), (relations, d.relation), (styles, d.style)):
            counts += d.same(codes, best)
        closest = np.maximum(closest, d.alike(best)) if len(picked) > 1 else d.alike(best)
    return out


BATCH = "user string, place int, item string, mode string, score double"


def _rows(user, d: Items, chosen: list[tuple[int, str, float]]) -> list[tuple]:
    return [(user, k + 1, d.item[i], mode, score) for k, (i, mode, score) in enumerate(chosen)]


def _batch(size: int):
    def choose(pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values("item", kind="stable")
        d = Items(pool)
        rows = _rows(pool.user.iloc[0] if len(pool) else None, d, _greedy(d, pool.fit.to_numpy(), pool.penalty.fillna(0.0).to_numpy(), size))
        return pd.DataFrame(rows, columns=["user", "place", "item", "mode", "score"])

    return choose


def batches_of_all(items: DataFrame, users: DataFrame, size: int = 12) -> DataFrame:
    """``user, place, item, mode, score``: the same as ``mmr_batches``, every user's pool being all items. Arguments as of ``next_items``."""
    d = Items(items.toPandas())

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for row in part.itertuples(index=False):
                fit = fit_of(row.weights, d.features, d.spread(row.reacted, row.signals))
                rows += _rows(str(row.user), d, _greedy(d, fit, d.spread(row.shown, row.penalties), size))
            yield pd.DataFrame(rows, columns=["user", "place", "item", "mode", "score"])

    return users.mapInPandas(run, BATCH)


def mmr_batches(pools: DataFrame, size: int = 12) -> DataFrame:
    """``user, place, item, mode, score``: a batch of fitting, diverse and exploring items for every user.

    ``pools``: user, item, name, features, sound, book, relation, category, style, fit, penalty; a user's pool is the item
    dimension, already narrowed by the caller to what one task may hold.
    """
    return pools.groupBy("user").applyInPandas(_batch(size), BATCH)


def _diverse(pool: pd.DataFrame) -> pd.DataFrame:
    pool = pool.sort_values(["score", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
    target, book_limit, work_limit = (int(pool[c].iloc[0]) for c in ("target", "book_limit", "work_limit"))
    letters = [set(x) for x in pool.naming]
    book, work = pool.book_id.to_numpy(), (pool.book_id + "\0" + pool.work_title.fillna("")).to_numpy()
    base, closest = pool.score.to_numpy(), np.zeros(len(pool))
    in_book, in_work, left, picked = np.zeros(len(pool), int), np.zeros(len(pool), int), np.ones(len(pool), bool), []
    while len(picked) < target:
        allowed = left & (in_book < book_limit) & (in_work < work_limit)
        if not allowed.any():
            break
        score = np.where(allowed, base - closest * 120 - in_work * 80 - in_book * 12, -np.inf)
        best = int(np.argmax(score))  # of equal ones the first: greater score, then smaller id
        picked.append(best)
        left[best] = False
        in_book += book == book[best]
        in_work += work == work[best]
        own = letters[best]
        for i in np.flatnonzero(left):
            if own and letters[i]:
                common = len(own & letters[i])
                closest[i] = max(closest[i], common / (len(own) + len(letters[i]) - common))
    return pd.DataFrame({"id": pool.id.iloc[picked], "place": np.arange(1, len(picked) + 1, dtype=np.int32)})


def diverse_passages(pool: DataFrame, naming: DataFrame) -> DataFrame:
    """``id, place`` of a global greedy selection from ``mining.selection_pool``, whose size is bounded by its target."""
    rows = pool.join(naming.select("id", "naming"), "id").withColumn("all", F.lit(1))
    return rows.groupBy("all").applyInPandas(lambda p: _diverse(p), "id string, place int")


def _capped(target: int):
    limits = max(2, -(-target * 10 // 100)), max(3, -(-target * 15 // 100)), max(3, -(-target * 20 // 100))

    def choose(pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values(["score", "item"], ascending=[False, True], kind="stable")
        counts: dict[tuple[str, str], int] = {}
        picked = []
        for row in pool.itertuples(index=False):
            if len(picked) >= target:
                break
            keys = [("c", c) for c in set(row.name)], [("b", row.book)], [("i", row.category)]
            if any(counts.get(k, 0) >= most for group, most in zip(keys, limits) for k in group):
                continue
            for group in keys:
                for k in group:
                    counts[k] = counts.get(k, 0) + 1
            picked.append(row.item)
        return pd.DataFrame({"item": picked, "place": np.arange(1, len(picked) + 1, dtype=np.int32)})

    return choose


def capped_selection(candidates: DataFrame, target: int) -> DataFrame:
    """``item, place``: a scan by score that passes over items whose characters, book or category are used up.

    ``candidates``: item, name, book, category, score: the candidate dimension.
    """
    return candidates.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(_capped(target), "item string, place int")


def hash_sample(df: DataFrame, key: str, n: int, seed: int, exclude: DataFrame | None = None) -> DataFrame:
    """``n`` rows in a random but repeatable order of the key's hash, without those of ``exclude`` unless too few are left."""
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)
    rows = df.withColumn("order", order)
    if exclude is not None:
        rows = rows.join(exclude.select(key).distinct().withColumn("was", F.lit(1)), key, "left")
        free = rows.where("was is null").count()
        rows = (rows.where("was is null") if free >= n else rows).drop("was")
    return rows.orderBy("order").limit(n).drop("order")


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page of a total order; numbers beyond the last page give the last."""
    pages = max(1, -(-df.count() // size))
    return df.orderBy(*order).offset((min(max(1, number), pages) - 1) * size).limit(size)
