import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkstrata.operators import mining, pool, preference, profiles, selection
from inkstrata.streaming import reactions


def events(spark, n=400, users=5, seed=2, names=("love", "like", "dislike", "skip")):
    rng = random.Random(seed)
    rows = [(rng.randrange(users), str(rng.randrange(6)), rng.choice(names), k // 2, k) for k in range(n)]
    df = spark.createDataFrame(rows, "user long, item string, reaction string, t long, seq long").withColumn("at", F.timestamp_seconds("t")).drop("t")
    features = {str(i): [rng.random() for _ in range(4)] for i in range(6)}
    return rows, df, features, spark.createDataFrame(list(features.items()), "item string, features array<double>")


def fold(rows, features, user):
    w, last = np.zeros(4), {}
    for u, item, reaction, _, _ in sorted(rows, key=lambda r: (r[3], r[4])):
        if u == user:
            worth = preference.SIGNALS[reaction]
            w = np.clip(w + 0.55 * (worth - last.get(item, 0)) * (np.array(features[item]) - 0.5), -3, 3)
            last[item] = worth
    return w


@pytest.mark.parametrize("names", [("love", "like", "dislike", "skip"), ("love", "dislike")])
def test_weights_equal_the_step_by_step_fold(spark, names):
    rows, df, features, table = events(spark, names=names)
    found = {r.user: r for r in preference.reaction_weights(df, table, 4).collect()}
    assert len(found) == 5 and sum(r.events for r in found.values()) == len(rows)
    for user, r in found.items():
        assert np.allclose(r.weights, fold(rows, features, user), atol=1e-9)


def test_bounded_steps_compose(spark):
    features = {"0": [1.0, 0.0], "1": [0.0, 1.0]}
    rows = [(1, str(k // 2 % 2), ("love", "dislike")[k % 2], k, k) for k in range(300)] + [(1, "0", "love", 1000 + k, 1000 + k) for k in range(3)]
    df = spark.createDataFrame(rows, "user long, item string, reaction string, t long, seq long").withColumn("at", F.timestamp_seconds("t")).drop("t")
    (r,) = preference.reaction_weights(df, spark.createDataFrame(list(features.items()), "item string, features array<double>"), 2).collect()
    w, last = np.zeros(2), {}
    for _, item, reaction, _, _ in rows:
        worth = preference.SIGNALS[reaction]
        w = np.clip(w + 0.55 * (worth - last.get(item, 0)) * (np.array(features[item]) - 0.5), -3, 3)
        last[item] = worth
    assert np.allclose(r.weights, w) and abs(r.weights[0]) <= 3


def test_the_stream_gives_the_same_weights(spark):
    rows, df, features, table = events(spark, n=120)
    batch = {r.user: r.weights for r in preference.reaction_weights(df, table, 4).collect()}
    stream = {r.user: r.weights for r in reactions.replay(spark, df, table, 4).collect()}
    assert batch.keys() == stream.keys() and all(np.allclose(batch[u], stream[u], atol=1e-9) for u in batch)


def test_undoing_restores_the_weights():
    w = np.array([0.3, -0.2])
    there = reactions._step(w, 1.0, np.array([0.9, 0.1]))
    assert np.allclose(reactions._step(there, -1.0, np.array([0.9, 0.1])), w)


def test_sigmoid_is_exact_at_the_ends(spark):
    row = spark.createDataFrame([(1000.0, -1000.0, 0.0)], "a double, b double, c double").select(*[preference.sigmoid(F.col(c)) for c in "abc"]).first()
    assert tuple(row) == (1.0, 0.0, 0.5)


def test_reasons_are_the_greatest_contributions(spark):
    users = spark.createDataFrame([(1, [1.0, 1.0, -1.0, 0.1, 1.0])], "user long, weights array<double>")
    items = spark.createDataFrame([("i", [0.9, 0.9, 0.1, 0.9, 0.55])], "item string, features array<double>")
    (r,) = preference.reasons(users, items, spark.createDataFrame([(1, "i")], "user long, item string"), list("abcde")).collect()
    assert r.reasons == ["a", "b", "c"]


def test_pairwise_fold(spark):
    features = {"x": [0.9, 0.1], "y": [0.2, 0.6]}
    table = spark.createDataFrame(list(features.items()), "item string, features array<double>")
    rows = [("p", "x", "y", c, k, k) for k, c in enumerate(["left", "skip", "right", "both-dislike", "left"])]
    (r,) = preference.pairwise_weights(spark.createDataFrame(rows, "profile string, left string, right string, choice string, at long, seq long"), table, [0.5, 0.0]).collect()
    prior, w = np.array([0.5, 0.0]), np.array([0.5, 0.0])
    for c in ("left", "right", "left"):
        gap = (np.array(features["x"]) - np.array(features["y"])) * (1 if c == "left" else -1)
        w = prior + (w + 0.4 * (1 - 1 / (1 + math.exp(-(w @ gap)))) * gap - prior) * 0.985
    assert np.allclose(r.weights, w) and r.progress == 4


def items(n=18):
    rng = random.Random(4)
    sounds = [f"s{0 if i == 1 else i}" if i < 3 else f"s{i}" for i in range(n)]
    return [("u", f"i{i:02d}", chr(97 + i) + chr(97 + (i * 5) % 26), [rng.random() for _ in range(13)], sounds[i], i % 5, i % 4, i % 5, i % 6, rng.random(), 0.0) for i in range(n)]


POOL = "user string, item string, name string, features array<double>, sound string, book int, relation int, category int, style int, fit double, penalty double"


def test_a_batch_is_diverse_and_independent_of_input_order(spark):
    rows = items()
    runs = [selection.mmr_batches(spark.createDataFrame(r, POOL)).orderBy("place").collect() for r in (rows, rows[::-1])]
    assert runs[0] == runs[1] and len(runs[0]) == 12
    kinds = [r.mode for r in runs[0]]
    assert (kinds.count("fit"), kinds.count("diverse"), kinds.count("explore")) == (7, 3, 2)
    by = {r[1]: r for r in rows}
    chosen = [by[r.item] for r in runs[0]]
    assert len({r[4] for r in chosen}) == 12
    letters = [c for r in chosen for c in set(r[2])]
    assert max(map(letters.count, letters)) <= 2


def test_small_and_single_pools(spark):
    assert selection.mmr_batches(spark.createDataFrame(items(3), POOL)).count() == 3
    assert selection.mmr_batches(spark.createDataFrame([], POOL)).count() == 0


def test_diverse_passages_equal_the_plain_greedy_loop(spark):
    rng = random.Random(9)
    rows = [(f"p{i:02d}", f"b{i % 3}", f"w{i % 7}", float(rng.randrange(50, 90)), sorted(rng.sample("abcdefgh", rng.randrange(0, 5)))) for i in range(40)]
    df = spark.createDataFrame([(*r[:4], 12, 5, 3) for r in rows], "id string, book_id string, work_title string, score double, target int, book_limit int, work_limit int")
    naming = spark.createDataFrame([(r[0], r[4]) for r in rows], "id string, naming array<string>")
    found = [r.id for r in selection.diverse_passages(df, naming).orderBy("place").collect()]
    picked, left = [], list(rows)
    jaccard = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0
    while len(picked) < 12:
        best = None
        for r in left:
            n, m = sum(p[1] == r[1] for p in picked), sum(p[1:3] == r[1:3] for p in picked)
            if n >= 5 or m >= 3:
                continue
            value = r[3] - 120 * max((jaccard(r[4], p[4]) for p in picked), default=0) - 80 * m - 12 * n
            key = (-value, -r[3], r[0])
            best = min(best, (key, r)) if best else (key, r)
        if best is None:
            break
        picked.append(best[1])
        left.remove(best[1])
    assert found == [r[0] for r in picked]


def test_capped_selection(spark):
    rows = [(f"i{i}", "ab" if i < 5 else f"{chr(100 + i)}{chr(110 + i)}", f"b{i}", f"c{i}", float(10 - i)) for i in range(10)]
    found = [r.item for r in selection.capped_selection(spark.createDataFrame(rows, "item string, name string, book string, category string, score double"), 5).orderBy("place").collect()]
    assert found == ["i0", "i1", "i5", "i6", "i7"]


def test_merge_prefers_later_sources_and_keeps_all_citations(spark):
    schema = "name string, id string, passage_id string, grade string"
    first = spark.createDataFrame([("ab", "m2", "p2", "B"), ("ab", "m1", "p1", "A"), ("cd", "m3", None, "B")], schema)
    second = spark.createDataFrame([("ab", "c1", "p9", "A")], schema)
    found = {r.name: r for r in pool.merge_by_name([first, second]).collect()}
    assert (found["ab"].id, found["ab"].citations, found["ab"].source) == ("c1", ["p1", "p2", "p9"], 1)
    assert (found["cd"].id, found["cd"].citations) == ("m3", [])


def test_ranks_and_pages(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 5.0), ("c", 3.0), ("d", 0.0), ("e", 1.0)], "n string, s double")
    assert {r.n: r["rank"] for r in pool.competition_rank(df, "s").collect()} == {"b": 1, "a": 2, "c": 2, "e": 4, "d": None}
    assert [r.n for r in selection.page(df, [F.asc("n")], 99, 2).collect()] == ["e"] and [r.n for r in selection.page(df, [F.asc("n")], 0, 2).collect()] == ["a", "b"]


def test_scenarios(spark):
    found = pool.scenarios(spark, "2026-01-30", "2026-02-09").orderBy("id").collect()
    assert len(found) == 132 and found[0].id == "SCN-001" and str(found[-1].day) == "2026-02-09" and (found[0].begins, found[0].ends) == (23, 1)


def test_hash_samples_repeat_and_exclude(spark):
    df = spark.range(50).selectExpr("cast(id as string) k")
    a = selection.hash_sample(df, "k", 10, 1)
    again = selection.hash_sample(df.orderBy(F.desc("k")), "k", 10, 1)
    assert {r.k for r in a.collect()} == {r.k for r in again.collect()}
    assert not {r.k for r in selection.hash_sample(df, "k", 10, 1, a).collect()} & {r.k for r in a.collect()}
    assert selection.hash_sample(df, "k", 45, 1, a).count() == 45


def test_pointers(spark):
    passages = spark.createDataFrame([("p", "行行止𠀀")], "id string, normalized_text string")
    wanted = spark.createDataFrame([("p", 1), ("p", 3), ("p", 4), ("q", 0)], "passage_id string, place int")
    found = {(r.passage_id, r.place): (r.unit, r.occurrence) for r in pool.pointers(wanted, passages).collect()}
    assert found == {("p", 1): ("行", 1), ("p", 3): ("𠀀", 0), ("p", 4): (None, None), ("q", 0): (None, None)}


def test_profiles_are_checked_field_by_field(spark):
    texts = ['{"version":2,"weights":{"a":9,"b":"x"},"explicitFeedback":{"n":1,"m":7,"k":"y"},"calibrationProgress":99}', '{"version":1,"a":0.5,"b":-0.25}', "broken", None, '{"version":2,"weights":3,"calibrationProgress":-4}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = [r.p for r in df.select("i", profiles.parsed(F.col("t"), ["a", "b"], 0.1).alias("p")).orderBy("i").collect()]
    assert (rows[0].weights, rows[0].explicit, rows[0].progress) == ([3.0, 0.1], {"n": 1.0}, 8)
    assert rows[1].weights == [0.5, -0.25]
    assert all((r.weights, r.explicit, r.progress) == ([0.1, 0.1], {}, 0) for r in rows[2:])


def test_losing_rows_name_the_winner(spark):
    df = spark.createDataFrame([("n", "a", 1.0), ("n", "b", 2.0), ("m", "c", 0.0)], "name string, id string, v double")
    found = {r.id: (r.kept, r.reason) for r in pool.best_kept(df, "name", [F.desc("v"), F.asc("id")]).collect()}
    assert found == {"a": (False, "weaker than b"), "b": (True, None), "c": (True, None)}


def test_batches_are_consecutive_and_named_by_their_members(spark):
    df = spark.createDataFrame([(f"p{i}", i + 1) for i in range(5)], "id string, place int")
    found = mining.batches(df, 2).orderBy("batch").collect()
    assert [r.ids for r in found] == [["p0", "p1"], ["p2", "p3"], ["p4"]]
    assert [r.batch_id for r in found] == [f"source-{i + 1:04d}-{hashlib.sha256(chr(10).join(r.ids).encode()).hexdigest()[:12]}" for i, r in enumerate(found)]
