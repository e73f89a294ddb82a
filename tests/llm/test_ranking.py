import math
import random

import pytest

from inkstrata.llm import ranking

SCHEMA = "feedback_id long, left_name string, right_name string, choice string, item string, i string"


def votes(spark, rows, names):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return ranking.comparisons(df, "feedback_id", "left_name", "right_name", "choice", spark.createDataFrame(names, "name string, item string"))


def test_what_counts_as_a_comparison(spark):
    names = [("a", "a"), ("sa", "a"), ("b", "b"), ("sb", "b")]
    rows = [(1, "a", "b", " LEFT "), (1, "a", "b", " LEFT "), (2, "sa", "sb", "right\t"), (3, "a", "sa", "left"), (4, "a", "b", "skip"), (5, "a", "b", None), (6, None, "b", "left"), (7, "", "b", "left"), (8, "a", "z", "left"), (None, "a", "b", "left")]
    assert sorted(tuple(r) for r in votes(spark, rows, names).collect()) == [("a", "b"), ("b", "a")]


def noisy(spark, n=24, games=4000, seed=3):
    rng = random.Random(seed)
    strength = {f"n{i:02d}": rng.gauss(0, 1) for i in range(n)}
    names = sorted(strength)
    rows = []
    for k in range(games):
        a = names[min(int(rng.expovariate(0.2)), n - 1)]  # a few items are asked about far more often
        b = rng.choice([x for x in names if x != a])
        p = 1 / (1 + math.exp(strength[b] - strength[a]))
        rows.append((k, a, b, "left" if rng.random() < p else "right"))
    items = spark.createDataFrame([(x,) for x in names], "item string")
    return strength, votes(spark, rows, [(x, x) for x in names]), items


def test_the_ranking_recovers_the_strengths(spark):
    strength, cast, items = noisy(spark)
    found = {r.item: r for r in ranking.rank_items(cast, items).collect()}
    order = sorted(strength, key=strength.get)
    rank = {x: i for i, x in enumerate(order)}
    mine = sorted(found, key=lambda x: found[x].strength)
    n = len(order)
    rho = 1 - 6 * sum((rank[x] - i) ** 2 for i, x in enumerate(mine)) / (n * (n * n - 1))
    assert rho > 0.95
    assert sorted(r.position for r in found.values()) == list(range(1, n + 1))


def test_tables_and_memory_give_the_same(spark):
    """Strengths after several rounds, and the first system of a thousand items."""
    _, cast, items = noisy(spark, n=6, games=300)
    many = noisy(spark, n=1000, games=12_000)
    for cast, items, rounds in ((cast, items, 3), (*many[1:], 1)):  # noqa: B020
        local = {r.item: r for r in ranking.rank_items(cast, items, rounds=rounds).collect()}
        spread = {r.item: r for r in ranking.rank_items(cast, items, rounds=rounds, local_edges=0).collect()}
        assert all(abs(local[x].strength - spread[x].strength) < 1e-6 and abs((local[x].residual or 0) - (spread[x].residual or 0)) < 1e-6 for x in local)
        assert all(local[x].position == spread[x].position for x in local)


def test_tables_are_given_back(spark, tmp_path):
    from inkstrata import session

    _, cast, items = noisy(spark, n=5, games=60)
    with session.scratch():
        before = len(session._WRITTEN)
        assert ranking.rank_items(cast, items, rounds=2, local_edges=0).count() == 5
        assert len(session._WRITTEN) - before <= 4
    assert len(session._WRITTEN) <= before


def test_comparisons_without_a_cycle_leave_no_residual(spark):
    items = spark.createDataFrame([(x,) for x in "abcde"], "item string")
    chain = [("a", "b")] * 3 + [("b", "c")] * 2 + [("c", "b")] + [("b", "d")] * 7 + [("d", "e")]
    found = ranking.rank_items(spark.createDataFrame(chain, "winner string, loser string"), items).collect()
    assert all(r.residual < 1e-4 for r in found)
    assert {r.item: round(r.potential, 3) for r in found}["a"] - {r.item: round(r.potential, 3) for r in found}["b"] == pytest.approx(math.log(3.5 / 0.5), abs=2e-3)


def test_cycles_show_in_the_residual(spark):
    items = spark.createDataFrame([(x,) for x in "abcd"], "item string")
    cycle = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")] * 10, "winner string, loser string")
    found = {r.item: r for r in ranking.rank_items(cycle, items).collect()}
    assert all(abs(found[x].strength) < 1e-6 and found[x].residual > 1 for x in "abc")
    assert found["d"].strength == 0 and found["d"].residual is None and found["d"].comparisons == 0
    assert [found[x].position for x in "abcd"] == [1, 2, 3, 4] or len({round(found[x].strength, 9) for x in "abcd"}) > 1


def test_winners_without_a_loss_and_parts_without_a_link(spark):
    items = spark.createDataFrame([(x,) for x in "abcd"], "item string")
    cast = spark.createDataFrame([("a", "b")] * 3 + [("c", "d")] * 3, "winner string, loser string")
    found = {r.item: r.strength for r in ranking.rank_items(cast, items).collect()}
    assert all(math.isfinite(v) for v in found.values()) and found["a"] > found["b"] and found["c"] > found["d"]


def test_no_votes_and_no_items(spark):
    none = spark.createDataFrame([], "winner string, loser string")
    items = spark.createDataFrame([("b",), ("a",), (None,)], "item string")
    assert [(r.item, r.strength, r.position) for r in ranking.rank_items(none, items).orderBy("position").collect()] == [("a", 0.0, 1), ("b", 0.0, 2)]
    assert ranking.rank_items(none, items.limit(0)).collect() == []
