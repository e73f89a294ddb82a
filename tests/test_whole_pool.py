"""Every user's candidates are all items: the queries against plain loops over the whole pool."""

import os

import compare
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from inkstrata.operators import pool, preference, selection
from inkstrata.plans import catalog

ITEMS = "item string, name string, features array<double>, sound string, book int, relation int, category int, style int"
needs_tables = pytest.mark.skipif(not os.path.isdir(compare.SF), reason="needs the test tables")


def state(spark, weights, reactions, shown):
    users = spark.createDataFrame([(u, w) for u, w in weights.items()], "user long, weights array<double>")
    events = spark.createDataFrame([(*r, k) for k, r in enumerate(reactions)], "user long, item string, reaction string, seq long").withColumn("at", F.timestamp_seconds("seq"))
    return preference.states(users, events, pool.recent(events), spark.createDataFrame(shown, "user long, item string"))


def plain_items():
    return [(f"i{k}", chr(97 + k) + chr(107 + k), [0.1 + 0.1 * k, *[0.5] * 12], f"s{k}", k, k, k, k) for k in range(8)]


def test_items_never_shown_are_chosen_and_shown_ones_only_lowered(spark):
    items = spark.createDataFrame(plain_items(), ITEMS)
    users = state(spark, {1: [3.0, *[0.0] * 12], 2: [0.0] * 13}, [(1, "i7", "love")], [(1, "i0")])
    found = {r.user: r for r in selection.next_items(items, users).collect()}
    assert found[1].item == "i6"  # the best of those without a reaction; never shown
    assert found[2].item == "i0" and found[2].score == pytest.approx(0.5 * 0.75 + 0.25)  # without any event
    batch = selection.batches_of_all(items, users, 8).where("user = '1'").orderBy("place").collect()
    assert [r.item for r in batch][0] == "i7" and {r.item for r in batch} == {f"i{k}" for k in range(8)}


def test_fits_and_reasons_are_of_every_pair(spark):
    items = spark.createDataFrame(plain_items(), ITEMS).select("item", "features")
    users = spark.createDataFrame([(1, [3.0, *[0.0] * 12]), (2, [0.0] * 13)], "user long, weights array<double>")
    signals = spark.createDataFrame([(1, "i2", -1.0)], "user long, item string, signal double")
    found = {(r.user, r.item): r.fit for r in preference.fits(users, items, signals).collect()}
    assert len(found) == 16 and found[2, "i3"] == 0.5
    x = np.array([0.1 + 0.1 * k for k in range(8)])
    assert np.allclose([found[1, f"i{k}"] for k in range(8)], 1 / (1 + np.exp(-3 * (x - 0.5) + 1.25 * (np.arange(8) == 2))))
    told = {(r.user, r.item): r.reasons for r in preference.reasons(users, items, None, list("abcdefghijklm")).collect()}
    assert len(told) == 16 and told[1, "i7"] == ["a"] and told[1, "i0"] == []


def test_the_bonus_of_a_diverse_step_counts_a_new_style(spark):
    rows = [(f"i{k}", chr(97 + k) + chr(107 + k), [0.5] * 13, f"s{k}", k, 0, "c", style) for k, style in enumerate((0, 0, 0, 1))]
    users = state(spark, {1: [0.0] * 13}, [(1, "i0", "skip"), (1, "i1", "skip")], [])
    (r,) = selection.next_items(spark.createDataFrame(rows, ITEMS.replace("category int", "category string")), users).collect()
    # relation and category are known, so only the style tells i3 from i2
    assert (r.mode, r.item) == ("diverse", "i3") and r.score == pytest.approx(0.5 * 0.75 + (1 - 0.55) * 0.25 + 0.18)


@needs_tables
def test_fit_agrees_with_its_sql_and_covers_all_pairs(spark):
    _, rows = compare.rows_of(catalog.queries()["fit"], spark)
    _, part = compare.rows_of_sql(catalog.oracle_sql()["fit"])
    assert part == rows
    con = duckdb.connect()
    users, items = (con.sql(f"select count(distinct {c}) from '{compare.SF}/{t}.parquet'").fetchall()[0][0] for t, c in (("events", "user_id"), ("embeddings", "vec_id")))
    assert len(rows) == users * items


@needs_tables
def test_the_next_item_equals_the_sql_over_the_whole_pool(spark):
    assert compare.rows_of(catalog.queries()["adaptive_next"], spark) == compare.rows_of_sql(catalog.oracle_sql()["adaptive_next"])


@needs_tables
def test_reasons_equal_their_sql_over_all_pairs(spark):
    assert compare.rows_of(catalog.queries()["reasons"], spark) == compare.rows_of_sql(catalog.oracle_sql()["reasons"])
