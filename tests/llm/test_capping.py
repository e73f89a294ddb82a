import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from inkstrata.llm import capping

SCHEMA = "id string, book_id string, score double, owner string, kept int, n int"


def capped(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    return {r.id: r for r in capping.capped(df, "id", "book_id", "score", **how).collect()}


def test_the_best_stay(spark):
    rows = [(f"a{i}", " Book ", float(i)) for i in range(6)] + [("b1", "other", 1.0), ("a6", "book", None), ("a7", "BOOK", float("nan")), ("z", None, 99.0), (None, "book", 99.0), ("a5", "book", 5.0)]
    found = capped(spark, rows, share=0.25)  # nine take part, two stay of each
    assert {i for i, r in found.items() if r.kept} == {"a5", "a4", "b1"} and len(found) == 9
    assert found["a6"].place == 7 and found["a7"].place == 8


def test_ties_go_by_id(spark):
    found = capped(spark, [(x, "b", 1.0) for x in "dbca"], share=None, most=2)
    assert {i for i, r in found.items() if r.kept} == {"a", "b"}


def test_a_contributor_with_most_rows(spark):
    df = spark.range(20_000).selectExpr("cast(id as string) id", "if(id % 3 = 0, concat('o', id % 50), 'hot') book_id", "cast(id % 977 as double) score")
    found = capping.capped(df, "id", "book_id", "score", share=0.1)
    assert {r["count"] for r in found.where("kept and owner = 'hot'").groupBy("owner").count().collect()} == {2000}
    hot = sorted(((-(i % 977), str(i)) for i in range(20_000) if i % 3), key=lambda x: x)
    assert {r.id for r in found.where("kept and owner = 'hot'").collect()} == {i for _, i in hot[:2000]}


def test_empty_tables(spark):
    assert capped(spark, []) == {}
    assert capped(spark, [("a", None, 1.0)]) == {}


def test_share_of_the_output(spark):
    rows = [(f"{b}{i}", b, float(i)) for b, n in (("x", 50), ("y", 10), ("z", 10)) for i in range(n)]
    kept = [r.owner for r in capped(spark, rows, share=0.4, basis="output").values() if r.kept]
    assert max(kept.count(o) for o in "xyz") <= 0.4 * len(kept) and kept.count("x") == 13


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=12), st.sampled_from([0.05, 0.1, 0.25, 0.34, 0.5, 0.9, 1.0]), st.sampled_from([None, 1, 7]), st.booleans())
def test_water_level_is_the_last_that_fits(counts, share, most, fixed):
    base = lambda c: sum(counts) if fixed else sum(min(n, c) for n in counts)
    fits = [c for c in range(1, min(max(counts), most or 99) + 1) if c <= share * base(c) + 1e-9]
    values, owners = np.unique(counts, return_counts=True)
    assert capping.water_level(values, owners, share, most, sum(counts) if fixed else None) == max(fits, default=0)


def test_a_share_that_too_few_owners_can_keep_leaves_nothing(spark):
    found = capped(spark, [("a", "x", 1.0), ("b", "y", 2.0), ("c", "z", 3.0)], share=0.02, basis="output")
    assert len(found) == 3 and not any(r.kept for r in found.values())
