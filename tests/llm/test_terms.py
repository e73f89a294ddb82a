import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from inkstrata.llm import terms

SCHEMA = "id string, normalized_text string, term string, mark string"


def frequencies(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return {r.term: r for r in terms.term_frequencies(df, "id", "normalized_text", **how).collect()}


def test_counts_and_marks(spark):
    rows = [("a", "玉玉石"), ("b", "玉石"), ("c", "玉"), ("d", "石abc"), ("e", None), ("f", ""), ("a", "玉玉石")]
    found = frequencies(spark, rows, common_share=0.4)
    assert (found["玉"].occurrences, found["玉"].records, found["玉"].total_records, found["玉"].mark) == (4, 3, 6, "common")
    assert (found["石"].records, found["石"].mark) == (3, "common")
    assert set(found) == {"玉", "石"}


def test_limits_are_inclusive_and_exclusive(spark):
    rows = [(str(i), "甲" if i < 2 else "乙" if i < 5 else "丙") for i in range(20)]
    found = frequencies(spark, rows, common_share=0.15)
    assert found["甲"].mark == "rare" and found["乙"].mark is None and found["丙"].mark == "common"


def test_astral_ideographs_long_texts_and_null_ids(spark):
    found = frequencies(spark, [("a", "𠀀" * 100_000), (None, "玉")])
    assert found["𠀀"].occurrences == 100_000 and "玉" not in found


def test_empty_table(spark):
    assert frequencies(spark, []) == {}


def test_more_records_than_a_container_holds(spark):
    df = spark.range(150_000).selectExpr("cast(id as string) as id", "if(id % 3 = 0, '玉', '石') as normalized_text").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        found = {r.term: r.records for r in terms.term_frequencies(df, "id", "normalized_text").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found == {"玉": 50_000, "石": 100_000}


@given(st.lists(st.sets(st.integers(0, 65_535), max_size=300), min_size=1, max_size=4))
def test_containers_round_trip_and_unite(sets):
    packed = [terms.pack(np.array(sorted(s), np.int64)) for s in sets]
    assert [set(terms.unpack(p).tolist()) for p in packed] == sets
    assert terms.cardinality(terms.union(packed)) == len(set().union(*sets))


@pytest.mark.parametrize("n", [4096, 4097, 65_536])
def test_dense_containers(n):
    packed = terms.pack(np.arange(n))
    assert terms.cardinality(packed) == n and len(packed) <= 8193


def test_a_container_holds_records_of_several_tasks(spark):
    df = spark.createDataFrame([(str(i), "玉") for i in range(400)] * 2, "id string, normalized_text string")
    parts = terms.term_bitmaps(df, "id", "normalized_text").where("term is not null").collect()
    assert len(parts) == 4 and {r.container for r in parts} == {0}
    assert terms.cardinality(terms.union([bytes(r.bitmap) for r in parts])) == 400
    assert {r.term: (r.records, r.occurrences) for r in terms.term_frequencies(df, "id", "normalized_text").collect()} == {"玉": (400, 400)}
