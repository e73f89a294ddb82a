"""Candidates, sources and reviews: small cases, and the queries against their SQL."""

import os

import compare
import pytest
from pyspark.sql import functions as F

from inkstrata.operators import candidates as C
from inkstrata.operators import pool, preference
from inkstrata.plans import catalog

needs_tables = pytest.mark.skipif(not os.path.isdir(compare.SF), reason="needs the test tables")
CHOSEN = "discovery_views curated_views allusion_browse features_seed features_reviewed adjusted_fit rerank family_proxy pointer_relations proposal_issues review_join in_several merge_by_score calibration_batches profile_shortlist undo_order undo_exposure list_states".split()


@needs_tables
@pytest.mark.parametrize("name", CHOSEN)
def test_queries_equal_their_sql(spark, name):
    assert compare.rows_of(catalog.queries()[name], spark) == compare.rows_of_sql(catalog.oracle_sql()[name])


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("fit,blocked,born,weight,score,expected", [
    (0.72, False, True, 0.9, 100.0, (0.1, 0.748, "recorded")), (0.72, True, True, 0.9, 100.0, (0.0, None, "blocked")), (0.72, False, False, 0.9, 100.0, (0.0, 0.72, "not yet born")),
    (1.4, False, True, -1.0, None, (0.0, 1.0, "no score")), (0.5, False, True, 0.05, 250.0, (0.05, 0.525, "recorded")),
])
def test_a_second_score_adjusts_the_fit(spark, fit, blocked, born, weight, score, expected):
    found = one(spark, C.adjusted(F.col("fit"), F.col("blocked"), F.col("born"), F.col("weight"), F.col("score").cast("double")), fit=fit, blocked=blocked, born=born, weight=weight, score=score)
    assert (found.weight, found.adjusted, found.status) == expected


def test_features_of_mined_seed_and_reviewed_candidates(spark):
    rows = spark.createDataFrame([("a", "A", 4.0, 3.0, 5.0, 1.0), ("b", "B", None, float("nan"), 9.0, 7.0)], "given_name string, grade string, feminine double, rarity double, usability double, family_score double")
    found = {r.item: r.features for r in pool.features(rows).collect()}
    assert found["a"] == pytest.approx([0.9, 0.8, 0.71, 0.7, 0.55, 0.15, 0.5, 1, 1, 0.6, 0.5, 1, 0])
    assert found["b"] == pytest.approx([0.9, 0, 0, 1, 0, 0.15, 0.5, 1, 1, 0, 1, 0.35, 0])
    seed = one(spark, C.seed_features(F.col("s"), F.col("g"), F.col("r"), F.col("n")), s="modern", g="C", r="多音，重名", n="無直接")
    assert seed == pytest.approx([0.55, 0.45, 0.4, 0.35, 0.35, 0.9, 0.55, 0.9, 0.9, 0.3, 0.1, 0.25, 1.0])
    scores = dict(femininity=F.lit(1.0), feel=F.lit(0.5), distinctiveness=F.lit(0.2), phonology=F.lit(2.0), usability=F.lit(0.4))
    told = one(spark, C.reviewed_features(F.col("s"), F.col("r"), scores, F.col("n")), s="gentle", r="passage-related", n=" ")
    assert told == pytest.approx([0.92, 0.68, 0.95, 0.5, 0.37, 0.18, 1, 0.4, 0.4, 0.2, 0.08, 0.28, 0.72])


def test_styles_kinds_and_worth(spark):
    assert one(spark, C.style_of(F.col("f"), F.col("r"), F.col("u")), f=4.2, r=4.0, u=5.0) == "graceful" and one(spark, C.style_of(F.col("f"), F.col("r"), F.col("u")), f=4.9, r=4.1, u=5.0) == "austere"
    assert one(spark, C.risk_kind(F.col("t")), t="读音与原典") == "source-context" and one(spark, C.risk_kind(F.col("t")), t="人物读音") == "pronunciation" and one(spark, C.risk_kind(F.col("t")), t="") == "source-context"
    assert one(spark, C.family_worth([F.col("t"), F.col("t")], [F.col("u"), F.col("v")]), t="玉", u="玉", v="韶") == 5.0 and one(spark, C.family_worth([F.lit("绍")], [F.col("u")]), u="韶") == 3.0


def test_curated_rows_take_the_place_of_mined_ones(spark):
    make = lambda rows: spark.createDataFrame(rows, "name string, id string, grade string")
    found = {r.name: (r.origin, r.id) for r in C.united(make([("a", "1", "B"), ("a", "2", "B"), ("b", "3", "A")]), make([("a", "0", "A"), ("c", "9", "A")])).collect()}
    assert found == {"a": ("curated", "0"), "b": ("corpus", "3"), "c": ("curated", "9")}
    assert C.united(make([]), make([])).collect() == []


def test_reviews_and_gates(spark):
    items = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    reviews = spark.createDataFrame([("a", 1, "reject"), ("a", 2, "approve"), ("b", 1, "manual-review"), ("c", 1, None), ("z", 1, "approve")], "id string, seq int, decision string")
    assert {r.id: (r.status, r.reason) for r in C.reviewed(items, reviews).collect()} == {"a": ("approved", None), "b": ("manual-review", None), "c": ("rejected", "not approved"), "d": ("rejected", "no review")}
    names = lambda x: spark.createDataFrame([(c,) for c in x], "name string")
    assert [(r.name, r.artifacts) for r in C.in_several({"x": names("aab"), "y": names("bc")}).collect()] == [("b", "x,y")]
    books, sources = spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("a", "o")], "id string, origin string")
    assert C.with_source(books.where("id = 'a'"), sources).first().origin == "o"
    with pytest.raises(Exception, match="no source: b"):
        C.with_source(books, sources).collect()


def test_an_undo_takes_its_reaction_back(spark):
    rows = [(1, "i", "love", 1), (1, "i", "undo", 2), (1, "j", "like", 3), (1, "j", "dislike", 4), (1, "k", "undo", 5), (1, "i", "like", 6), (1, "i", "undo", 7), (1, "i", "undo", 8)]
    events = spark.createDataFrame(rows, "user long, item string, reaction string, seq long").withColumn("at", F.timestamp_seconds("seq"))
    features = spark.createDataFrame([(x, [0.9, 0.1]) for x in "ijk"], "item string, features array<double>")
    weights = preference.reaction_weights(events, features, 2).first().weights
    assert weights == pytest.approx([-0.22, 0.22])  # as if only the dislike of j had been
    assert [(r.item, r.seq) for r in preference.reacted_in_order(events).collect()] == [("j", 3)]
    shown = spark.createDataFrame([(1, "k")], "user long, item string")
    assert {r.item: r.shown for r in preference.exposure_counts(shown, events).collect()} == {"j": 2, "k": 1}
    assert [tuple(r) for r in preference.disliked(spark.createDataFrame([("p", "a", "b", "both-dislike")] * 2 + [("p", "a", "c", "left")], "profile string, left string, right string, choice string")).orderBy("item").collect()] == [("p", "a", -0.75), ("p", "b", -0.75)]


def test_lists_exclude_each_other_and_are_capped(spark):
    rows = [("a", "favourite"), ("b", "favourite"), *[(x, "compare") for x in "abcde"], ("a", "reject"), ("e", "compare"), ("b", "favourite")]
    events = spark.createDataFrame([(1, i, kind, k) for k, (i, kind) in enumerate(rows)], "user long, item string, list string, seq long").withColumn("at", F.timestamp_seconds("seq"))
    (r,) = preference.list_states(events).collect()
    assert (r.favourites, r.rejected, r.compared) == ([], ["a"], ["b", "c", "d", "e"])
    assert r.explicit == ["a=-1", "c=0.25", "d=0.25", "e=0.25"]
    assert preference.list_states(events.limit(0)).collect() == []
