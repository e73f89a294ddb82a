import pytest
from pyspark.sql import functions as F

from inkstrata.functions import text as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


def test_sentences_keep_their_mark_and_drop_blanks(spark):
    assert one(spark, " 高山仰止，景行行止。 四牡！？", T.split_sentences) == ["高山仰止，景行行止。", "四牡！"]
    assert one(spark, "", T.split_sentences) == []
    assert one(spark, None, T.split_sentences) is None


def test_clauses(spark):
    assert one(spark, "高山仰止，景行行止。", T.split_clauses) == ["高山仰止，", "景行行止。"]


def test_search_text_is_composed_simplified_han(spark):
    assert one(spark, "令儀孔昭。a1", lambda c: T.search_text(c, "儀", "仪")) == "令仪孔昭"
    assert one(spark, "が", lambda c: T.nfc(c)) == "が"


@pytest.mark.parametrize("char,bucket", [("景", "066"), ("𠀀", "200"), ("a", "000")])
def test_bucket(spark, char, bucket):
    assert one(spark, char, T.bucket_of) == bucket


@pytest.mark.parametrize("value,digits,want", [(1.005, 2, 1.0), (2.5, 0, 3.0), (-2.5, 0, -2.0), (0.15, 1, 0.2)])
def test_rounding_is_half_up_on_the_double(spark, value, digits, want):
    assert one(spark, value, lambda c: T.round_half_up(c, digits), "double") == want


def test_indexed_text_and_its_length(spark):
    for text in ("", "景", "景行行止" * 30):
        rendered = one(spark, text, T.indexed_text)
        assert rendered == " ".join(f"[{i}]{c}" for i, c in enumerate(text))
        assert one(spark, text, T.indexed_length) == len(rendered)


@pytest.mark.parametrize("query,want", [("岑令仪", "令仪"), ("令仪孔", "令仪"), ("岑", ""), ("岑岑a玉", "岑玉"), ("abc", ""), ("皎", "皎")])
def test_given_query(spark, query, want):
    assert one(spark, query, lambda c: T.given_query(c, "岑")) == want


def test_source_family(spark):
    assert one(spark, "楚辞《九歌·湘君》注", T.source_family) == "楚辞《九歌》"
    assert one(spark, "楚辞·九歌", T.source_family) == "楚辞·九歌"


def test_evidence_ranks_differ_in_weight(spark):
    row = spark.createDataFrame([("令(儀)孔昭", "令仪孔昭")], "t string, n string")
    assert row.select(T.evidence_rank(F.col("t"), F.col("n")), T.mining_penalty(F.col("t"), F.col("n"))).first() == (4 + 200 + 200, 4 + 160)
