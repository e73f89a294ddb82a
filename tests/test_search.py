import pytest
from pyspark.sql import functions as F

from inkstrata.operators import index, mining, search

TEXTS = [("book-a", 1, ["令儀孔昭。", "令其儀。"]), ("book-a", 2, ["景行行止。", "如玉如圭。"]), ("book-a", 3, ["景星庆云。"]), ("book-a", 4, ["玉振金声。"]), ("book-a", 5, ["皎皎白驹。"]), ("book-b", 1, ["舒窈纠兮。"]), ("book-b", 2, ["怀瑾握玉。"])]
ALIASES = ("儀", "仪")
_SOURCE = "struct<originUrl:string,editionNote:string,rightsNote:string,retrievedAt:string,checksum:string,segmentation:string>"


def corpus(spark, segmentation="punctuated", texts=TEXTS):
    rows, ords = [], {}
    for book, work, lines in texts:
        for k, line in enumerate(lines, 1):
            ords[book] = ords.get(book, 0) + 1
            w = f"{book}/work-{work:04d}"
            plain = "".join(c for c in line.replace("儀", "仪") if c not in "。，")
            rows.append((f"{w}/passage-{k:04d}", book, w, f"{w}/c", "t", "c", ords[book], line, plain, "https://a", "https://b"))
    passages = spark.createDataFrame(rows, "id string, book_id string, work_id string, chapter_id string, work_title string, chapter_title string, ord int, text string, normalized_text string, source_url string, verification_url string")
    books = spark.createDataFrame([(b, b, "经", "x", 1, "ready", ("https://a", "e", "r", "2026-01-01", None, segmentation)) for b in ("book-a", "book-b")], f"id string, title string, category string, period string, priority int, status string, source {_SOURCE}")
    return passages, books


def run(spark, u1, u2=None, segmentation="punctuated"):
    passages, books = corpus(spark, segmentation)
    q = spark.createDataFrame([(u1 + (u2 or ""), u1, u2)], "query string, u1 string, u2 string")
    return search.search(q, passages, books, ALIASES).collect()


def test_adjacent_same_passage_and_same_work(spark):
    found = run(spark, "令", "仪")
    assert {r.grade for r in found} >= {"A", "B", "C"}
    assert [r.id_a for r in found if r.grade == "A"] == ["book-a/work-0001/passage-0001"]


def test_wider_scopes_and_single_units(spark):
    found = run(spark, "景", "玉")
    assert {r.grade for r in found} >= {"C", "D", "E", "F"}
    singles = {r.id_a for r in found if r.grade == "F"}
    assert "book-a/work-0003/passage-0001" in singles and "book-b/work-0002/passage-0001" in singles


def test_one_unit_gives_single_evidence_only(spark):
    assert {r.grade for r in run(spark, "皎")} == {"F"}


def test_unpunctuated_books_have_no_adjacent_evidence(spark):
    found = run(spark, "令", "仪", "unpunctuated")
    assert "A" not in {r.grade for r in found}
    assert "adjacent, not direct" in {r.kind for r in found}


def test_unknown_units_have_no_hit(spark):
    assert run(spark, "芷", "若") == []


def test_same_unit_twice(spark):
    assert {(r.grade, r.id_a) for r in run(spark, "行", "行")} == {("A", "book-a/work-0002/passage-0001")}


def test_postings_and_ordinals(spark):
    passages, _ = corpus(spark, texts=[("b", 1, ["高山仰止，景行行止。"])])
    posts = {r.unit: r.positions for r in index.postings(passages).collect()}
    assert posts["行"] == [5, 6] and posts["高"] == [0]
    passages, _ = corpus(spark)
    rows = sorted(index.ordinals(passages).collect(), key=lambda r: r.passage_ord)
    assert [r.passage_ord for r in rows] == list(range(9)) and rows[-1].work_ord == 6 and rows[-1].book_ord == 1
    again = sorted(index.ordinals(passages.orderBy(F.desc("id"))).collect(), key=lambda r: r.passage_ord)
    assert rows == again


@pytest.fixture(scope="module")
def units(spark):
    return spark.createDataFrame([(c, "x", 4.5, 3.5, 4.0, 0) for c in "令仪孔昭景玉成章"], "unit string, category string, feminine double, rarity double, usability double, family int")


def mined(spark, units, segmentation, texts):
    passages, books = corpus(spark, segmentation, texts)
    return {r.name: r for r in mining.best_evidence(mining.pairs(passages, books, units, ALIASES)).collect()}


def test_mining_grades(spark, units):
    found = mined(spark, units, "punctuated", [("book-a", 1, ["令儀孔昭。"])])
    assert found["令仪"].grade == "A" and found["令昭"].grade == "B"
    found = mined(spark, units, "unpunctuated", [("book-a", 1, ["景玉成章。"])])
    assert found["景玉"].grade == "B" and "景章" not in found and "A" not in {r.grade for r in found.values()}


def test_units_parted_by_punctuation_are_no_pair(spark, units):
    found = mined(spark, units, "punctuated", [("book-a", 1, ["景，玉。"])])
    assert found == {}


def test_the_shorter_passage_is_the_better_evidence(spark, units):
    texts = [("book-a", 1, ["令儀孔昭（注）（注）令。", "令儀。"])]
    assert mined(spark, units, "punctuated", texts)["令仪"].id == "book-a/work-0001/passage-0002"


def test_quota_backfills_from_the_other_grade(spark):
    rows = [(f"n{i:02d}", "A" if i < 2 else "B", float(100 - i), "p") for i in range(20)]
    pool = spark.createDataFrame(rows, "name string, grade string, score double, id string")
    found = mining.quota(pool, limit=8).orderBy("place").collect()
    assert len(found) == 8 and [r.name for r in found if r.grade == "A"] == ["n00", "n01"]
