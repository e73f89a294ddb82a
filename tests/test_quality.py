from inkstrata.operators import quality

from test_search import _SOURCE, corpus


def test_a_clean_corpus_has_no_errors(spark):
    passages, books = corpus(spark)
    assert quality.issues(books, passages).collect() == []


def test_every_rule(spark):
    good = ("https://a", "e", "r", "2026-01-01", None, "punctuated")
    books = spark.createDataFrame(
        [("Bad Id", "t", "经", "x", 1, "planned", None), ("b-1", " ", "史", "x", 1, "ready", ("http://a", "e", "r", "2026-01-01", None, None)), ("b-2", "t", "子", "x", 1, "source-reviewed", None), ("b-3", "t", "集", "x", 1, "ready", good), ("b-4", "t", "集", "x", 1, "ready", good), ("b-4", "t", "集", "x", 1, "ready", good)],
        f"id string, title string, category string, period string, priority int, status string, source {_SOURCE}",
    )
    passages = spark.createDataFrame(
        [("p1", "nope", "x", "https://a", "https://b"), ("p2", "b-3", None, "https://other", None), ("p2", "b-3", "x", "https://a", "https://b"), ("p3", "b-1", "x", "", "https://b"), ("p4", "b-4", "x", "https://a", "https://b")],
        "id string, book_id string, normalized_text string, source_url string, verification_url string",
    )
    found = {(r.code, r.target_id, r.severity) for r in quality.issues(books, passages).collect()}
    want = {
        ("INVALID_BOOK_ID", "Bad Id"), ("EMPTY_BOOK_TITLE", "b-1"), ("READY_BOOK_MISSING_SOURCE", "b-1"), ("REVIEWED_BOOK_MISSING_SOURCE", "b-2"), ("DUPLICATE_BOOK_ID", "b-4"),
        ("UNKNOWN_PASSAGE_BOOK", "p1"), ("EMPTY_NORMALIZED_TEXT", "p2"), ("PASSAGE_MISSING_VERIFICATION_URL", "p2"), ("PASSAGE_SOURCE_MISMATCH", "p2"), ("PASSAGE_MISSING_SOURCE_URL", "p3"), ("PASSAGE_SOURCE_MISMATCH", "p3"), ("DUPLICATE_PASSAGE_ID", "p2"),
    }
    assert found == {(*w, "error") for w in want} | {("PLANNED_BOOK_SOURCE_PENDING", "Bad Id", "warning")}
    empty = quality.issues(books, passages.limit(0))
    assert {r.target_id for r in empty.where("code = 'READY_BOOK_WITHOUT_PASSAGES'").collect()} == {"b-1", "b-3", "b-4"}


def test_the_report_fills_its_domains_with_zeros(spark):
    passages, books = corpus(spark)
    found = {(r.measure, r.key): r.value for r in quality.report(books, passages).collect()}
    assert found["total", "passages"] == 9 and found["category", "经"] == 2 and found["category", "史"] == 0 and found["status", "planned"] == 0
    assert found["total", "characters"] == sum(len(r.normalized_text) for r in passages.collect())
