"""Data-quality gates: violation rows, reports with zero-filled domains, citation checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The closed domains of the report.
CATEGORIES = ("经", "史", "子", "集", "字书")
STATUSES = ("planned", "source-reviewed", "ready")
_ID = r"^[a-z0-9]+(-[a-z0-9]+)*$"
_URL = r"^https://\S+$"


def _blank(column: str) -> Column:
    return F.coalesce(F.regexp_replace(column, r"(?U)\s+", ""), F.lit("")) == ""


def _https(column: str) -> Column:
    return F.coalesce(F.col(column).rlike(_URL), F.lit(False))


def _violations(df: DataFrame, target: str, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """One pass over a table: a row ``code, target_id, severity`` for every rule a row breaks."""
    broken = F.array_compact(F.array(*[F.when(rule, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, severity, rule in rules]))
    return df.select(F.col(target).alias("target_id"), F.explode(broken).alias("v")).select("v.code", "target_id", "v.severity")


def issues(books: DataFrame, passages: DataFrame) -> DataFrame:
    """``code, target_id, severity``, distinct. ``passages`` may hold a passage several times; that is an issue of its own."""
    complete = _https("source.originUrl") & ~_blank("source.editionNote") & ~_blank("source.rightsNote") & F.coalesce(F.col("source.retrievedAt").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False))
    has_source = F.col("source").isNotNull()
    of_books = _violations(books, "id", [
        ("INVALID_BOOK_ID", "error", ~F.col("id").rlike(_ID)),
        ("EMPTY_BOOK_TITLE", "error", _blank("title")),
        ("PLANNED_BOOK_SOURCE_PENDING", "warning", (F.col("status") == "planned") & ~has_source),
        ("READY_BOOK_MISSING_SOURCE", "error", (F.col("status") == "ready") & ~(has_source & complete)),
        ("REVIEWED_BOOK_MISSING_SOURCE", "error", ~F.col("status").isin("planned", "ready") & ~(has_source & complete)),
    ])
    twice = lambda df, code: df.groupBy(F.col("id").alias("target_id")).count().where("count > 1").select(F.lit(code).alias("code"), "target_id", F.lit("error").alias("severity"))
    shelf = books.groupBy(F.col("id").alias("book_id")).agg(F.max("source.originUrl").alias("origin"), F.lit(True).alias("known"))
    joined = passages.join(shelf, "book_id", "left")
    of_passages = _violations(joined, "id", [
        ("UNKNOWN_PASSAGE_BOOK", "error", F.col("known").isNull()),
        ("EMPTY_NORMALIZED_TEXT", "error", _blank("normalized_text")),
        ("PASSAGE_MISSING_SOURCE_URL", "error", ~_https("source_url")),
        ("PASSAGE_MISSING_VERIFICATION_URL", "error", ~_https("verification_url")),
        ("PASSAGE_SOURCE_MISMATCH", "error", F.col("origin").isNotNull() & ~F.col("source_url").eqNullSafe(F.col("origin"))),
    ])
    empty = books.where("status = 'ready'").join(passages.select(F.col("book_id").alias("id")), "id", "left_anti").select(F.lit("READY_BOOK_WITHOUT_PASSAGES").alias("code"), F.col("id").alias("target_id"), F.lit("error").alias("severity"))
    parts = [of_books, twice(books, "DUPLICATE_BOOK_ID"), of_passages, empty, twice(passages, "DUPLICATE_PASSAGE_ID")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def report(books: DataFrame, passages: DataFrame) -> DataFrame:
    """``measure, key, value``: totals, and counts by category and status with zeros for absent members of the domains."""
    totals = passages.agg(F.count("*").alias("passages"), F.coalesce(F.sum(F.char_length("normalized_text")), F.lit(0)).alias("characters"))
    sums = books.agg(F.count("*").alias("books"), *[F.count_if(F.col("category") == c).alias(f"category:{c}") for c in CATEGORIES], *[F.count_if(F.col("status") == s).alias(f"status:{s}") for s in STATUSES])
    long = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(f"`{c}`").cast("bigint").alias("value")) for c in df.columns])).alias("r")).select("r.*")
    both = long(totals).unionByName(long(sums))
    return both.select(F.when(F.col("k").contains(":"), F.substring_index("k", ":", 1)).otherwise("total").alias("measure"), F.substring_index("k", ":", -1).alias("key"), "value")


def coverage(books: DataFrame) -> DataFrame:
    return books.agg(F.count("*").alias("books"), F.count_if(F.col("status") == "ready").alias("ready_books"))


def citation_issues(candidates: DataFrame, passages: DataFrame) -> DataFrame:
    """``code, target_id`` of candidates whose citation doesn't match the corpus: missing passage, other fields, characters not in the quote."""
    fields = ("book_id", "work_title", "chapter_title", "source_url", "verification_url")
    known = passages.select(F.col("id").alias("passage_id"), F.col("text").alias("p_text"), *[F.col(f).alias(f"p_{f}") for f in fields])
    joined = candidates.join(known, "passage_id", "left")
    rules = [("CITATION_PASSAGE_MISSING", "error", F.col("p_text").isNull()), ("CITATION_QUOTE_NOT_IN_PASSAGE", "error", F.col("p_text").isNotNull() & (F.coalesce(F.instr("p_text", F.col("quote")), F.lit(0)) == 0))]
    rules += [(f"CITATION_{f.upper()}_DIFFERS", "error", F.col("p_text").isNotNull() & ~F.col(f).eqNullSafe(F.col(f"p_{f}"))) for f in fields]
    missing = F.exists(F.split("given_name", ""), lambda c: F.coalesce(F.instr(F.col("quote"), c), F.lit(0)) == 0)
    rules.append(("CITATION_CHARACTER_NOT_IN_QUOTE", "error", missing))
    return _violations(joined, "id", rules).select("code", "target_id")


def name_validation(units: DataFrame, fragments: DataFrame, candidates: DataFrame, least_units: int = 145) -> DataFrame:
    """``code, target_id`` of a hand-kept data set: duplicate units and names, too few units, missing fields, scores out of [0, 5]."""
    twice = units.groupBy("unit").count().where("count > 1").select(F.lit("DUPLICATE_UNIT").alias("code"), F.col("unit").alias("target_id"))
    few = units.agg(F.countDistinct("unit").alias("n")).where(F.col("n") < least_units).select(F.lit("TOO_FEW_UNITS").alias("code"), F.col("n").cast("string").alias("target_id"))
    lacking = _violations(fragments, "id", [("FRAGMENT_FIELD_MISSING", "error", _blank("quote") | _blank("work_title"))]).select("code", "target_id")
    names = candidates.groupBy("given_name").count().where("count > 1").select(F.lit("DUPLICATE_NAME").alias("code"), F.col("given_name").alias("target_id"))
    scores = [F.coalesce(~F.col(c).between(0, 5), F.lit(False)) for c in ("feminine", "rarity", "usability", "family_score")]
    bounds = _violations(candidates, "id", [("SCORE_OUT_OF_RANGE", "error", scores[0] | scores[1] | scores[2] | scores[3])]).select("code", "target_id")
    return twice.unionByName(few).unionByName(lacking).unionByName(names).unionByName(bounds)
