"""The queries over the operators for training data, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstrata.session import table

from . import capping, encoding, leakage, lookalikes, ranking, sentences, spans, splitting, terms


def p1_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.term_frequencies(table(spark, sf_dir, "corpus_passages"), "id", "normalized_text")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_terms(spark, sf_dir).where("mark is not null").select("term", "mark")


def p2_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    passages = table(spark, sf_dir, "corpus_passages")
    formed = lookalikes.canonical(passages, ["id"], ["text", "normalized_text"])
    return formed.distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.lookalike_pairs(table(spark, sf_dir, "corpus_passages"), "id", "text", "normalized_text")


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.lookalike_classes(table(spark, sf_dir, "corpus_passages"), "id", "text", "normalized_text")


def p3_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_spans(table(spark, sf_dir, "corpus_passages"), "id", "book_id", "normalized_text")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_pairs(table(spark, sf_dir, "corpus_passages"), "id", "book_id", "normalized_text")


def p4_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = table(spark, sf_dir, "name_candidates")
    names = candidates.select(F.explode(F.array("given_name", "full_name")).alias("name"), F.col("given_name").alias("item"))
    votes = ranking.comparisons(table(spark, sf_dir, "pairwise_feedback"), "feedback_id", "left_name", "right_name", "choice", names)
    return ranking.rank_items(votes, candidates.select(F.col("given_name").alias("item")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = p4_ranking(spark, sf_dir)
    tenth = table(spark, sf_dir, "name_candidates").select("given_name").where("given_name is not null").distinct().count() // 10
    return ranked.where(F.col("position") <= tenth).select(F.col("item").alias("given_name"))


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf_dir, "corpus_passages"), "id", "chapter_title", "text")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_pieces(spark, sf_dir).where("piece = 0").select("id", "kind")


def p6_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capping.capped(table(spark, sf_dir, "factory_passages"), "id", "book_id", "score", share=0.02)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_selection(spark, sf_dir).where("not kept").select("id")


def p6_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No book has more than a tenth of what is kept."""
    return capping.capped(table(spark, sf_dir, "factory_passages"), "id", "book_id", "score", share=0.1, basis="output")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode(table(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), "ids")


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_spans(spark, sf_dir).select("item_id", "doc_id").distinct()


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


QUERIES = (p1_found, p1_terms, p2_found, p2_canonical, p2_classes, p3_found, p3_shared, p4_found, p4_ranking, p5_found, p5_pieces, p6_found, p6_selection, p6_water, p7_ids, p8_found, p8_spans, p9_found)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


_TERMS = r"""
with once as (select id, max(normalized_text) as t from corpus_passages where id is not null group by id),
n as (select count(*) as total from once),
c as (select id, unnest(regexp_extract_all(t, '[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{20000}-\x{2A6DF}]')) as term from once),
f as (select term, count(*) as occurrences, count(distinct id) as records from c group by term)
select term, occurrences, records, total as total_records,
  case when records <= 2 then 'rare' when records > 0.15 * total then 'common' end as mark from f, n
"""

_SPANS = """
with p as (select id, book_id, normalized_text as t from corpus_passages where length(normalized_text) >= 24 group by all),
w as (select id, book_id, t[i : i + 23] as s from (select *, unnest(range(1, length(t) - 22)) as i from p))
select distinct a.id as id_a, b.id as id_b from w a join w b on a.s = b.s and a.id < b.id and a.book_id <> b.book_id
"""

_PIECES = r"""
with p as (select id, max({'text': text, 'chapter_title': chapter_title}) as r from corpus_passages
  where coalesce(length(chapter_title), 0) + length(text) > 240 group by id),
s as (select id, coalesce(length(r.chapter_title), 0) as t,
  regexp_replace(replace(r.text, chr(10), chr(10) || chr(1)), '([。！？!?；;][」』”’）)】〕]*)', '\1' || chr(1), 'g') as x from p)
select id, case when list_max(list_transform(string_split(x, chr(1)), lambda v: length(v))) > 240 - t then 'forced' else 'natural' end as kind from s
"""

_CAPPED = r"""
with r as (select id, max(score) as score, lower(regexp_replace(max(book_id), '^\s+|\s+$', '', 'g')) as owner from factory_passages
  where book_id is not null group by id),
n as (select floor(0.02 * count(*)) as cap from r)
select id, owner, score, row_number() over (partition by owner order by score desc nulls last, id) as place,
  row_number() over (partition by owner order by score desc nulls last, id) <= cap as kept from r, n
"""

_WATER = r"""
with r as (select id, max(score) as score, lower(regexp_replace(max(book_id), '^\s+|\s+$', '', 'g')) as owner from factory_passages
  where book_id is not null group by id),
n as (select owner, count(*) as n from r group by owner),
c as (select unnest(range(1, (select max(n) from n) + 1)) as cap),
k as (select cap, sum(least(n, cap)) as kept from c, n group by cap),
w as (select coalesce(max(cap), 0) as cap from k where cap <= 0.1 * kept)
select id, owner, score, row_number() over (partition by owner order by score desc nulls last, id) as place,
  row_number() over (partition by owner order by score desc nulls last, id) <= cap as kept from r, w
"""

_LEAKS = r"""
with d as (select doc_id, lower(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) as t from documents),
e as (select item_id, lower(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) as t from eval_items),
dw as (select doc_id, t[i : i + 39] as s from (select *, unnest(range(1, length(t) - 38)) as i from d where length(t) >= 40)),
ew as (select distinct item_id, t[i : i + 39] as s from (select *, unnest(range(1, length(t) - 38)) as i from e where length(t) >= 40))
select distinct item_id, doc_id from dw join ew using (s)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_terms": _TERMS,
        "p1_found": f"select term, mark from ({_TERMS}) where mark is not null",
        "p3_found": _SPANS,
        "p5_found": _PIECES,
        "p6_selection": _CAPPED,
        "p6_found": f"select id from ({_CAPPED}) where not kept",
        "p6_water": _WATER,
        "p8_found": _LEAKS,
    }
