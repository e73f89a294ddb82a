import os

import compare
import pytest

from inkstrata.plans import catalog

pytestmark = pytest.mark.skipif(not os.path.isdir(compare.SF), reason="needs the test tables")
CHOSEN = "posting_build alias_pairs bucket_histogram sentence_split quality_issues corpus_report citation_verify pair_dedup allusion_pairs clause_offsets source_filter culture_score pointer_resolve curated_search exposure".split()


@pytest.mark.parametrize("name", CHOSEN)
def test_queries_equal_their_sql(spark, name):
    assert compare.rows_of(catalog.queries()[name], spark) == compare.rows_of_sql(catalog.oracle_sql()[name])


def test_every_sql_belongs_to_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_evidence_search_equals_brute_force_in_sql(spark):
    assert compare.rows_of(catalog.queries()["evidence_search"], spark) == compare.rows_of_sql(catalog.oracle_sql()["evidence_search"])
