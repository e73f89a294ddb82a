"""Factory passages without a book: in everything that doesn't go by book."""

import os

import compare
import pytest
from pyspark.sql import functions as F

from inkstrata.plans import catalog

pytestmark = pytest.mark.skipif(not os.path.isdir(compare.SF), reason="needs the test tables")


@pytest.mark.parametrize("name", ["clause_offsets", "windows", "nameability", "source_filter"])
def test_passages_without_a_book_take_part(spark, name):
    assert compare.rows_of(catalog.queries()[name], spark) == compare.rows_of_sql(catalog.oracle_sql()[name])


def test_a_selection_by_book_leaves_them_out(spark):
    t = catalog.Tables(spark, compare.SF)
    assert t.factory.where("book_id is null").count() == t.factory_passages.where(F.col("book_id").isNull()).distinct().count() > 0
    assert catalog.queries()["passage_pool"](spark, compare.SF).where("book_id is null").count() == 0
