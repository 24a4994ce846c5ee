"""Every registered query on the smallest tables next to its SQL."""

import pytest

import __spark_entry__ as catalogue
from check import difference, open_tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    with open_tables(SF) as opened:
        yield opened


@pytest.mark.parametrize("name", catalogue.oracle_sql())
def test_query_equals_its_sql(spark, connection, name):
    frame = catalogue.queries()[name](spark, SF)
    assert difference(frame, connection, catalogue.oracle_sql()[name]) is None


def test_entry(spark):
    row = catalogue.entry(spark).first()
    assert row["Model"] == "Logistic_Regression"
    assert row["Feature_Count"] == 21
    assert row["ROC_AUC"] > 0.9
