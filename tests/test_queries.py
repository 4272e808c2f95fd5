import os

import pytest
from oracle import TABLES, compare

import __spark_entry__
from gleanline.plans.queries import ORACLES, QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables here")


def test_queries_agree_with_sql(spark):
    assert compare(spark, QUERIES, ORACLES) == {}


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
