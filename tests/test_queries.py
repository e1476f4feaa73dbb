"""A sample of registered queries beside their oracle SQL; all of them with ALL_QUERIES=1."""

import os

import pytest

from workload.check import compare, oracle

SF = "/root/testdata/sf0.001"
SAMPLE = ("domain_flags", "skill_depth_rows", "career_rows", "education_rows", "quarantine", "topk_per_job", "section_lists")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def names():
    from __spark_entry__ import oracle_sql
    return sorted(oracle_sql()) if os.environ.get("ALL_QUERIES") else SAMPLE


@pytest.mark.parametrize("name", names())
def test_against_sql(spark, name):
    from __spark_entry__ import oracle_sql, queries
    got = queries()[name](spark, SF).toPandas()
    assert compare(got, oracle(SF).execute(oracle_sql()[name]).df()) == ""


def test_entry_and_registry(spark):
    from __spark_entry__ import entry, oracle_sql, queries
    assert set(oracle_sql()) <= set(queries())
    assert entry(spark).count() > 0
