import os

import pytest

import __spark_entry__ as entry
from rowproof.plans.compare import differences

FOLDER = "/root/testdata/sf0.001"
# four steps of 40 vendors each: more than the smallest folder has
LARGER = "/root/testdata/sf0.01"
PLANNED = {"inject_vendors", "inject_transactions", "defect_labels", "baseline_metrics"}
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


def test_every_text_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


@needs_data
def test_entry_is_the_ranked_findings(spark):
    assert entry.entry(spark).columns[0] == "target_table"


@needs_data
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    folder = LARGER if name in PLANNED else FOLDER
    assert differences(spark, folder, QUERIES[name], SQL[name]) == []


@needs_data
@pytest.mark.parametrize("name", ["profile_approximate", "iforest_scores", "file_integrity", "rerank_model"])
def test_queries_without_sql_return_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).limit(5).count() == 5
