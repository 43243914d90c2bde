import pytest
from conftest import against_sql

from voxloom.llm.oracle import ORACLE
from voxloom.llm.queries import QUERIES


@pytest.mark.parametrize("name", list(ORACLE))
def test_equals_sql(spark, sf_dir, name):
    got, want = against_sql(spark, sf_dir, QUERIES[name], ORACLE[name])
    assert got == want


@pytest.mark.parametrize("name, columns", [("p4_found", ["train_ord", "eval_ord"]), ("p5_found", ["ord"]), ("p6_ids", ["doc_id", "ids"]), ("p8_found", ["doc_a", "doc_b"])])
def test_columns_of_the_compared_queries(spark, sf_dir, name, columns):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns == columns and df.count() > 0
