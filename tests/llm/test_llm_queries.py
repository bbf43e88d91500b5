import pytest
from compare import both

from fixity_spark.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    ours, theirs = both(spark, sf_dir, QUERIES[name], ORACLES[name])
    assert ours == theirs


def test_every_operator_has_a_query():
    assert sorted({int(n[2:].split("_")[0]) for n in QUERIES}) == list(range(1, 14))
