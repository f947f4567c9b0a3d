import pytest
from conftest import DATA, same_as_sql

from lodestone.llm import registry

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")


@pytest.mark.parametrize("name", list(registry.ORACLE))
def test_query_equals_its_sql(spark, name):
    same_as_sql(spark, [name], registry.QUERIES, registry.ORACLE)


COLUMNS = {"p1_found": ["doc_id"], "p2_found": ["doc_id"], "p3_found": ["doc_id_a", "doc_id_b"], "p6_found": ["doc_id", "term"], "p7_found": ["term"], "p10_found": ["doc_id"]}


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in registry.ORACLE])
def test_other_queries_run(spark, name):
    df = registry.QUERIES[name](spark, str(DATA))
    assert df.count() > 0 and df.columns == COLUMNS.get(name, df.columns)
