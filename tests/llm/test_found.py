"""The pN_ queries with SQL give the same rows as their SQL; the others run and keep their columns."""

import pytest
from conftest import same

from siltstone.llm import queries

COLUMNS = {
    "p1_found": ["vec_a", "vec_b"], "p2_found": ["rec_a", "rec_b"], "p3_found": ["rec_id"], "p4_found": ["rec_id", "section_no"], "p5_found": ["term", "mark"],
    "p6_found": ["rec_id", "noise"], "p7_found": ["doc_id"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, tiny, name):
    df = queries.QUERIES[name](spark, tiny)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        kinds = {"section_no": "int", "term": "string", "mark": "string", "noise": "string"}
        assert df.dtypes == [(c, kinds.get(c, "bigint")) for c in COLUMNS[name]]
        assert df.count() == df.distinct().count()
    if name in queries.SQL:
        same(df, duck.execute(queries.SQL[name]))
    else:
        assert df.count() > 0
