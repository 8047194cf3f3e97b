"""Every query of the subpackage over the smallest tables; results against brute force where it is cheap."""

import os

import pytest

from factloom.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not (os.path.isdir(FOLDER) and os.path.isdir("/opt/tokenizers")), reason="no test tables or tokenizer files here")
COLUMNS = {
    "p3_found": ["name_a", "name_b"], "p5_found": ["row_a", "row_b"], "p6_found": ["rec_a", "rec_b"], "p7_found": ["tbl", "item_id", "field", "hard"], "p8_ids": ["doc_id", "ids"], "p9_found": ["source"], "p10_found": ["doc_a", "doc_b"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    got = df.collect()
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        assert got and len(got) == len({str(r) for r in got})
    assert len(got) > 0
