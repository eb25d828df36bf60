from __future__ import annotations

import pytest

from tests.compare import connect, same
from tracewright.llm.queries import QUERIES, SQL

COLUMNS = {
    "p1_found": ["correlation_id_a", "correlation_id_b"],
    "p3_found": ["event_record_id", "group_id"],
    "p6_found": ["first_record_id", "last_record_id", "n_records"],
    "p9_found": ["doc_id", "item_id"],
    "p10_found": ["doc_id", "lang"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, data):
    df = QUERIES[name](spark, data)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    if name in SQL:
        same(df, connect(data), SQL[name])
    else:
        assert df.count() > 0
