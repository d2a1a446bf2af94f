"""The engine's operators on small stated inputs give the rows that are stated for them."""

import pytest

from .stated_queries import QUERIES
from .stated_rows import EXPECTED


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_stated_rows(spark, name):
    columns, rows = EXPECTED[name]
    named = [c.split() for c in columns.split(", ")]
    out = QUERIES[name](spark, None)
    kinds = {"int": "int", "long": "bigint", "boolean": "boolean", "double": "double", "string": "string"}
    assert sorted(out.dtypes) == sorted((c, kinds[k]) for c, k in named)
    got = out.select(*(c for c, _ in named)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, rows), key=repr)
