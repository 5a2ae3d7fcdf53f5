import os

import pytest

from assetlake.llm import queries
from tests.test_oracle import DATA, compare


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    if name in queries.SQL:
        compare(spark, name, queries.QUERIES[name], queries.SQL[name])
    else:
        assert queries.QUERIES[name](spark, DATA).count() > 0
