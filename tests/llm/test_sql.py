"""Every query of the package with SQL agrees with DuckDB."""

import check
import pytest

from gapmend.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(name, spark, sf, duck):
    assert check.compare(duck, QUERIES[name](spark, sf), ORACLE[name]) is None
