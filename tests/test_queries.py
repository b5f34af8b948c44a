"""Every registered trip query against its SQL."""

import pytest
from compare import differences, duck
from conftest import MIDDLE

from wayfare import queries, queries_board, queries_decide, queries_events, queries_players, queries_space  # noqa: F401  register more

CON = duck(MIDDLE)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_sql(spark, name):
    df = queries.QUERIES[name](spark, MIDDLE)
    sql = queries.oracle_sql().get(name)
    if sql is None:
        assert df.columns and df.count() > 0
    else:
        assert differences(df, CON, sql) == []
