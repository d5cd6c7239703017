import compare
import pytest
from quillforge.plans.catalogue import ORACLES, QUERIES


@pytest.fixture(scope="module")
def db(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, sf_dir, db, name):
    assert compare.rows_of_frame(QUERIES[name](spark, sf_dir)) == compare.rows_of_sql(db, ORACLES[name])


def test_communities_of_traders(spark, sf_dir):
    """The only query without SQL: a partition into communities, numbered by size."""
    rows = QUERIES["trade_communities"](spark, sf_dir).collect()
    size = {}
    for r in rows:
        size[r.community] = size.get(r.community, 0) + 1
    assert set(QUERIES) - set(ORACLES) == {"trade_communities"} and len({r.node for r in rows}) == len(rows) > 0
    order = sorted(size, key=lambda c: (-size[c], c))
    assert all(r.size == size[r.community] and order[r.rank - 1] == r.community for r in rows)
