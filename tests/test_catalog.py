import pytest

from tests.compare import duck, same
from tidetable.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, con, name):
    same(catalog.QUERIES[name](spark, SF), con, catalog.SQL[name])


def test_encoded_features_hold_no_null(spark):
    rows = catalog.QUERIES["encode_features"](spark, SF)
    names = [c for c in rows.columns if c.startswith("x_")]
    assert len(names) == 37
    assert rows.where(" OR ".join(f"{c} IS NULL" for c in names)).count() == 0
