"""Every registered query against its DuckDB SQL on the small driver
tables (the driver repeats this at sf0.01); queries without SQL must run and
return a stable schema."""

import pytest

import __spark_entry__ as E
from homerange import oracle, registry
from tests.compare import check
from tests.conftest import SF_SMALL

# the library's own queries; those of an installed extra package have tests of their own
QUERIES = registry.queries()
SQL = oracle.queries()


def test_every_query_has_a_name_and_sql_keys_exist():
    assert set(SQL) <= set(QUERIES) <= set(E.queries())
    assert set(SQL) <= set(E.oracle_sql())
    rows_only = set(QUERIES) - set(SQL)
    assert rows_only == {"forest_scores", "confusion", "forest_rates", "out_of_bag_error"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, duck_small, name):
    ok, msg = check(spark, SF_SMALL, name, QUERIES[name], SQL[name], duck_small)
    assert ok, msg


def test_entry(spark, duck_small):
    df = E.entry(spark)
    assert df.count() == len(duck_small.sql(SQL["local_users"]).fetchall()) > 0
    assert df.columns == [
        "user_id",
        "longitude_Centroid",
        "latitude_Centroid",
        "Tip_or_Review_Count",
        "AVG_Distance_From_Centroid",
        "STDEV_Distance_From_Centroid",
    ]


@pytest.mark.parametrize("name", ["hit_distances", "user_dispersion", "local_users"])
def test_hot_user_path_matches_duckdb(spark, duck_small, name):
    """With split_rows=3 most users take the salted join path; results must
    not change."""
    from dataclasses import replace

    from homerange import registry
    from homerange.plans import LocalMarket

    params = replace(registry.PARAMS, split_rows=3)

    def q(s, d):
        return registry.round_doubles(getattr(LocalMarket.from_standin(s, d, params), name))

    ok, msg = check(spark, SF_SMALL, name, q, SQL[name], duck_small)
    assert ok, msg


def test_missing_training_operators_leave_the_rest(monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, "homerange.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert set(E.queries()) == set(QUERIES) and set(E.oracle_sql()) == set(SQL)
