"""Each query against its DuckDB SQL on the smallest tables."""

import duckdb
import pytest

from accordant.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for t in "region nation part orders events documents labels conversations".split():
        made.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return made


def plain(rows, names):
    show = lambda x: f"{x:.9g}" if isinstance(x, float) else repr(x)
    return sorted(tuple(show(r[c]) for c in names) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    found = QUERIES[name](spark, SF)
    cursor = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(found.columns) == sorted(names)
    assert plain(found.collect(), sorted(names)) == plain([dict(zip(names, r)) for r in cursor.fetchall()], sorted(names))


def test_registry_without_corpus_operators(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())
    assert entry.entry(spark).count() == 1
