import duckdb
import pytest

import __spark_entry__ as entry
from assetloom import registry

SF = "/root/testdata/sf0.001"


def rows(frame, columns):
    return sorted(str([None if v != v or v is None else v for v in r]) for r in frame[columns].astype(object).values.tolist())


@pytest.fixture(scope="module")
def oracle():
    db = duckdb.connect()
    for name in ("pages", "documents", "events", "part", "conversations"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, oracle, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name in registry.ORACLE_SQL:
        want = oracle.sql(registry.ORACLE_SQL[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns) and rows(got, columns) == rows(want, columns)


def test_every_query_finds_something_and_every_classifier_fires(spark):
    frames = {n: registry.QUERIES[n](spark, SF) for n in registry.QUERIES if n.startswith(("spelled_", "program_", "unpacked_", "laid_", "resolved_maps", "page_script", "endpoint_"))}
    assert all(not df.isEmpty() for df in frames.values())
    for name in ("spelled_classes", "spelled_secrets", "spelled_names", "spelled_paths"):
        df = frames[name].toPandas()
        for column in df.columns.drop("v"):
            values = df[column]
            assert values.astype(object).nunique(dropna=False) >= 2 and values.any(), (name, column)
    assert frames["spelled_signatures"].select("rule").distinct().count() == 6
    assert registry.QUERIES["event_graphql"](spark, SF).select("graphql").distinct().count() == 5


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
