"""Query pairs on the smallest tables: Spark against DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
SOME = ["fold_docs", "surname_keys", "work_slugs", "snippets", "week_ranges", "page_fields", "filter_multi", "first_match_join", "merged_publishers", "revenue_by_nation", "asof_join", "conversation_state", "work_groups", "works_rollup", "facet_panel", "stats_dashboard", "match_lists", "bm25_search", "suggest", "knn_cosine", "tf_idf", "upsert", "streak_stop", "completeness", "session_events"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(row):
    return tuple("" if v is None else f"{v:.6g}" if isinstance(v, float) else repr(v) for v in row)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).columns == ["work_id", "score", "title"]


@pytest.mark.parametrize("name", SOME)
def test_spark_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(plain(r) for r in df.select(*columns).collect())
    found = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(plain([r[names.index(c)] for c in columns]) for r in found.fetchall())


def test_filters_and_columns_reach_the_scan(spark):
    plan = entry.queries()["filter_multi"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "In(lang" in plan and "text:string" not in plan
