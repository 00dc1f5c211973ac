import pytest

import __spark_entry__ as entry
from compare import rows, views
from kinweave.plans import details, problems, reference

NAMES = [n for m in (reference, details, problems) for n in m.QUERIES]


def test_entry(spark, small):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="session")
def sql():
    return views("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, small, sql, name):
    df = entry.queries()[name](spark, small)
    got = rows(df.columns, df.collect())
    if name in entry.oracle_sql():
        result = sql.execute(entry.oracle_sql()[name])
        columns = [c[0] for c in result.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == rows(columns, result.fetchall())


@pytest.fixture
def strict(spark):
    """A session that refuses repeated keys in maps, as Spark does by default."""
    key = "spark.sql.mapKeyDedupPolicy"
    before = spark.conf.get(key)
    spark.conf.set(key, "EXCEPTION")
    yield spark
    spark.conf.set(key, before)


def same(spark, folder, name):
    df, result = entry.queries()[name](spark, str(folder)), views(str(folder)).execute(entry.oracle_sql()[name])
    got, want = rows(df.columns, df.collect()), rows([c[0] for c in result.description], result.fetchall())
    assert got and got == want


def test_merged_results_by_default_settings(strict, small, made, tmp_path):
    same(strict, small, "merged_results")
    odd = [(1, "a", "o1", None), (2, "a", "o2", "h2"), (3, "a", "o3", None), (4, "b", "o4", None), (5, "c", "o5", "h5"), (6, "c", None, "h6"), (None, "d", "o7", "h7"), (None, "e", "o8", "h8"), (9, "e", "o9", None), (10, None, "o10", "h10")]
    made(odd, "ingest_seq long, signature_id string, observation_id string, hash_value string").write.parquet(str(tmp_path / "signatures.parquet"))
    same(strict, tmp_path, "merged_results")


def test_facet_merge_by_default_settings(strict, small, made, tmp_path):
    same(strict, small, "facet_merge")
    odd = [("o1", 0), ("o2", 1), ("o3", 2), ("o4", 3), ("o5", 6), ("o6", None), (None, 8), ("o7", -2), ("o7", -2), ("o8", -3), ("o9", 2**63 - 1)]
    made(odd, "observation_id string, ingest_seq long").write.parquet(str(tmp_path / "observations.parquet"))
    same(strict, tmp_path, "facet_merge")
