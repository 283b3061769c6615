import sys

import __spark_entry__ as e
from pyspark.sql import DataFrame


def test_entry(spark):
    df = e.entry(spark)
    assert isinstance(df, DataFrame) and "id" in df.columns and df.count() > 0


def test_every_sql_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_spatial_queries_match_their_sql(spark):
    import duckdb

    from tessera.plans import queries as spatial

    con = duckdb.connect()
    sf = "/root/testdata/sf0.001"
    for t in ("orders", "customer", "part", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    sql = spatial.oracle_sql()
    for name, query in spatial.queries().items():
        got, want = query(spark, sf), con.execute(sql[name])
        names = sorted(got.columns)
        assert names == sorted(d[0] for d in want.description), name
        place = {d[0]: k for k, d in enumerate(want.description)}
        rows = sorted(map(repr, (tuple(r[n] for n in names) for r in got.collect())))
        assert rows == sorted(map(repr, (tuple(r[place[n]] for n in names) for r in want.fetchall()))), name


def test_package_does_not_need_the_training_operators():
    import subprocess

    code = "import sys; sys.modules['tessera.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'bbox_search' in e.queries() and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=e.__file__.rpartition("/")[0])
