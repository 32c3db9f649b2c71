"""The driver contract in __spark_entry__.py."""

import duckdb

import __spark_entry__ as entry


def test_oracle_keys_are_queries():
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 50


def test_oracle_sql_binds_in_duckdb():
    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events "
              "documents embeddings pages benchmark labels conversations").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    for name, sql in entry.oracle_sql().items():
        con.execute(f"DESCRIBE {sql}")            # binds every name and type


def test_entry_schema(spark):
    df = entry.entry(spark)
    assert df.columns == ["month", "revenue", "orders"]
    assert df.count() > 0
