import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = con.sql(sql)
    return rel.columns, rel.fetchall()


def same(df, sql, sf_dir):
    """The query's rows equal the oracle's, columns by name, order aside."""
    cols, rows = oracle(sql, sf_dir)
    assert sorted(cols) == sorted(df.columns)
    got = sorted(tuple(map(repr, r)) for r in df.select(*cols).collect())
    assert got == sorted(tuple(map(repr, r)) for r in rows)
