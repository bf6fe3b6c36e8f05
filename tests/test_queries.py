"""Registered queries with SQL against DuckDB on the smallest tables, where these are at hand."""

import os

import pytest
from quirelay.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, float) and v == int(v):
        return int(v)
    return v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    columns = sorted(got.columns)
    duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in duck.description]
    assert sorted(names) == columns
    wanted = [[r[names.index(c)] for c in columns] for r in duck.fetchall()]
    rows = [[r[c] for c in columns] for r in got.collect()]
    assert sorted(repr(plain(r)) for r in rows) == sorted(repr(plain(r)) for r in wanted)


def test_ids_of_rounded_products(spark, tmp_path):
    """Vectors whose product with 200 is whole as a float and just below as a double; before and after the end mark, and among skipped ids."""
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    vectors = [[0.105, 0.021, 0.0, 0.105], [0.18, 0.105], [-0.105, 0.13], [0.0, 0.105]]
    path = f"{tmp_path}/embeddings.parquet"
    pq.write_table(pa.table({"vec_id": pa.array(range(4), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32()))}), path)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{path}'")
    con.execute(catalog.oracle_sql()["decode_tokens"])
    wanted = sorted(con.fetchall())
    assert sorted(map(tuple, catalog.queries()["decode_tokens"](spark, str(tmp_path)).select("vec_id", "decoded").collect())) == wanted
    assert wanted[0] == (0, "ud")
