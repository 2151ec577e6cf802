"""Every registered query of the synchronisation part against its SQL, over a small folder of the given tables."""

from pathlib import Path

import duckdb
import pytest

from seamark.plans import ORACLES, QUERIES

DIR = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    if not DIR.is_dir():
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, tmp_path, name):
    QUERIES[name](spark, str(DIR)).write.parquet(f"{tmp_path}/q")
    if name not in ORACLES:
        return
    db.execute(f"create or replace table want as {ORACLES[name]}")
    db.execute(f"create or replace table got as select * from '{tmp_path}/q/*.parquet'")
    columns = sorted(r[0] for r in db.sql("describe want").fetchall())
    assert columns == sorted(r[0] for r in db.sql("describe got").fetchall())
    pick = ", ".join(f'"{c}"' for c in columns)
    assert db.sql(f"select {pick} from want except all select {pick} from got").fetchall() == []
    assert db.sql(f"select {pick} from got except all select {pick} from want").fetchall() == []
