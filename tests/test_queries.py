import os

import duckdb
import pytest
from pyspark.sql import functions as F

from sheaf.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in os.listdir(SF):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return con


@pytest.mark.parametrize("name", registry.queries())
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted((tuple(r) for r in df.select(*[F.col(f"`{c}`") for c in columns]).collect()), key=str)
    listed = ",".join(f'"{c}"' for c in columns)
    assert ours == sorted(duck.sql(f"SELECT {listed} FROM ({registry.oracle_sql()[name]})").fetchall(), key=str)
