import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from geopanel import model_queries as models

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    return con


def cells(rows):
    return sorted([tuple("-" if v is None or v != v else f"{float(v):.4f}" if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v) for v in r) for r in rows])


@pytest.mark.filterwarnings("ignore")
@pytest.mark.parametrize("name", sorted(models.ORACLE))
def test_model_query_equals_its_sql(spark, duck, name):
    df = models.QUERIES[name](spark, DATA)
    want = duck.execute(models.ORACLE[name])
    order = [c[0] for c in want.description]
    assert sorted(order) == sorted(df.columns)
    assert cells(df.select(*[F.col(f"`{c}`") for c in order]).collect()) == cells(want.fetchall())


def test_all_are_registered():
    assert set(models.QUERIES) <= set(entry.queries()) and set(models.ORACLE) <= set(entry.oracle_sql())
