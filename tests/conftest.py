import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from screeline.session import local_session

    folder = tmp_path_factory.mktemp("shared")
    return local_session(4, "tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.checkpoint.dir": f"file://{folder}"})


def against_sql(spark, folder, query, sql):
    """Asserts that a query's rows equal those of its SQL."""
    import duckdb
    import numpy as np
    import pandas as pd

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{folder}/{name}'")

    def cell(v):
        if isinstance(v, (list, np.ndarray)):
            return tuple(v)
        if v is None or pd.isna(v):
            return None
        if isinstance(v, (bool, np.bool_)):
            return bool(v)
        return round(float(v), 6) + 0.0 if isinstance(v, (int, float, np.number)) else str(v)

    def rows(df):
        return sorted((tuple(cell(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=str)

    got, want = query(spark, folder).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
