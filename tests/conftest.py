import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lodestack.session import get_spark

    shared = tmp_path_factory.mktemp("shared")
    session = get_spark("local[4]", 4, **{"spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.checkpoint.dir": f"file://{shared}", "spark.sql.warehouse.dir": str(shared / "warehouse")})
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(rows, columns):
    """Rows as sorted tuples, columns by name, floats rounded."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: f"{v:.6f}" if isinstance(v, float) else [plain(x) for x in v] if isinstance(v, list) else str(v)
    return sorted(tuple(str(plain(r[i])) for i in order) for r in rows)


@pytest.fixture(scope="session")
def same_as_sql(spark, duck):
    def check(query, sql):
        df = query(spark, SF)
        mine = canonical([tuple(r) for r in df.collect()], df.columns)
        rel = duck.sql(sql)
        theirs = canonical(rel.fetchall(), rel.columns)
        assert sorted(df.columns) == sorted(rel.columns)
        assert mine == theirs

    return check
