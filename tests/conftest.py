import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from dredgeline.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    con = duckdb.connect()
    for file in os.listdir(data):
        con.execute(f"create view {file.split('.')[0]} as select * from '{data}/{file}'")
    return con


def rows(df):
    """Rows as a sorted list of tuples."""
    return sorted(map(tuple, df.collect()), key=repr)


def shuffled(spark, run):
    """Records that the shuffles of ``run()`` have written."""
    sc = spark.sparkContext
    none = (False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, *none)
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before = total()
    run()
    return total() - before


def same_as_sql(spark, duck, data, query, sql):
    """Asserts that a query's rows equal those of its SQL, columns by name."""
    got = query(spark, data)
    columns = sorted(got.columns)
    want = duck.execute(sql).fetchall()
    names = [d[0] for d in duck.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    plain = lambda v: float(v) if type(v).__name__ == "Decimal" else v
    assert sorted((tuple(plain(v) for v in r) for r in got.select(*columns).collect()), key=repr) == sorted((tuple(plain(r[i]) for i in order) for r in want), key=repr)
