import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    base = tempfile.mkdtemp(prefix="tests-")
    s = (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", f"file://{base}/shared").config("spark.sql.warehouse.dir", f"{base}/warehouse")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def canonical(rows, columns):
    """Rows as sorted tuples of comparable texts, columns in order of name."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(v):
        if v is None or v != v:
            return "null"
        if isinstance(v, float):
            return repr(int(v)) if v == int(v) else repr(v)
        if isinstance(v, (list, tuple)):
            return str([text(x) for x in v])
        return str(v)

    return sorted(tuple(text(r[i]) for i in order) for r in rows)
