import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from relrank.session import get_session, release  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="relrank-stages-"),
            "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="relrank-warehouse-"),
            "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    release(session)
    session.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """A table from rows and a DDL schema."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)


def table(df, key):
    """{key: remaining columns} of a small table."""
    rest = [c for c in df.columns if c != key]
    return {row[key]: row[rest[0]] if len(rest) == 1 else tuple(row[c] for c in rest) for row in df.collect()}
