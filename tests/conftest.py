import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from ledgerwatch.session import local_session

    session = local_session(cpus=8, shuffle_partitions=4, **{"spark.default.parallelism": "2"})
    session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerwatch-tests-"))
    yield session


@pytest.fixture(scope="session")
def tables(spark):
    from ledgerwatch.adapters import Tables

    return Tables(spark, SF)


def rows(df, *columns):
    """Rows as sorted tuples with floats rounded."""
    picked = df.select(*columns) if columns else df
    return sorted(
        (tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in picked.collect()),
        key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r),
    )
