import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from spellframe.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "spellframe-tests")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    return s


def rows(df, *order):
    """Sorted tuples of a small frame."""
    out = [tuple(r) for r in df.collect()]
    return sorted(out, key=lambda r: tuple((x is not None, str(x)) for x in r))


@pytest.fixture
def table(spark):
    def make(data, schema):
        return spark.createDataFrame(data, schema)
    return make


@pytest.fixture
def everything_hot(monkeypatch):
    """Treat every key with two rows as hot, so that small data takes the spreading paths."""
    from spellframe.operators import skew
    monkeypatch.setattr(skew, "HOT_ROWS", 2)
    monkeypatch.setattr(skew, "LOOK", 1.0)
