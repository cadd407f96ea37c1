import pytest

from samewise.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4)
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s


@pytest.fixture
def rows():
    """The rows of a frame as sorted tuples."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
