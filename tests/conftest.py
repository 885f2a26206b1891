"""One Spark session for all tests; the shared folder is set here only where none is configured."""

import pytest

from quillworks.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("tests", 8)
    if not session.conf.get("spark.checkpoint.dir", None):
        folder = str(tmp_path_factory.mktemp("checkpoints"))
        session.conf.set("spark.checkpoint.dir", folder)
        session.sparkContext.setCheckpointDir(folder)
    yield session


@pytest.fixture
def rows(spark):
    """Build a small table: ``rows("id long, name string", (1, "a"), (2, None))``."""

    def build(schema, *data):
        return spark.createDataFrame(list(data), schema)

    return build
