import pytest

from loomwork.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    root = tmp_path_factory.mktemp("shared")
    session = local_session(
        4, 4, "4g", **{"spark.checkpoint.dir": str(root), "spark.sql.warehouse.dir": str(root / "warehouse")}
    )
    yield session
    session.stop()
