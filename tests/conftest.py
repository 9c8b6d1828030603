import pytest

from pagegraph.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    home = tmp_path_factory.mktemp("shared")
    session = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": str(home), "spark.sql.warehouse.dir": str(home / "warehouse"), "spark.driver.memory": "3g"})
    session.sparkContext.setLogLevel("ERROR")
    return session
