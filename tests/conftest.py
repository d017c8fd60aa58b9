import pytest

from floodspark.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("floodspark-tests", "local[4]", {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.driver.memory": "6g", "spark.sql.ansi.enabled": "true"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
