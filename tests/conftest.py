import pytest

from skein.runtime import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    root = tmp_path_factory.mktemp("shared")
    s = session(
        "local[4]",
        4,
        **{
            "spark.checkpoint.dir": f"file://{root}/checkpoints",
            "spark.sql.warehouse.dir": str(root / "warehouse"),
            "spark.driver.memory": "4g",
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
