import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tessera.session import get_spark

    session = get_spark(
        "tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "2g", "spark.driver.host": "127.0.0.1"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.hookimpl(hookwrapper=True)
def pytest_runtest_makereport(item, call):
    """The first lines of a Java error, which name its cause, go into the report: the log's end is all frames."""
    report = (yield).get_result()
    java = getattr(call.excinfo.value, "java_exception", None) if call.excinfo else None
    if java is not None:
        report.sections.append(("Java error", "\n".join(java.toString().splitlines()[:40])))
