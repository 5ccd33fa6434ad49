import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from millrace.engine import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session.build("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(autouse=True)
def plain_names(request):
    """Tests of the SQL surface change how names are read; others shall not see it."""
    yield
    if "spark" in request.fixturenames:
        s = request.getfixturevalue("spark")
        for key in ("spark.sql.caseSensitive", "spark.sql.ansi.doubleQuotedIdentifiers"):
            s.conf.unset(key)
