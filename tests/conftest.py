from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from zonemill.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    session = get_session("local[4]", 4, **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows():
    """Rows of a DataFrame as dictionaries keyed by the given columns (a bare value for one column)."""
    def collect(df, *keys):
        out = {}
        for r in df.collect():
            key = tuple(r[k] for k in keys)
            out[key[0] if len(key) == 1 else key] = r.asDict()
        return out
    return collect
