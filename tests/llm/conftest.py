from __future__ import annotations

import pytest

from tallymart.llm.common import on_executors


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    """The package on the workers, as for the named queries."""
    on_executors(lambda session: None)(spark)
