from __future__ import annotations

import pytest


@pytest.fixture(scope="session", autouse=True)
def cleared(spark):
    """What the operators wrote goes when the tests are done."""
    from foliant.llm.common import clear

    yield
    clear(spark)
