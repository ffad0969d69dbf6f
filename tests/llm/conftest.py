import pytest

from coterie.llm.tables import ship


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
