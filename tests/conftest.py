import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent.parent), str(Path(__file__).parent)]

from plumbline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(8)
    s.sparkContext.setLogLevel("OFF")
    return s


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def dirty(spark):
    rows = [
        (1, "Alice", 25, 50000, "a@example.com"), (2, "Bob", 30, 60000, "b@example.com"), (2, None, 35, None, "c@example.com"),
        (4, "Dan", 200, -5000, "bad"), (5, "", -1, 70000, "e@example.com"), (6, "Fay", 28, 52000, "f@example.com"),
        (7, None, 41, None, "g@example.com"), (8, "Hal", 39, 61000, "h@example.com"), (9, "Ida", 33, 58000, "i@example.com"), (10, "Jon", 45, 75000, "j@example.com"),
    ]
    return spark.createDataFrame(rows, "id bigint, name string, age bigint, salary bigint, email string")
