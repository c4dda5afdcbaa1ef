from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from labelspark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def articles(spark):
    """14 balanced classes in two splits, class ids with a vocabulary beside them."""
    rows = [
        (i, f"title {i}", f'body "{i}" é\n', i % 14, "train" if i < 1400 else "test")
        for i in range(1400 + 280)
    ]
    return spark.createDataFrame(rows, "id long, title string, content string, label int, split string")


@pytest.fixture(scope="session")
def article_classes(spark):
    rows = [("label", i, f" Class{i:02d}") for i in range(14)]
    return spark.createDataFrame(rows, "label_name string, class_id int, class_name string")


@pytest.fixture(scope="session")
def injuries(spark):
    """Two padded labels with nulls and unequal class sizes."""
    rows = []
    for i in range(600):
        nature = None if i % 50 == 7 else f"  Nature{min(i % 23, i % 13)} \t"
        body = None if i % 60 == 9 else f"Part{min(i % 17, i % 12)}\n"
        rows.append((i, f"narrative {i}", i * 10, nature, body))
    return spark.createDataFrame(
        rows, "id long, `Final Narrative` string, Inspection long, NatureTitle string, `Part of Body Title` string")
