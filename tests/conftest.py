from __future__ import annotations

import pytest

from promptweave.session import local_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(
        "tests",
        8,
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def battles(spark):
    """Thirteen battles: three are kept, every rule drops some."""
    rows = [
        (0, "  Explain TCP  ", "gpt-4", "koala-13b", "model_a"),
        (1, "hi", "gpt-4", "koala-13b", "model_b"),
        (2, None, "gpt-4", "koala-13b", "model_a"),
        (3, " \t\n", "gpt-4", "koala-13b", "model_a"),
        (4, "x", "gpt-4", "koala-13b", "tie"),
        (5, "x", "gpt-4", "koala-13b", "tie (bothbad)"),
        (6, "x", "gpt-4", "koala-13b", None),
        (7, "x", "gpt-4", "koala-13b", " model_a "),
        (8, "x", " gpt-4", "koala-13b", "model_a"),
        (9, "x", "llama-13b", "gpt-4", "model_a"),
        (10, "x", "GPT-4", "koala-13b", "model_a"),
        (11, "x", None, "gpt-4", "model_a"),
        (12, None, "llama-13b", "gpt-4", "tie"),
    ]
    return spark.createDataFrame(
        rows, "battle_id long, user_prompt string, model_a string, model_b string, winner string"
    )
