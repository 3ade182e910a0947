import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from odorframe.session import build_session

    session = build_session(
        "tests",
        "local[8]",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="8g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def toy(spark):
    """30 sequences of 3 channels x 20 steps in two classes, around different curves."""
    import numpy as np

    rng = np.random.default_rng(7)
    t = np.linspace(0, 1, 20)
    rows = []
    for i in range(30):
        label = "a" if i < 15 else "b"
        base = np.stack([np.sin(3 * t), t, t**2]) * (1.0 if label == "a" else -1.0)
        rows.append((i, label, (base + rng.normal(0, 0.3, base.shape)).tolist()))
    return spark.createDataFrame(rows, "measurement_id bigint, label string, x array<array<double>>").cache()
