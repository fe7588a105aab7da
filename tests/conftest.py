import os
import sys
from datetime import date, timedelta

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from hearthline import schemas  # noqa: E402
from hearthline.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        **{
            "spark.master": "local[8]",
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def random_pairs():
    """Pairs of two groups, some wild, as tuples in schema order."""

    def build(n=300, seed=1, noise=0.05, groups=("A", "B"), months=24):
        rng = np.random.default_rng(seed)
        rows = []
        for i in range(n):
            first = date(2015, 1, 1) + timedelta(days=int(rng.integers(0, months * 15)))
            second = first + timedelta(days=int(rng.integers(1, months * 15)))
            change = 0.0002 * (second - first).days + rng.normal(0, noise)
            if i % 25 == 0:
                change += rng.normal(0, 1)
            price = float(np.round(rng.uniform(1e5, 4e5), 2))
            group = groups[i % len(groups)]
            rows.append((f"P{i:04d}", f"{group}{i % 5}", group, first, price, second, float(np.round(price * np.exp(change), 2))))
        return rows

    return build


@pytest.fixture(scope="session")
def pairs_table(spark):
    return lambda rows: spark.createDataFrame(rows, schemas.PAIRS)
