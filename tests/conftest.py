from __future__ import annotations

import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pixelloom.model import PIXEL_SCHEMA  # noqa: E402
from pixelloom.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", 8)
    yield session
    session.stop()


class Images:
    """numpy pictures (height, width, 4) to pixel rows and back."""

    def __init__(self, spark):
        self.spark = spark

    def table(self, **pictures: np.ndarray):
        rows = []
        for name, picture in pictures.items():
            h, w = picture.shape[:2]
            for y in range(h):
                for x in range(w):
                    rows.append((name, w, h, x, y, *map(int, picture[y, x])))
        return self.spark.createDataFrame(rows, PIXEL_SCHEMA)

    @staticmethod
    def arrays(df, columns=("r", "g", "b", "a"), key="image_id") -> dict[str, np.ndarray]:
        out: dict[str, np.ndarray] = {}
        rows = df.select(key, "width", "height", "x", "y", *columns).collect()
        for row in rows:
            picture = out.setdefault(row[0], np.full((row[2], row[1], len(columns)), -1, dtype=int))
            assert (picture[row[4], row[3]] == -1).all(), "pixel twice"
            picture[row[4], row[3]] = row[5:]
        for picture in out.values():
            assert (picture >= 0).all(), "pixel missing"
        return out


@pytest.fixture(scope="session")
def images(spark):
    return Images(spark)


def gradient(w=64, h=64):
    """Opaque: red grows to the right, green downwards, blue along the diagonal."""
    row, column = np.indices((h, w))
    return np.dstack([column * 255 // w, row * 255 // h, (column + row) * 255 // (w + h), np.full_like(row, 255)])


def disc(w=64, h=64):
    """An opaque round spot in the middle half, clear around it."""
    row, column = np.indices((h, w))
    spot = (2 * column - w) ** 2 + (2 * row - h) ** 2 <= (min(w, h) // 2) ** 2
    return spot[..., None] * np.array([200, 120, 60, 255])


def noise(w, h, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 4))
