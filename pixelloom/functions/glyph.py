"""Prompt pictures in NumPy; the helper of the table function ``glyph``."""

from __future__ import annotations

import hashlib

import numpy as np


def glyph_pixels(prompt: str, seed: int, w: int, h: int) -> dict[str, np.ndarray]:
    """x, y, r, g, b, a of the picture of ``prompt:seed``, row by row."""
    color = hashlib.sha256(f"{prompt}:{seed}".encode()).digest()[:3]
    y, x = (v.ravel() for v in np.indices((max(0, h), max(0, w))))
    away = np.sqrt((x - w / 2.0) * (x - w / 2.0) + (y - h / 2.0) * (y - h / 2.0))
    radius = min(w, h) * 0.36
    inside = away <= radius
    reach = max(1.0, radius)
    shade = np.clip(1.0 - (away / reach) * (away / reach), 0.0, 1.0)
    behind = (18.0 + 6.0 * np.sin(x / float(w or 1) * 6.28), np.full(len(x), 20.0), 26.0 + 6.0 * np.cos(y / float(h or 1) * 6.28))
    planes = [np.where(inside, c * (0.4 + 0.6 * shade), back) for c, back in zip(color, behind)]
    out = {"x": x, "y": y} | {
        name: np.floor(np.clip(plane, 0.0, 255.0) + 1e-9) for name, plane in zip("rgb", planes)
    } | {"a": np.where(inside, 255, 0)}
    return {name: values.astype(np.int32) for name, values in out.items()}
