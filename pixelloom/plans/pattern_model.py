"""The model of the registered inference queries: an arithmetic pattern, easy to state in SQL."""

from __future__ import annotations

import base64
import struct
import zlib
from typing import Any

import numpy as np

MODEL_ID = "stub-image"


class PatternModel:
    """text2img paints a woven pattern from the seed and the prompt's length; img2img inverts colours."""

    name = "pattern"
    ops = ("text2img", "img2img")

    def supports(self, op: str, model_id: str) -> bool:
        return model_id == MODEL_ID and op in self.ops

    def models(self) -> list[dict[str, Any]]:
        return [{"model_id": MODEL_ID, "ops": list(self.ops)}]

    def run_batch(self, op: str, model_id: str, jobs: list[tuple[dict, dict]]) -> list[dict | Exception]:
        paint = self._weave if op == "text2img" else self._invert
        out: list[dict | Exception] = []
        for given, params in jobs:
            try:
                picture = paint(given, params)
                out.append({"rgba": picture.astype(np.uint8).tobytes(), "w": picture.shape[1], "h": picture.shape[0]})
            except ValueError as error:
                out.append(error)
        return out

    @staticmethod
    def _weave(given: dict, params: dict) -> np.ndarray:
        w, h, seed = (int(params.get(k, d)) for k, d in (("width", 512), ("height", 512), ("seed", 0)))
        row, column = np.indices((h, w))
        planes = (7 * column + 13 * row + 31 * seed, column * row + len(given.get("prompt") or ""), 40 + 180 * ((column + row) % 2))
        return np.stack([*(p % 256 for p in planes), np.full((h, w), 255)], axis=-1)

    @staticmethod
    def _invert(given: dict, params: dict) -> np.ndarray:
        if not given.get("image_b64"):
            raise ValueError("img2img needs image_b64")
        samples = own_png(base64.b64decode(given["image_b64"]))
        return np.concatenate([255 - samples[..., :3], samples[..., 3:]], axis=-1)


class InvertModel(PatternModel):
    """The part of ``PatternModel`` that a second adapter serves."""

    name = "invert"
    ops = ("img2img",)


def own_png(data: bytes) -> np.ndarray:
    """(height, width, 4) of an RGBA file as ``functions.png`` writes them: no line filter."""
    at, body = 8, b""
    while at < len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        if data[at + 4 : at + 8] == b"IDAT":
            body += data[at + 8 : at + 8 + size]
        at += 12 + size
    width, height = struct.unpack(">II", data[16:24])
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + 4 * width)
    return lines[:, 1:].reshape(height, width, 4)
