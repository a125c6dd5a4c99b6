"""8-bit PNG files from scanlines and back; the small helper of the image sink and payload decoder."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed value
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}  # fixed values: colour type -> samples per pixel


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png_parts(width: int, height: int, bands: Iterable[bytes]) -> Iterator[bytes]:
    """The pieces of an RGBA PNG, one per band of whole RGBA scanlines, in order.

    Only one band is held at a time, so the image may be larger than memory.
    """
    yield SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0))
    packer = zlib.compressobj(6)
    for band in bands:
        samples = np.frombuffer(band, dtype=np.uint8).reshape(-1, width * 4)
        lines = np.zeros((len(samples), 1 + width * 4), dtype=np.uint8)  # filter 0 in front
        lines[:, 1:] = samples
        body = packer.compress(lines.tobytes())
        if body:
            yield _chunk(b"IDAT", body)
    yield _chunk(b"IDAT", packer.flush()) + _chunk(b"IEND", b"")


def _unfilter(raw: np.ndarray, width: int, channels: int) -> np.ndarray:
    """Undo the scanline filters of (height, 1 + width*channels) bytes."""
    height = len(raw)
    if not raw[:, 0].any():  # no line has a filter
        return raw[:, 1:].reshape(height, width, channels)
    out = np.zeros((height + 1, width + 1, channels), dtype=np.int32)
    for y in range(height):
        kind = raw[y, 0]
        line = raw[y, 1:].reshape(width, channels).astype(np.int32)
        above = out[y, 1:]
        row = out[y + 1]
        if kind == 0:
            row[1:] = line
        elif kind == 1:
            row[1:] = np.cumsum(line, axis=0) & 255
        elif kind == 2:
            row[1:] = (line + above) & 255
        elif kind in (3, 4):
            corner = out[y]
            for x in range(width):
                left, up, diagonal = row[x], above[x], corner[x]
                if kind == 3:
                    guess = (left + up) >> 1
                else:
                    estimate = left + up - diagonal
                    to_left, to_up, to_diagonal = (
                        np.abs(estimate - left), np.abs(estimate - up), np.abs(estimate - diagonal)
                    )
                    guess = np.where(
                        (to_left <= to_up) & (to_left <= to_diagonal),
                        left,
                        np.where(to_up <= to_diagonal, up, diagonal),
                    )
                row[x + 1] = (line[x] + guess) & 255
        else:
            raise ValueError(f"unknown PNG filter {kind}")
    return out[1:, 1:].astype(np.uint8)


def decode_png(data: bytes) -> np.ndarray:
    """(height, width, 4) uint8 of an 8-bit, non-interlaced gray, RGB or RGBA PNG."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, header, body = 8, None, b""
    while at < len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        kind = data[at + 4 : at + 8]
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", data[at + 8 : at + 8 + size])
        elif kind == b"IDAT":
            body += data[at + 8 : at + 8 + size]
        at += 12 + size
    if header is None or header[2] != 8 or header[6] != 0 or header[3] not in CHANNELS:
        raise ValueError("only 8-bit, non-interlaced gray, RGB and RGBA PNG")
    width, height, channels = header[0], header[1], CHANNELS[header[3]]
    raw = np.frombuffer(zlib.decompress(body), dtype=np.uint8).reshape(height, 1 + width * channels)
    samples = _unfilter(raw, width, channels)
    color = samples[..., :1].repeat(3, axis=2) if channels < 3 else samples[..., :3]
    alpha = samples[..., -1:] if channels in (2, 4) else np.full_like(samples[..., :1], 255)
    return np.concatenate([color, alpha], axis=2)


def is_plain(data: bytes) -> bool:
    """A whole 8-bit, non-interlaced gray, RGB or RGBA PNG without a transparent colour: every reader sees the same samples."""
    at, kinds = 8, []
    while at + 8 <= len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        kinds.append(data[at + 4 : at + 8])
        at += 12 + size
    return (
        data[:8] == SIGNATURE and kinds[:1] == [b"IHDR"] and kinds[-1:] == [b"IEND"] and at == len(data)
        and b"tRNS" not in kinds and data[24] == 8 and data[25] in (0, 2, 6) and data[28] == 0
    )
