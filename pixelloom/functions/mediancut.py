"""Median cut of colour histograms; the small numpy helper behind ``operators.cuts``.

Contract, per image: start with one box holding every colour. While there are
fewer than ``colors`` boxes and a box with two or more colours is left, split
the one with the largest weight (the older box on a tie). The split axis is the
longest one (R before G before B on a tie). Colours at an axis value go to the
new box when the weight at lower values, doubled, reaches the weight of the box;
the highest value always does. The colour of a box is its weighted mean, rounded
half up.

Round k makes the k-th split of every image of an Arrow batch at once, so the
number of numpy calls depends on ``colors`` and not on the number of images.

A cut is kept as its splits in order: split k moves the colours of a box whose
value on an axis reaches a threshold to box k + 1, so splits and palette are all
that a pixel needs to find its colour.
"""

from __future__ import annotations

import numpy as np


def packed_split(slot, axis, threshold):
    return (slot << 16) | (axis << 8) | threshold


def channels_of(rgb: np.ndarray) -> np.ndarray:
    return np.stack([(rgb >> 16) & 255, (rgb >> 8) & 255, rgb & 255])


def median_cut(rgb: np.ndarray, weight: np.ndarray, starts: np.ndarray, colors: int) -> np.ndarray:
    """Replacement colours 0xRRGGBB for distinct colours 0xRRGGBB.

    Image i owns the entries from ``starts[i]`` up to the next start; no image
    is empty.
    """
    image, box, _, palette = cut(rgb, weight, starts, colors)
    return palette[image, box]


def paint(rgb: np.ndarray, image: np.ndarray, splits: np.ndarray, palette: np.ndarray) -> np.ndarray:
    """Palette colour of every colour; splits (images, k) and palette (images, n) of its image, splits padded with -1."""
    return palette[image, boxes_of(rgb, image, splits)]


def boxes_of(rgb: np.ndarray, image: np.ndarray, splits: np.ndarray) -> np.ndarray:
    """Box of every colour after the splits of its image."""
    axes = channels_of(rgb)
    box = np.zeros(len(rgb), dtype=np.int64)
    every = np.arange(len(rgb))
    for k in range(splits.shape[1]):
        split = splits[:, k][image]
        axis = np.maximum(split >> 8, 0) & 3  # an absent split is box -1
        box[(box == split >> 16) & (axes[axis, every] >= (split & 255))] = k + 1
    return box


def cut(
    rgb: np.ndarray, weight: np.ndarray, starts: np.ndarray, colors: int
) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """(image and box of every entry, splits of every image, palette (images, colors)) of ``median_cut``."""
    images = len(starts)
    sizes = np.diff(np.append(starts, len(rgb)))
    image = np.repeat(np.arange(images), sizes)
    axes = channels_of(rgb)
    splits = np.full((images, colors - 1), -1, dtype=np.int64)
    box = np.zeros(len(rgb), dtype=np.int64)
    boxes = np.ones(images, dtype=np.int64)
    # Weight of every box that can still be split, else 0.
    splittable = np.zeros((images, colors))
    splittable[:, 0] = np.where(sizes > 1, np.add.reduceat(weight, starts), 0)
    while True:
        chosen = splittable.argmax(axis=1)
        active = (splittable[np.arange(images), chosen] > 0) & (boxes < colors)
        if not active.any():
            break
        chosen[~active] = -1
        rows = np.flatnonzero(box == chosen[image])
        owner = image[rows]
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        split, segment = owner[first], np.repeat(
            np.arange(len(first)), np.diff(np.append(first, len(rows)))
        )
        part, w = axes[:, rows], weight[rows]
        low = np.minimum.reduceat(part, first, axis=1)
        axis = (np.maximum.reduceat(part, first, axis=1) - low).argmax(axis=0)
        value = part[axis[segment], np.arange(len(rows))] - low[axis, np.arange(len(first))][segment]
        at_value = np.bincount(
            segment * 256 + value, weights=w, minlength=len(first) * 256
        ).reshape(-1, 256)
        total = at_value.sum(axis=1)
        below = at_value.cumsum(axis=1) - at_value
        upper_values = below * 2 >= total[:, None]
        upper_values[np.arange(len(first)), np.maximum.reduceat(value, first)] = True
        upper = upper_values[segment, value]
        box[rows[upper]] = boxes[owner[upper]]
        threshold = low[axis, np.arange(len(first))] + upper_values.argmax(axis=1)
        splits[split, boxes[split] - 1] = packed_split(chosen[split], axis, threshold)
        for slot, side in ((chosen[split], ~upper), (boxes[split], upper)):
            members = np.bincount(segment[side], minlength=len(first))
            mass = np.bincount(segment[side], weights=w[side], minlength=len(first))
            splittable[split, slot] = np.where(members > 1, mass, 0)
        boxes[split] += 1
    group = image * colors + box
    mass = np.bincount(group, weights=weight, minlength=images * colors)
    palette = np.zeros(images * colors, dtype=np.int64)
    for channel in axes:
        total = np.bincount(group, weights=channel * weight, minlength=images * colors)
        palette = (palette << 8) | mean(total.astype(np.int64), mass.astype(np.int64))
    return image, box, [splits[i, : boxes[i] - 1] for i in range(images)], palette.reshape(images, colors)


def mean(total: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """total / mass, rounded half up; 0 without mass."""
    return (2 * total + mass) // np.maximum(2 * mass, 1)


# --- one image in parts ------------------------------------------------------------------

OPEN, WHOLE = -2, -1  # the axis of a box whose counts are not known yet, and of one colour
CELLS = 3 * 256  # counts of a box: by axis and value


class Growing:
    """The boxes of one image while its histogram lies in many parts.

    The parts count the colours of every open box by axis and value; from those
    counts alone a box gets its mean, its axis and its threshold. ``grow`` then
    makes the splits that the contract makes next, up to the first box whose
    counts are still to come.
    """

    def __init__(self, splits, weight, mean, axis, threshold, lower):
        self.splits, self.weight, self.mean = list(splits), list(weight), list(mean)
        self.axis, self.threshold, self.lower = list(axis), list(threshold), list(lower)

    @classmethod
    def start(cls) -> Growing:
        return cls([], [0], [0], [OPEN], [0], [0])

    def open(self) -> list[int]:
        return [i for i, axis in enumerate(self.axis) if axis == OPEN]

    def learn(self, box: int, counts: np.ndarray) -> None:
        """counts (3, 256) of the colours of an open box."""
        total = int(counts[0].sum())
        values = np.arange(256)
        red, green, blue = (int(mean((row * values).sum(), np.int64(total))) for row in counts)
        low = [int(np.flatnonzero(row)[0]) for row in counts]
        high = [int(np.flatnonzero(row)[-1]) for row in counts]
        spread = [h - l for h, l in zip(high, low)]
        axis = spread.index(max(spread))
        self.weight[box], self.mean[box] = total, (red << 16) | (green << 8) | blue
        if not spread[axis]:
            self.axis[box] = WHOLE
            return
        below = counts[axis].cumsum() - counts[axis]
        upper = below * 2 >= total
        upper[high[axis]] = True
        at = int(upper.argmax())
        self.axis[box], self.threshold[box], self.lower[box] = axis, at, int(counts[axis][:at].sum())

    def grow(self, colors: int) -> None:
        while len(self.axis) < colors:
            able = [i for i, axis in enumerate(self.axis) if axis != WHOLE]
            if not able:
                return
            box = max(able, key=lambda i: (self.weight[i], -i))
            if self.axis[box] == OPEN:
                return
            self.splits.append(packed_split(box, self.axis[box], self.threshold[box]))
            self.weight.append(self.weight[box] - self.lower[box])
            self.weight[box] = self.lower[box]
            self.axis[box] = OPEN
            for row, value in ((self.mean, 0), (self.axis, OPEN), (self.threshold, 0), (self.lower, 0)):
                row.append(value)
