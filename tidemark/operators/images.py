"""Change metrics of grey frames, in Arrow batches: images are no columns that Spark could compute with."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The size frames are compared at, the difference that counts as change, and the masked parts (of height and width).
WIDTH, HEIGHT, CHANGED = 320, 180, 20
TOP, BOTTOM, CORNER = 0.06, 0.90, (0.72, 0.78)
KERNEL = np.array([1, 4, 6, 4, 1]) / 16


def resized(image: np.ndarray, height: int = HEIGHT, width: int = WIDTH) -> np.ndarray:
    """Bilinear, by the centres of the pixels."""
    def along(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), at - low

    (a, b, v), (c, d, w) = along(image.shape[0], height), along(image.shape[1], width)
    rows = image[a] * (1 - v)[:, None] + image[b] * v[:, None]
    return rows[:, c] * (1 - w) + rows[:, d] * w


def analysis_frame(image: np.ndarray) -> np.ndarray:
    """A grey image at the size of comparison, blurred by five pixels, without the parts where players and presenters stand."""
    x = np.pad(resized(image.astype(float)), 2, mode="reflect")
    x = sum(k * x[:, i : i + WIDTH] for i, k in enumerate(KERNEL))
    x = np.rint(sum(k * x[i : i + HEIGHT] for i, k in enumerate(KERNEL)))
    x[: int(HEIGHT * TOP)] = 0
    x[int(HEIGHT * BOTTOM) :] = 0
    x[int(HEIGHT * CORNER[0]) :, int(WIDTH * CORNER[1]) :] = 0
    return x.astype(np.uint8)


def component_sizes(mask: np.ndarray) -> np.ndarray:
    """Pixels of each connected part, diagonals included: labels spread over runs of rows and columns until none changes."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        p, best = np.pad(label, 1), label
        for i in range(3):
            for j in range(3):
                best = np.maximum(best, p[i : i + mask.shape[0], j : j + mask.shape[1]])
        best = np.where(mask, best, 0)
        # A label may jump to its label's label, so that long parts need few rounds.
        flat = np.r_[0, best.ravel()]
        for _ in range(4):
            flat[1:] = np.where(best.ravel() > 0, flat[flat[1:]], 0)
        best = flat[1:].reshape(mask.shape)
        if (best == label).all():
            return np.unique(label[mask], return_counts=True)[1]
        label = best


def change_metrics(before: np.ndarray, now: np.ndarray) -> tuple[float, float, float, float]:
    """(mean difference, share of changed pixels, share of the largest changed part, parts)."""
    differ = np.abs(before.astype(int) - now.astype(int))
    mask = differ > CHANGED
    sizes = component_sizes(mask) if mask.any() else np.zeros(0, int)
    return float(differ.mean()), float(mask.mean()), float(sizes.max(initial=0) / mask.size), float(len(sizes))


def with_change_metrics(frames: DataFrame) -> DataFrame:
    """frames (stream_id, event_id, ts, image binary, height, width) with the metrics against the frame before; the first has none (0). Images leave with their rows."""
    order = Window.partitionBy("stream_id").orderBy("ts", "event_id")
    pairs = frames.withColumns({f"last_{c}": F.lag(c).over(order) for c in ("image", "height", "width")})
    names = ["scene_score", "change_ratio", "component_ratio", "component_count"]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grey = lambda data, h, w: analysis_frame(np.frombuffer(data, np.uint8).reshape(int(h), int(w)))
        for b in batches:
            rows = [change_metrics(grey(*x[:3]), grey(*x[3:])) if x[0] is not None and x[3] is not None else (0.0, 0.0, 0.0, 0.0) for x in zip(*(b[c] for c in ("last_image", "last_height", "last_width", "image", "height", "width")), strict=True)]
            yield b[["stream_id", "event_id", "ts"]].assign(**{n: [r[k] for r in rows] for k, n in enumerate(names)})

    kinds = {f.name: f.dataType.simpleString() for f in frames.schema}
    return pairs.mapInPandas(work, ", ".join([f"{c} {kinds[c]}" for c in ("stream_id", "event_id", "ts")] + [f"{n} double" for n in names]))
