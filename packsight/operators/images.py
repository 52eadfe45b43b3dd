"""Stage 0 image operators on numpy arrays, with Arrow drivers over Spark's image rows.

Masks and boxes are computed one image at a time; images stay on the executor that decoded them,
only crops' boxes, notes and hashes leave it unless pixels are asked for. The learned matte, codecs
and bar decoders are pluggable functions; without one the operators say so in their notes.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import merged_boxes
from ..shipping import ship


def rgb_of(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Spark's image bytes (BGR or BGRA or grey) as RGB; transparency is laid on white."""
    x = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    if channels == 1:
        return np.repeat(x, 3, axis=2)
    rgb = x[:, :, 2::-1]
    if channels == 4:
        alpha = x[:, :, 3:].astype(np.float32) / 255
        rgb = np.round(rgb * alpha + 255 * (1 - alpha)).astype(np.uint8)
    return np.ascontiguousarray(rgb)


def exif_orientation(content: bytes) -> int:
    """Orientation (1 to 8) of a JPEG file's EXIF block; 1 where there is none."""
    at = 2
    while content[:2] == b"\xff\xd8" and at + 4 <= len(content) and content[at] == 0xFF:
        marker, size = content[at + 1], int.from_bytes(content[at + 2 : at + 4], "big")
        block = content[at + 4 : at + 2 + size]
        if marker == 0xE1 and block[:6] == b"Exif\0\0":
            tiff = block[6:]
            order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
            if order is None or len(tiff) < 8:
                return 1
            start = struct.unpack(order + "I", tiff[4:8])[0]
            count = struct.unpack(order + "H", tiff[start : start + 2])[0] if start + 2 <= len(tiff) else 0
            for k in range(count):
                entry = tiff[start + 2 + 12 * k : start + 14 + 12 * k]
                if len(entry) == 12 and struct.unpack(order + "H", entry[:2])[0] == 274:
                    value = struct.unpack(order + "H", entry[8:10])[0]
                    return value if 1 <= value <= 8 else 1
            return 1
        if marker == 0xDA:
            break
        at += 2 + size
    return 1


def oriented(rgb: np.ndarray, orientation: int) -> np.ndarray:
    """The image turned upright."""
    turns = {3: 2, 4: 2, 5: 3, 6: 3, 7: 1, 8: 1}.get(orientation, 0)
    out = np.rot90(rgb, turns)
    return np.ascontiguousarray(out[:, ::-1] if orientation in (2, 4, 5, 7) else out)


def border_pixels(rgb: np.ndarray, share: float = 0.03) -> np.ndarray:
    """Pixels of a ring along the image's edge."""
    h, w = rgb.shape[:2]
    k = max(1, int(min(h, w) * share))
    return np.concatenate([rgb[:k].reshape(-1, 3), rgb[-k:].reshape(-1, 3), rgb[k:-k, :k].reshape(-1, 3), rgb[k:-k, -k:].reshape(-1, 3)])


def corner_colour(rgb: np.ndarray, size: int = 12) -> tuple[int, int, int]:
    """Median colour of the four corners."""
    k = max(1, min(size, rgb.shape[0] // 2, rgb.shape[1] // 2))
    corners = np.concatenate([c.reshape(-1, 3) for c in (rgb[:k, :k], rgb[:k, -k:], rgb[-k:, :k], rgb[-k:, -k:])])
    return tuple(int(v) for v in np.median(corners, axis=0))


def backdrop(rgb: np.ndarray, clusters: int = 3, least: float = 0.08, most: int = 20_000) -> tuple[np.ndarray, float]:
    """Backdrop colours from the border ring, and the distance within which a pixel belongs to them."""
    ring = border_pixels(rgb).astype(np.float32)
    if len(ring) > most:
        ring = ring[np.random.default_rng(0).choice(len(ring), most, replace=False)]
    centres = np.quantile(ring, np.linspace(0.1, 0.9, clusters), axis=0)
    for _ in range(20):
        near = ((ring[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.stack([ring[near == k].mean(axis=0) if (near == k).any() else centres[k] for k in range(clusters)])
    sizes = np.bincount(near, minlength=clusters) / len(ring)
    centres = centres[sizes >= least]
    distance = np.sqrt(((ring[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1))
    return centres, max(15.0, 1.3 * float(np.quantile(distance, 0.95)) + 8)


def gradient(grey: np.ndarray) -> np.ndarray:
    """Absolute Sobel response, both directions added."""
    p = np.pad(grey.astype(np.float32), 1, mode="edge")
    rows = p[:-2] + 2 * p[1:-1] + p[2:]
    columns = p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    return np.abs(rows[:, 2:] - rows[:, :-2]) + np.abs(columns[2:] - columns[:-2])


def edge_density(rgb: np.ndarray, region: np.ndarray, level: float = 150.0) -> float:
    """Share of a region's pixels that lie on an edge."""
    return float((gradient(rgb.mean(axis=2)) > level)[region].mean()) if region.any() else 0.0


def dilate(mask: np.ndarray, size: int) -> np.ndarray:
    """Any set pixel within a square of the size."""
    k = size // 2
    sums = np.pad(np.pad(mask.astype(np.int32), k).cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
    n = 2 * k + 1
    return sums[n:, n:] - sums[:-n, n:] - sums[n:, :-n] + sums[:-n, :-n] > 0


def erode(mask: np.ndarray, size: int) -> np.ndarray:
    return ~dilate(~mask, size)


def fill_outlines(mask: np.ndarray) -> np.ndarray:
    """Everything that can't be reached from the image's edge through unset pixels."""
    outside = np.zeros_like(mask)
    outside[[0, -1]], outside[:, [0, -1]] = ~mask[[0, -1]], ~mask[:, [0, -1]]
    while True:
        grown = outside.copy()
        for axis in (0, 1):  # sweep along lines, both ways
            for flip in (False, True):
                g, free = (np.flip(a, axis) if flip else a for a in (grown, ~mask))
                g, free = (np.moveaxis(a, axis, 0) for a in (g, free))
                for k in range(1, len(g)):
                    g[k] |= g[k - 1] & free[k]
        if (grown == outside).all():
            return ~outside
        outside = grown


def components(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """x, y, w, h and area of each connected part (four neighbours), by runs of rows."""
    parent: list[int] = []
    boxes: list[list[int]] = []

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    before: list[tuple[int, int, int]] = []
    for y, row in enumerate(mask):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]])))
        now = []
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            touching = {root(k) for p, q, k in before if p < b and a < q}
            if touching:
                k = min(touching)
                for other in touching - {k}:
                    parent[other] = k
                    boxes[k] = [min(boxes[k][0], boxes[other][0]), min(boxes[k][1], boxes[other][1]), max(boxes[k][2], boxes[other][2]), max(boxes[k][3], boxes[other][3]), boxes[k][4] + boxes[other][4]]
                boxes[k] = [min(boxes[k][0], a), boxes[k][1], max(boxes[k][2], b), y + 1, boxes[k][4] + b - a]
            else:
                k = len(parent)
                parent.append(k)
                boxes.append([a, y, b, y + 1, b - a])
            now.append((a, b, k))
        before = now
    return [(x, y, x2 - x, y2 - y, area) for k, (x, y, x2, y2, area) in enumerate(boxes) if parent[k] == k]


def segment(rgb: np.ndarray, matte: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, str]:
    """Foreground mask and the reason for it. In doubt the whole image is kept."""
    whole = np.ones(rgb.shape[:2], dtype=bool)
    if matte is not None:
        mask = matte(rgb) > 127
        if 0.02 <= mask.mean() <= 0.98:
            return mask, "matte"
    centres, reach = backdrop(rgb)
    distance = np.sqrt(((rgb[:, :, None].astype(np.float32) - centres[None, None]) ** 2).sum(axis=3).min(axis=2))
    mask = fill_outlines(erode(dilate(distance > reach, 5), 5))
    if mask.mean() < 0.02:
        return whole, "too little foreground: kept whole"
    if edge_density(rgb, ~mask) > 0.015:
        return whole, "print in the backdrop: kept whole"
    return mask, "backdrop"


def skew_angle(mask: np.ndarray) -> float:
    """Angle in degrees, within -45 to 45, of the smallest rectangle around a mask."""
    ys, xs = np.nonzero(mask)
    if len(xs) < 10:
        return 0.0
    points = np.stack([xs, ys], axis=1).astype(np.float64)
    points = points[:: max(1, len(points) // 20_000)]
    best = min(np.arange(-45.0, 45.0, 0.25), key=lambda a: (_area(points, a), abs(a)))
    return float(best)


def _area(points: np.ndarray, degrees: float) -> float:
    a = np.deg2rad(degrees)
    turned = points @ np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])
    return float(np.prod(turned.max(axis=0) - turned.min(axis=0)))


def rotate(rgb: np.ndarray, degrees: float) -> np.ndarray:
    """Turn by an angle on a canvas that holds all of it, padded with the corners' colour."""
    a, (h, w) = np.deg2rad(degrees), rgb.shape[:2]
    c, s = abs(np.cos(a)), abs(np.sin(a))
    nh, nw = int(round(h * c + w * s)), int(round(h * s + w * c))
    y, x = np.mgrid[:nh, :nw]
    x, y = x - (nw - 1) / 2, y - (nh - 1) / 2
    sx, sy = np.cos(a) * x - np.sin(a) * y + (w - 1) / 2, np.sin(a) * x + np.cos(a) * y + (h - 1) / 2
    inside = (sx >= 0) & (sx <= w - 1) & (sy >= 0) & (sy <= h - 1)
    out = np.empty((nh, nw, 3), dtype=np.uint8)
    out[:] = corner_colour(rgb)
    out[inside] = rgb[np.round(sy[inside]).astype(int), np.round(sx[inside]).astype(int)]
    return out


def resized(rgb: np.ndarray, scale: float) -> np.ndarray:
    """Bilinear when enlarging, box average of nearby pixels when shrinking."""
    h, w = rgb.shape[:2]
    nh, nw = max(1, round(h * scale)), max(1, round(w * scale))
    if scale < 1:
        ys, xs = (np.arange(nh) * h // nh), (np.arange(nw) * w // nw)
        sums = np.add.reduceat(np.add.reduceat(rgb.astype(np.float64), ys, axis=0), xs, axis=1)
        counts = np.diff(np.append(ys, h))[:, None] * np.diff(np.append(xs, w))[None]
        return np.round(sums / counts[:, :, None]).astype(np.uint8)
    y, x = np.clip((np.arange(nh) + 0.5) / scale - 0.5, 0, h - 1), np.clip((np.arange(nw) + 0.5) / scale - 0.5, 0, w - 1)
    y0, x0 = np.minimum(y.astype(int), max(0, h - 2)), np.minimum(x.astype(int), max(0, w - 2))
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    f = rgb.astype(np.float64)
    top, low = f[y0][:, x0] * (1 - fx) + f[y0][:, x1] * fx, f[y1][:, x0] * (1 - fx) + f[y1][:, x1] * fx
    return np.round(top * (1 - fy) + low * fy).astype(np.uint8)


def band_scale(h: int, w: int, low: int = 900, high: int = 2200) -> float:
    scale = low / min(h, w) if min(h, w) < low else high / max(h, w) if max(h, w) > high else 1.0
    return 1.0 if abs(scale - 1) < 0.01 else scale


def local_contrast(rgb: np.ndarray, limit: float = 2.0, grid: int = 8) -> np.ndarray:
    """Histogram equalisation of the lightness, clipped and interpolated between tiles."""
    light = rgb.max(axis=2)
    h, w = light.shape
    ys, xs = np.linspace(0, h, grid + 1).astype(int), np.linspace(0, w, grid + 1).astype(int)
    maps = np.empty((grid, grid, 256))
    for i in range(grid):
        for j in range(grid):
            tile = light[ys[i] : max(ys[i + 1], ys[i] + 1), xs[j] : max(xs[j + 1], xs[j] + 1)]
            counts = np.bincount(tile.ravel(), minlength=256).astype(np.float64)
            cut = max(1.0, limit * tile.size / 256)
            counts = np.minimum(counts, cut) + np.maximum(counts - cut, 0).sum() / 256
            maps[i, j] = counts.cumsum() / counts.sum() * 255
    y, x = np.clip(np.arange(h) * grid / h - 0.5, 0, grid - 1), np.clip(np.arange(w) * grid / w - 0.5, 0, grid - 1)
    i0, j0 = y.astype(int), x.astype(int)
    i1, j1 = np.minimum(i0 + 1, grid - 1), np.minimum(j0 + 1, grid - 1)
    fy, fx = (y - i0)[:, None], (x - j0)[None]
    at = lambda i, j: maps[i[:, None], j[None], light]
    new = (at(i0, j0) * (1 - fx) + at(i0, j1) * fx) * (1 - fy) + (at(i1, j0) * (1 - fx) + at(i1, j1) * fx) * fy
    return np.clip(np.round(rgb * (new / np.maximum(light, 1))[:, :, None]), 0, 255).astype(np.uint8)


def crop_box(mask: np.ndarray, pad: int = 12) -> tuple[int, int, int, int] | None:
    """The mask's padded bounding box; null when it holds nothing or nearly everything."""
    if not 0 < mask.mean() <= 0.98:
        return None
    ys, xs = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    x, y = max(0, xs[0] - pad), max(0, ys[0] - pad)
    return int(x), int(y), int(min(mask.shape[1], xs[-1] + 1 + pad) - x), int(min(mask.shape[0], ys[-1] + 1 + pad) - y)


def instance_boxes(mask: np.ndarray, least: float = 0.005, pad: int = 8) -> list[tuple[int, int, int, int]]:
    """Padded boxes of the separate things in a mask, left to right; the whole image if there are none."""
    h, w = mask.shape
    large = [b[:4] for b in components(mask) if b[4] >= least * h * w]
    boxes = [(max(0, x - pad), max(0, y - pad), min(w, x + bw + pad) - max(0, x - pad), min(h, y + bh + pad) - max(0, y - pad)) for x, y, bw, bh in merged_boxes(large)]
    return boxes or [(0, 0, w, h)]


def bar_regions(rgb: np.ndarray, most: int = 4, least: int = 400) -> list[tuple[int, int, int, int]]:
    """Boxes likely to hold bars, the largest of each orientation first."""
    grey = np.pad(rgb.mean(axis=2), 1, mode="edge")
    across, along = np.abs(grey[1:-1, 2:] - grey[1:-1, :-2]), np.abs(grey[2:, 1:-1] - grey[:-2, 1:-1])
    found = []
    for strong in (across - along, along - across):
        mask = dilate(erode(erode(dilate(np.clip(strong, 0, 255) > 50, 21), 21), 9), 9)
        found += [b[:4] for b in sorted(components(mask), key=lambda b: -b[4])[:most] if b[4] > least]
    return found


def crop_region(rgb: np.ndarray, points: list[tuple[int, int]], pad: int = 15) -> np.ndarray | None:
    if not points:
        return None
    xs, ys = zip(*points)
    part = rgb[max(0, int(min(ys)) - pad) : int(max(ys)) + pad, max(0, int(min(xs)) - pad) : int(max(xs)) + pad]
    return part if part.size else None


def decode_ladder(rgb: np.ndarray, decode: Callable[[np.ndarray], str | None], valid: Callable[[str], bool]) -> tuple[str, str] | None:
    """(code, step): directly, then enlarged, two-tone and turned, then in likely regions."""

    def tries(image: np.ndarray, name: str) -> Iterator[tuple[str, np.ndarray]]:
        yield name, image
        for scale in (2, 3, 4):
            big = resized(image, scale)
            grey = big.mean(axis=2)
            two = np.repeat(((grey > (grey.min() + grey.max()) / 2) * np.uint8(255))[:, :, None], 3, axis=2)
            for turn in range(4):
                yield f"{name} x{scale} turned {90 * turn}", np.rot90(two, turn)

    for name, image in tries(rgb, "direct"):
        if (code := decode(image)) and valid(code):
            return code, name
    for x, y, w, h in bar_regions(rgb):
        for name, image in tries(rgb[y : y + h, x : x + w], "region"):
            if (code := decode(image)) and valid(code):
                return code, name
    return None


@dataclass(frozen=True)
class Steps:
    """Which steps of Stage 0 run, and their parameters."""

    deskew: bool = True
    contrast: bool = True
    resolution: bool = True
    crop: bool = True
    split: bool = True
    low: int = 900
    high: int = 2200
    least_area: float = 0.005


def prepare(rgb: np.ndarray, steps: Steps = Steps(), matte: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[list[np.ndarray], np.ndarray, list[str]]:
    """Crops, the image before cropping, and a note for every step that changed something."""
    notes = []
    if steps.deskew:
        angle = skew_angle(segment(rgb)[0])
        if 0.5 < abs(angle) <= 15:
            rgb = rotate(rgb, angle)
            notes.append(f"deskew {angle:.2f}")
    if steps.contrast:
        rgb = local_contrast(rgb)
        notes.append("contrast")
    if steps.resolution and (scale := band_scale(*rgb.shape[:2], steps.low, steps.high)) != 1.0:
        rgb = resized(rgb, scale)
        notes.append(f"scale {scale:.3f}")
    crops, cuts = cut(rgb, steps, matte)
    return crops, rgb, notes + cuts


def cut(rgb: np.ndarray, steps: Steps = Steps(), matte: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[list[np.ndarray], list[str]]:
    """The crops of an image that is otherwise prepared, and notes."""
    if not (steps.crop or steps.split):
        return [rgb], []
    mask, reason = segment(rgb, matte)
    notes = [f"mask: {reason}"]
    if steps.crop and (box := crop_box(mask)):
        x, y, w, h = box
        rgb, mask = rgb[y : y + h, x : x + w], mask[y : y + h, x : x + w]
        notes.append(f"crop {w}x{h}")
    if not steps.split:
        return [rgb], notes
    boxes = instance_boxes(mask, steps.least_area)
    return [rgb[y : y + h, x : x + w] for x, y, w, h in boxes], notes + [f"{len(boxes)} crops"]


CROPS = "path string, crop int, height int, width int, data binary, key string, notes array<string>"


def _rows(path: str, numbered: list[tuple[int, np.ndarray]], notes: list[str]) -> pd.DataFrame:
    import hashlib

    rows = [(path, k, c.shape[0], c.shape[1], c.tobytes(), hashlib.sha256(f"{c.shape[0]}:{c.shape[1]}:".encode() + c.tobytes()).hexdigest(), notes) for k, c in numbered]
    return pd.DataFrame(rows, columns=["path", "crop", "height", "width", "data", "key", "notes"])


def prepare_images(images: DataFrame, steps: Steps = Steps(), matte: Callable[[np.ndarray], np.ndarray] | None = None, uncropped: bool = False) -> DataFrame:
    """path, crop, height, width, data (RGB), key (hash with shape), notes; one row a crop.

    images: rows of Spark's image source, and the file's bytes as `content` if photos are to be turned
    upright by their EXIF block. Images that can't be decoded give no rows. uncropped: the image
    before cropping is added as crop -1, which is what bars are to be looked for in.
    """
    ship(images.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                if row.height <= 0:
                    continue
                rgb, turned = rgb_of(row.data, row.height, row.width, row.nChannels), []
                orientation = exif_orientation(row.content) if row.content else 1
                if orientation != 1:
                    rgb, turned = oriented(rgb, orientation), [f"orientation {orientation}"]
                crops, before, notes = prepare(rgb, steps, matte)
                yield _rows(row.origin, [*([(-1, before)] if uncropped else []), *enumerate(crops)], turned + notes)

    content = "content" if "content" in images.columns else F.lit(None).cast("binary").alias("content")
    return images.select("image.*", content).mapInPandas(run, CROPS)


def matte_images(images: DataFrame, matte: Callable[[np.ndarray], np.ndarray], cache: DataFrame | None = None) -> DataFrame:
    """key, alpha (a byte a pixel), cached of every distinct image (key, height, width, data as RGB).

    Images with a row in cache (key, alpha) aren't given to the model. Alphas are kept as they come;
    what counts as foreground is decided where they are used. New rows can be added to the cache.
    """
    ship(images.sparkSession)
    result = "key string, alpha binary"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            alphas = [matte(np.frombuffer(r.data, dtype=np.uint8).reshape(r.height, r.width, 3)).astype(np.uint8).tobytes() for r in frame.itertuples()]
            yield pd.DataFrame({"key": frame["key"], "alpha": alphas})

    distinct = images.select("key", "height", "width", "data").dropDuplicates(["key"])
    if cache is None:
        return distinct.mapInPandas(run, result).withColumn("cached", F.lit(False))
    known = cache.select("key", "alpha").join(distinct.select("key"), "key", "left_semi").withColumn("cached", F.lit(True))
    return distinct.join(cache, "key", "left_anti").mapInPandas(run, result).withColumn("cached", F.lit(False)).unionByName(known)


def cut_images(images: DataFrame, mattes: DataFrame, steps: Steps = Steps()) -> DataFrame:
    """Crops, as prepare_images gives them, of images that were prepared without cropping and splitting.

    mattes: key, alpha. An image without one, or with one that holds nearly nothing or everything, is
    segmented by its backdrop.
    """
    ship(images.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                rgb = np.frombuffer(row.data, dtype=np.uint8).reshape(row.height, row.width, 3)
                alpha = None if row.alpha is None else np.frombuffer(row.alpha, dtype=np.uint8).reshape(row.height, row.width)
                crops, notes = cut(rgb, steps, None if alpha is None else lambda _, a=alpha: a)
                yield _rows(row.path, list(enumerate(crops)), [*row.notes, *notes])

    return images.select("path", "key", "height", "width", "data", "notes").join(mattes.select("key", "alpha"), "key", "left").mapInPandas(run, CROPS)


def decode_images(images: DataFrame, decode: Callable[[np.ndarray], str | None], valid: Callable[[str], bool], cache: DataFrame | None = None) -> DataFrame:
    """key, code, step, cached of every distinct image (key, height, width, data as RGB).

    Images with a row in cache (key, code, step) aren't decoded: a row without a code says that the
    ladder has found nothing, an image without a row has not been tried. New rows can be added to it.
    """
    ship(images.sparkSession)
    result = "key string, code string, step string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [decode_ladder(np.frombuffer(r.data, dtype=np.uint8).reshape(r.height, r.width, 3), decode, valid) or (None, None) for r in frame.itertuples()]
            yield pd.DataFrame({"key": frame["key"], "code": [c for c, _ in found], "step": [s for _, s in found]})

    distinct = images.select("key", "height", "width", "data").dropDuplicates(["key"])
    if cache is None:
        return distinct.mapInPandas(run, result).withColumn("cached", F.lit(False))
    known = cache.select("key", "code", "step").join(distinct.select("key"), "key", "left_semi").withColumn("cached", F.lit(True))
    return distinct.join(cache, "key", "left_anti").mapInPandas(run, result).withColumn("cached", F.lit(False)).unionByName(known)
