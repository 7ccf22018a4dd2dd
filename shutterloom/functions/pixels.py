"""Pictures as arrays: decoding, scaling, marking, bright regions. Pure numpy; other formats come from an injected decoder."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


DECODED = "height int, width int, rgb binary"


def decode(content: bytes | None, other: Callable[[bytes], np.ndarray | None] | None = None) -> np.ndarray | None:
    """(height, width, 3) of a binary PNM or a plain 8-bit PNG, else what `other` makes of it; null if unreadable."""
    try:
        if content is None:
            return None
        if content[:2] in (b"P5", b"P6"):
            return _pnm(content)
        if content[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(content)
        return other(content) if other else None
    except (ValueError, IndexError, struct.error, zlib.error):
        return None


def _pnm(content: bytes) -> np.ndarray:
    fields, at = [], 2
    while len(fields) < 3:
        while content[at : at + 1].isspace():
            at += 1
        if content[at : at + 1] == b"#":
            at = content.index(b"\n", at)
            continue
        end = at
        while end < len(content) and not content[end : end + 1].isspace():
            end += 1
        fields.append(int(content[at:end]))
        at = end
    width, height, most = fields
    if most > 255:
        raise ValueError("16-bit samples")
    depth = 3 if content[:2] == b"P6" else 1
    x = np.frombuffer(content, np.uint8, width * height * depth, at + 1).reshape(height, width, depth)
    return np.repeat(x, 3, 2) if depth == 1 else x


def _png(content: bytes) -> np.ndarray:
    at, data, header = 8, b"", None
    while at < len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data += body
        at += 12 + size
    width, height, bits, color, _, _, interlaced = header
    depth = {0: 1, 2: 3, 4: 2, 6: 4}.get(color)
    if bits != 8 or depth is None or interlaced:
        raise ValueError("a kind of PNG that is not read here")
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + width * depth)
    out = np.zeros((height + 1, width + 1, depth), np.int32)
    for y in range(height):
        line = raw[y, 1:].reshape(width, depth).astype(np.int32)
        above, row = out[y, 1:], out[y + 1]
        kind = raw[y, 0]
        if kind == 0:
            row[1:] = line
        elif kind == 2:
            row[1:] = (line + above) & 255
        elif kind == 1:
            row[1:] = np.cumsum(line, 0) & 255
        else:
            for x in range(width):
                left, up, corner = row[x], above[x], out[y, x]
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    a, b, c = np.abs(p - left), np.abs(p - up), np.abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                row[x + 1] = (line[x] + guess) & 255
    pixels = out[1:, 1:].astype(np.uint8)
    return np.repeat(pixels[..., :1], 3, 2) if depth < 3 else pixels[..., :3]


def decoded(files: DataFrame, key: str = "path", other: Callable[[bytes], np.ndarray | None] | None = None) -> DataFrame:
    """`files` (key, content) as (key, DECODED); unreadable pictures have nulls."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, content in zip(frame[key], frame.content, strict=True):
                x = decode(None if content is None else bytes(content), other)
                rows.append((name, None, None, None) if x is None else (name, x.shape[0], x.shape[1], x.tobytes()))
            yield pd.DataFrame(rows, columns=[key, "height", "width", "rgb"]).astype({"height": "Int32", "width": "Int32"})

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, "content").mapInPandas(run, f"{key} {kind}, {DECODED}")


def resized(x: np.ndarray, most: int) -> np.ndarray:
    """The picture with its long side at most `most`, each pixel the mean of those it stands for."""
    h, w = x.shape[:2]
    scale = most / max(h, w)
    if scale >= 1:
        return x
    rows, cols = (np.arange(max(1, round(n * scale)) + 1) * n // max(1, round(n * scale)) for n in (h, w))
    total = np.zeros((h + 1, w + 1, x.shape[2]))
    total[1:, 1:] = x.cumsum(0, dtype=np.float64).cumsum(1)
    block = total[rows[1:]][:, cols[1:]] - total[rows[:-1]][:, cols[1:]] - total[rows[1:]][:, cols[:-1]] + total[rows[:-1]][:, cols[:-1]]
    area = np.diff(rows)[:, None, None] * np.diff(cols)[None, :, None]
    return (block / area).round().astype(np.uint8)


def framed(x: np.ndarray, box: tuple[int, int, int, int], color: tuple[int, int, int] = (255, 0, 0), width: int = 2) -> np.ndarray:
    """A copy with a box drawn on it."""
    out, (x1, y1, x2, y2) = x.copy(), box
    for rows, cols in ((slice(y1, y1 + width), slice(x1, x2)), (slice(max(y1, y2 - width), y2), slice(x1, x2)), (slice(y1, y2), slice(x1, x1 + width)), (slice(y1, y2), slice(max(x1, x2 - width), x2))):
        out[rows, cols] = color
    return out


def white(x: np.ndarray, least: int = 180, spread: int = 40) -> np.ndarray:
    """Where a picture is nearly white: bright, with channels close together."""
    y = x.astype(np.int32)
    return (y.max(2) >= least) & (y.max(2) - y.min(2) <= spread)


def mostly_white(x: np.ndarray, share: float = 0.25) -> bool:
    """F24."""
    return bool(white(x).mean() >= share)


def regions(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(pixels, x1, y1, x2, y2) of each region whose pixels touch, also at corners, the largest first, then the upper.

    Rows are cut into runs; runs of neighbouring rows that touch are tied, and ties are followed to the first run.
    """
    h, w = mask.shape
    edges = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, begin = np.nonzero(edges == 1)
    end = np.nonzero(edges == -1)[1]
    if not len(row):
        return []
    # Runs as stretches of one line, each row on a stretch of its own, so that one search finds all that touch from below.
    low, high = row * (w + 2) + begin, row * (w + 2) + end
    first, last = np.searchsorted(high, low + w + 2, "left"), np.searchsorted(low, high + w + 2, "right")
    n = np.maximum(last - first, 0)
    upper = np.repeat(np.arange(len(row)), n)
    lower = np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)
    tied = np.arange(len(row))
    while len(upper):
        a, b = tied[upper], tied[lower]
        apart = a != b
        upper, lower = upper[apart], lower[apart]
        np.minimum.at(tied, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (tied[tied] != tied).any():
            tied = tied[tied]
    roots, region = np.unique(tied, return_inverse=True)
    pixels = np.bincount(region, end - begin).astype(int)
    x1, y1, x2, y2 = np.full(len(roots), w), np.full(len(roots), h), np.zeros(len(roots), int), np.zeros(len(roots), int)
    for f, out, values in ((np.minimum, x1, begin), (np.minimum, y1, row), (np.maximum, x2, end), (np.maximum, y2, row + 1)):
        f.at(out, region, values)
    order = np.lexsort((np.arange(len(roots)), -pixels))
    return [tuple(int(v[k]) for v in (pixels, x1, y1, x2, y2)) for k in order]


def _around(m: np.ndarray, size: int) -> np.ndarray:
    """How many of the square of `size` pixels around each pixel are set."""
    before, after = size // 2, size - 1 - size // 2
    h, w = m.shape
    total = np.zeros((h + size, w + size), np.int32)
    total[before + 1 : before + 1 + h, before + 1 : before + 1 + w] = m
    np.cumsum(total, axis=0, out=total)
    np.cumsum(total, axis=1, out=total)
    return total[size:, size:] - total[:-size, size:] - total[size:, :-size] + total[:-size, :-size]


@lru_cache(maxsize=64)
def _inside(h: int, w: int, size: int) -> np.ndarray:
    return _around(np.ones((h, w), bool), size)


def closed_and_opened(mask: np.ndarray, size: int) -> np.ndarray:
    """Gaps narrower than a square of `size` pixels filled, then what is narrower taken away. Beyond the border nothing counts."""
    there = _inside(*mask.shape, size)
    for grow in (True, False, False, True):
        mask = _around(mask, size) > 0 if grow else _around(mask, size) == there
    return mask


def dense_text(x: np.ndarray, most: int = 20) -> bool:
    """more than `most` dark marks inside the picture."""
    return len(regions(x.mean(2) < 100)) > most


def has_placard(x: np.ndarray) -> bool:
    """a white region of the size and shape of a card in the lower two thirds."""
    h, w = x.shape[:2]
    small = resized(x, 160)
    return any(0.01 <= n / small[..., 0].size <= 0.30 and 1.0 <= (x2 - x1) / max(1, y2 - y1) <= 4.0 and (y1 + y2) / 2 >= small.shape[0] / 3 for n, x1, y1, x2, y2 in regions(white(small))) and h > 0 < w


#: What makes a white region a card: shares of the picture's area, width by height, how far down it begins, the free
#: border beside it, and the share of its box that is white. Fixed values.
CARD = {"least": 0.008, "most": 0.25, "wide": (1.2, 3.5), "below": 0.30, "border": 0.05, "filled": 0.65}
CARD_GAPS, CARD_MARGIN = 15, 12


def card_box(x: np.ndarray) -> tuple[int, int, int, int] | None:
    """(x1, y1, x2, y2) of the largest white region that can be a card, with a margin."""
    h, w = x.shape[:2]
    r, g, b = x[..., 0], x[..., 1], x[..., 2]
    top, low = np.maximum(np.maximum(r, g), b).astype(np.int32), np.minimum(np.minimum(r, g), b)
    mask = (top >= 170) & ((top - low) * 255 <= 40 * top)
    if not mask.any():
        return None
    for n, x1, y1, x2, y2 in regions(closed_and_opened(mask, CARD_GAPS)):
        wide, tall = x2 - x1, y2 - y1
        if CARD["least"] * h * w <= n <= CARD["most"] * h * w and CARD["wide"][0] < wide / tall < CARD["wide"][1] and y1 >= h * CARD["below"] and x1 >= w * CARD["border"] and x2 <= w * (1 - CARD["border"]) and n / (wide * tall) >= CARD["filled"]:
            return max(0, x1 - CARD_MARGIN), max(0, y1 - CARD_MARGIN), min(w, x2 + CARD_MARGIN), min(h, y2 + CARD_MARGIN)
    return None


def card_region(x: np.ndarray) -> np.ndarray:
    """The card, else the lower middle of the picture."""
    h, w = x.shape[:2]
    if box := card_box(x):
        return x[box[1] : box[3], box[0] : box[2]]
    return x[int(h * 0.45) : int(h * 0.85), int(w * 0.10) : int(w * 0.90)]


#: Pictures of a task whose answers are kept for equal ones.
KNOWN_PICTURES = 50_000


def cards(pictures: DataFrame, key: str = "id", placard: bool = True) -> DataFrame:
    """E15 and F23 of pictures (key, height, width, rgb): (key, found, x1, y1, x2, y2, placard); nulls for unreadable ones.

    Without `placard` F23 is not looked for, and its column is left out. Equal pictures that a task meets are looked at once."""
    kind = pictures.schema[key].dataType.simpleString()
    columns = ["found", "x1", "y1", "x2", "y2", *(["placard"] if placard else [])]

    def looked(h: int, w: int, rgb: bytes) -> tuple:
        x = np.frombuffer(rgb, np.uint8).reshape(h, w, 3)
        box = card_box(x)
        return (box is not None, *(box or (None,) * 4), *((has_placard(x),) if placard else ()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple, tuple] = {}
        for p in batches:
            rows = []
            for k, h, w, rgb in zip(p[key], p.height, p.width, p.rgb, strict=True):
                if rgb is None or pd.isna(h):
                    rows.append((k, *(None,) * len(columns)))
                    continue
                same = int(h), int(w), hashlib.blake2b(rgb, digest_size=32).digest()
                if same not in known:
                    if len(known) >= KNOWN_PICTURES:
                        known.clear()
                    known[same] = looked(int(h), int(w), bytes(rgb))
                rows.append((k, *known[same]))
            kinds = {c: "Int32" if c[1:].isdigit() else "boolean" for c in columns}
            yield pd.DataFrame(rows, columns=[key, *columns]).astype(kinds)

    return pictures.select(key, "height", "width", "rgb").mapInPandas(run, f"{key} {kind}, " + ", ".join(f"{c} {'int' if c[1:].isdigit() else 'boolean'}" for c in columns))


def card_variants(x: np.ndarray) -> list[np.ndarray]:
    """A card as it is, and with its grey levels stretched."""
    low, high = np.percentile(x, (2, 98))
    stretched = np.clip((x.astype(np.float64) - low) / max(high - low, 1.0) * 255, 0, 255).astype(np.uint8)
    return [x, stretched]
