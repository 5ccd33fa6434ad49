"""Hashes and differences of images held as bytes: PNG of 8 bits a channel, and portable grey and colour maps."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.engine.batches import keyed, restored


def decode(data: bytes) -> np.ndarray:
    """Grey values (height, width) from 0 to 255; ValueError for what can't be read."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return _png(data)
    if data[:2] in (b"P5", b"P6"):
        parts = data.split(maxsplit=4)
        w, h, top = int(parts[1]), int(parts[2]), int(parts[3])
        n = 1 if data[:2] == b"P5" else 3
        body = np.frombuffer(data, np.uint8, w * h * n, len(data) - w * h * n).reshape(h, w, n).astype(np.float64)
        return _grey(body) * (255 / max(1, top))
    raise ValueError("the image is in no format that can be read")


def _grey(a: np.ndarray) -> np.ndarray:
    if a.shape[2] < 3:
        return a[:, :, 0]
    return a[:, :, :3] @ np.array([0.299, 0.587, 0.114])


def _png(data: bytes) -> np.ndarray:
    at, body, palette = 8, b"", None
    w = h = depth = colour = lace = 0
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h, depth, colour, _, _, lace = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += chunk
        at += 12 + n
    if depth != 8 or lace or colour not in (0, 2, 3, 4, 6) or w * h > 100_000_000:
        raise ValueError("the image is of a kind that can't be read")
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, w * n + 1)
    out = np.zeros((h, w * n), np.uint8)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        up = out[y - 1].astype(np.int64) if y else np.zeros(w * n, np.int64)
        if kind == 2:
            line = line + up
        elif kind == 1:
            line = np.cumsum(line.reshape(w, n), 0).reshape(-1)
        elif kind in (3, 4):
            for i in range(w * n):
                a = line[i - n] if i >= n else 0
                b, c = up[i], up[i - n] if i >= n else 0
                if kind == 3:
                    line[i] += (a + b) // 2
                else:
                    p = a + b - c
                    da, db, dc = abs(p - a), abs(p - b), abs(p - c)
                    line[i] += a if da <= db and da <= dc else b if db <= dc else c
                line[i] &= 255
        out[y] = line & 255
    px = out.reshape(h, w, n)
    return _grey(palette[px[:, :, 0]].astype(np.float64) if colour == 3 and palette is not None else px.astype(np.float64))


def cells(grey: np.ndarray, w: int, h: int) -> np.ndarray:
    """Mean grey of w x h cells."""
    ys, xs = np.linspace(0, grey.shape[0], h + 1), np.linspace(0, grey.shape[1], w + 1)
    out = np.zeros((h, w))
    for j in range(h):
        for i in range(w):
            a, b = int(ys[j]), max(int(ys[j]) + 1, int(ys[j + 1]))
            c, d = int(xs[i]), max(int(xs[i]) + 1, int(xs[i + 1]))
            out[j, i] = grey[a:b, c:d].mean()
    return out


def _bits(b: np.ndarray) -> int:
    n = int("".join("1" if x else "0" for x in b.reshape(-1)), 2)
    return n - 2**64 if n >= 2**63 else n


def dhash(grey: np.ndarray) -> int:
    """64 bits of whether each of 9 x 8 cells is brighter than the next in its row."""
    g = cells(grey, 9, 8)
    return _bits(g[:, :-1] > g[:, 1:])


def phash(grey: np.ndarray) -> int:
    """64 bits of whether the lowest 8 x 8 cosine coefficients of 32 x 32 cells are above the median without the first."""
    g, k = cells(grey, 32, 32), np.arange(32)
    basis = np.cos(np.pi * (2 * k[None] + 1) * np.arange(8)[:, None] / 64)
    c = (basis @ g @ basis.T).reshape(-1)
    return _bits(c > np.sort(c[1:])[31])


def hashes(images: DataFrame, id_col: str, bytes_col: str) -> DataFrame:
    """(id, width, height, dhash, phash, error): null hashes and a sentence for what can't be read."""
    kind = images.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, data in zip(b["id_"], b["data_"]):
                try:
                    g = decode(bytes(data))
                    rows.append((key, g.shape[1], g.shape[0], dhash(g), phash(g), None))
                except (ValueError, zlib.error, struct.error, IndexError) as x:
                    rows.append((key, None, None, None, None, str(x) or "the image is damaged"))
            yield pd.DataFrame(rows, columns=["id_", "width", "height", "dhash", "phash", "error"], dtype=object)

    some = images.where(F.col(bytes_col).isNotNull()).select(keyed(id_col), F.col(bytes_col).alias("data_"))
    return restored(some.mapInPandas(run, f"id_ string, width bigint, height bigint, dhash bigint, phash bigint, error string"), id_col, kind)


def distance(a: Column, b: Column) -> Column:
    """Differing bits of two hashes; up to 10 the images are alike."""
    return F.bit_count(a.bitwiseXOR(b))


#: Pixels of a window that similarity is measured in, and of a cell that changes are gathered in.
WINDOW, CELL = 8, 16


def _means(a: np.ndarray, n: int) -> np.ndarray:
    """Means of all n x n windows, by sums over the image."""
    s = np.zeros((a.shape[0] + 1, a.shape[1] + 1))
    s[1:, 1:] = a.cumsum(0).cumsum(1)
    return (s[n:, n:] - s[:-n, n:] - s[n:, :-n] + s[:-n, :-n]) / (n * n)


def similarity(x: np.ndarray, y: np.ndarray, window: int = WINDOW) -> float:
    """Structural similarity: the mean over all windows; images smaller than a window are one."""
    n = max(1, min(window, *x.shape))
    mx, my = _means(x, n), _means(y, n)
    vx, vy, cov = _means(x * x, n) - mx * mx, _means(y * y, n) - my * my, _means(x * y, n) - mx * my
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return float(((2 * mx * my + c1) * (2 * cov + c2) / ((mx * mx + my * my + c1) * (vx + vy + c2))).mean())


def regions(changed: np.ndarray, cell: int = CELL) -> list[tuple[int, int, int, int, int]]:
    """(left, top, right, bottom, pixels) of the connected groups of cells with changed pixels, most pixels first."""
    at = np.argwhere(changed)
    by: dict[tuple[int, int], list] = {}
    for key, p in zip(map(tuple, at // cell), at):
        by.setdefault(key, []).append(p)
    out = []
    while by:
        todo, mine = [next(iter(by))], []
        while todo:
            r, c = todo.pop()
            if (r, c) in by:
                mine += by.pop((r, c))
                todo += [(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)]
        m = np.array(mine)
        out.append((int(m[:, 1].min()), int(m[:, 0].min()), int(m[:, 1].max()) + 1, int(m[:, 0].max()) + 1, len(m)))
    return sorted(out, key=lambda r: (-r[4], r[1], r[0]))


def difference(a: bytes, b: bytes, threshold: int = 16) -> dict:
    """changed: the share of pixels that differ by more than ``threshold``; ssim: structural similarity; box: the smallest
    rectangle around the changes; regions: those of its connected parts."""
    x, y = decode(a), decode(b)
    if x.shape != y.shape:
        raise ValueError("the images differ in size")
    d = np.abs(x - y) > threshold
    found = regions(d)
    box = tuple(f(r[i] for r in found) for i, f in enumerate((min, min, max, max))) if found else None
    return {"changed": float(d.mean()) if d.size else 0.0, "ssim": similarity(x, y) if d.size else 1.0, "box": box, "regions": found}


def differences(pairs: DataFrame, id_col: str, before_col: str, after_col: str, threshold: int = 16) -> DataFrame:
    """(id, changed, ssim, regions, error): ``difference`` of two images a row. A null image, or one that can't be read,
    is an error in a sentence."""
    kind = pairs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, a, b in zip(batch["id_"], batch["a_"], batch["b_"]):
                try:
                    if a is None or b is None:
                        raise ValueError("an image is missing")
                    d = difference(bytes(a), bytes(b), threshold)
                    rows.append((key, d["changed"], d["ssim"], [dict(zip(("left", "top", "right", "bottom", "pixels"), r)) for r in d["regions"]], None))
                except (ValueError, zlib.error, struct.error, IndexError) as x:
                    rows.append((key, None, None, None, str(x) or "the image is damaged"))
            yield pd.DataFrame(rows, columns=["id_", "changed", "ssim", "regions", "error"], dtype=object)

    some = pairs.select(keyed(id_col), F.col(before_col).alias("a_"), F.col(after_col).alias("b_"))
    box = "array<struct<left: bigint, top: bigint, right: bigint, bottom: bigint, pixels: bigint>>"
    return restored(some.mapInPandas(run, f"id_ string, changed double, ssim double, regions {box}, error string"), id_col, kind)


def size_of(data: bytes) -> tuple[str, int, int] | None:
    """(format, width, height) from an image's first bytes: PNG, GIF, JPEG and portable maps; None for others."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return "png", *struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return "gif", *struct.unpack("<HH", data[6:10])
    if data[:2] in (b"P5", b"P6") and len(parts := data[:64].split(maxsplit=3)) > 3 and parts[1].isdigit() and parts[2].isdigit():
        return "pnm", int(parts[1]), int(parts[2])
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(data) and data[at] == 0xFF:
            mark = data[at + 1]
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return "jpeg", w, h
            at += 2 if mark == 0xFF or 0xD0 <= mark <= 0xD8 else 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


def geometry(images: DataFrame, id_col: str, bytes_col: str, within: int | None = None) -> DataFrame:
    """(id, format, width, height, fit_width, fit_height): of every image that isn't null, nulls where no size is told;
    fit: its size when neither side may exceed ``within``, sides kept in proportion and at least 1."""
    kind = images.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(key, *(size_of(bytes(data)) or (None, None, None))) for key, data in zip(b["id_"], b["data_"])]
            yield pd.DataFrame(rows, columns=["id_", "format", "width", "height"], dtype=object)

    some = images.where(F.col(bytes_col).isNotNull()).select(keyed(id_col), F.col(bytes_col).alias("data_"))
    out = restored(some.mapInPandas(run, "id_ string, format string, width bigint, height bigint"), id_col, kind)
    scale = F.least(F.lit(1.0), F.lit(within) / F.greatest("width", "height", F.lit(1))) if within else F.lit(1.0)
    fit = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(1), F.round(F.col(c) * scale))).cast("long")
    return out.select("*", fit("width").alias("fit_width"), fit("height").alias("fit_height"))


def palette(pixels: np.ndarray, colours: int) -> list[tuple[tuple[int, int, int], int]]:
    """(colour, pixels) by median cut: the box of the widest channel is halved at its median until there are enough."""
    boxes = [pixels.reshape(-1, 3)]
    while len(boxes) < colours:
        k = max(range(len(boxes)), key=lambda i: np.ptp(boxes[i], 0).max() if len(boxes[i]) > 1 else -1)
        b = boxes[k]
        if len(b) < 2 or not np.ptp(b, 0).max():
            break
        ch = int(np.ptp(b, 0).argmax())
        order = b[b[:, ch].argsort(kind="stable")]
        boxes[k : k + 1] = [order[: len(order) // 2], order[len(order) // 2 :]]
    out = [(tuple(int(v) for v in b.mean(0).round()), len(b)) for b in boxes]
    return sorted(out, key=lambda x: -x[1])
