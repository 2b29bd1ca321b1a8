"""Pixels: decoding, orientation, resizing, perceptual hashes. Codecs are optional; arrays of pixels need none."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np


def oriented(pixels: np.ndarray, orientation: int) -> np.ndarray:
    """Pixels (rows, columns, ...) turned upright by EXIF orientation; values outside 2 to 8 change nothing."""
    turned = {
        2: lambda p: p[:, ::-1],
        3: lambda p: p[::-1, ::-1],
        4: lambda p: p[::-1],
        5: lambda p: np.swapaxes(p, 0, 1),
        6: lambda p: np.swapaxes(p, 0, 1)[:, ::-1],
        7: lambda p: np.swapaxes(p, 0, 1)[::-1, ::-1],
        8: lambda p: np.swapaxes(p, 0, 1)[::-1],
    }.get(orientation)
    return pixels if turned is None else turned(pixels)


def exif_orientation(data: bytes) -> int:
    """The orientation that a JPEG's or TIFF's EXIF names; 1 if there is none."""
    tiff = data if data[:4] in (b"II*\0", b"MM\0*") else b""
    at = 2
    while not tiff and data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF:
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            tiff = data[at + 10 : at + 2 + size]
        at += 2 + size
    if len(tiff) < 8:
        return 1
    order = "little" if tiff[:2] == b"II" else "big"
    start = int.from_bytes(tiff[4:8], order)
    for i in range(int.from_bytes(tiff[start : start + 2], order)):
        entry = tiff[start + 2 + 12 * i : start + 14 + 12 * i]
        if len(entry) == 12 and int.from_bytes(entry[:2], order) == 0x0112:
            value = int.from_bytes(entry[8:10], order)
            return value if 1 <= value <= 8 else 1
    return 1


def fitted_size(width: int, height: int, target: int) -> tuple[int, int]:
    if max(width, height) <= target:
        return width, height
    return (target, int(height * target / width)) if width >= height else (int(width * target / height), target)


def jpeg_end(data: bytes, at: int) -> int | None:
    """Where the JPEG that starts at `at` ends, by its segments; None if it is cut off. What lies inside a segment, such as
    a thumbnail with an end marker of its own, is stepped over."""
    at += 2
    while at + 4 <= len(data) or data[at : at + 2] == b"\xff\xd9":
        if data[at] != 0xFF:
            return None
        kind = data[at + 1]
        if kind == 0xD9:
            return at + 2
        if kind == 0xFF:  # padding
            at += 1
        elif kind == 0x01 or 0xD0 <= kind <= 0xD7:
            at += 2
        else:
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
            if kind == 0xDA:  # coded data, up to a marker that isn't a stuffed byte or a restart
                found = _AFTER_SCAN.search(data, at)
                if found is None:
                    return None
                at = found.start()
    return None


_AFTER_SCAN = re.compile(rb"\xff+[^\x00\xd0-\xd7\xff]", re.S)


def _directories(data: bytes) -> Iterator[dict[int, list[int]]]:
    """Tags with integer values of all directories of a TIFF container, sub-directories included; each once."""
    order = {b"II": "little", b"MM": "big"}.get(data[:2])
    if order is None or len(data) < 8:
        return
    waiting, seen = [int.from_bytes(data[4:8], order)], set()
    while waiting:
        at = waiting.pop(0)
        if at in seen or not 8 <= at <= len(data) - 2:
            continue
        seen.add(at)
        n = int.from_bytes(data[at : at + 2], order)
        tags: dict[int, list[int]] = {}
        for entry in range(at + 2, min(at + 2 + 12 * n, len(data) - 11), 12):
            tag, kind, count = (int.from_bytes(data[entry + i : entry + i + w], order) for i, w in ((0, 2), (2, 2), (4, 4)))
            width = {3: 2, 4: 4, 13: 4}.get(kind)
            if width is None or count * width > len(data):
                continue
            start = entry + 8 if count * width <= 4 else int.from_bytes(data[entry + 8 : entry + 12], order)
            tags[tag] = [int.from_bytes(data[start + i : start + i + width], order) for i in range(0, count * width, width)]
        yield tags
        waiting += tags.get(_SUB, []) + tags.get(_EXIF, []) + [int.from_bytes(data[at + 2 + 12 * n : at + 6 + 12 * n], order)]


#: Fixed values of the container formats: tags of sub-directories and of where a JPEG or a strip lies, and a maker's header.
_SUB, _EXIF, _JPEG, _JPEG_SIZE, _STRIPS, _STRIP_SIZES = 0x014A, 0x8769, 0x0201, 0x0202, 0x0111, 0x0117
_RAF, _RAF_JPEG = b"FUJIFILMCCD-RAW", 84


def embedded_preview(data: bytes) -> bytes | None:
    """The largest JPEG inside a raw file: those that its directories name, else, or where they name none that is whole,
    those found by their first marker and followed segment by segment."""
    places: list[tuple[int, int]] = []
    if data.startswith(_RAF):
        places.append(tuple(int.from_bytes(data[i : i + 4], "big") for i in (_RAF_JPEG, _RAF_JPEG + 4)))
    for tags in _directories(data):
        for where, sizes in ((_JPEG, _JPEG_SIZE), (_STRIPS, _STRIP_SIZES)):
            if len(tags.get(where, ())) == len(tags.get(sizes, ())) == 1:
                places.append((tags[where][0], tags[sizes][0]))
    best = b""
    for at, size in places:
        if data[at : at + 3] == b"\xff\xd8\xff" and (end := jpeg_end(data, at)) is not None and end <= at + size:
            best = max(best, data[at:end], key=len)
    at = -1 if best else data.find(b"\xff\xd8\xff")
    while at >= 0:
        end = jpeg_end(data, at)
        if end is not None:
            best = max(best, data[at:end], key=len)
        at = data.find(b"\xff\xd8\xff", at + 3 if end is None else end)
    return best or _between_markers(data)


def _between_markers(data: bytes) -> bytes | None:
    """Of a file without a JPEG that is whole, the longest piece from a first marker to the next last one."""
    best, at = b"", data.find(b"\xff\xd8\xff")
    while at >= 0 and (end := data.find(b"\xff\xd9", at)) >= 0:
        best = max(best, data[at : end + 2], key=len)
        at = data.find(b"\xff\xd8\xff", at + 3)
    return best or None


def decoded(data: bytes, target: int | None = None, raw: bool = False) -> np.ndarray | None:
    """Upright RGB pixels, long side at most target; None if they can't be had (also where no codec is installed)."""
    try:
        from PIL import Image
    except ImportError:
        return None
    try:
        source = embedded_preview(data) if raw else data
        if source is None:
            return None
        image = Image.open(io.BytesIO(source)).convert("RGB")
        pixels = oriented(np.asarray(image), exif_orientation(source))
        if target and max(pixels.shape[:2]) > target:
            size = fitted_size(pixels.shape[1], pixels.shape[0], target)
            pixels = np.asarray(Image.fromarray(np.ascontiguousarray(pixels)).resize(size, Image.Resampling.LANCZOS))
        return pixels
    except Exception:  # noqa: BLE001  any damage in a file means no pixels
        return None


def ppm_decoded(data: bytes) -> np.ndarray | None:
    """Pixels of a binary portable pixmap, which needs no codec."""
    m = re.match(rb"P6(?:\s+#[^\n]*)*\s+(\d+)\s+(\d+)\s+255\s", data)
    if m is None:
        return None
    width, height = int(m[1]), int(m[2])
    body = data[m.end() : m.end() + 3 * width * height]
    return np.frombuffer(body, np.uint8).reshape(height, width, 3) if len(body) == 3 * width * height else None


def ppm_encoded(pixels: np.ndarray) -> bytes:
    return b"P6 %d %d 255\n" % (pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def webp_encoded(pixels: np.ndarray, quality: int = 85) -> bytes | None:
    """None where no codec is installed."""
    try:
        from PIL import Image
    except ImportError:
        return None
    out = io.BytesIO()
    Image.fromarray(np.ascontiguousarray(pixels)).save(out, "WEBP", quality=quality)
    return out.getvalue()


def area_weights(n: int, side: int) -> np.ndarray:
    """[i, j]: the share of pixel j of n in area i of side."""
    edges = np.linspace(0, n, side + 1)
    cover = np.clip(np.minimum(edges[1:, None], np.arange(1, n + 1)) - np.maximum(edges[:-1, None], np.arange(n)), 0, None)
    return cover / cover.sum(axis=1, keepdims=True)


def area_resized(gray: np.ndarray, side: int) -> np.ndarray:
    """Mean over side x side areas of a gray image."""
    return area_weights(gray.shape[0], side) @ gray @ area_weights(gray.shape[1], side).T


def phash(pixels: np.ndarray, hash_size: int = 16) -> str:
    """hash_size squared bits in hex: which low frequencies of the cosine transform exceed their median."""
    gray = pixels.astype(float) @ np.array([0.299, 0.587, 0.114]) if pixels.ndim == 3 else pixels.astype(float)
    n = 4 * hash_size
    small = area_resized(gray, n)
    k = np.arange(n)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))
    low = (basis @ small @ basis.T)[:hash_size, :hash_size]
    bits = (low > np.median(low)).ravel()
    return np.packbits(bits).tobytes().hex()
