"""Settings. Explicit arguments win over the environment, that over a JSON file, that over defaults."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from pathlib import Path

#: Suffixes by kind.
RAW_SUFFIXES = (".cr2", ".cr3", ".dng", ".nef", ".arw", ".raf", ".rw2", ".orf")
JPEG_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp")
PAGE_SIZES = (50, 100, 200, 500, 1000)


@dataclass(frozen=True)
class Options:
    vector_candidates: int = 200
    text_candidates: int = 200
    rrf_k: int = 60
    results: int = 50
    threshold: float = 0.0
    distance: str = "Cosine"
    dimension: int = 1152
    long_side: int = 512
    skip_shadowed: bool = True
    batch: int = 128
    batch_min: int = 32
    batch_max: int = 256
    caption_batch: int = 8
    photo_root: str = ""

    @classmethod
    def load(cls, file: str | Path | None = None, environment: Mapping[str, str] | None = None, **given) -> Options:
        """An unreadable file counts as empty; unknown names in it are ignored, unknown arguments are not."""
        kinds = {f.name: type(f.default) for f in fields(cls)}
        merged: dict = {}
        if file is not None:
            try:
                merged |= {k: v for k, v in json.loads(Path(file).read_text()).items() if k in kinds}
            except (OSError, ValueError, AttributeError):
                pass
        for name, kind in kinds.items():
            if (raw := (os.environ if environment is None else environment).get(f"GLIMMER_{name.upper()}")) is not None:
                merged[name] = raw.lower() in ("1", "true", "yes", "on") if kind is bool else kind(raw)
        return replace(cls(**merged), **given)


def limited(limit: int, threshold: float = 0.0) -> None:
    """What a served search accepts."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be from 1 to 500")
    if not 0.0 <= threshold <= 1.0:
        raise ValueError("threshold must be from 0 to 1")
