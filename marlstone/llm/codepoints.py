"""Whole texts as numpy arrays of code points, in groups of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

GROUP_CHARS = 1 << 20


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def groups(texts: list[str], overlap: int = 0, limit: int = GROUP_CHARS) -> Iterator[tuple[list[int], list[str]]]:
    """Consecutive (text number, part) groups of about ``limit`` characters.

    A longer text is split every ``limit`` characters, each part but the last with the next ``overlap``
    characters added; every text has at least one part, an empty text an empty one.
    """
    at, parts, size = [], [], 0
    for i, t in enumerate(texts):
        for k in range(0, max(1, len(t)), limit):
            part = t[k : k + limit + overlap]
            at.append(i)
            parts.append(part)
            size += len(part)
            if size >= limit:
                yield at, parts
                at, parts, size = [], [], 0
    if at:
        yield at, parts
