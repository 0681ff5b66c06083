"""What a Python worker keeps between tasks.

Spark gives the tasks of later stages to the same workers, so what one operator keeps would take memory
from the next. A worker keeps the things of one kind only: asking for another kind drops them.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

T = TypeVar("T")
_KEPT: dict[str, dict] = {}


def kept(kind: str, key: object, make: Callable[[], T]) -> T:
    """The worker's thing of this kind and key, made where there is none; things of other kinds are dropped."""
    only(kind)
    own = _KEPT.setdefault(kind, {})
    if key not in own:
        own[key] = make()
    return own[key]


def only(kind: str) -> None:
    """Drop what is kept of other kinds."""
    for other in [k for k in _KEPT if k != kind]:
        del _KEPT[other]
