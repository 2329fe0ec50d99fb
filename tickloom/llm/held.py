"""The one large object a Python worker keeps between tasks.

Workers are used again by later stages, so a model that each stage left behind would add up. Asking for another one lets the last go.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from typing import Any

import pyarrow as pa

_held: dict[Any, Any] = {}


def held(key: Any, make: Callable[[], Any]) -> Any:
    """What ``make`` gave for ``key``, made anew if something else was asked for since."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def let_go() -> None:
    """Drop what is held for an earlier stage; for tasks that hold nothing themselves."""
    if _held:
        _held.clear()
        gc.collect()
        give_back()


def give_back() -> None:
    """Return freed memory to the system at the end of a task; allocators keep it otherwise, in every worker that waits for work."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library
        pass
