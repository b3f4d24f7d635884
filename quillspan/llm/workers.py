"""What a Python worker keeps between tasks, and how it gives memory back.

Spark keeps worker processes between stages, so what one operator's tasks leave behind would stand beside what the next
one's need.  A task begins by naming its operator: whatever was kept for another one goes, and freed memory returns to
the operating system.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

_kept: dict = {}
_running: list[str] = [""]


def begin(operator: str) -> None:
    """Start a task of ``operator``; what this process kept for another operator is dropped."""
    if _running[0] != operator:
        _running[0] = operator
        _kept.clear()
        give_back()


def kept(key, make: Callable):
    """What ``make`` gives, made once for the running operator's tasks in this process."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def give_back() -> None:
    """Return freed memory to the operating system, where the C library can do it."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
