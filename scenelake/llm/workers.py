"""What a Python worker keeps between tasks: the tables of one operator at a time.

Spark reuses its Python workers, over stages and over jobs. A table that an operator keeps for its next task would
stay while other operators run in the same worker, so asking for another operator's table gives up the one before.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable
from typing import Any

_held: dict[Hashable, Any] = {}


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """The table of that key, made anew unless it is the one held."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Gives up the table and hands freed memory back to the system."""
    _held.clear()
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return
