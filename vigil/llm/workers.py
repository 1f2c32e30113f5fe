"""What a Python worker holds between tasks: one object at most, and no freed memory.

Workers are reused by tasks of all operators. Arrow takes its memory from the
system as Python does, and large arrays are mapped, so that freeing them returns
their memory; tables that a task builds stay until a task of another kind comes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa

#: mallopt's M_MMAP_THRESHOLD, and the bytes from which memory is mapped.
_MMAP_THRESHOLD, _BYTES = -3, 1 << 18
_held: dict[Any, Any] = {}
pa.set_memory_pool(pa.system_memory_pool())

try:
    _libc: ctypes.CDLL | None = ctypes.CDLL("libc.so.6")
    _libc.mallopt(_MMAP_THRESHOLD, _BYTES)
except (OSError, AttributeError):
    _libc = None


def clear() -> None:
    """Drops what is held and gives free memory back."""
    _held.clear()
    trim()


def tidy(batches: Iterator[Any]) -> Iterator[Any]:
    """The batches of a task; free memory goes back after the last."""
    yield from batches
    trim()


def trim() -> None:
    if _libc is not None and hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def hold(key: Any, make: Callable[[], Any]) -> Any:
    """make() of the key, once for a run of tasks with the same key."""
    if key not in _held:
        clear()
        _held[key] = make()
    return _held[key]
