"""What a Python worker keeps between tasks belongs to one operator at a time."""

from __future__ import annotations

import gc

import pyarrow as pa

_owner: list[str] = [""]
_caches: list[dict] = []


def cache() -> dict:
    """A dict that is emptied when another operator's task begins in this process."""
    made: dict = {}
    _caches.append(made)
    return made


def claim(name: str) -> None:
    """Called by a task before it starts: drops what other operators have left in this process."""
    if _owner[0] != name:
        for c in _caches:
            c.clear()
        _owner[0] = name
        gc.collect()
    pa.default_memory_pool().release_unused()
