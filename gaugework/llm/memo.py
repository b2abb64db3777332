"""Memos of Python workers. A worker lives for many tasks and stages; it holds the memo of one operator at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

_held: dict[object, dict] = {}
_release: dict[object, Callable[[], None]] = {}


def own(name: object, memo: dict | None = None, release: Callable[[], None] | None = None) -> dict:
    """The memo of one operator in this process; asking for it empties those of the others and calls their ``release``."""
    emptied = False
    for other, held in _held.items():
        if other != name and held:
            held.clear()
            _release.get(other, held.clear)()
            emptied = True
    if emptied:
        try:
            ctypes.CDLL(None).malloc_trim(0)  # freed memory goes back to the system where the C library can do that
        except (AttributeError, OSError):
            pass
    if release is not None:
        _release[name] = release
    return _held.setdefault(name, {} if memo is None else memo)
