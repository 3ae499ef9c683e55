"""Objects that a Python worker makes once and keeps for all its tasks."""

from __future__ import annotations

import sys
from collections.abc import Callable, Hashable
from typing import TypeVar

Thing = TypeVar("Thing")


def once_per_worker(key: Hashable, make: Callable[[], Thing]) -> Thing:
    """What `make` gave for this key in this process.

    Functions reach workers by value and bring their module's globals with them, so a global of such a module is a
    new one in every task. The interpreter's own module is not copied.
    """
    kept = sys.__dict__.setdefault("_chatrisk_kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]
