"""Models that callers plug in: built once per Python worker.

A hook is a name and a factory.  The cache lives in this module, which workers
import, so tasks of one worker share what was built; a nested function's own
dictionary would be pickled anew with every task.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

_BUILT: dict[str, Any] = {}


@dataclass(frozen=True)
class Hook:
    """``factory()`` gives the callable; ``name`` tells one model from another
    (a new version needs a new name)."""
    name: str
    factory: Callable[[], Any]


def built(hook: Hook) -> Any:
    if hook.name not in _BUILT:
        _BUILT[hook.name] = hook.factory()
    return _BUILT[hook.name]
