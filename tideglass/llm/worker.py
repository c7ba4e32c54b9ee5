"""What Python workers keep between tasks: tokenizers, by path."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from typing import Any


def kept(name: str, make: Callable[[], Any]) -> Any:
    """The worker's one instance under this name."""
    held = sys.modules.setdefault("_tideglass_worker", types.ModuleType("_tideglass_worker"))
    if not hasattr(held, name):
        setattr(held, name, make())
    return getattr(held, name)
