"""What Python workers keep between tasks."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from typing import Any


def per_process(name: str, make: Callable[[], Any]) -> Any:
    """``make()`` once per worker process. Functions sent by value have globals of their own in every task, so the value lives in a module of the process."""
    home = sys.modules.setdefault("_glyphloom_kept", types.ModuleType("_glyphloom_kept"))
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)
