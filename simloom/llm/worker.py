"""What a Python worker keeps between tasks: the tables and caches of one operator, those it ran last.

Workers live on from stage to stage; without this, each stage's caches would stay beside the next one's.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from typing import Any

import pyarrow as pa

_live: dict[str, Any] = {}


def kept(operator: str, make: Callable[[], Any]) -> Any:
    """The object of ``operator``, made if another operator's was kept; that one is dropped and its memory given back."""
    if operator not in _live:
        if _live:
            _live.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)
        _live[operator] = make()
    return _live[operator]
