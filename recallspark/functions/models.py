"""Python models, loaded once in each worker process."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle

_KEPT = 4
_HELD = "_recallspark_models"


def name_of(model: object) -> str:
    """The same for equal models: their class and parameters, as they travel to the workers."""
    return hashlib.sha256(cloudpickle.dumps(model)).hexdigest()


def loaded(name: str, load: Callable[[], Any]) -> Any:
    """What `load` gave when this process first asked for the name; few models are kept."""
    # This package travels to the workers by value, anew with each task, so its own globals would not last.
    held = sys.__dict__.setdefault(_HELD, {})
    if name not in held:
        while len(held) >= _KEPT:
            held.pop(next(iter(held)))
        held[name] = load()
    return held[name]
