"""Memory of Spark's Python workers, which go from one stage to the next.

What a task has used stays with its worker as memory that is free but not handed back, and
adds up with what the next stage needs.  A worker that gets no other task for a moment
hands it back, and lets go of what it keeps for such a task.
"""

from __future__ import annotations

import ctypes
import gc
import threading
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa

# Seconds without a task.
_IDLE_S = 2.0
_waiting: list[threading.Timer] = []
_kept: list[Callable[[], None]] = []


def on_idle(release: Callable[[], None]) -> None:
    """`release` is called when the worker has been idle for a moment."""
    _kept.append(release)


def _hand_back() -> None:
    for release in _kept:
        release()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def busy() -> None:
    while _waiting:
        _waiting.pop().cancel()


def idle() -> None:
    timer = threading.Timer(_IDLE_S, _hand_back)
    timer.daemon = True
    timer.start()
    _waiting.append(timer)


def tidy(task: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """`task` for mapInPandas, with its worker's memory handed back after it."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        busy()
        yield from task(batches)
        idle()

    return run
