"""What Python workers keep between tasks."""

from __future__ import annotations

import sys
import types


def worker_memo() -> dict:
    """A dict that lives as long as the worker process, as code that travels by value has fresh globals in each task."""
    module = sys.modules.setdefault("_stratum_worker_memo", types.ModuleType("_stratum_worker_memo"))
    return module.__dict__.setdefault("kept", {})


def slices(batch, rows: int = 256):
    """A record batch in small pieces, so that few of its texts are Python strings at a time."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def stream(column, rows: int = 256):
    """A column's values, a few made at a time."""
    for i in range(0, len(column), rows):
        yield from column.slice(i, rows).to_pylist()


def tidy() -> None:
    """Gives freed memory back to the system: workers outlive tasks, and what they keep adds up."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass
