"""Counters of a run, taken while its steps are written anyway; runs that go on at once keep their own."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation

from .staging import staged

log = logging.getLogger("hoptrace")
_NOW: ContextVar[dict[str, dict[str, int]] | None] = ContextVar("counters", default=None)
#: Counters of the last run of each sample: by the step's name, then by the counter's.
RUNS: dict[str, dict[str, dict[str, int]]] = {}


@contextmanager
def counting(sample: str) -> Iterator[dict[str, dict[str, int]]]:
    """What is counted inside the block, in this thread, belongs to ``sample``."""
    own = RUNS[sample] = {}
    token = _NOW.set(own)
    try:
        yield own
    finally:
        _NOW.reset(token)


def note(name: str, **values: int) -> None:
    """Log counters and add them to those of the run, if there is one."""
    log.info("%s: %s", name, ", ".join(f"{v} {k.replace('_', ' ')}" for k, v in values.items()))
    now = _NOW.get()
    if now is not None:
        now.setdefault(name, {}).update(values)


def counted(df: DataFrame, name: str, **counters: Column) -> DataFrame:
    """``df`` staged, with counters of it."""
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    out = staged(df.observe(seen, *[c.alias(k) for k, c in counters.items()]), name)
    note(name, **seen.get)
    return out
