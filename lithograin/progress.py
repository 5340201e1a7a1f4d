"""Progress events and cancellation of long verbs.

An observer is called on the driver with counts only, never with paths, values or digests. A token is cancelled from any
thread; it is looked at before and after each phase and between chunks, and it interrupts the verb's running Spark jobs.
"""

from __future__ import annotations

import contextlib
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession

from .errors import Cancelled

#: The phases of an operation, in the order in which they may come.
PHASES = (
    "analyzing", "planning", "reading_input", "hashing", "compressing", "writing_archive", "reading_archive", "decompressing", "writing_output", "validating", "comparing", "benchmarking",
    "cleaning_up", "finalizing",
)


@dataclass(frozen=True)
class Count:
    """How much is done, of how much (None: not known)."""

    done: int = 0
    of: int | None = None


@dataclass(frozen=True)
class Event:
    """One report of an operation: where it is, and the bytes and items of the phase."""

    operation: str
    phase: str
    state: str
    bytes: Count = Count()
    items: Count = Count()

    @property
    def percentage(self) -> float | None:
        """Share of the phase's bytes; a phase of no bytes is whole when it completes and has no share before."""
        done, of = self.bytes.done, self.bytes.of
        if of:
            return min(done / of, 1.0) * 100
        return 100.0 if of == 0 and self.state == "completed" else None

    @property
    def is_success(self) -> bool:
        """Is this the last event of an operation that went well?"""
        return (self.phase, self.state) == (PHASES[-1], "completed")


class Token:
    """Once cancelled it stays so."""

    def __init__(self) -> None:
        self._event, self._tags, self._lock = threading.Event(), set(), threading.Lock()

    def cancel(self) -> None:
        self._event.set()
        with self._lock:
            for spark, tag in list(self._tags):
                spark.interruptTag(tag)

    @property
    def cancelled(self) -> bool:
        return self._event.is_set()


class Operation:
    """What one verb reports to; without observer and token it only costs the calls."""

    def __init__(self, name: str, observer: Callable[[Event], None] | None = None, token: Token | None = None):
        self.name, self.observer, self.token = name, observer, token

    def checkpoint(self) -> None:
        if self.token is not None and self.token.cancelled:
            raise Cancelled(f"{self.name} was cancelled")

    def emit(self, phase: str, state: str, done: int = 0, total: int | None = None, items: int = 0, of: int | None = None) -> None:
        if self.observer is not None:
            self.observer(Event(self.name, phase, state, Count(done, total), Count(items, of)))

    @contextlib.contextmanager
    def phase(self, phase: str, total: int | None = None, of: int | None = None):
        """started, any number of advanced through the yielded function, completed; no completed event on failure."""
        self.checkpoint()
        self.emit(phase, "started", 0, total, 0, of)
        at = [0, 0]

        def advance(size: int) -> None:
            self.checkpoint()
            at[0] += size
            at[1] += 1
            self.emit(phase, "advanced", at[0], total, at[1], of)

        yield advance
        self.checkpoint()
        self.emit(phase, "completed", at[0] if total is None else total, total, at[1] if of is None else of, of)

    @contextlib.contextmanager
    def jobs(self, spark: SparkSession):
        """Spark jobs inside carry a tag that the token interrupts; an interrupted job shows as Cancelled."""
        if self.token is None:
            yield
            return
        tag = f"lithograin-{uuid.uuid4().hex}"
        with self.token._lock:
            self.token._tags.add((spark, tag))
        spark.addTag(tag)
        try:
            yield
        except Exception:
            self.checkpoint()
            raise
        finally:
            spark.removeTag(tag)
            with self.token._lock:
                self.token._tags.discard((spark, tag))
