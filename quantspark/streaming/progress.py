"""Counters of a running stream: rows so far, rows a second, and how long the rest will take."""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass

from pyspark.sql.streaming import StreamingQueryListener

log = logging.getLogger("quantspark")


@dataclass(frozen=True)
class Step:
    """What is known after a batch: its number, rows of all batches so far, rows a second, seconds left (if a total is known)."""

    batch: int
    rows: int
    per_second: float
    left: float | None


class Progress(StreamingQueryListener):
    """Keeps a ``Step`` for every ``every`` rows at most and for the last batch; ``total`` is the expected number of rows."""

    def __init__(self, total: int | None = None, every: int = 10_000):
        self.total, self.every = total, every
        self.steps: list[Step] = []
        self.rows, self.ended, self._shown, self._began = 0, False, 0, time.monotonic()

    def onQueryStarted(self, event) -> None:
        self._began = time.monotonic()

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows += max(0, p.numInputRows)
        if self.steps and self.rows - self._shown < self.every:
            self._last = p.batchId
            return
        self._keep(p.batchId)

    def _keep(self, batch: int) -> None:
        spent = max(1e-9, time.monotonic() - self._began)
        rate = self.rows / spent
        left = None if self.total is None or not rate else max(0.0, (self.total - self.rows) / rate)
        self.steps.append(Step(batch, self.rows, rate, left))
        self._shown = self.rows
        log.info("batch %d: %d rows, %.0f a second%s", batch, self.rows, rate, "" if left is None else f", {left:.0f} s left")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if self.steps and self.rows != self.steps[-1].rows:
            self._keep(self._last)
        self.ended = True
