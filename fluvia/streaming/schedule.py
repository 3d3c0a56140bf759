"""A poll that is folded on a schedule and survives errors."""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable

log = logging.getLogger(__name__)

#: Seconds between polls, at least.
LEAST_WAIT = 60.0


class Schedule:
    """Runs `job` every `seconds` (LEAST_WAIT at least) in a daemon thread, first after `first` seconds.

    A job that raises is logged and counted, and the next one runs as planned. `done` is called after each job that succeeds.
    """

    def __init__(self, job: Callable[[], object], seconds: float, done: Callable[[], object] = lambda: None, first: float = LEAST_WAIT, least: float = LEAST_WAIT):
        self.job, self.done, self.wait, self.first = job, done, max(least, seconds), first
        self.runs = self.failures = 0
        self._stop = threading.Event()
        self._thread = threading.Thread(target=self._loop, name="fluvia-poll", daemon=True)

    def start(self) -> Schedule:
        self._thread.start()
        return self

    def stop(self, timeout: float | None = None) -> None:
        self._stop.set()
        self._thread.join(timeout)

    def _loop(self) -> None:
        wait = self.first
        while not self._stop.wait(wait):
            try:
                self.job()
                self.done()
                self.runs += 1
            except Exception:
                self.failures += 1
                log.exception("a scheduled poll failed")
            wait = self.wait
