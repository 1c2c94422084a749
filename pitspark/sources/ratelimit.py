"""A pace for fetchers that run on the driver."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable


class RateLimiter:
    """``rate`` calls a second on average, ``burst`` at once. It keeps the one moment at which all calls so far are paid for;
    a call may run that far ahead of the clock as the burst allows, and waits for the rest. Callers wait in line."""

    def __init__(self, rate: float, burst: int = 1, *, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        if not (rate > 0 and burst >= 1):
            raise ValueError("rate and burst must be positive")
        self.rate, self.burst = rate, burst
        self.waited_seconds = 0.0
        self._clock, self._sleep = clock, sleep
        self._paid_until = clock()
        self._line = threading.Lock()

    def acquire(self, weight: int = 1) -> None:
        if weight not in range(1, self.burst + 1):
            raise ValueError("a call weighs between 1 and the burst")
        with self._line:
            self._paid_until = max(self._paid_until, self._clock()) + weight / self.rate
            pause = self._paid_until - self.burst / self.rate - self._clock()
            if pause > 0:
                self.waited_seconds += pause
                self._sleep(pause)
