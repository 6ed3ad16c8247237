"""Rate limit and backpressure for one fetching task."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable


class TokenBucket:
    """At most ``capacity`` at once and ``rate`` a second in the long run; starts full and refills continuously."""

    def __init__(self, capacity: float, rate: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.capacity, self._rate, self._clock, self._sleep = float(capacity), float(rate), clock, sleep
        self._level, self._at = self.capacity, clock()
        self._lock = threading.Lock()

    def _refill(self) -> None:
        now = self._clock()
        self._level = min(self.capacity, self._level + max(0.0, now - self._at) * max(0.0, self._rate))
        self._at = now

    def try_acquire(self) -> bool:
        with self._lock:
            self._refill()
            if self._level < 1:
                return False
            self._level -= 1
            return True

    def acquire(self) -> None:
        """Waits for a token: each time as long as one takes to come, 1 ms if none ever will at this rate."""
        while not self.try_acquire():
            self._sleep(1 / self._rate if self._rate > 0 else 0.001)

    def set_rate(self, rate: float) -> None:
        with self._lock:
            self._refill()
            self._rate = float(rate)

    def available(self) -> float:
        with self._lock:
            self._refill()
            return self._level


class BoundedQueue:
    """A queue that closes at ``max_buffered`` items and opens again at ``resume_at``."""

    def __init__(self, max_buffered: int = 1000, resume_at: int = 500, on_pause: Callable[[], None] | None = None, on_resume: Callable[[], None] | None = None):
        self.max_buffered, self.resume_at = max_buffered, resume_at
        self._on_pause, self._on_resume = on_pause, on_resume
        self._items: deque = deque()
        self._paused = False
        self._change = threading.Condition()

    def _put(self, item) -> None:
        self._items.append(item)
        if len(self._items) >= self.max_buffered and not self._paused:
            self._paused = True
            if self._on_pause:
                self._on_pause()
        self._change.notify_all()

    def offer(self, item) -> bool:
        """Adds an item unless the queue is closed."""
        with self._change:
            if self._paused:
                return False
            self._put(item)
            return True

    def put(self, item) -> None:
        """Adds an item, waiting while the queue is closed."""
        with self._change:
            self._change.wait_for(lambda: not self._paused)
            self._put(item)

    def poll(self):
        """The next item, or None if there is none."""
        with self._change:
            if not self._items:
                return None
            item = self._items.popleft()
            if self._paused and len(self._items) <= self.resume_at:
                self._paused = False
                if self._on_resume:
                    self._on_resume()
            self._change.notify_all()
            return item

    @property
    def paused(self) -> bool:
        with self._change:
            return self._paused

    def __len__(self) -> int:
        with self._change:
            return len(self._items)
