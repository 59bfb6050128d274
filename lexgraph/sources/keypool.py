"""CON-04: keys of several providers with cooldowns. Host-side state for optional text models; nothing else needs it."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field


@dataclass
class KeyPool:
    """Keys by provider, in order of preference. A key rests after a limit (60 s) or a server error (15 s); the next one of its provider takes over, then the next provider."""

    keys: Mapping[str, Sequence[str]]
    clock: Callable[[], float] = time.time
    sleep: Callable[[float], None] = time.sleep
    _rest: dict[tuple[str, str], float] = field(default_factory=dict)
    _turn: dict[str, int] = field(default_factory=dict)
    _provider: int = 0
    _lock: threading.Lock = field(default_factory=threading.Lock)

    def _ready(self, now: float) -> tuple[str, str] | None:
        names = [n for n, held in self.keys.items() if held]
        for p in range(len(names)):
            at = (self._provider + p) % len(names)
            held, turn = self.keys[names[at]], self._turn.get(names[at], 0)
            for k in range(len(held)):
                place = (turn + k) % len(held)
                if self._rest.get((names[at], held[place]), 0.0) <= now:
                    self._provider, self._turn[names[at]] = at, place
                    return names[at], held[place]
        return None

    def get(self, max_wait: float = 120.0) -> tuple[str, str]:
        """(provider, key) that may be used now; waits for the earliest one, at most ``max_wait`` seconds."""
        with self._lock:
            if not any(self.keys.values()):
                raise ValueError("no keys")
            found = self._ready(self.clock())
            if found:
                return found
            wait = min(self._rest.values()) - self.clock()
        if wait > max_wait:
            raise TimeoutError(f"the earliest key rests for {wait:.1f} s")
        self.sleep(max(0.0, wait))
        return self.get(max_wait)

    def _pause(self, provider: str, key: str, seconds: float) -> None:
        with self._lock:
            self._rest[provider, key] = self.clock() + seconds
            self._turn[provider] = (self._turn.get(provider, 0) + 1) % max(1, len(self.keys.get(provider, ())))

    def limited(self, provider: str, key: str, seconds: float = 60.0) -> None:
        self._pause(provider, key, seconds)

    def failed(self, provider: str, key: str, seconds: float = 15.0) -> None:
        self._pause(provider, key, seconds)
