"""What a long-lived driver shares between requests: single computations, counted holds, expiring entries and gates."""

from __future__ import annotations

import hashlib
import threading
import time
from collections import OrderedDict
from collections.abc import Callable, Hashable
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


class Once:
    """Requests for one key at the same time share one computation; a failed one is told to all who wait and then forgotten."""

    def __init__(self):
        self.lock, self.running = threading.Lock(), {}

    def get(self, key: Hashable, compute: Callable[[], object]):
        with self.lock:
            mine = key not in self.running
            if mine:
                self.running[key] = (threading.Event(), [])
            done, out = self.running[key]
        if not mine:
            done.wait()
        else:
            try:
                out.append((compute(), None))
            except BaseException as e:
                out.append((None, e))
                with self.lock:
                    del self.running[key]
            done.set()
        value, error = out[0]
        if error is not None:
            raise error
        return value


class Held:
    """A DataFrame that is persisted while anybody holds it: the first hold persists it, the last release lets it go."""

    def __init__(self, make: Callable[[], DataFrame]):
        self.make, self.lock, self.holds, self.df = make, threading.Lock(), 0, None

    @contextmanager
    def hold(self):
        with self.lock:
            self.holds += 1
            if self.df is None:
                self.df = self.make().persist()
        try:
            yield self.df
        finally:
            with self.lock:
                self.holds -= 1
                if not self.holds:
                    self.df.unpersist()
                    self.df = None


class Expiring:
    """Entries that go when they weren't asked for in so many seconds, or when there are too many, the least recent first."""

    def __init__(self, most: int, seconds: float, clock: Callable[[], float] = time.monotonic):
        self.most, self.seconds, self.clock, self.entries = most, seconds, clock, OrderedDict()

    def get(self, key: Hashable, make: Callable[[], object]):
        now = self.clock()
        for k in [k for k, (_, at) in self.entries.items() if now - at > self.seconds]:
            del self.entries[k]
        value = self.entries.pop(key)[0] if key in self.entries else make()
        self.entries[key] = value, now
        while len(self.entries) > self.most:
            self.entries.popitem(last=False)
        return value


@dataclass
class CountGate:
    """So many at once, and of so many different packages; who has waited for ``patience`` seconds goes through all the same."""

    workers: int
    packages: int = 0
    patience: float = 2.0
    live: dict[str, int] = field(default_factory=dict)
    condition: threading.Condition = field(default_factory=threading.Condition)

    def open_for(self, package: str) -> bool:
        return sum(self.live.values()) < self.workers and (not self.packages or package in self.live or len(self.live) < self.packages)

    @contextmanager
    def enter(self, package: str):
        with self.condition:
            in_time = self.condition.wait_for(lambda: self.open_for(package), self.patience)
            self.live[package] = self.live.get(package, 0) + 1
        try:
            yield in_time
        finally:
            with self.condition:
                self.live[package] -= 1
                if not self.live[package]:
                    del self.live[package]
                self.condition.notify_all()


@dataclass
class ByteGate:
    """Work that wants so many bytes is admitted if they fit the budget, or if nothing else is in flight."""

    budget: int
    in_flight: int = 0
    blocked: int = 0
    condition: threading.Condition = field(default_factory=threading.Condition)

    @contextmanager
    def enter(self, want: int):
        fits = lambda: self.in_flight == 0 or self.in_flight + want <= self.budget
        with self.condition:
            self.blocked += not fits()
            self.condition.wait_for(fits)
            self.in_flight += want
        try:
            yield
        finally:
            with self.condition:
                self.in_flight -= want
                self.condition.notify_all()


class Session:
    """Configuration and what is built from it, built anew only if the path, the text or the enabled names change."""

    def __init__(self, build: Callable[[str, str, tuple[str, ...]], object]):
        self.build, self.key, self.built = build, None, None

    def get(self, path: str, text: str, enabled: list[str]):
        key = path, hashlib.sha256(text.encode()).hexdigest(), tuple(sorted(enabled))
        if key != self.key:
            self.built, self.key = self.build(path, text, key[2]), key
        return self.built
