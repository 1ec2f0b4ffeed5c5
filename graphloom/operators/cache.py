"""Caches of query results, materialised views by predicate, and a rate limit for a front end."""

from __future__ import annotations

import re
import threading
import time
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame

from graphloom.sources.graphs import Graph


class QueryCache:
    """Persisted results by query text: the least recently used and the expired go."""

    def __init__(self, size: int = 32, ttl: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.size, self.ttl, self.clock = size, ttl, clock
        self.entries: OrderedDict[str, tuple[float, DataFrame]] = OrderedDict()
        self.hits = self.misses = 0

    @staticmethod
    def key(text: str) -> str:
        return re.sub(r"\s+", " ", re.sub(r"#[^\n<>]*\n", "\n", text)).strip()

    def get(self, text: str, make: Callable[[], DataFrame]) -> DataFrame:
        key, now = self.key(text), self.clock()
        if key in self.entries and now - self.entries[key][0] <= self.ttl:
            self.entries.move_to_end(key)
            self.hits += 1
            return self.entries[key][1]
        self.misses += 1
        self.drop(key)
        made = make().persist()
        self.entries[key] = now, made
        while len(self.entries) > self.size:
            self.drop(next(iter(self.entries)))
        return made

    def drop(self, key: str) -> None:
        if key in self.entries:
            self.entries.pop(key)[1].unpersist()

    def invalidate(self, predicates: set[str]) -> None:
        """Drops the results of queries that name one of the predicates."""
        for key in [k for k in self.entries if any(p.strip("<>") in k or p.strip("<>").rsplit("/", 1)[-1].rsplit(":", 1)[-1] in k for p in predicates)]:
            self.drop(key)

    def clear(self) -> None:
        for key in list(self.entries):
            self.drop(key)


class Views:
    """Named queries kept as persisted tables, made anew when a predicate they read has changed."""

    def __init__(self):
        self.views: dict[str, tuple[set[str], Callable[[Graph], DataFrame], DataFrame | None]] = {}

    def define(self, name: str, predicates: set[str], make: Callable[[Graph], DataFrame]) -> None:
        self.views[name] = predicates, make, None

    def read(self, name: str, graph: Graph) -> DataFrame:
        predicates, make, kept = self.views[name]
        if kept is None:
            kept = make(graph).persist()
            self.views[name] = predicates, make, kept
        return kept

    def changed(self, predicates: set[str]) -> list[str]:
        out = []
        for name, (reads, make, kept) in self.views.items():
            if reads & predicates and kept is not None:
                kept.unpersist()
                self.views[name] = reads, make, None
                out.append(name)
        return out


def apply_result_diff(result: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    keys = result.columns
    return result.join(removed, keys, "left_anti").unionByName(added).distinct()


class RateLimiter:
    """A token bucket: ``rate`` requests a second, ``burst`` at once."""

    def __init__(self, rate: float, burst: int, clock: Callable[[], float] = time.monotonic):
        self.rate, self.burst, self.clock = rate, burst, clock
        self.tokens, self.last, self.lock = float(burst), clock(), threading.Lock()

    def allow(self) -> bool:
        with self.lock:
            now = self.clock()
            self.tokens = min(self.burst, self.tokens + (now - self.last) * self.rate)
            self.last = now
            if self.tokens < 1:
                return False
            self.tokens -= 1
            return True


__all__ = ["QueryCache", "RateLimiter", "Views", "apply_result_diff"]
