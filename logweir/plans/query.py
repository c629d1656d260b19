"""Queries by type: a registry, and results cached until an event of a given type or a deadline."""

from __future__ import annotations

import threading
import time
from collections import OrderedDict
from collections.abc import Callable, Hashable
from dataclasses import dataclass
from typing import Any


class QueryBus:
    """Handlers by the exact class of the query."""

    def __init__(self) -> None:
        self.handlers: dict[type, Callable[[Any], Any]] = {}

    def register(self, kind: type, handler: Callable[[Any], Any]) -> None:
        if kind in self.handlers:
            raise ValueError(f"{kind.__name__} has a handler")
        self.handlers[kind] = handler

    def dispatch(self, query: Any, user: str | None = None) -> Any:
        if type(query) not in self.handlers:
            raise ValueError(f"no handler for {type(query).__name__}")
        return self.handlers[type(query)](query)


@dataclass(frozen=True)
class CachePolicy:
    ttl_s: float
    most: int
    evict_on: frozenset[str] = frozenset()
    per_user: bool = False


class CachingBus:
    """A bus in front of another one. A query that is kept per user and has none is not cached; a result whose type was
    evicted while it was made is not kept."""

    def __init__(self, inner: QueryBus, policies: dict[type, CachePolicy], clock: Callable[[], float] = time.monotonic):
        self.inner, self.policies, self.clock, self.lock = inner, policies, clock, threading.Lock()
        self.held: dict[type, OrderedDict[Hashable, tuple[float, Any]]] = {k: OrderedDict() for k in policies}
        self.turn: dict[type, int] = dict.fromkeys(policies, 0)

    def dispatch(self, query: Any, user: str | None = None) -> Any:
        kind = type(query)
        policy = self.policies.get(kind)
        if policy is None or policy.per_user and user is None:
            return self.inner.dispatch(query, user)
        key = (user, query) if policy.per_user else query
        with self.lock:
            entry, turn = self.held[kind].get(key), self.turn[kind]
            if entry and entry[0] > self.clock():
                self.held[kind].move_to_end(key)
                return entry[1]
        result = self.inner.dispatch(query, user)
        with self.lock:
            if self.turn[kind] == turn:
                self.held[kind][key] = (self.clock() + policy.ttl_s, result)
                self.held[kind].move_to_end(key)
                while len(self.held[kind]) > policy.most:
                    self.held[kind].popitem(last=False)
        return result

    def events(self, types: set[str]) -> None:
        """Evicts what events of these types make stale."""
        with self.lock:
            for kind, policy in self.policies.items():
                if policy.evict_on & types:
                    self.held[kind].clear()
                    self.turn[kind] += 1
