"""Collections that fetch what their live selectors ask for, keep it while it is observed, and merge it by key."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame

from foliant.operators.changes import merge_live
from foliant.plans.collection import Cursor
from foliant.streaming.observe import Observer


class AutoFetch:
    """fetch(selector) -> DataFrame; results are cached by the selector's canonical JSON and counted by observers."""

    def __init__(self, fetch: Callable[[dict], DataFrame], purge_delay: float = 10.0, merge: Callable[[list[DataFrame]], DataFrame] | None = None, key: str = "id", clock: Callable[[], float] = time.monotonic) -> None:
        self.fetch, self.purge_delay, self.key, self.clock = fetch, purge_delay, key, clock
        self.merge = merge or (lambda parts: merge_live(parts, key))
        self.cached: dict[str, DataFrame] = {}
        self.selectors: dict[str, dict] = {}
        self.watchers: dict[str, int] = {}
        self.idle: dict[str, float] = {}
        self.loading: set[str] = set()
        self.observers: list[Observer] = []
        self.timers: set[threading.Timer] = set()

    @staticmethod
    def key_of(selector: dict | None) -> str:
        return json.dumps(selector or {}, sort_keys=True, default=str)

    def register_query(self, selector: dict | None) -> None:
        k = self.key_of(selector)
        self.watchers[k] = self.watchers.get(k, 0) + 1
        self.idle.pop(k, None)
        if k not in self.cached:
            self._load(k, selector or {})

    def _load(self, k: str, selector: dict) -> None:
        self.loading.add(k)
        try:
            self.cached[k] = self.fetch(selector).persist()  # spills to executors' disks; recomputed if one is lost
            self.selectors[k] = selector
        finally:
            self.loading.discard(k)

    def unregister_query(self, selector: dict | None) -> None:
        k = self.key_of(selector)
        if k in self.watchers:
            self.watchers[k] -= 1
            if self.watchers[k] <= 0:
                del self.watchers[k]
                self.idle[k] = self.clock()
                self._purge_later()
        self.purge()

    def _purge_later(self) -> None:
        """Look again once the delay is over, whether or not anyone asks for anything until then."""

        def run() -> None:
            self.timers.discard(timer)
            self.purge()

        timer = threading.Timer(self.purge_delay + 0.01, run)
        timer.daemon = True
        self.timers.add(timer)
        timer.start()

    def dispose(self) -> None:
        for timer in list(self.timers):
            timer.cancel()
        for o in self.observers:
            o.cleanup()
        for df in self.cached.values():
            df.unpersist()
        self.cached.clear()

    def purge(self) -> None:
        for k, since in list(self.idle.items()):
            if self.clock() - since >= self.purge_delay:
                del self.idle[k]
                self.selectors.pop(k, None)
                if (df := self.cached.pop(k, None)) is not None:
                    df.unpersist()

    def is_loading(self, selector: dict | None = None) -> bool:
        return bool(self.loading) if selector is None else self.key_of(selector) in self.loading

    def refetch(self) -> None:
        for k, selector in list(self.selectors.items()):
            old = self.cached[k]
            self._load(k, selector)
            old.unpersist()
        self._requery()

    def _requery(self) -> None:
        self.observers = [o for o in self.observers if o.active]
        for o in self.observers:
            o.requery()

    def items(self) -> DataFrame | None:
        parts = list(self.cached.values())
        return self.merge(parts) if parts else None

    def _cursor(self, selector: dict | None, options: dict[str, Any]) -> Cursor:
        def source() -> DataFrame:
            if self.key_of(selector) not in self.cached:  # purged since
                self.register_query(selector)
                self.unregister_query(selector)
            return self.items()

        return Cursor(source, selector, key=self.key, **options)

    def find(self, selector: dict | None = None, **options: Any) -> Cursor:
        """What the selector asks for, fetched if need be; no longer held once the purge delay is over."""
        self.register_query(selector)
        self.unregister_query(selector)
        return self._cursor(selector, options)

    def observe(self, selector: dict | None, callbacks: dict[str, Callable[..., Any]], skip_initial: bool = False, **options: Any) -> Observer:
        """The query is held until the observer's cleanup."""
        self.register_query(selector)
        out = self._cursor(selector, options).observe(callbacks, skip_initial)
        end = out.cleanup

        def cleanup() -> None:
            if out.active:
                end()
                self.unregister_query(selector)

        out.cleanup = cleanup
        self.observers.append(out)
        return out
