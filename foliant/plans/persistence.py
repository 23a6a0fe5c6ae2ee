"""Keeping a collection in a store: load protocol, save queue, state flags."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from foliant.operators.changes import Load, diff
from foliant.plans.collection import SEQ, Collection
from foliant.sources.stores import BaseStore, apply_load


class Persisted:
    """Binds a collection to a store: register, load, flush earlier writes, load again; then save each write.

    Writes made while a save runs, or inside a batch, are saved together afterwards. Items that a load brings while
    writes are still unsaved are discarded, since the save that follows would be lost otherwise.
    """

    def __init__(self, collection: Collection, store: BaseStore) -> None:
        self.collection, self.store = collection, store
        self.is_ready = self.is_pulling = self.is_pushing = False
        self.dirty, self.loading = False, False
        self.saved: DataFrame = collection.df.drop(SEQ).limit(0)
        for event in ("added", "changed", "removed", "reset"):
            collection.on(event, self._written)
        collection.on("dispose", self.store.unregister)
        self.store.register(self.pull)
        early = not collection.df.isEmpty()
        self.pull()
        if early:
            self.dirty = True
            self.flush()
            self.pull()
        self.is_ready = True
        collection.emit("persistence.init")

    @property
    def is_loading(self) -> bool:
        return self.is_pulling or self.is_pushing

    def pull(self, load: Load | None = None) -> None:
        if self.is_pushing:
            return
        self.is_pulling = True
        try:
            load = load or self.store.load()
            if self.dirty and load.items is not None:
                return
            now = self.collection.df.drop(SEQ)
            state = apply_load(now, load, self.collection.key) if load.items is None else load.items
            if not self.is_ready and not self.saved.columns == [] and not now.isEmpty() and load.items is not None:
                state = state.join(now.select(self.collection.key), self.collection.key, "left_anti").unionByName(now, allowMissingColumns=True)
            self.loading = True
            try:
                self.collection.apply(diff(now, state, self.collection.key))
            finally:
                self.loading = False
            self.saved = load.items if load.items is not None else state
        finally:
            self.is_pulling = False

    def _written(self, *_: Any) -> None:
        if not self.loading:
            self.dirty = True
            if not self.collection.batching:
                self.flush()

    def flush(self) -> None:
        """Save what was written since the last save, as one change set."""
        if self.is_pushing or not self.dirty:
            return
        self.is_pushing = True
        try:
            while self.dirty:
                self.dirty = False
                now = self.collection.df.drop(SEQ)
                changes = diff(self.saved, now, self.collection.key)
                self.store.save(now, changes)
                self.saved = now
        finally:
            self.is_pushing = False

    def reset_data(self) -> None:
        """Finish pending saves, clear, and load again."""
        self.flush()
        self.saved = self.collection.df.drop(SEQ).limit(0)
        self.loading = True
        try:
            self.collection.remove_many({})
        finally:
            self.loading = False
        self.pull()
