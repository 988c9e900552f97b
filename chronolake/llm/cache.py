"""A bounded map from short texts to what is derived from them."""

from __future__ import annotations

from collections.abc import Callable, Iterable


class Cache(dict):
    """Two generations of ``most`` entries: what is asked for again outlives what is seen once.

    Keys of over ``longest`` characters are derived anew each time.
    """

    def __init__(self, make: Callable, most: int = 150_000, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(key) > self.longest:
            return
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value

    def unknown(self, keys: Iterable) -> list:
        """Those of keys that would be kept and aren't known."""
        return [x for x in keys if x not in self and x not in self.old and len(x) <= self.longest]
