"""Settings of a store, their checks, and how they are read from JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

from tidemark.errors import InvalidError

DAY_MS = 86_400_000


@dataclass
class StoreConfig:
    """``db_path`` is the store's root.

    ``ttl_days`` and ``max_column_families`` (tables) take effect.  The others
    tune an embedded engine's storage; they are read and checked, so that
    existing files work, and have no meaning on a cluster.
    """

    db_path: str = ""
    disable_wal: bool = False
    use_direct_reads: bool = False
    fill_cache_on_read: bool = True
    enable_mmap_reads: bool = False
    block_cache_size_mb: int = 512
    ttl_days: int = 3
    max_column_families: int = 1024
    max_active_versions_per_table: int = 16
    max_background_compactions: int = 4
    max_background_flushes: int = 2
    write_buffer_size: int = 128 << 20

    def validate(self) -> StoreConfig:
        if not self.db_path:
            raise InvalidError("db_path must not be empty")
        for name in ("block_cache_size_mb", "ttl_days", "max_column_families", "max_active_versions_per_table", "write_buffer_size"):
            if getattr(self, name) <= 0:
                raise InvalidError(f"{name} must be positive")
        for name in ("max_background_compactions", "max_background_flushes"):
            if getattr(self, name) < 0:
                raise InvalidError(f"{name} must not be negative")
        return self

    @property
    def ttl_ms(self) -> int:
        return self.ttl_days * DAY_MS

    @classmethod
    def load(cls, path: str) -> StoreConfig:
        """From a JSON file.  Unknown keys are ignored, missing ones keep their defaults."""
        try:
            with open(path, encoding="utf-8") as file:
                text = file.read()
        except OSError as e:
            raise OSError(f"can't read {path}: {e}") from e
        try:
            found = json.loads(text)
        except ValueError as e:
            raise InvalidError(f"{path} isn't JSON: {e}") from e
        if not isinstance(found, dict):
            raise InvalidError(f"{path} must hold an object")
        known = {f.name: type(f.default) for f in fields(cls)}
        for name, kind in known.items():
            if name in found and (type(found[name]) is not kind or kind is int and not -(1 << 63) <= found[name] < 1 << 64):
                raise InvalidError(f"{name} must be of type {kind.__name__}")
        return cls(**{name: found[name] for name in known if name in found}).validate()

    def to_json(self) -> str:
        return json.dumps(asdict(self))
