"""What a store raises."""

from __future__ import annotations


class StoreError(Exception):
    """Base of all of a store's own errors."""

    code = "Error"


class InvalidError(StoreError, ValueError):
    """An argument, a state or a schema that the store doesn't accept."""

    code = "Invalid"


class NotFoundError(StoreError, KeyError):
    """A table, schema version, entity or column that isn't there."""

    code = "KeyError"

    def __str__(self) -> str:
        return str(self.args[0]) if self.args else ""


class CapacityError(StoreError):
    """More tables than the configuration allows."""

    code = "CapacityError"


class ConflictError(StoreError):
    """Another writer has changed what this one had read; nothing was published."""

    code = "Conflict"


class SerializationError(StoreError):
    """Frames exist but none of them is valid."""

    code = "SerializationError"


class CorruptFrameError(StoreError, IOError):
    """A frame whose checksum doesn't match its bytes."""

    code = "IOError"
