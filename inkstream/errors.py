"""What goes wrong in the engine's own terms; each kind has a name that stays the same for callers."""

from __future__ import annotations


class EngineError(Exception):
    name = "unknown"


class MissingValue(EngineError, ValueError):
    """Something that must be given is None."""

    name = "null"


class ConfigError(EngineError, ValueError):
    """A key that isn't known, or a value of another type."""

    name = "illegal_parameter"


class NotStarted(EngineError):
    """Used before it was started."""

    name = "not_initialised"


class AlreadyStarted(EngineError):
    name = "initialised"


class QueueEmpty(EngineError):
    """No result came within the time given."""

    name = "queue_empty"


class QueueFull(EngineError):
    name = "queue_full"


class Absent(EngineError, LookupError):
    """No such thing."""

    name = "absent"


class TimedOut(EngineError, TimeoutError):
    name = "timeout"


class NotReady(EngineError):
    name = "not_ready"


class InvalidHandle(EngineError):
    """A pipeline that was closed."""

    name = "invalid_handle"


class NoMemory(EngineError, MemoryError):
    name = "no_memory"


class NotCapable(EngineError):
    """A pipeline whose models are missing."""

    name = "not_supported"
