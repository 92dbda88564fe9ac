"""The engine's one error type."""


class ZarrError(ValueError):
    """A store, array or request that can't be served; the message says why."""
