"""The package's one kind of error."""


class SpatialError(ValueError):
    """An argument or a buffer that no query can use."""
