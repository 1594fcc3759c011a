"""Errors that callers can tell apart."""


class DatasetError(ValueError):
    """A request that can't be planned: an unknown dataset, column, catalog, format or path."""


class NotSupported(NotImplementedError):
    """A catalog or format that is named but has no implementation."""
