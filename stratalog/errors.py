"""Errors of the store, in one hierarchy."""


class StoreError(Exception):
    """Base of all errors of this package."""


class KeyIsEmpty(StoreError):
    """A key is null or has no bytes."""


class KeyNotFound(StoreError):
    """The key is absent, deleted or expired."""


class DatabaseIsUsing(StoreError):
    """Another writer published a version first."""


class ReadOnlyBatch(StoreError):
    """A read-only batch was asked to write."""


class BatchCommitted(StoreError):
    """The batch has been committed."""


class BatchRollbacked(StoreError):
    """The batch has been rolled back."""


class DBClosed(StoreError):
    """The store has been closed."""


class MergeRunning(StoreError):
    """A compaction of this store is under way."""


class WatchDisabled(StoreError):
    """The change feed is off."""


class InvalidOptions(StoreError, ValueError):
    """Options that cannot be used."""


class InvalidPattern(StoreError, ValueError):
    """A key pattern that the regular-expression dialect does not allow."""
