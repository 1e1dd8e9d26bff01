"""Refusals that end a whole request. Refusals of one group are rows of its answer instead."""


class LogError(Exception):
    """Base of the errors below."""


class CollectionReset(LogError):
    """The collection is another incarnation than the caller knows, or its log is shorter than the cursor."""

    def __init__(self, epoch: str | None):
        super().__init__(f"the collection's epoch is {epoch}")
        self.epoch = epoch


class CursorTooOld(LogError):
    """History after the cursor has been trimmed."""

    def __init__(self, behind: int):
        super().__init__(f"the cursor is {behind} changes behind what is kept")
        self.behind = behind


class BadToken(LogError):
    """A cursor or page token that this log didn't issue."""


class UnknownCollection(LogError):
    """No such collection is registered."""


class UnknownBlob(LogError):
    """No such blob is registered."""


class CommitConflict(LogError):
    """Another writer committed first."""


class BlobRefused(LogError):
    """A blob's declaration or upload was refused; `code` says why."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(message or code)
        self.code = code


class PendingChanges(LogError):
    """Signing out would lose changes that were never sent."""
