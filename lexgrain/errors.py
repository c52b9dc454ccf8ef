"""Errors of the engine."""


class LexgrainError(Exception):
    """Base of all errors here."""


class InvalidPattern(LexgrainError):
    """The pattern can't be parsed, or uses what the dialect leaves out."""


class InvalidOptions(LexgrainError):
    """Options that contradict each other."""


class IndexError_(LexgrainError):
    """Base of what can be wrong with a stored index."""


class IndexMissing(IndexError_):
    """No index at the path."""


class UnsupportedVersion(IndexError_):
    """Written by another major version."""


class IndexCorrupted(IndexError_):
    """Tables and their recorded counts or checksums disagree."""


class TableMissing(IndexCorrupted):
    """A table that the metadata names is absent."""


class WatcherRunning(LexgrainError):
    """A live watcher owns the index, so it isn't rebuilt by hand."""
