"""Exception taxonomy: each outcome a caller has to tell apart has its own class."""


class TimelineError(Exception):
    """Base of every error raised by this package."""


class InvalidRequestError(TimelineError, ValueError):
    """A limit, stream name or position that can never be valid."""


class LsnExpiredError(TimelineError):
    """The requested position is below the retention floor."""

    def __init__(self, requested: int, oldest: int, head_next: int):
        super().__init__(f"lsn {requested} is below the floor {oldest} (head {head_next})")
        self.requested, self.oldest, self.head_next = requested, oldest, head_next


class LsnExhaustedError(TimelineError):
    """The position after the largest possible sequence number was asked for."""


class LsnRangeError(TimelineError):
    """A sequence number does not fit the signed 64-bit analytic representation."""


class PartitionNotFoundError(TimelineError):
    """No head is known for the partition."""


class TimestampRegressionError(TimelineError):
    """An append would make the timestamps of a partition go backwards."""


class CorruptDataError(TimelineError):
    """Bytes or metadata contradict each other."""


class CheckpointError(TimelineError):
    """A cursor checkpoint is malformed or of an unknown version."""


class CheckpointMismatchError(CheckpointError):
    """The checkpoint belongs to another stream or partition."""


class CheckpointAheadError(CheckpointError):
    """The checkpoint lies beyond the committed head."""


class FencedError(TimelineError):
    """A newer writer epoch owns the partition."""


class ConflictError(TimelineError):
    """A compare-and-set lost against another commit; definitely not applied."""


class IndeterminateCommitError(TimelineError):
    """The commit may or may not have been applied."""


class RetentionRegressionError(TimelineError):
    """A retention request is older than the one already recorded."""
