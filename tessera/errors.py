"""What a statement can fail with: one class for each client-visible code."""

from __future__ import annotations


class EngineError(Exception):
    """code and retryable are what a client acts on; public is False where the message stays in the log."""

    code = "INTERNAL_ERROR"
    retryable = False
    public = True


class WriteConflict(EngineError):
    code, retryable = "WRITE_CONFLICT", True


class ConstraintViolation(EngineError):
    code = "CONSTRAINT_VIOLATION"


class SchemaMismatch(EngineError):
    code = "SCHEMA_MISMATCH"


class UnsupportedSql(EngineError):
    code = "UNSUPPORTED_SQL"


class SqlParseError(EngineError):
    code = "SQL_PARSE_ERROR"


class InvalidArgument(EngineError):
    code = "INVALID_ARGUMENT"


class StatementTimeout(EngineError):
    code, retryable = "STATEMENT_TIMEOUT", True


class NotLeader(EngineError):
    code, retryable = "NOT_LEADER", True


class ProposalUnavailable(EngineError):
    code, retryable = "PROPOSAL_UNAVAILABLE", True


class ConnectionLimit(EngineError):
    code, retryable = "CONNECTION_LIMIT", True


class CommitOutcomeUnknown(EngineError):
    code = "COMMIT_OUTCOME_UNKNOWN"


class CatalogOutcomeUnknown(EngineError):
    code = "CATALOG_OUTCOME_UNKNOWN"


class CheckpointOutcomeUnknown(EngineError):
    code = "CHECKPOINT_OUTCOME_UNKNOWN"


class CorruptData(EngineError):
    public = False


class RecoveryRequired(EngineError):
    public = False


class CommitNotStaged(EngineError):
    """The log certainly does not hold the commit."""

    public = False


def error_to_json(error: BaseException) -> dict:
    """The response to a failed statement. Internal details are replaced."""
    known = isinstance(error, EngineError)
    message = str(error) if known and error.public else "an internal engine error occurred"
    return {"ok": False, "error": {"code": error.code if known else "INTERNAL_ERROR", "message": message, "retryable": known and error.retryable}}


def from_spark(error: BaseException) -> BaseException:
    """The engine's error for one that Spark raised while it evaluated an expression; others come back as they are."""
    name = getattr(error, "getCondition", lambda: None)() or ""
    text = f"{name} {error}"
    for mark in ("DIVIDE_BY_ZERO", "ARITHMETIC_OVERFLOW", "REMAINDER_BY_ZERO", "integer remainder overflow", "BINARY_ARITHMETIC_OVERFLOW"):
        if mark in text:
            return InvalidArgument("division by zero" if "ZERO" in mark else "integer overflow")
    return error
