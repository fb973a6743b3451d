"""One exception for all refusals, with a code that callers can test."""

from __future__ import annotations

from typing import Any


#: The codes that callers know.
CODES = (
    "INVALID_DATA", "SCHEMA_MISMATCH", "NONFINITE_TARGET", "INF_DISABLED", "NUMERIC_OVERFLOW", "SNAPSHOT_CORRUPT",
    "CONTEXT_INCOMPATIBLE", "RESULT_INVALID", "STALE_REQUEST", "CANCELLED", "INVALID_FORMAT", "TYPE_LOSS",
    "NAME_CONFLICT", "INVALID_QUERY", "EMPTY_INPUT", "INVALID_TARGET", "FEATURE_MISMATCH", "INPUT_LIMIT", "EXPORT_FAILED",
)


class WorkbenchError(Exception):
    def __init__(self, code: str, message: str, **details: Any) -> None:
        if code not in CODES:
            raise ValueError(code)
        super().__init__(f"{code}: {message}" + (f" {details}" if details else ""))
        self.code, self.message, self.details = code, message, details
