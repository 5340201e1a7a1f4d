"""Typed failures: a stable code, a broad category and a process exit status each."""

from __future__ import annotations


class EngineError(Exception):
    code, category, exit_code = "operation_failed", "operation", 1


class Cancelled(EngineError):
    """The operation's token was cancelled at a safe point; nothing was committed."""

    code, category, exit_code = "cancelled", "cancellation", 1


class UnreadableInput(EngineError):
    code, category, exit_code = "analysis_read", "analysis", 1


class BadFormat(EngineError, ValueError):
    code, category, exit_code = "invalid_format", "format", 1


class BadInput(EngineError, ValueError):
    """The source is no table that can be profiled."""

    code, category, exit_code = "invalid_csv", "format", 2


class BadProfile(EngineError, ValueError):
    code, category, exit_code = "invalid_profile", "configuration", 1


class RowsOutOfRange(EngineError, ValueError):
    code, category, exit_code = "rows_out_of_range", "configuration", 3


class BadOption(EngineError, ValueError):
    code, category, exit_code = "invalid_format", "configuration", 1


class OutputExists(EngineError, FileExistsError):
    """An output is only replaced where that is asked for."""

    code, category, exit_code = "output_not_writable", "output", 2


class MetadataError(BadFormat):
    code = "metadata_serialization_error"


class ArchiveParseError(BadFormat):
    code = "archive_parse"


def describe(error: BaseException) -> tuple[str, str, int]:
    """(code, category, exit status) of any failure."""
    if isinstance(error, EngineError):
        return error.code, error.category, error.exit_code
    if isinstance(error, FileExistsError):
        return OutputExists.code, OutputExists.category, OutputExists.exit_code
    if isinstance(error, OSError):
        return "io_error", "io", 1
    if isinstance(error, ValueError):
        return BadFormat.code, BadFormat.category, 1
    return EngineError.code, EngineError.category, 1
