"""Errors with a code and a context, as a caller or the command line reports them."""

from __future__ import annotations


class CodedError(Exception):
    """code: one of the fixed codes below; context: what the message is about."""

    def __init__(self, code: str, message: str, **context: object) -> None:
        super().__init__(message)
        self.code, self.message, self.context = code, message, context

    def as_dict(self, command: str | None = None) -> dict[str, object]:
        out: dict[str, object] = {"error_code": self.code, "message": self.message}
        if command:
            out["command"] = command
        return out | ({"context": self.context} if self.context else {})


# The error codes.
SENSOR = "invalid_sensor_schema"
PREPARE = "prepare_failed"
LIBRARY = "invalid_prepared_library"
VERSION = "prepared_library_incompatible"
INPUT = "invalid_mapping_input"
CSV = "invalid_input_csv"
MISSING = "missing_input_file"
USAGE = "invalid_cli_usage"
RESULT = "invalid_result"
DOWNLOAD = "download_failed"
