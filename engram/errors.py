"""Typed errors, raised on the driver when a plan is built, and the engine's limits."""

from __future__ import annotations

CODES = (
    "DIMENSION_MISMATCH", "EMBEDDING_SPACE_MISMATCH", "INVALID_ARGUMENT", "LIMIT_EXCEEDED", "NOT_FOUND", "ALREADY_EXISTS", "CORRUPT",
    "UNSUPPORTED", "LOCKED", "EMBEDDER_UNAVAILABLE", "PATH_UNSAFE", "READ_ONLY", "VERSION",
)

MAX_DIMENSION = 4096
MAX_ID_BYTES = 512
MAX_METADATA_BYTES = 64 * 1024
MAX_BATCH = 10_000
MAX_K = 1000
MAX_QUERY_CHARS = 32_768
MAX_OVERFETCH = 4096


class EngineError(Exception):
    def __init__(self, code: str, message: str, **details):
        assert code in CODES, code
        super().__init__(f"{code}: {message}")
        self.code, self.message, self.details = code, message, details

    def to_dict(self) -> dict:
        return {"code": self.code, "message": self.message, "details": self.details}


def invalid(message: str, **details) -> EngineError:
    return EngineError("INVALID_ARGUMENT", message, **details)


def unsupported(message: str, **details) -> EngineError:
    return EngineError("UNSUPPORTED", message, **details)
