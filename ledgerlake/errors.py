"""Errors with a stable code. A message names fields and types, never a data value."""

from __future__ import annotations

# The codes.
CODES = frozenset(
    {
        "params_invalid",
        "filter_syntax",
        "token_unknown",
        "token_partial",
        "token_ambiguous",
        "token_type_mismatch",
        "entity_unknown",
        "entity_hidden",
        "object_not_found",
        "permission_denied",
        "field_write_denied",
        "recipe_unknown",
        "recipe_param",
        "pending_expired",
        "pending_stale",
        "commit_limit",
        "record_exists",
        "undo_unsupported",
    }
)


class EngineError(Exception):
    def __init__(self, code: str, message: str, hint: str = "") -> None:
        if code not in CODES:
            raise ValueError(f"unknown error code {code}")
        super().__init__(message)
        self.code, self.message, self.hint = code, message, hint

    def as_dict(self) -> dict:
        return {"error": {"code": self.code, "message": self.message, "hint": self.hint}}
