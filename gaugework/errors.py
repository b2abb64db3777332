"""Failure categories. Every error carries the entity it is about, so a caller can tell what to correct."""

from __future__ import annotations


class AnalysisError(Exception):
    category = "unknown"

    def __init__(self, message: str, **entity: object):
        super().__init__(message)
        self.entity = entity


def _kinds(*names: str) -> dict[str, type[AnalysisError]]:
    return {n: type("".join(w.capitalize() for w in n.split("_")) + "Error", (AnalysisError,), {"category": n}) for n in names}


#: The closed set of categories.
CATEGORIES = _kinds(
    "validation", "not_found", "already_exists", "conflict", "unauthenticated", "permission_denied", "precondition_failed", "out_of_range", "resource_exhausted", "canceled", "deadline_exceeded", "unavailable",
    "unimplemented", "data_loss", "internal",
)
ValidationError = CATEGORIES["validation"]
NotFoundError = CATEGORIES["not_found"]
AlreadyExistsError = CATEGORIES["already_exists"]
PreconditionFailedError = CATEGORIES["precondition_failed"]
InternalError = CATEGORIES["internal"]
UnavailableError = CATEGORIES["unavailable"]

#: Remote call status of each category; anything else is an internal failure.
RPC_CODES = {"validation": "invalid_argument", "conflict": "aborted", "precondition_failed": "failed_precondition"} | {
    k: k for k in CATEGORIES if k not in ("validation", "conflict", "precondition_failed")
}
