"""Settings: typed defaults, an optional JSON document over them, and single overrides over both."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace

from gaugework.errors import ValidationError


@dataclass(frozen=True)
class Settings:
    sort: str = "afferent"
    limit: int = 20
    findings_limit: int = 0
    calls_limit: int = 50
    fail_on: str = "none"
    similarity: float = 0.85
    duplication_budget: int = 0
    crap_limit: float = 8.0
    interval_ms: int = 750
    cache: str = "auto"

    def __post_init__(self):
        for f in fields(self):
            kind = type(f.default)
            value = getattr(self, f.name)
            if not isinstance(value, kind) and not (kind is float and isinstance(value, int)):
                raise ValidationError(f"{f.name} must be of type {kind.__name__}", setting=f.name)

    @classmethod
    def load(cls, text: str | None = None) -> Settings:
        values = json.loads(text) if text else {}
        return cls().override(**values)

    def override(self, **values: object) -> Settings:
        unknown = set(values) - {f.name for f in fields(self)}
        if unknown:
            raise ValidationError(f"unknown settings {', '.join(sorted(unknown))}")
        return replace(self, **values)

    @classmethod
    def schema(cls) -> dict:
        """A JSON schema of the document."""
        names = {str: "string", int: "integer", float: "number"}
        return {"type": "object", "additionalProperties": False, "properties": {k: {"type": names[type(v)], "default": v} for k, v in asdict(cls()).items()}}
