"""Component classification by ordered path templates, and the classification of generated files, as columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.errors import ValidationError
from gaugework.functions.globs import matches_any
from gaugework.schemas import ROLES

PLACEHOLDER = re.compile(r"^\{(component|application)\}$")


@dataclass(frozen=True)
class Template:
    """A path template of a role; segments in braces name the component or the application."""

    path: str
    role: str
    category: str

    def __post_init__(self):
        if self.role not in ROLES:
            raise ValidationError(f"template {self.path!r} has the unknown role {self.role!r}", template=self.path)
        names = [m.group(1) for s in self.segments if (m := PLACEHOLDER.match(s))]
        plain = [s for s in self.segments if not PLACEHOLDER.match(s)]
        if not self.path or self.path != self.path.strip() or any(s in ("", ".", "..") or re.search(r"[{}*?\[\\]", s) for s in plain) or len(set(names)) < len(names):
            raise ValidationError(f"template {self.path!r} isn't a relative path of names and distinct placeholders", template=self.path)
        needed = {"application": {"application"}, "application-module": {"application", "component"}}.get(self.role, {"component"} if "application" in names else set())
        if not needed <= set(names):
            raise ValidationError(f"{self.role} template {self.path!r} must hold {', '.join(sorted(needed))}", template=self.path)

    @property
    def segments(self) -> list[str]:
        return self.path.split("/")

    @property
    def exact(self) -> bool:
        """A template that names no component stands for one folder alone, not for what lies below it."""
        return self.role != "application" and "{component}" not in self.segments


@dataclass
class Classifier:
    """Templates in order of precedence: taxonomy first, then by role."""

    templates: list[Template] = field(default_factory=list)

    @classmethod
    def of(cls, taxonomy: list[tuple[str, str, list[str]]] = (), **by_role: list[str]) -> Classifier:
        ordered = [Template(p, role, category) for category, role, paths in taxonomy for p in paths]
        for role in ("application-module", "shared-module", "library", "development", "infrastructure", "application"):
            ordered += [Template(p, role, role) for p in by_role.get(role.replace("-", "_"), [])]
        paths = [t.path for t in ordered]
        if not ordered or len(set(paths)) < len(paths):
            raise ValidationError("component templates must be distinct, and there must be one")
        return cls(ordered)

    def columns(self, path: Column) -> dict[str, Column]:
        """id, name, role, category, application of a path; all null for a path that no template classifies.

        The first template that a path matches decides. A path that ends within a template, unless it is one of an
        application module, belongs to nothing, whatever comes after.
        """
        clean = F.trim(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("/"))
        folder = F.when(clean.endswith(".go"), F.when(clean.contains("/"), F.regexp_replace(clean, "/[^/]*$", "")).otherwise("")).otherwise(clean)
        parts = F.split(folder, "/")
        found: dict[str, Column | None] = dict.fromkeys(("id", "name", "role", "category", "application"))
        for t in self.templates:
            n = len(t.segments)
            same = [F.get(parts, F.lit(k)) == s for k, s in enumerate(t.segments) if not PLACEHOLDER.match(s)]
            whole = (F.size(parts) == n) if t.exact else (F.size(parts) >= n)
            for s in same:
                whole = whole & s
            values = {m.group(1): F.get(parts, F.lit(k)) for k, s in enumerate(t.segments) if (m := PLACEHOLDER.match(s))}
            name = values["application"] if t.role == "application" else values.get("component", F.lit(t.segments[-1]))
            row = {"id": F.array_join(F.slice(parts, 1, n), "/"), "name": name, "role": F.lit(t.role), "category": F.lit(t.category), "application": values.get("application", F.lit(""))}
            stop = None
            if t.role != "application-module":
                stop = F.size(parts) < n
                for k, s in enumerate(t.segments):
                    if not PLACEHOLDER.match(s):
                        stop = stop & ((F.size(parts) <= k) | (F.get(parts, F.lit(k)) == s))
            for c, value in row.items():
                found[c] = F.when(whole, value) if found[c] is None else found[c].when(whole, value)
                if stop is not None:
                    found[c] = found[c].when(stop, F.lit(None))
        return {c: F.when(folder != "", v) for c, v in found.items()}

    def classify(self, df: DataFrame, path: str = "path") -> DataFrame:
        return df.select("*", *(c.alias(f"component_{k}") for k, c in self.columns(F.col(path)).items()))


def generated(path: Column, header: Column, standard: Column, *, force_handwritten: list[str] = (), force_generated: list[str] = (), markers: list[str] = ()) -> Column:
    """Whether a file is generated: paths said to be handwritten, then paths said to be generated, the standard marker, header expressions."""
    by_header = F.lit(False)
    for m in markers:
        by_header = by_header | header.rlike(f"(?m){m}")
    return F.when(matches_any(path, list(force_handwritten)), False).when(matches_any(path, list(force_generated)), True).otherwise(standard | by_header)
