"""Two glob grammars, compiled to regular expressions that run as ``rlike``.

Policy globs match whole paths: ``**`` is any number of segments, none included. Ignore patterns match a whole segment
anywhere if they hold no slash, else the first segments of a path.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugework.errors import ValidationError


def segment_regex(segment: str) -> str:
    """One segment: ``*`` and ``?`` stay within it, classes are ``[a-z]`` and ``[^a-z]``, a backslash quotes."""
    out, i = [], 0
    while i < len(segment):
        c = segment[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            end = segment.find("]", i + 2 if segment[i + 1 : i + 2] != "^" else i + 3)
            if end < 0:
                raise ValidationError(f"pattern segment {segment!r} has an open class", pattern=segment)
            body = segment[i + 1 : end]
            negated = body.startswith("^")
            out.append("[" + "^/" * negated + body[negated:].replace("[", r"\[").replace("&&", r"&\&") + "]")
            i = end
        elif c == "\\":
            i += 1
            if i == len(segment):
                raise ValidationError(f"pattern segment {segment!r} ends in a backslash", pattern=segment)
            out.append(re.escape(segment[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def glob_regex(pattern: str) -> str:
    """A policy glob as an anchored regular expression."""
    parts = [p for k, p in enumerate(pattern.split("/")) if not (p == "**" and k and pattern.split("/")[k - 1] == "**")]
    out = ""
    for k, part in enumerate(parts):
        first, last = k == 0, k == len(parts) - 1
        if part != "**":
            out += segment_regex(part) + ("" if last or parts[k + 1] == "**" and k + 1 == len(parts) - 1 else "/")
        elif first and last:
            out += ".*"
        elif last:
            out += "(?:/[^/]+)*"
        else:
            out += "(?:[^/]+/)*"
    return f"^{out}$"


def matches_any(path: Column, patterns: list[str]) -> Column:
    return path.rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns)) if patterns else F.lit(False)


def selected(path: Column, include: list[str], exclude: list[str]) -> Column:
    """An exclusion wins; without inclusions everything is included."""
    included = matches_any(path, include) if include else F.lit(True)
    return included & ~matches_any(path, exclude)


def ignored(path: Column, patterns: list[str]) -> Column:
    """A pattern without a slash matches any segment; one with a slash matches the path from its root on."""
    tests = [f"(?:^|/){segment_regex(p)}(?:/|$)" if "/" not in p else "^" + "/".join(segment_regex(s) for s in p.strip("/").split("/")) + "(?:/|$)" for p in patterns]
    return path.rlike("|".join(f"(?:{t})" for t in tests)) if tests else F.lit(False)
