"""File patterns as Java regular expressions, and rule sets over file names."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_regex(pattern: str) -> str:
    """A glob, or with re: a regular expression, for a case-blind search that is anchored at the name's end only."""
    if pattern.startswith("re:"):
        return "(?iu)" + pattern[3:]
    lead, body, tail = "", pattern, ""
    if body.startswith("**/"):
        lead, body = "(?:.*?/)?", body[3:]
    elif body.startswith("*/"):
        lead, body = "(?:[^/]*/)?", body[2:]
    if body.endswith("/*") and not body.endswith("**/*"):
        body, tail = body[:-2], ".*"
    parts = ("[^/]*".join(map(re.escape, p.split("*"))) for p in body.split("**"))
    return f"(?iu){lead}{'.*?'.join(parts)}{tail}$"


def matches(name: Column, patterns: list[str]) -> Column:
    if not patterns:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [name.rlike(to_regex(p)) for p in patterns])


def categorize(name: Column, rules: list[tuple[str, list[str]]], default: str = "uncategorized") -> Column:
    """The first rule (category, patterns) that fits a file name."""
    out = F.lit(default)
    for category, patterns in reversed(rules):
        out = F.when(matches(name, patterns), F.lit(category)).otherwise(out)
    return out
