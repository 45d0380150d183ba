"""Globs as regular expressions, in three dialects: ignore files, right-anchored path matching, and directory globbing."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _segment(part: str) -> str:
    """A glob without slashes as a regular expression that both Java and Python read."""
    out, i = "", 0
    while i < len(part):
        c = part[i]
        i += 1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            end = part.find("]", i + 1 + (part[i : i + 1] in ("!", "^")))
            if end < 0:
                out += r"\["
            else:
                inside = part[i:end]
                negate = inside[:1] in ("!", "^")
                body = inside[1:] if negate else inside
                out += "[" + ("^/" if negate else "") + re.sub(r"([\\\[\]&^])", r"\\\1", body) + "]"
                i = end + 1
        elif c == "\\" and i < len(part):
            out += re.escape(part[i])
            i += 1
        else:
            out += re.escape(c)
    return out


def path_match(pattern: str) -> str:
    """Regex of a right-anchored match: as many segments as the pattern has, '**' being one of them."""
    parts = [p for p in pattern.split("/") if p and p != "."]
    body = "/".join(_segment("*" if p == "**" else p) if p not in ("*", "**") else "[^/]+" for p in parts)
    return f"^{body}$" if pattern.startswith("/") else f"(?:^|/){body}$"


def directory_glob(pattern: str) -> str:
    """Regex of files below a root that a glob finds: '**' stands for any number of directories."""
    parts = [p for p in pattern.split("/") if p and p != "."]
    out = ""
    for k, p in enumerate(parts):
        last = k + 1 == len(parts)
        if p == "**":
            out += ".*" if last else "(?:[^/]+/)*"
        else:
            out += _segment(p) + ("" if last else "/")
    return f"^{out}$"


def name_match(pattern: str) -> str:
    """Regex of a glob over a whole name."""
    return f"^{_segment(pattern)}$"


def ignore_rules(lines: list[str]) -> list[tuple[bool, str]]:
    """Rules of an ignore file in order: (ignored or not, regex over a path whose directories end in a slash)."""
    rules = []
    for line in lines:
        text = line.rstrip("\r\n")
        while text.endswith(" ") and not text.endswith("\\ "):
            text = text[:-1]
        if not text or text.startswith("#"):
            continue
        ignored = not text.startswith("!")
        if not ignored:
            text = text[1:]
        if text.startswith(("\\#", "\\!")):
            text = text[1:]
        only_dir = text.endswith("/")
        text = text.strip("/") if text.startswith("/") else text.rstrip("/")
        if not text:
            continue
        anchored = line.lstrip("!").startswith("/") or "/" in text
        parts = text.split("/")
        out = "^" if anchored else "^(?:.*/)?"
        for k, p in enumerate(parts):
            last = k + 1 == len(parts)
            if p == "**":
                if last:
                    out += ".+"
                else:
                    out += "(?:[^/]+/)*"
                continue
            out += ("[^/]+" if p == "*" else _segment(p)) + ("" if last else "/")
        ends_open = parts[-1] == "**"
        rules.append((ignored, out + ("$" if ends_open else "/.*$" if only_dir else "(?:/.*)?$")))
    return rules


def any_match(column: Column, patterns: list[str]) -> Column:
    """Whether any of the regular expressions is found; one pattern, one pass. No patterns: False."""
    return column.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def ignored(path: Column, rules: list[tuple[bool, str]]) -> Column:
    """Whether the last rule that fits a path ignores it."""
    out = F.lit(False)
    for ignore, pattern in rules:
        out = F.when(path.rlike(pattern), F.lit(ignore)).otherwise(out)
    return out
