"""Grok patterns as regular expressions, evaluated by the JVM once a row."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from silt.functions.scalar import may_be_empty, quoted

#: Names that patterns may use; each is written with the ones before it.
PATTERNS = {
    "INT": r"[+-]?\d+",
    "BASE10NUM": r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)",
    "NUMBER": "%{BASE10NUM}",
    "WORD": r"\b\w+\b",
    "NOTSPACE": r"\S+",
    "SPACE": r"\s*",
    "DATA": r".*?",
    "GREEDYDATA": r".*",
    "QUOTEDSTRING": r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'",
    "UUID": r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",
    "MAC": r"(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}|(?:[0-9A-Fa-f]{4}\.){2}[0-9A-Fa-f]{4}",
    "IPV4": r"(?<![0-9])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![0-9])",
    "IPV6": r"(?:[0-9A-Fa-f]{0,4}:){2,7}(?:%{IPV4}|[0-9A-Fa-f]{0,4})",
    "IP": "%{IPV6}|%{IPV4}",
    "HOSTNAME": r"\b[0-9A-Za-z](?:[0-9A-Za-z-]{0,62})(?:\.[0-9A-Za-z][0-9A-Za-z-]{0,62})*\.?",
    "EMAILADDRESS": r"[A-Za-z0-9._%+-]+@%{HOSTNAME}",
    "URIPATH": r"(?:/[A-Za-z0-9$.+!*'(){},~:;=@#%&_-]*)+",
    "URIPATHPARAM": r"%{URIPATH}(?:\?[^\s]*)?",
    "URI": r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^\s/@]+@)?(?:%{HOSTNAME}|%{IP})?(?::\d+)?(?:%{URIPATHPARAM})?",
    "DATE": r"\d{4}-\d\d-\d\d|\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}",
    "TIME": r"(?:2[0-3]|[01]?\d):[0-5]\d(?::[0-5]?\d(?:[.,]\d+)?)?",
    "TIMESTAMP_ISO8601": r"\d{4}-\d\d-\d\d[T ]\d\d:?\d\d(?::?\d\d(?:[.,]\d+)?)?(?:Z|[+-]\d\d:?\d\d)?",
    "LOGLEVEL": r"(?i:trace|debug|info(?:rmation)?|notice|warn(?:ing)?|err(?:or)?|crit(?:ical)?|fatal|severe|alert|emerg(?:ency)?)",
}
_USE = re.compile(r"%\{(\w+)(?::([A-Za-z_]\w*)(?::\w+)?)?\}")
_CUT = "\ue0ff"


class Grok:
    """A compiled pattern: fields, in alphabetical order, and the groups of regex that hold them."""

    def __init__(self, pattern: str) -> None:
        self.groups: list[tuple[str, int, bool]] = []
        count = 0
        if re.search(r"(?<!\\)\((?!\?)", pattern):
            pattern = re.sub(r"(?<!\\)\((?!\?)", "(?:", pattern)
        pattern = re.sub(r"\(\?P?<([A-Za-z]\w*)>", lambda m: f"(?<{m[1]}>", pattern)

        def plain(text: str, depth: int = 0) -> str:
            def put(m: re.Match) -> str:
                if m[1] not in PATTERNS:
                    raise ValueError(f"unknown grok pattern %{{{m[1]}}}")
                if depth > 20:
                    raise ValueError("grok patterns refer to one another in a circle")
                return f"(?:{plain(PATTERNS[m[1]], depth + 1)})"

            return _USE.sub(put, text)

        def named(m: re.Match) -> str:
            nonlocal count
            inner = plain(m[0] if not m[2] else f"%{{{m[1]}}}")
            if not m[2]:
                return inner
            count += 1
            self.groups.append((m[2], count, may_be_empty(inner)))
            return f"({inner})"

        # Inline named groups are counted in the order of their place with the named uses.
        out, at = [], 0
        for m in re.finditer(rf"{_USE.pattern}|\(\?<([A-Za-z]\w*)>", pattern):
            out.append(pattern[at : m.start()])
            if m[3]:
                count += 1
                self.groups.append((m[3], count, True))
                out.append("(")
            else:
                out.append(named(m))
            at = m.end()
        self.regex = "".join(out) + pattern[at:]
        seen: dict[str, tuple[str, int, bool]] = {}
        for g in self.groups:
            seen.setdefault(g[0], g)
        self.fields = [seen[n] for n in sorted(seen)]


@lru_cache(128)
def compiled(pattern: str) -> Grok:
    return Grok(pattern)


def grok_sql(x: str, pattern: str) -> str:
    """SQL of a struct with a text for each named use; all null where the pattern doesn't match.

    One replacement writes all groups with marks between them; the text is then cut at the marks.
    """
    g = compiled(pattern)
    if not g.fields:
        return "CAST(NULL AS STRING)"
    marks = "".join(f"{_CUT}${n}" for _, n, _ in g.fields)
    whole = quoted(f"(?s)^.*?(?:{g.regex}).*$")
    parts = f"split(regexp_replace({x}, {whole}, '{marks}'), '{_CUT}')"
    values = []
    for i, (name, _, empty) in enumerate(g.fields):
        value = f"get({parts}, {i + 1})"
        values.append(f"'{name}', {value if empty else f"nullif({value}, '')"}")
    return f"named_struct({', '.join(values)})"


def grok(column: str, pattern: str) -> Column:
    """grok of a column, by name."""
    return F.expr(grok_sql(f"`{column}`", pattern))
