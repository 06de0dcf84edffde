"""What an unquoted text may stand for: numbers, byte sizes, dates, calendar slots, item ids, patterns."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from .syntax import QueryError

#: Item ids: blocks of 2**58; fixed values of the data model.
BLOCK = 1 << 58
ORIGINS = {-1: "builtin", 0: "user", 8: "file", 16: "plugin"}
SHOWN = {-1: "Sys", 0: "User", 8: "File", 16: "Plg"}

_UNITS = {"B": 1} | {u: 1024**k for k, x in enumerate("KMGTP", 1) for u in (x, f"{x}B", f"{x}IB")}
_META = re.compile(r"(?<!\\)[*?\[]")


def is_pattern(text: str) -> bool:
    """Whether a text holds an unescaped pattern character."""
    return bool(_META.search(re.sub(r"\\\\", "", text)))


def plain(text: str) -> str:
    """A text without the escapes of its pattern characters."""
    return re.sub(r"\\([*?\[\]\\])", r"\1", text)


def glob_regex(pattern: str) -> str:
    """A Java and Python expression for a whole-string, case-sensitive pattern of ``* ? [set] [!set]`` and escapes."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "\\" and i < len(pattern):
            out.append(re.escape(pattern[i]))
            i += 1
        elif c == "[":
            end = pattern.find("]", i + 1 + (pattern[i : i + 1] == "!"))
            if end < 0:
                return r"(?s)\A(?!)\z"  # an open set never matches
            body, i = pattern[i:end], end + 1
            no, body = body[:1] == "!", body.removeprefix("!")
            out.append("[" + "^" * no + re.sub(r"([\\\[\]^&~])", r"\\\1", body) + "]")
        else:
            out.append(re.escape(c))
    return rf"(?s)\A{''.join(out)}\z"


def group_regex(pattern: str) -> str:
    """The expression whose first group is what a label is grouped by."""
    left, right = pattern.startswith("^"), pattern.endswith("$")
    body = pattern[left : len(pattern) - right]
    text = "".join(".*?" if c == "*" else "." if c == "?" else re.escape(c) for c in body)
    return f"(?s){'^' * (left or body.startswith('*'))}({text}){'$' * (right or body.endswith('*'))}"


@dataclass(frozen=True)
class Band:
    """Integers from lo to hi; with a modulus, of the remainder."""

    lo: int
    hi: int
    modulus: int | None = None


@dataclass(frozen=True)
class Slot:
    """Fixed calendar fields, from the coarsest; the others are free."""

    fields: tuple  # (name, value or None)


FIELDS = ("year", "month", "day", "hour", "minute", "second")


def size(text: str) -> Band | None:
    """Bytes with a unit (1024-based): a point, or a band of ``*MB``, ``2.*MB`` and ``*.5MB``."""
    m = re.fullmatch(r"\s*([0-9.*]+)\s*([A-Za-z]+)\s*", text)
    if not m or m[2].upper() not in _UNITS:
        return None
    unit, num = _UNITS[m[2].upper()], m[1]
    if "*" not in num:
        try:
            n = int(float(num) * unit)
        except ValueError:
            return None
        return Band(n, n)
    if num in ("*", "*.*"):
        return Band(0, 2**63 - 1)
    if m := re.fullmatch(r"(\d+)\.\*", num):
        return Band(int(m[1]) * unit, (int(m[1]) + 1) * unit - 1)
    if m := re.fullmatch(r"\*\.(\d+)", num):
        ten, n = 10 ** len(m[1]), int(m[1])
        return Band(-(-n * unit // ten), -(-(n + 1) * unit // ten) - 1, unit)
    return None


def _stamp(*parts: int) -> int:
    return int(datetime(*parts, tzinfo=UTC).timestamp())


def _next(parts: list[int]) -> int:
    """The first second after the period that the parts name."""
    y, mo, d = (parts + [1, 1])[:3] if len(parts) < 3 else parts[:3]
    if len(parts) == 1:
        return _stamp(y + 1, 1, 1)
    if len(parts) == 2:
        return _stamp(y + mo // 12, mo % 12 + 1, 1)
    start = datetime(*parts, tzinfo=UTC)
    return int((start + timedelta(**{("days", "hours", "minutes", "seconds")[len(parts) - 3]: 1})).timestamp())


def date(text: str, now: datetime, bare_year: bool = True) -> Band | Slot | None:
    """A point in time by its precision (UTC), or a calendar slot with free fields."""
    text = text.strip()
    low = text.lower()
    if low in ("today", "yesterday", "now"):
        day = now - timedelta(days=low == "yesterday")
        return Band(int(now.timestamp()), int(now.timestamp())) if low == "now" else _period([day.year, day.month, day.day])
    if m := re.fullmatch(r"(\d+)(mo|[smhdwy])(?: ago)?", low):
        if not low.endswith("ago"):
            return None
        n, unit = int(m[1]), m[2]
        if unit in "smh":
            t = int((now - timedelta(**{{"s": "seconds", "m": "minutes", "h": "hours"}[unit]: n})).timestamp())
            return Band(t, t)
        day = now - timedelta(days=n * {"d": 1, "w": 7, "mo": 30, "y": 365}[unit])
        return _period([day.year, day.month, day.day])
    if m := re.fullmatch(r"(\d{1,2})/(\d{1,2})", text):
        return _period([now.year, int(m[1]), int(m[2])])
    x = r"(\d+|\*)"
    m = re.fullmatch(rf"(?:{x})(?:-{x}(?:-{x})?)?(?:[ T]{x}(?::{x}(?::{x})?)?)?", text)
    if m and "-" in text:
        fields = list(m.groups())
    elif t := re.fullmatch(rf"{x}:{x}(?::{x})?", text):
        fields = [None, None, None, *t.groups()]
        if "*" not in text:
            return _period([now.year, now.month, now.day, int(t[1]), int(t[2]), *([int(t[3])] if t[3] else [])])
    elif bare_year and re.fullmatch(r"\d{4}", text):
        fields = [text, *[None] * 5]
    else:
        return None
    if "*" in fields:
        return Slot(tuple((n, None if f in ("*", None) else int(f)) for n, f in zip(FIELDS, fields, strict=True)))
    parts = [int(f) for f in fields if f is not None]
    if len(str(parts[0])) != 4 and len(fields[0] or "") != 4:
        return None
    return _period(parts)


def _period(parts: list[int]) -> Band:
    try:
        start = _stamp(*(parts + [1, 1])[: max(3, len(parts))])
        return Band(start, _next(parts) - 1)
    except ValueError as e:
        raise QueryError(f"no such date: {e}") from None


def item_id(text: str) -> Band | None:
    """``File(3)`` or a whole block, ``File(*)``."""
    for block, shown in SHOWN.items():
        if m := re.fullmatch(rf"{shown}\((\d+|\*)\)", text):
            base = block * BLOCK
            return Band(base, base + BLOCK - 1) if m[1] == "*" else Band(base + int(m[1]), base + int(m[1]))
    return None


def number(text: str) -> int | float | None:
    if re.fullmatch(r"[-+]?\d+", text):
        return int(text)
    if re.fullmatch(r"[-+]?(\d+\.\d*|\.\d+|\d+(?:\.\d*)?[eE][-+]?\d+)", text):
        return float(text)
    return None
