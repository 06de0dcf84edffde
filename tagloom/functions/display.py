"""How values are shown."""

from __future__ import annotations

from datetime import UTC, datetime


def size(n: int) -> str:
    """Bytes in 1024-based units with two decimals."""
    if n < 1024:
        return f"{n}B"
    value = float(n)
    for unit in ("KB", "MB", "GB", "TB", "PB"):
        value /= 1024
        if value < 1024 or unit == "PB":
            return f"{value:.2f}{unit}"
    return str(n)


def time(seconds: int, form: str = "human", now: datetime | None = None) -> str:
    """Epoch seconds: human, iso, relative or raw."""
    t = datetime.fromtimestamp(seconds, UTC)
    if form == "raw":
        return str(seconds)
    if form == "iso":
        return t.isoformat().replace("+00:00", "Z")
    if form == "relative":
        d = int(((now or datetime.now(UTC)) - t).total_seconds())
        for unit, n in (("d", 86400), ("h", 3600), ("m", 60)):
            if abs(d) >= n:
                return f"{abs(d) // n}{unit} {'ago' if d > 0 else 'ahead'}"
        return f"{abs(d)}s {'ago' if d > 0 else 'ahead'}"
    return t.strftime("%Y-%m-%d %H:%M:%S")


def value(v, tag=None, form: str = "human") -> str:
    """A value as its type shows it; NULL if there is none."""
    if v is None:
        return "NULL"
    if tag is not None and tag.show:
        return tag.show(v, form)
    if tag is not None and tag.size:
        return size(int(v)) if form != "raw" else str(int(v))
    if tag is not None and tag.date:
        return time(int(v), form)
    if isinstance(v, float) and v.is_integer():
        return str(int(v))
    return str(v)


def table(rows: list, columns: list[str], defs: dict | None = None, form: str = "human") -> str:
    """Rows as aligned text; defs: how a column's values are shown."""
    lines = [columns, *([value(r[c], (defs or {}).get(c), form) for c in columns] for r in rows)]
    wide = [max(len(x[i]) for x in lines) for i in range(len(columns))]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(line, wide, strict=True)).rstrip() for line in lines)


def groups(rows: list, columns: list[str], defs: dict | None = None, form: str = "human", names: dict | None = None) -> str:
    """A line a group: its keys, what was computed, how many items it has; below it the first of them, if they were asked for."""
    defs, out = defs or {}, []
    for r in rows:
        keys = " / ".join(value(r[c], defs.get(c), form) for c in columns if c.startswith("key"))
        computed = f": {value(r['nvalue'], defs.get('nvalue'), form)}" if "nvalue" in columns else ""
        out.append(f"{keys}{computed} ({r['item_count']})")
        out += [f"  {(names or {}).get(i, i)}" for i in (r["members"] if "members" in columns else [])]
    return "\n".join(out)


def short(rows: list, columns: list[str], defs: dict | None = None, form: str = "human", names: dict | None = None) -> str:
    """One thing a line and nothing else: an item's name, a group's keys, a value."""
    first = [c for c in columns if c.startswith("key")] or [c for c in ("name", "item_id", "value") if c in columns][:1]
    named = lambda r: (names or {}).get(r["item_id"]) if "item_id" in columns else None
    return "\n".join(named(r) or "\t".join(value(r[c], (defs or {}).get(c), form) for c in first) for r in rows)
