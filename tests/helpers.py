"""Small file trees as item tables, and tags as long rows."""

from __future__ import annotations

from datetime import UTC, datetime

from tagloom.plans.catalog import TAG_COLUMNS, TagDef, files_catalog
from tagloom.plans.compiler import Engine
from tagloom.plans.literals import BLOCK

FILES = "item_id long, rank long, item_kind string, path string, parentdir string, filename string, stem string, extension string, is_dir boolean, size long, mtime long, file_id string"
NOW = datetime(2024, 6, 1, 12, tzinfo=UTC)


def tree(spark, sizes: dict, tags: dict | None = None, mtimes: dict | None = None, dirs: bool = True, defs: tuple = ()):
    """An engine over files (path to size) and the directories above them; tags: path to list of (type, label)."""
    rows, ids = [], {}

    def put(path, is_dir, size):
        if path in ids or not path:
            return
        parent, _, name = path.rpartition("/")
        if dirs:
            put(parent, True, 0)
        ids[path] = 8 * BLOCK + len(ids)
        stem, dot, ext = name.rpartition(".")
        rows.append((ids[path], 0, "file", path, parent, name, stem if dot and not is_dir else name, ext.lower() if dot and not is_dir else None, is_dir, size, (mtimes or {}).get(path, 0), f"f{len(ids)}"))

    for path, size in sizes.items():
        put(path, False, size)
    long_ = []
    for path, ts in (tags or {}).items():
        for kind, v in ts:
            cols = [v if isinstance(v, t) and not (t is int and isinstance(v, bool)) else None for t in (str, int, float, bool)]
            long_.append((ids[path], kind, *cols))
    catalog = files_catalog(spark.createDataFrame(rows, FILES), spark.createDataFrame(long_, TAG_COLUMNS), NOW).register(*defs)
    engine = Engine(catalog)
    engine.names = {v: k for k, v in ids.items()}
    return engine


def number(name: str) -> TagDef:
    return TagDef(name, "integer")


def names(engine, query: str) -> set:
    found = engine.query(query)
    assert found.kind == "items", found.kind
    return {engine.names[r.item_id] for r in found.df.collect()}


def groups(engine, query: str, value: str = "nvalue") -> dict:
    found = engine.query(query)
    assert found.kind == "groups", found.kind
    keys = [c for c in found.df.columns if c.startswith("key")]
    return {(r[keys[0]] if len(keys) == 1 else tuple(r[k] for k in keys)): r[value] for r in found.df.collect()}


def value(engine, query: str):
    found = engine.query(query)
    assert found.kind in ("scalar", "boolean"), found.kind
    (row,) = found.df.collect()
    return row.value
