"""The tag catalog: which types exist, where their labels are stored, and the hooks of each.

Two storage mappings: a single-valued tag may be a column of the wide item table (no unpivot, no self-join); every other tag is rows
of the long table (item_id, type, label_str, label_int, label_double, label_bool).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Typed label columns of the long form; fixed names of the data model.
LABELS = {"string": "label_str", "integer": "label_int", "double": "label_double", "boolean": "label_bool"}
TAG_COLUMNS = "item_id long, type string, label_str string, label_int long, label_double double, label_bool boolean"
#: Ranks of built-in types, for the order of definitions; fixed values.
DEFAULT_RANKS = {"name": 10, "size": 8, "mtime": 7, "parentdir": 6, "item_kind": 5, "content": 4, "filename": 2, "path": -1}


@dataclass(frozen=True)
class TagDef:
    """A tag type and its hooks.

    interpret rewrites a literal's text; expand turns a label into query text; rewrite turns a comparison (operator and text) into
    query text, or leaves it with None; implies names query text that also holds wherever the tag is matched; read names the type
    whose label an item has that has none of its own; capture finds what a pattern's wildcards match (item_id, value to item_id,
    captures); extract computes labels from a file table's columns; show formats a value; strategy says how edits act.
    """

    name: str
    kind: str = "string"
    column: str | None = None  # of the wide table
    date: bool = False
    size: bool = False
    rank: int = 0
    interpret: Callable[[str], str] | None = None
    expand: Callable[[str], str] | None = None
    expand_projection: str | None = None
    rewrite: Callable[[str, str], str | None] | None = None
    read: str | None = None
    capture: Callable[[DataFrame, str], DataFrame] | None = None
    implies: str | None = None
    extract: Callable[..., Column] | None = None
    show: Callable[[object, str], str] | None = None
    strategy: str = "append"


@dataclass
class Catalog:
    items: DataFrame  # item_id, rank, item_kind and the wide columns
    tags: DataFrame | None = None
    defs: dict[str, TagDef] = field(default_factory=dict)
    definitions: DataFrame | None = None  # stored definition items: item_id, rank, name, item_kind
    now: datetime = field(default_factory=lambda: datetime.now(UTC))

    def get(self, name: str) -> TagDef:
        """A registered type, a fixed attribute, or an unknown one, which lives in the long form."""
        if name in self.defs:
            return self.defs[name]
        fixed = {"item_id": "integer", "rank": "integer", "item_kind": "string"}
        if name in fixed:
            return TagDef(name, fixed[name], name)
        return TagDef(name, self.inferred.get(name, "any"))

    @property
    def inferred(self) -> dict[str, str]:
        return {}

    def register(self, *defs: TagDef) -> Catalog:
        """A catalog in which these definitions win over others of the same name."""
        return replace(self, defs=self.defs | {d.name: d for d in defs})


_KINDS = {T.StringType: "string", T.LongType: "integer", T.IntegerType: "integer", T.ShortType: "integer", T.ByteType: "integer", T.DoubleType: "double", T.FloatType: "double", T.BooleanType: "boolean", T.TimestampType: "integer", T.TimestampNTZType: "integer", T.DateType: "integer"}


def from_table(df: DataFrame, kind: str, key: str | Column, rank: int = 0, tags: DataFrame | None = None, now: datetime | None = None) -> Catalog:
    """A table as items of one kind: every scalar column is a single-valued tag, times become epoch seconds."""
    columns, defs = [], {}
    for f in df.schema:
        t = _KINDS.get(type(f.dataType))
        if not t:
            continue
        c = F.col(f.name)
        time = isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
        c = F.unix_seconds(c.cast("timestamp")) if time else c.cast({"integer": "long"}.get(t, t))
        columns.append(c.alias(f.name))
        defs[f.name] = TagDef(f.name, t, f.name, date=time)
    key = F.col(key) if isinstance(key, str) else key
    items = df.select(key.cast("long").alias("item_id"), F.lit(rank).cast("long").alias("rank"), F.lit(kind).alias("item_kind"), *columns)
    return Catalog(items, tags, defs, now=now or datetime.now(UTC))


def files_catalog(files: DataFrame, tags: DataFrame | None = None, now: datetime | None = None, definitions: DataFrame | None = None) -> Catalog:
    """The built-in types over a file table (path, parentdir, filename, stem, extension, is_dir, size, mtime)."""
    slash = lambda t: t.replace("\\\\", "/").rstrip("/") or t
    defs = [
        TagDef("path", "string", "path", rank=-1, interpret=slash, strategy="relocate"),
        TagDef("parentdir", "string", "parentdir", rank=6, interpret=slash, strategy="relocate"),
        TagDef("filename", "string", "filename", rank=2, implies="is_dir:false", strategy="relocate"),
        TagDef("stem", "string", "stem", strategy="relocate"),
        TagDef("extension", "string", "extension", interpret=lambda t: t.lstrip(".").lower(), implies="is_dir:false", strategy="relocate"),
        TagDef("is_dir", "boolean", "is_dir", strategy="none"),
        TagDef("size", "integer", "size", size=True, rank=8, strategy="none"),
        TagDef("mtime", "integer", "mtime", date=True, rank=7, strategy="attribute"),
        TagDef("directory", expand=lambda label: f'filename_of_directory:"{label}" & is_dir:true'),
        TagDef("filename_of_directory", "string", "filename", strategy="none"),
        TagDef("file_id", "string", "file_id", strategy="none"),
        TagDef("hash", strategy="none"),
        TagDef("content", rank=4, strategy="inject"),
        TagDef("name", rank=10, strategy="replace"),
        TagDef("removed_file_at", "integer", date=True, strategy="none"),
        TagDef("removed_file_size", "integer", size=True, strategy="none"),
        TagDef("removed_file_mtime", "integer", date=True, strategy="none"),
        TagDef("removed_file_path", strategy="none"),
        TagDef("removed_file_is_dir", "boolean", strategy="none"),
        TagDef("removed_file", expand=lambda label: "removed_file_path:*" if label == "true" else "*:* - removed_file_path:*"),
    ]
    have = set(files.columns)
    defs = [d for d in defs if d.column is None or d.column in have]
    items = files if {"rank", "item_kind"} <= have else files.withColumn("rank", F.lit(0).cast("long")).withColumn("item_kind", F.lit("file"))
    return Catalog(items, tags, {d.name: d for d in defs}, definitions, now=now or datetime.now(UTC))
