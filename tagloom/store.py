"""A folder of tables with files, tags and stored items: index, search, tag, untag, note, and type settings."""

from __future__ import annotations

import time
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import display
from .functions.ids import allocate
from .operators import edit as E
from .operators import incremental as I
from .operators.merge import cut, key_replace, read_or_empty, tag_layout, write_atomic
from .operators.oneview import unpivot
from .plans.catalog import DEFAULT_RANKS, LABELS, TAG_COLUMNS, Catalog, TagDef, files_catalog
from .plans.compiler import Engine, Result, Space, flat
from .plans.literals import is_pattern
from .plans.syntax import Compare, QueryError, Typed, parse
from .sources.cache import ResultCache
from .sources.files import extract, path_attributes, scan_tree

#: Names and types of the stored tables and their columns: fixed values of the data model.
SCHEMAS = {
    "files": "item_id long, rank long, path string, parentdir string, filename string, stem string, extension string, file_id string, is_dir boolean, size long, mtime long",
    "user_tags": TAG_COLUMNS,
    "base_tags": TAG_COLUMNS,
    "item_references": "item_id long, rank long, name string, item_kind string, content string",
    "removed_files": "item_id long, rank long, file_id string, scan_hash long, basename_scan_hash long, path string, size long, mtime long, is_dir boolean, removed_file_at long",
    "type_config": "type string, kind string",
}


class Store:
    """All tables live below one folder of a shared file system; every change swaps whole tables in."""

    def __init__(self, spark: SparkSession, folder: str, hooks: tuple[TagDef, ...] = ()):
        self.spark, self.folder, self.hooks = spark, folder.rstrip("/"), hooks
        self.cache = ResultCache(spark, f"{self.folder}/cache")

    def read(self, name: str) -> DataFrame:
        return read_or_empty(self.spark, f"{self.folder}/{name}", SCHEMAS[name])

    def write(self, name: str, df: DataFrame) -> None:
        write_atomic(tag_layout(df) if name.endswith("_tags") else df, f"{self.folder}/{name}", {"at": time.time()})
        self.cache.clear()

    # --- Index -------------------------------------------------------------------------------------------------------

    def index(self, roots: list[str], dry: bool = False) -> dict[str, int]:
        """Bring the files below roots up to date; returns how many files are in each state."""
        files, removed, tags = self.read("files"), self.read("removed_files"), self.read("user_tags")
        local = self.folder.removeprefix("file://")
        scan = cut(scan_tree(self.spark, roots, [local]))
        d = I.diff(scan, files, removed, roots)
        counts = {n: getattr(d, n).count() for n in ("live", "changed", "moved", "returned", "new", "deleted")}
        if dry:
            return counts
        gone = cut(I.record_removed(files, d.deleted, tags, removed, int(time.time())).join(d.returned.select("item_id"), "item_id", "left_anti"))
        after = cut(I.apply(files, d, removed))
        self.write("removed_files", gone.select(*removed.columns))
        self.write("files", after.select(*files.columns))
        hooks = [h for h in self.hooks if h.extract]
        if hooks:
            fresh = extract(after, hooks)
            self.write("base_tags", cut(fresh.select("item_id", "type", *LABELS.values())))
        return counts

    # --- Search ------------------------------------------------------------------------------------------------------

    def catalog(self) -> Catalog:
        """Files and stored items as one item table; a user's rank wins; names and contents are long tags."""
        files = self.read("files").withColumn("item_kind", F.lit("file"))
        refs, tags, removed = self.read("item_references"), self.read("user_tags"), self.read("removed_files")
        items = files.unionByName(refs.select("item_id", "rank", "item_kind"), allowMissingColumns=True)
        items = items.unionByName(removed.select("item_id", "rank", F.lit("file").alias("item_kind")), allowMissingColumns=True)
        volatile = tags.select("item_id").distinct().join(items.select("item_id"), "item_id", "left_anti")
        items = items.unionByName(volatile.select("item_id", F.lit(0).cast("long").alias("rank"), F.lit("volatile").alias("item_kind")), allowMissingColumns=True)
        ranks = tags.where("type = 'rank'").groupBy("item_id").agg(F.max("label_int").alias("__rank"))
        items = items.join(ranks, "item_id", "left").withColumn("rank", F.coalesce("__rank", "rank")).drop("__rank")
        stored = unpivot(refs, [TagDef("name", "string", "name"), TagDef("content", "string", "content")])
        gone = [TagDef(f"removed_file_{n}", k, n) for n, k in (("path", "string"), ("size", "integer"), ("mtime", "integer"), ("is_dir", "boolean"))] + [TagDef("removed_file_at", "integer", "removed_file_at")]
        lost = unpivot(removed.withColumn("item_kind", F.lit("file")), gone)
        # A name that a user gave replaces the file's own; else the file name is the name.
        own = tags.where("type = 'name'").select("item_id")
        plain = files.join(own, "item_id", "left_anti").select("item_id", F.lit("name").alias("type"), F.col("filename").alias("label_str"))
        long_ = tags.unionByName(self.read("base_tags"))
        for part in (stored, lost, plain):
            long_ = long_.unionByName(part.select(*(c for c in ("item_id", "type", *LABELS.values()) if c in part.columns)), allowMissingColumns=True)
        c = files_catalog(items, long_, definitions=refs.where("item_kind IN ('type', 'tag')"))
        kinds = {r["type"]: r["kind"] for r in self.read("type_config").collect()}
        c = c.register(*(TagDef(t, k, rank=DEFAULT_RANKS.get(t, 0)) for t, k in kinds.items() if t not in c.defs))
        return c.register(*(replace(h, column=None) for h in self.hooks))

    def search(self, text: str, n: int = 100, offset: int = 0, order: tuple = ()) -> Result:
        """A page of a query's result: the result is kept until a table changes, so further pages need no second run. n = 0 gives all of it, unkept and unordered."""
        e = Engine(self.catalog())
        return self.cache.page(e, text, n, offset, order) if n else e.query(text, n, offset, order)

    def names(self, ids: list[int]) -> dict[int, str]:
        """The paths or names of some items, for display."""
        some = lambda df, c: {r["item_id"]: r[c] for r in df.where(F.col("item_id").isin(ids)).select("item_id", c).collect()}
        return some(self.read("files"), "path") | some(self.read("item_references"), "name")

    def shown(self, found: Result, rows: list, columns: list[str], mode: str = "table", form: str = "human") -> str:
        """Rows of a result as text: a table, compact groups, or one thing a line."""
        c = self.catalog()
        defs = {k: c.get(v) for k, v in found.types.items()}
        if mode == "table":
            return display.table(rows, columns, defs, form)
        ids = [r["item_id"] for r in rows if r["item_id"] is not None] if "item_id" in columns else [i for r in rows for i in r["members"]] if "members" in columns else []
        if mode == "groups" and found.kind == "groups":
            return display.groups(rows, columns, defs, form, self.names(ids) if ids else None)
        return display.short(rows, columns, defs, form, self.names(ids) if ids else None)

    # --- Edits -------------------------------------------------------------------------------------------------------

    def _hits(self, text: str):
        c = self.catalog()
        found = Engine(c).query(text)
        if found.kind == "definitions":
            return c, self._kept(found.df)
        if found.kind != "items":
            raise QueryError("only items can be edited")
        return c, cut(found.df.select("item_id"))

    def _kept(self, definitions: DataFrame) -> DataFrame:
        """Definition items, stored first if they are not yet."""
        rows = cut(definitions)
        new = rows.where("item_id IS NULL")
        refs = self.read("item_references")
        named = allocate(new.drop("item_id"), refs, 0, ["item_kind", "name"])
        named = cut(named.select("item_id", "rank", "name", "item_kind", F.lit(None).cast("string").alias("content")))
        self.write("item_references", cut(E.store_items(refs, named)))
        return rows.where("item_id IS NOT NULL").select("item_id").unionByName(named.select("item_id"))

    def captured(self, text: str, c: Catalog, hits: DataFrame) -> DataFrame:
        """What the wildcards of a query's patterns matched, numbered through all of its patterns; an item with several labels of a type has each combination."""
        terms = [t.first if isinstance(t, Compare) else t for t in flat(parse(text), "&")]
        terms = [t for t in terms if isinstance(t, Typed) and is_pattern(t.label.text)]
        if not terms:
            raise QueryError("captures need a query with a pattern")
        out = None
        for t in terms:
            d = c.get(t.type)
            if d.column:
                values = c.items.select("item_id", F.col(d.column).cast("string").alias("value"))
            else:
                values = Space(Engine(c)).rows(t.type).select("item_id", F.coalesce("label_str", F.col("label_int").cast("string"), F.col("label_double").cast("string")).alias("value"))
            one = (d.capture or E.captures)(values.join(hits, "item_id", "left_semi"), d.interpret(t.label.text) if d.interpret else t.label.text)
            out = one if out is None else out.join(one.withColumnRenamed("captures", "__more"), "item_id").select("item_id", F.concat("captures", "__more").alias("captures"))
        return out

    def tag(self, text: str, edit: str, conflict: str = "abort", hardlink: str = "abort", dry: bool = False) -> list:
        """Put the tags of an edit on a query's items; {n} is what the n-th wildcard of its patterns matched.

        Labels of a file's path move it, those of its time change it, a content goes into a stored item; all others are user tags.
        Returns the moves; with dry, nothing is changed.
        """
        c, hits = self._hits(text)
        parts = E.parse_edit(edit)
        caps = self.captured(text, c, hits) if any("{" in (p.label or "") + p.type for p in parts) else None
        new = E.new_tags(hits, parts, c, caps)
        by: dict[str, list[str]] = {}
        for p in parts:
            by.setdefault(c.get(p.type).strategy, []).append(p.type)
        rows = lambda strategy: new.where(F.col("type").isin(by.get(strategy, [])))
        plan = cut(E.moves(self.read("files"), rows("relocate"), conflict, hardlink)) if "relocate" in by else None
        moved = plan.limit(1000).collect() if plan is not None else []  # for display
        if dry:
            return moved
        if plan is not None:
            E.move_files(plan)
            files = self.read("files")
            after = files.join(plan.select("item_id", "target"), "item_id").withColumn("path", F.col("target"))
            self.write("files", cut(key_replace(files, path_attributes(after).select(*files.columns), "item_id")))
        if "attribute" in by:
            self.write("files", cut(E.set_times(self.read("files"), rows("attribute"))))
        if "inject" in by:
            self.write("item_references", cut(E.inject(self.read("item_references"), rows("inject"))))
        rest = new.where(~F.col("type").isin([t for s in ("relocate", "attribute", "inject") for t in by.get(s, [])]))
        if set(by) - {"relocate", "attribute", "inject"}:
            self.write("user_tags", cut(E.tag(self.read("user_tags"), rest, c)))
        return moved

    def untag(self, text: str, edit: str) -> None:
        """Take tags from a query's items; ``item_id:`` deletes stored items with all their tags."""
        _, hits = self._hits(text)
        parts = E.parse_edit(edit)
        tags = cut(E.untag(self.read("user_tags"), hits, parts))
        if any(p.type == "item_id" for p in parts):
            refs, tags = (cut(x) for x in E.delete_items(self.read("item_references"), tags, hits))
            self.write("item_references", refs)
        self.write("user_tags", tags)

    def note(self, name: str, content: str | None = None, kind: str = "note") -> int:
        """Store an item of its own; returns its id."""
        refs = self.read("item_references")
        row = self.spark.createDataFrame([(0, name, kind, content)], "rank long, name string, item_kind string, content string")
        new = cut(allocate(row, refs, 0, ["name"]))
        self.write("item_references", cut(E.store_items(refs, new.select(*refs.columns))))
        return new.head()["item_id"]

    def set_type(self, name: str, kind: str) -> None:
        """Give a user type a kind: its labels move, or QueryError names those that cannot."""
        if kind not in LABELS:
            raise QueryError(f"no such kind: {kind}")
        tags = cut(E.cast_type(self.read("user_tags"), name, kind))
        row = self.spark.createDataFrame([(name, kind)], SCHEMAS["type_config"])
        config = cut(key_replace(self.read("type_config"), row, "type"))
        self.write("user_tags", tags)
        self.write("type_config", config)
