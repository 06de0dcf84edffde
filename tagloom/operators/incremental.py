"""Incremental indexing: what a scan changes in the stored tables, as joins of two snapshots.

scan: path, parentdir, filename, stem, extension, file_id, is_dir, size, mtime. files: the same with item_id and rank.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import allocate
from .merge import cut, key_replace

FILE_BLOCK = 8


def with_hashes(df: DataFrame) -> DataFrame:
    """scan_hash tells a file at its place unchanged; basename_scan_hash the same file wherever it lies."""
    same = [F.col("mtime"), F.col("size"), F.col("is_dir")]
    return df.withColumn("scan_hash", F.xxhash64("path", *same)).withColumn("basename_scan_hash", F.xxhash64("filename", *same))


def in_scope(path: Column, roots: list[str]) -> Column:
    """Whether a path is a root or below one."""
    hit = F.lit(False)
    for r in roots:
        r = r.rstrip("/")
        hit = hit | (path == r) | path.startswith(r + "/")
    return hit


@dataclass
class Diff:
    live: DataFrame  # item_id: unchanged
    changed: DataFrame  # scan rows with the item_id of the file they are
    moved: DataFrame  # scan rows with the item_id of the file that was elsewhere
    returned: DataFrame  # scan rows with the item_id of a removed file
    new: DataFrame  # scan rows without an id
    deleted: DataFrame  # item_id


def diff(scan: DataFrame, files: DataFrame, removed: DataFrame | None = None, roots: list[str] | None = None) -> Diff:
    """Classify a scan against the stored files.

    A path with the same hash is live. Else a file is moved if a stored file that is not live any more has its name, size and
    time; changed if it has a stored file_id; returned if a removed file has its name, size and time; else new. Ties go to the
    least item_id. Stored files in scope that none of these accounts for are deleted.
    """
    scan, known = with_hashes(scan), with_hashes(files)
    live = known.join(scan.select("scan_hash", "path"), ["scan_hash", "path"], "left_semi").select("item_id")
    live, full = cut(live), cut(scan.join(known.select("scan_hash", "path"), ["scan_hash", "path"], "left_anti"))
    stale = known.join(live, "item_id", "left_anti")
    was = stale.groupBy("basename_scan_hash", "file_id").agg(F.min("item_id").alias("item_id"), F.min("path").alias("__was"))
    moved = full.join(was, ["basename_scan_hash", "file_id"]).where(F.col("path") != F.col("__was")).drop("__was")
    # Of several links to one file, the least path is the file that moved.
    once = moved.groupBy("item_id").agg(F.min("path").alias("path"))
    moved = cut(moved.join(once, ["item_id", "path"], "left_semi"))
    rest = full.join(moved.select("path"), "path", "left_anti")
    ids = known.join(moved.select("item_id"), "item_id", "left_anti").groupBy("file_id").agg(F.min("item_id").alias("item_id"))
    # A hard link's further paths are files of their own: an id is given away once, to the least path.
    taken = rest.join(ids.join(live, "item_id", "left_anti"), "file_id")
    first = taken.groupBy("item_id").agg(F.min("path").alias("path"))
    changed = cut(taken.join(first, ["item_id", "path"], "left_semi"))
    rest = cut(rest.join(changed.select("path"), "path", "left_anti"))
    if removed is not None:
        back = removed.groupBy("basename_scan_hash").agg(F.min("item_id").alias("item_id"))
        hit = rest.join(back, "basename_scan_hash")
        once = hit.groupBy("item_id").agg(F.min("path").alias("path"))
        returned = cut(hit.join(once, ["item_id", "path"], "left_semi"))
        rest = rest.join(returned.select("path"), "path", "left_anti")
    else:
        returned = rest.where(F.lit(False)).withColumn("item_id", F.lit(None).cast("long"))
    gone = known.where(in_scope(F.col("path"), roots)) if roots else known
    for x in (live, changed, moved):
        gone = gone.join(x.select("item_id"), "item_id", "left_anti")
    return Diff(live, changed, moved, returned, rest, gone.select("item_id"))


def apply(files: DataFrame, d: Diff, ids_in_use: DataFrame | None = None) -> DataFrame:
    """The stored files after a scan: rows of changed, moved and returned files replaced, new ones with new ids, deleted ones gone."""
    columns = files.columns
    used = files.select("item_id") if ids_in_use is None else files.select("item_id").unionByName(ids_in_use.select("item_id"))
    new = allocate(d.new, used, FILE_BLOCK, ["path"])
    rows = d.changed.unionByName(d.moved, allowMissingColumns=True).unionByName(d.returned, allowMissingColumns=True).unionByName(new, allowMissingColumns=True)
    for c in columns:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast(files.schema[c].dataType))
    rows = rows.join(files.select("item_id", F.col("rank").alias("__rank")), "item_id", "left").withColumn("rank", F.coalesce("__rank", F.lit(0)))
    return key_replace(files, rows.select(*columns), "item_id").join(d.deleted, "item_id", "left_anti")


def record_removed(files: DataFrame, deleted: DataFrame, user_tags: DataFrame | None, removed: DataFrame, now: int) -> DataFrame:
    """The table of removed files with those deleted ones that a user has tagged; with all deleted ones, if tags are not known."""
    lost = with_hashes(files).join(deleted, "item_id", "left_semi")
    if user_tags is not None:
        lost = lost.join(user_tags.select("item_id"), "item_id", "left_semi")
    return key_replace(removed, lost.withColumn("removed_file_at", F.lit(now).cast("long")).select(*removed.columns), "item_id")
