"""Edits of user tags as merges: tag, untag, replace, captures, casts, deletion of items."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import literals as L
from ..plans.catalog import LABELS, Catalog
from ..plans.syntax import QueryError
from .merge import key_replace

COLUMNS = ["item_id", "type", *LABELS.values()]
#: What happens if a file gets several targets, or several files get one: an error, the file stays, a number is put to the name,
#: or (of several targets) the least one counts. And what happens to a file with several hard links: an error, it stays, it moves.
CONFLICT, HARDLINK = ("abort", "skip", "serial", "first"), ("abort", "skip", "all")
#: Types that are parts of a path.
PATH_TYPES = ("path", "parentdir", "filename", "stem", "extension")


@dataclass(frozen=True)
class Part:
    """``type:label`` of an edit; either may hold captures like {1}."""

    type: str
    label: str | None


def parse_edit(text: str) -> list[Part]:
    """Parts separated by spaces or `` | ``; quotes keep spaces."""
    found = []
    for m in re.finditer(r"""(?:"((?:[^"\\]|\\.)*)"|((?:[^\s:"|\\]|\\.)+)):(?:"((?:[^"\\]|\\.)*)"|((?:[^\s"|\\]|\\.)+))?|\||(\S+)""", text):
        if m[0] == "|":
            continue
        if m[5]:
            raise QueryError(f"cannot read the edit at {m[5]!r}")
        plain = lambda s: None if s is None else re.sub(r"\\(.)", r"\1", s)
        found.append(Part(plain(m[1] if m[1] is not None else m[2]), plain(m[3] if m[3] is not None else m[4])))
    if not found:
        raise QueryError("an empty edit")
    return found


def capture_regex(pattern: str) -> str:
    """The pattern with a group for each star and question mark; stars match as little as they can."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c in "*?":
            out += "(.*?)" if c == "*" else "(.)"
        elif c == "\\" and i < len(pattern):
            out += re.escape(pattern[i])
            i += 1
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            out += "(" + L.glob_regex(pattern[i - 1 : end + 1])[6:-2] + ")"
            i = end + 1
        else:
            out += re.escape(c)
    return rf"(?s)\A{out}\z"


def captures(values: DataFrame, pattern: str) -> DataFrame:
    """(item_id, value) to (item_id, captures): what the pattern's wildcards matched; other values are dropped."""
    regex = capture_regex(pattern)
    n = re.compile(regex.replace(r"\z", r"\Z")).groups
    hit = values.where(F.col("value").rlike(regex))
    return hit.select("item_id", F.array(*(F.regexp_extract("value", regex, k + 1) for k in range(n))).alias("captures"))


def fill(template: str, cap: Column | None) -> Column:
    """A template with {n} replaced by capture n."""
    parts = re.split(r"\{(\d+)\}", template)
    if len(parts) == 1:
        return F.lit(template)
    if cap is None:
        raise QueryError("{n} needs a pattern in the query")
    return F.concat(*(F.lit(p) if k % 2 == 0 else F.get(cap, F.lit(int(p) - 1)) for k, p in enumerate(parts)))


def label_columns(c: Column, kind: str) -> list[Column]:
    """A text as a typed label; of an unknown type, by what it looks like."""
    whole, real = c.rlike(r"\A[-+]?\d+\z"), c.rlike(r"\A[-+]?(\d+\.\d*|\.\d+)\z")
    none = F.lit(None)
    if kind == "any":
        cols = {"string": F.when(~whole & ~real, c), "integer": F.when(whole, c.try_cast("long")), "double": F.when(real, c.try_cast("double")), "boolean": none}
    else:
        cols = {k: (c.try_cast({"integer": "long"}.get(k, k)) if k == kind else none) for k in LABELS}
    return [cols[k].cast({"integer": "long"}.get(k, k)).alias(n) for k, n in LABELS.items()]


def new_tags(items: DataFrame, parts: list[Part], catalog: Catalog, caps: DataFrame | None = None) -> DataFrame:
    """The tag rows that an edit puts on items, one for each part (and, with several captures of an item, each of them)."""
    rows = items.select("item_id").distinct()
    if caps is not None:
        rows = rows.join(caps, "item_id")
    cap = F.col("captures") if caps is not None else None
    out = None
    for p in parts:
        if p.label is None:
            raise QueryError(f"{p.type}: needs a label")
        d = catalog.get(p.type)
        if d.strategy == "none":
            raise QueryError(f"{p.type} cannot be edited")
        one = rows.select("item_id", fill(p.type, cap).alias("type"), *label_columns(fill(p.label, cap), d.kind))
        out = one if out is None else out.unionByName(one)
    return out.select(*COLUMNS).distinct()


def tag(tags: DataFrame, new: DataFrame, catalog: Catalog) -> DataFrame:
    """User tags after adding rows: types with the replace strategy lose their former labels on these items."""
    replaced = [d.name for d in catalog.defs.values() if d.strategy == "replace"] + ["rank"]
    alone = new.where(F.col("type").isin(replaced))
    kept = tags.join(alone.select("item_id", "type").distinct(), ["item_id", "type"], "left_anti").select(*COLUMNS)
    return kept.unionByName(new).distinct()


def moves(files: DataFrame, new: DataFrame, conflict: str = "abort", hardlink: str = "abort", show: int = 10) -> DataFrame:
    """(item_id, path, target) of the files that new labels of PATH_TYPES put elsewhere; QueryError names what a policy forbids.

    files: item_id, path, parentdir, filename, stem, extension, is_dir, file_id. Only the new rows and the paths that they meet
    take part in joins; nothing is collected but up to ``show`` names for an error.
    """

    def refuse(df: DataFrame, what: str) -> None:
        if bad := [r[0] for r in df.limit(show).collect()]:
            raise QueryError(f"{what}: {', '.join(sorted(bad))}")

    rows = new.where(F.col("type").isin(*PATH_TYPES)).groupBy("item_id", "type").agg(F.min("label_str").alias("label"), F.countDistinct("label_str").alias("n"))
    at = files.join(rows.groupBy("item_id").agg(F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("type", "label"))).alias("to")), "item_id")
    many = at.where("n > 1")
    if conflict in ("abort", "serial"):
        refuse(many.select("path"), "several targets")
    at = at.where("n = 1") if conflict == "skip" else at
    links = files.join(at.select("file_id").distinct(), "file_id", "left_semi").groupBy("file_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    if hardlink == "abort":
        refuse(at.join(links, "file_id", "left_semi").select("path"), "several hard links")
    elif hardlink == "skip":
        at = at.join(links, "file_id", "left_anti")
    part = lambda name: F.coalesce(F.col("to")[name], F.col(name))
    ext = F.when(F.col("to")["extension"].isNotNull() | F.col("extension").isNotNull(), F.concat(F.lit("."), part("extension"))).otherwise(F.lit(""))
    # A name that is given whole wins over its parts; so does a path.
    own = F.when(F.col("to")["stem"].isNull() & F.col("to")["extension"].isNull(), F.col("filename")).otherwise(F.concat(part("stem"), ext))
    target = F.coalesce(F.col("to")["path"], F.concat(part("parentdir"), F.lit("/"), F.coalesce(F.col("to")["filename"], own)))
    at = at.select("item_id", "path", target.alias("target")).where("path <> target")
    # A path is taken by a file that stays there; of files with one target, the first by id may have it if it is free.
    stays = files.join(at.select("item_id"), "item_id", "left_anti").select(F.col("path").alias("target"), F.lit(1).alias("taken"))
    place = F.row_number().over(Window.partitionBy("target").orderBy("item_id")) - 1
    at = at.withColumn("k", place).join(stays, "target", "left").withColumn("k", F.col("k") + F.coalesce("taken", F.lit(0)))
    clash = at.where("k > 0")
    if conflict in ("abort", "first"):
        refuse(clash.select("target").distinct(), "a target of several files, or one that exists")
    if conflict == "skip":
        at = at.where("k = 0")
    dot = F.regexp_extract("target", r"(\.[^./]+)$", 1)
    numbered = F.concat(F.expr("substring(target, 1, length(target) - length(__dot))"), F.lit("_"), F.col("k").cast("string"), F.col("__dot"))
    return at.withColumn("__dot", dot).select("item_id", "path", F.when(F.col("k") > 0, numbered).otherwise(F.col("target")).alias("target"))


def move_files(plan: DataFrame) -> None:
    """Rename files as planned, in the tasks; a target that has come up since is an error."""

    def run(rows) -> None:
        import os

        for r in rows:
            if os.path.lexists(r["target"]):
                raise OSError(f"{r['target']} exists")
            os.makedirs(os.path.dirname(r["target"]), exist_ok=True)
            # A task that is run again finds its own work done.
            if os.path.lexists(r["path"]):
                os.rename(r["path"], r["target"])

    plan.foreachPartition(run)


def set_times(files: DataFrame, new: DataFrame) -> DataFrame:
    """Files with the time of change that new mtime labels give them, on disk, too."""
    times = new.where("type = 'mtime'").groupBy("item_id").agg(F.max("label_int").alias("__t"))

    def run(rows) -> None:
        import os

        for r in rows:
            os.utime(r["path"], (r["__t"], r["__t"]))

    both = files.join(times, "item_id", "left")
    both.where("__t IS NOT NULL").select("path", "__t").foreachPartition(run)
    return both.withColumn("mtime", F.coalesce("__t", "mtime")).select(*files.columns)


def inject(references: DataFrame, new: DataFrame) -> DataFrame:
    """Stored items with the content that new content labels give them."""
    content = new.where("type = 'content'").groupBy("item_id").agg(F.min("label_str").alias("__c"))
    return references.join(content, "item_id", "left").withColumn("content", F.coalesce("__c", "content")).select(*references.columns)


def untag(tags: DataFrame, items: DataFrame, parts: list[Part]) -> DataFrame:
    """User tags without those of a type (and label, a pattern too) on these items; ``item_id:`` takes all of an item's tags."""
    ids = items.select("item_id").distinct().withColumn("__hit", F.lit(True))
    text = F.coalesce("label_str", F.col("label_int").cast("string"), F.col("label_double").cast("string"), F.col("label_bool").cast("string"))
    gone = F.lit(False)
    for p in parts:
        if p.type == "item_id":
            gone = F.lit(True)
            break
        hit = F.col("type") == p.type
        gone = gone | (hit & text.rlike(L.glob_regex(p.label)) if p.label is not None else hit)
    return tags.join(ids, "item_id", "left").where(~(F.coalesce("__hit", F.lit(False)) & gone)).select(*COLUMNS)


def delete_items(references: DataFrame, tags: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored items and their tags without these items."""
    ids = items.select("item_id").distinct()
    return references.join(ids, "item_id", "left_anti"), tags.join(ids, "item_id", "left_anti")


def set_rank(references: DataFrame, items: DataFrame, rank: int) -> DataFrame:
    ids = items.select("item_id").distinct().withColumn("__hit", F.lit(True))
    return references.join(ids, "item_id", "left").withColumn("rank", F.when(F.col("__hit"), F.lit(rank).cast("long")).otherwise(F.col("rank"))).drop("__hit")


def cast_type(tags: DataFrame, name: str, kind: str, show: int = 10) -> DataFrame:
    """Labels of a type moved to another column; QueryError names labels that cannot be read so, and nothing changes."""
    text = F.coalesce("label_str", F.col("label_int").cast("string"), F.col("label_double").cast("string"), F.col("label_bool").cast("string"))
    rows = tags.where(F.col("type") == name).select("item_id", "type", text.alias("__text"))
    to = text_to(F.col("__text"), kind)
    bad = [r[0] for r in rows.where(to.isNull() & F.col("__text").isNotNull()).select("__text").distinct().limit(show).collect()]
    if bad:
        raise QueryError(f"{name}: not {kind}: {', '.join(sorted(bad))}")
    cast = rows.select("item_id", "type", *((to if k == kind else F.lit(None)).cast({"integer": "long"}.get(k, k)).alias(n) for k, n in LABELS.items()))
    return tags.where(F.col("type") != name).select(*COLUMNS).unionByName(cast)


def text_to(c: Column, kind: str) -> Column:
    if kind == "integer":
        return F.coalesce(c.try_cast("long"), F.when(c.try_cast("double") == F.floor(c.try_cast("double")), c.try_cast("double").cast("long")))
    return c if kind == "string" else c.try_cast(kind)


def store_items(references: DataFrame, new: DataFrame) -> DataFrame:
    """New notes and definitions (with ids) in the table of stored items."""
    return key_replace(references, new, "item_id")
