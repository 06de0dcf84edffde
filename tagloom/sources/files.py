"""Scans of a file tree, and attributes that follow from a path."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, file_id string, is_dir boolean, size long, mtime long"


#: Partitions that a scan has at least, if there are as many directories: large ones are opened until then.
PARTS = 64


@dataclass(frozen=True)
class Rule:
    """A line of an ignore file, read relative to the folder of that file."""

    base: str
    regex: re.Pattern
    keep: bool
    dirs_only: bool


def ignore_rule(line: str, base: str) -> Rule | None:
    """A pattern line: ! keeps what an earlier line left out, a final / means directories, another / ties it to the folder."""
    line = line.rstrip("\r\n")
    line = re.sub(r"(?<!\\) +$", "", line)
    if not line or line.startswith("#"):
        return None
    keep = line.startswith("!")
    line = line[1:] if keep else line
    dirs_only = line.endswith("/")
    line = line.rstrip("/")
    tied = "/" in line
    out, i, line = "", 0, line.lstrip("/")
    while i < len(line):
        if line.startswith("**/", i) and (i == 0 or line[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif line[i:] == "**":
            out, i = out + ".*", i + 2
        elif line[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif line[i] == "?":
            out, i = out + "[^/]", i + 1
        elif line[i] == "[" and "]" in line[i + 2 :]:
            end = line.index("]", i + 2)
            inner = line[i + 1 : end].replace("\\", "\\\\")
            out, i = out + f"[{'^' + inner[1:] if inner[0] in '!^' else inner}]", end + 1
        else:
            i += line[i] == "\\" and i + 1 < len(line)
            out, i = out + re.escape(line[i]), i + 1
    return Rule(base.rstrip("/"), re.compile(("" if tied else "(?:.*/)?") + out + r"\Z", re.S), keep, dirs_only) if out else None


def ignore_rules(folder: str, in_repository: bool) -> tuple[Rule, ...]:
    """The rules of a folder's own ignore files; those of version control count inside a repository only. The last match wins."""
    found = []
    for name in (*((".git/info/exclude", ".gitignore") if in_repository else ()), ".ignore"):
        try:
            with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
                found += [r for line in f if (r := ignore_rule(line, folder))]
        except OSError:
            continue
    return tuple(found)


def ignored(path: str, is_dir: bool, rules: tuple[Rule, ...]) -> bool:
    for r in reversed(rules):
        if (is_dir or not r.dirs_only) and r.regex.match(path[len(r.base) + 1 :]):
            return not r.keep
    return False


@dataclass(frozen=True)
class Folder:
    """A directory, and the ignore rules that hold in it."""

    path: str
    rules: tuple[Rule, ...]
    in_repository: bool

    def below(self, path: str) -> Folder:
        inside = self.in_repository or os.path.exists(os.path.join(path, ".git"))
        return Folder(path, self.rules + ignore_rules(path, inside), inside)


def opened(root: str) -> Folder:
    """A root with the rules of the folders above it, as far as its repository reaches."""
    chain = [root]
    while not os.path.exists(os.path.join(chain[-1], ".git")) and os.path.dirname(chain[-1]) != chain[-1]:
        chain.append(os.path.dirname(chain[-1]))
    inside = os.path.exists(os.path.join(chain[-1], ".git"))
    at = Folder(chain[-1], ignore_rules(chain[-1], inside), inside)
    for path in reversed(chain[:-1]):
        at = at.below(path)
    return at


class _Part(InputPartition):
    def __init__(self, folder: Folder, deep: bool):
        super().__init__((folder, deep))


class TreeReader(DataSourceReader):
    """Partitions are directories: some alone with their files, some with all below them. Only metadata is read.

    The driver opens directories, the topmost first, until there are PARTS partitions.
    """

    def __init__(self, options):
        self.roots = [r.rstrip("/") or "/" for r in options.get("paths", options.get("path", "")).split(",") if r]
        self.skip = {s for s in options.get("skip", "").split(",") if s}

    def entries(self, folder: Folder) -> tuple[list[Folder], list[str]]:
        """The directories and the other entries of a folder that are neither skipped nor ignored."""
        dirs, rest = [], []
        for e in sorted(os.scandir(folder.path), key=lambda e: e.name):
            is_dir = e.is_dir(follow_symlinks=False)
            if e.path in self.skip or ignored(e.path, is_dir, folder.rules):
                continue
            if is_dir:
                dirs.append(folder.below(e.path))
            else:
                rest.append(e.path)
        return dirs, rest

    def partitions(self) -> list[_Part]:
        closed, alone = [opened(r) for r in self.roots], []
        while closed and len(closed) + len(alone) < PARTS:
            now, closed = closed, []
            for folder in now:
                alone.append(folder)
                closed += self.entries(folder)[0]
        return [_Part(f, False) for f in alone] + [_Part(f, True) for f in closed]

    def read(self, partition: _Part) -> Iterator[tuple]:
        folder, deep = partition.value
        waiting = [folder]
        while waiting:
            at = waiting.pop()
            yield self.row(at.path)
            dirs, rest = self.entries(at)
            for path in rest:
                yield self.row(path)
            if deep:
                waiting += dirs

    def row(self, path: str) -> tuple:
        s = os.lstat(path)
        is_dir = os.path.isdir(path) and not os.path.islink(path)
        return path, f"{s.st_dev:08x}-{s.st_ino:016x}", is_dir, 0 if is_dir else s.st_size, int(s.st_mtime)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def scan_tree(spark: SparkSession, roots: list[str], skip: list[str] = ()) -> DataFrame:
    """Files and directories below roots with the attributes of their paths."""
    spark.dataSource.register(TreeSource)
    df = spark.read.format("file_tree").option("paths", ",".join(roots)).option("skip", ",".join(skip)).load()
    return path_attributes(df)


def path_attributes(df: DataFrame) -> DataFrame:
    """parentdir, filename, stem and extension (lower case, none for directories and dot files)."""
    name = F.substring_index("path", "/", -1)
    dot = F.regexp_extract(name, r"^(.+)\.([^.]+)$", 2)
    extension = F.when(~F.col("is_dir") & (dot != ""), F.lower(dot))
    stem = F.when(dot != "", F.regexp_extract(name, r"^(.+)\.([^.]+)$", 1)).otherwise(name)
    parent = F.expr("substring(path, 1, greatest(length(path) - length(substring_index(path, '/', -1)) - 1, 0))")
    return df.withColumn("filename", name).withColumn("parentdir", parent).withColumn("stem", stem).withColumn("extension", extension)


def extract(df: DataFrame, defs: list) -> DataFrame:
    """Long tag rows (item_id, type, labels) from the extract hooks of types: functions from columns to a column."""
    from ..operators.oneview import unpivot
    from ..plans.catalog import LABELS, TagDef

    hooks = [d for d in defs if d.extract]
    wide = df.select("item_id", F.lit(0).cast("long").alias("rank"), F.lit("file").alias("item_kind"), *(d.extract(df).alias(f"__x{k}") for k, d in enumerate(hooks)))
    rows = unpivot(wide, [TagDef(d.name, d.kind, f"__x{k}") for k, d in enumerate(hooks)])
    return rows.select("item_id", "type", *LABELS.values())


def of_file(read: Callable[[str], object], kind: str = "string") -> Callable:
    """An extract hook from a function of one file's path, which may read the file, in the tasks, Arrow batches at a time.

    Of a list the first value that is not empty is the label; a file that cannot be read has none.
    """

    def one(path: str):
        try:
            found = read(path)
        except OSError:
            return None
        return next((v for v in found if v not in (None, "")), None) if isinstance(found, (list, tuple)) else found

    def labels(paths: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in paths:
            yield some.map(one, na_action="ignore")

    column = F.pandas_udf(labels, {"integer": "long"}.get(kind, kind))
    return lambda df: column(F.when(~F.col("is_dir"), F.col("path")))


#: Media types by extension, for the sample hook; fixed values.
MIME_TYPES = {"txt": "text/plain", "md": "text/markdown", "html": "text/html", "csv": "text/csv", "json": "application/json", "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "mp3": "audio/mpeg", "mp4": "video/mp4", "rs": "text/x-rust", "py": "text/x-python"}


def mimetype(df: DataFrame):
    """An extract hook: the media type of a file's extension."""
    pairs = F.create_map(*(F.lit(x) for kv in MIME_TYPES.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, F.col("extension")), F.when(~F.col("is_dir"), F.lit("application/octet-stream")))
