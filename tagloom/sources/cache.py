"""Results kept as Parquet, found again by the query's text, and cleared by size and age."""

from __future__ import annotations

import hashlib
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import _fs, current, read_metadata, write_atomic
from ..plans.compiler import Result

#: Bytes that a cache may hold; fixed value.
CAP = 3 << 30


class ResultCache:
    """A result is stored whole and in its order, with the place of each row, so that pages of it need no second run."""

    def __init__(self, spark: SparkSession, folder: str, cap: int = CAP, version: str = ""):
        self.spark, self.folder, self.cap, self.version = spark, folder.rstrip("/"), cap, version

    def path(self, text: str, order: tuple = ()) -> str:
        return f"{self.folder}/{hashlib.sha256(repr((text, order, self.version)).encode()).hexdigest()[:32]}"

    def _stored(self, engine, text: str, order: tuple) -> tuple[DataFrame, dict]:
        path = self.path(text, order)
        if current(self.spark, path) is None:
            found = engine.query(text, order=order, sort=True)
            # Partitions of a sorted result are ranges in order, so these numbers rise with it.
            rows = found.df.withColumn("__at", F.monotonically_increasing_id())
            write_atomic(rows, path, {"query": text, "at": time.time(), "kind": found.kind, "warnings": list(found.warnings), "types": found.types})
            self.trim()
        return self.spark.read.parquet(current(self.spark, path)), read_metadata(self.spark, path)

    def get(self, engine, text: str, order: tuple = ()) -> DataFrame:
        """The whole result of a query: stored at first, then read from there."""
        return self._stored(engine, text, order)[0].drop("__at")

    def page(self, engine, text: str, n: int, offset: int = 0, order: tuple = ()) -> Result:
        """Rows offset to offset + n of a query's result in its order."""
        df, info = self._stored(engine, text, order)
        return Result(info["kind"], df.orderBy("__at").offset(offset).limit(n).drop("__at"), tuple(info["warnings"]), info["types"])

    def trim(self) -> None:
        """Drop the oldest results beyond the cap."""
        fs, p = _fs(self.spark, self.folder)
        found = sorted(((s.getModificationTime(), fs.getContentSummary(s.getPath()).getLength(), s.getPath()) for s in fs.listStatus(p)), key=lambda x: x[0])
        total = sum(n for _, n, _ in found)
        for _, n, path in found[:-1]:
            if total <= self.cap:
                break
            fs.delete(path, True)
            total -= n

    def clear(self) -> None:
        fs, p = _fs(self.spark, self.folder)
        fs.delete(p, True)
