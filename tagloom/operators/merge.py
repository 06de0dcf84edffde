"""Tables that are rewritten by merging: key replacement, a layout for row-group statistics, and versions that are swapped in."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def key_replace(old: DataFrame, new: DataFrame, key: str | list[str], keep: Column | None = None) -> DataFrame:
    """new, and the rows of old (that keep allows) whose key is not in new."""
    key = [key] if isinstance(key, str) else key
    rest = old.join(new.select(*key).distinct(), key, "left_anti")
    return (rest.where(keep) if keep is not None else rest).select(*old.columns).unionByName(new.select(*old.columns))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors see. Only a local session may do without and gets one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise OSError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tagloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared checkpoint folder, so that later plans neither repeat nor contain it."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def tag_layout(tags: DataFrame, partitions: int | None = None) -> DataFrame:
    """Tags clustered for pruning: ranges of (type, labels), sorted inside, so that row groups have narrow statistics."""
    keys = ["type", "label_int", "label_str", "item_id"]
    ranged = tags.repartitionByRange(partitions, *keys) if partitions else tags.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(p)]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of a table's last version, or None if there is none yet."""
    found = _versions(spark, path)
    return f"{path}/v{found[-1]:012d}" if found else None


def write_atomic(df: DataFrame, path: str, metadata: dict | None = None) -> None:
    """Write a table's next version as ZSTD Parquet; metadata goes to a JSON file.

    Below path lie numbered folders, of which the last one is the table. A version is written aside and gets its number by one
    rename once it is complete: at any time, also after a crash, readers find the old version or the new one. Of two writers at
    once the second one's rename fails. The version before stays for those who are reading it; older ones are deleted.
    """
    spark = df.sparkSession
    found = _versions(spark, path)
    tmp, target = f"{path}/_tmp-{uuid.uuid4().hex}", f"{path}/v{(found[-1] if found else 0) + 1:012d}"
    df.write.option("compression", "zstd").parquet(tmp)
    fs, _ = _fs(spark, path)
    make = lambda x: spark._jvm.org.apache.hadoop.fs.Path(x)
    if metadata is not None:
        out = fs.create(make(f"{tmp}/_info.json"), True)
        out.write(bytearray(json.dumps(metadata).encode()))
        out.close()
    if fs.exists(make(target)) or not fs.rename(make(tmp), make(target)):
        fs.delete(make(tmp), True)
        raise OSError(f"{target} was written by somebody else")
    for n in found[:-1]:
        fs.delete(make(f"{path}/v{n:012d}"), True)


def read_metadata(spark: SparkSession, path: str) -> dict:
    """The metadata of a table written by write_atomic, or {}."""
    now = current(spark, path)
    fs, p = _fs(spark, f"{now}/_info.json")
    if now is None or not fs.exists(p):
        return {}
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table, or an empty one with this schema if there is none yet."""
    now = current(spark, path)
    return spark.read.schema(schema).parquet(now) if now else spark.createDataFrame([], schema)
