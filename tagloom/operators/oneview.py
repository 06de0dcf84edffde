"""The long view: every attribute of every item as one row (item_id, item_kind, rank, origin, type, labels, tag)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import origin_of
from ..plans.catalog import LABELS, Catalog, TagDef

COLUMNS = ("item_id", "item_kind", "rank", "origin", "type", *LABELS.values(), "tag")


def _row(name: str, kind: str, c: Column) -> Column:
    cast = {"integer": "long"}.get(kind, kind)
    return F.struct(F.lit(name).alias("type"), *((c if k == kind else F.lit(None)).cast({"integer": "long"}.get(k, k)).alias(n) for k, n in LABELS.items()), c.cast(cast).isNotNull().alias("__has"))


def unpivot(df: DataFrame, defs: list[TagDef]) -> DataFrame:
    """One row for each non-null column of each item, in one pass over the table."""
    rows = F.array(*(_row(d.name, d.kind, F.col(d.column)) for d in defs))
    return df.select("item_id", "rank", "item_kind", F.inline(rows)).where("__has").drop("__has")


def number_text(c: Column) -> Column:
    """A double as text: whole numbers with one decimal, no exponent below 1e15."""
    return F.when(F.abs(c) < 1e15, F.regexp_replace(F.regexp_replace(F.format_string("%.10f", c), "0+$", ""), "\\.$", ".0")).otherwise(c.cast("string"))


def value_text() -> Column:
    return F.coalesce("label_str", F.col("label_int").cast("string"), number_text(F.col("label_double")), F.col("label_bool").cast("string"))


def oneview(files: DataFrame, defs: list[TagDef], user_tags: DataFrame | None = None, references: DataFrame | None = None, removed: DataFrame | None = None, other_tags: tuple[tuple[DataFrame, str], ...] = ()) -> DataFrame:
    """The union of all stored attributes, with each item's kind and rank.

    references: item_id, rank, name, item_kind, content. removed: item_id, rank, path, size, mtime, is_dir, removed_file_at.
    other_tags: further tag tables and their origin. A user's rank tag overrides the stored rank; an item without a row of its own
    is volatile, or a file if it was removed.
    """
    parts = [unpivot(files, defs).withColumn("origin", F.lit("file"))]
    known = files.select("item_id", "rank", "item_kind")
    if references is not None:
        refs = [TagDef("name", "string", "name"), TagDef("item_kind", "string", "item_kind"), TagDef("content", "string", "content")]
        parts.append(unpivot(references, refs).withColumn("origin", origin_of(F.col("item_id"))))
        known = known.unionByName(references.select("item_id", "rank", "item_kind"))
    if removed is not None:
        gone = [TagDef(f"removed_file_{n}", k, n) for n, k in (("path", "string"), ("size", "integer"), ("mtime", "integer"), ("is_dir", "boolean"))] + [TagDef("removed_file_at", "integer", "removed_file_at")]
        parts.append(unpivot(removed.withColumn("item_kind", F.lit("file")), gone).withColumn("origin", F.lit("file")))
    for tags, origin in (*(((user_tags, "user"),) if user_tags is not None else ()), *other_tags):
        rows = tags.join(known, "item_id", "left")
        parts.append(rows.select("item_id", "rank", "item_kind", "type", *LABELS.values()).withColumn("origin", F.lit(origin)))
    view = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if user_tags is not None:
        ranks = user_tags.where("type = 'rank'").groupBy("item_id").agg(F.max("label_int").alias("__rank")).where("__rank IS NOT NULL")
        view = view.join(ranks, "item_id", "left").withColumn("rank", F.coalesce("__rank", "rank", F.lit(0))).drop("__rank")
    else:
        view = view.withColumn("rank", F.coalesce("rank", F.lit(0)))
    if removed is not None:
        ids = removed.select("item_id").distinct().withColumn("__gone", F.lit(True))
        view = view.join(ids, "item_id", "left").withColumn("item_kind", F.coalesce("item_kind", F.when(F.col("__gone"), F.lit("file")), F.lit("volatile"))).drop("__gone")
    else:
        view = view.withColumn("item_kind", F.coalesce("item_kind", F.lit("volatile")))
    return view.withColumn("tag", F.concat_ws(":", "type", value_text())).select(*COLUMNS)


def prefer(view: DataFrame, name: str, fallback: str) -> DataFrame:
    """One row an item of a type: the user's own, else the fallback type's row under this name."""
    rows = view.where((F.col("type") == name) & (F.col("origin") == "user") | (F.col("type") == fallback))
    own = F.col("type") == name
    order = Window.partitionBy("item_id").orderBy(own.cast("int").desc(), value_text().isNull(), value_text())
    best = rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
    return best.withColumn("type", F.lit(name)).withColumn("tag", F.concat_ws(":", "type", value_text()))


def long_catalog(catalog: Catalog) -> Catalog:
    """The same catalog with every attribute in the long form: what a query gives must not depend on the mapping."""
    defs = [d for d in catalog.defs.values() if d.column]
    rows = unpivot(catalog.items, defs).select("item_id", "type", *LABELS.values())
    tags = rows if catalog.tags is None else rows.unionByName(catalog.tags.select(*rows.columns))
    from dataclasses import replace

    return replace(catalog, items=catalog.items.select("item_id", "rank", "item_kind"), tags=tags, defs={n: replace(d, column=None) for n, d in catalog.defs.items()})
