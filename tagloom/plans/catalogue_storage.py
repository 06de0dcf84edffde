"""More registered queries: files, hooks, stored items, edits, versions of tables, and results that are kept.

Files are made from parts: a folder for each brand, every tenth part a directory, the others with one of three extensions.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import allocate
from ..operators import edit as E
from ..operators import incremental as I
from ..operators.merge import read_metadata, read_or_empty, shared_folder, tag_layout, write_atomic
from ..operators.oneview import oneview
from ..sources.cache import ResultCache
from ..sources.files import extract, mimetype, path_attributes
from .catalog import TagDef, files_catalog
from .catalogue import _GRADES, NOW, QUERIES, Query, catalog, items, read, tagged, text, user_tags
from .compiler import Engine
from .literals import BLOCK
from .syntax import QueryError

_ID = "2305843009213693952 + p_partkey"  # the block of files, from 8 * 2 ** 58
_EXT = "CASE WHEN p_partkey % 10 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN 'rs' WHEN p_partkey % 3 = 1 THEN 'txt' ELSE 'jpg' END"
_DIR = "'/data/' || replace(p_brand, '#', '')"


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, rank, item_kind and a file table's columns."""
    ext = F.expr("CASE WHEN p_partkey % 10 = 0 THEN '' WHEN p_partkey % 3 = 0 THEN '.rs' WHEN p_partkey % 3 = 1 THEN '.txt' ELSE '.JPG' END")
    path = F.concat(F.lit("/data/"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("/p"), F.col("p_partkey").cast("string"), ext)
    rows = read(spark, sf_dir, "part").select(
        (F.lit(8 * BLOCK) + F.col("p_partkey")).alias("item_id"), F.lit(0).cast("long").alias("rank"), F.lit("file").alias("item_kind"), path.alias("path"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("file_id"),
        F.expr("p_partkey % 10 = 0").alias("is_dir"), (F.col("p_size") * 100).cast("long").alias("size"), (F.lit(1_700_000_000) + F.col("p_partkey") * 3600).cast("long").alias("mtime"),
    )
    return path_attributes(rows)


def removed_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every thirteenth file, the path that it had before it was removed."""
    rows = part_files(spark, sf_dir).where("item_id % 13 = 0")
    return rows.select("item_id", F.lit("removed_file_path").alias("type"), F.col("path").alias("label_str"), F.lit(None).cast("long").alias("label_int"), F.lit(None).cast("double").alias("label_double"), F.lit(None).cast("boolean").alias("label_bool"))


def over_files(key: str, query: str, sql: str) -> None:
    """Register a query text over the files; sql is a condition on part for items, else the whole statement."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = Engine(files_catalog(part_files(spark, sf_dir), removed_tags(spark, sf_dir), NOW)).query(query)
        return found.df.select("item_id") if found.kind == "items" else found.df

    QUERIES[key] = Query(run, sql if sql.startswith("SELECT") else f"SELECT {_ID} AS item_id FROM part WHERE {sql}")


over_files("fl_bool_glob", "is_dir:t*", "p_partkey % 10 = 0")
over_files("fl_bool_not", "is_dir: :^ true", "p_partkey % 10 <> 0")
over_files("fl_implied", "extension:rs | filename:p1?0", f"{_EXT} = 'rs'")
over_files("fl_directory", "directory:p1*", "p_partkey % 10 = 0 AND CAST(p_partkey AS VARCHAR) LIKE '1%'")
over_files("fl_normal", "extension:.JPG & parentdir:/data/Brand11/", f"{_EXT} = 'jpg' AND {_DIR} = '/data/Brand11'")
over_files("fl_removed", "removed_file:true & size: :> 1KB", f"({_ID}) % 13 = 0 AND p_size * 100 > 1024")
over_files("fl_present", "removed_file:false & extension:txt", f"({_ID}) % 13 <> 0 AND {_EXT} = 'txt'")
over_files("a_bool", "parentdir: &: sum(is_dir:)", f"SELECT {_DIR} AS key0, CAST(count(*) FILTER (p_partkey % 10 = 0) AS DOUBLE) AS nvalue, count(*) AS item_count FROM part GROUP BY 1")
over_files("a_bool_calc", "is_dir: + 1", "SELECT CAST(CASE WHEN p_partkey % 10 = 0 THEN 2 ELSE 1 END AS DOUBLE) AS key0, count(*) AS item_count FROM part GROUP BY 1")


def origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that the system made, of files beside notes whose ids are a user's."""
    files = part_files(spark, sf_dir)
    notes = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("item_id"), F.lit(3).cast("long").alias("rank"), F.lit("note").alias("item_kind"))
    both = files.unionByName(notes, allowMissingColumns=True)
    e = Engine(files_catalog(both, now=NOW))
    found = [e.query(q).df.select(F.lit(q).alias("query"), "item_id") for q in ("origin:system & size: :> 4000", "origin:user - item_id: :< 20", "origin: :^ file")]
    return found[0].unionByName(found[1]).unionByName(found[2])


QUERIES["f_origin"] = Query(origins, f"SELECT 'origin:system & size: :> 4000' AS query, {_ID} AS item_id FROM part WHERE p_size * 100 > 4000 UNION ALL SELECT 'origin:user - item_id: :< 20', n_nationkey FROM nation WHERE n_nationkey >= 20 UNION ALL SELECT 'origin: :^ file', n_nationkey FROM nation")

# --- Queries over tables ---------------------------------------------------------------------------------------------

items("f_column", "orders", "item_kind:orders & rank:0 & item_id: :> 100 - item_kind:part", "o_orderkey > 100")
items("f_empty_and", "orders", "*:* - o_orderstatus:F", "o_orderstatus <> 'F'")
items("f_empty_or", "orders", "q(o_orderstatus:Z) | o_orderpriority:5-LOW", "o_orderpriority = '5-LOW'")
items("l_proj_or_tag", "orders", "(o_orderpriority: | o_orderstatus:F) - o_orderstatus:O", "o_orderstatus <> 'O'")
items("c_nest_lit", "orders", "(o_custkey: &: count()) :> 5", "o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 5)")
items("c_lit_nest", "orders", "300000 :< (o_custkey: &: sum(o_totalprice:))", "o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING sum(o_totalprice) > 300000)")
items("c_nest_calc", "orders", "(o_custkey: &: sum(o_totalprice:)) :> ((o_custkey: &: count()) * 150000)", "o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING sum(o_totalprice) > count(*) * 150000)")
items("c_ratio", "orders", "((o_custkey: &: count(o_orderstatus:F)) / (o_custkey: &: count())) :>= 0.6", "o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderstatus = 'F') * 1.0 / count(*) >= 0.6 AND count(*) FILTER (o_orderstatus = 'F') > 0)")
items("n_having_two", "orders", "o_orderstatus: &: o_orderpriority: &: (count() > 100)", "(o_orderstatus, o_orderpriority) IN (SELECT (o_orderstatus, o_orderpriority) FROM orders GROUP BY o_orderstatus, o_orderpriority HAVING count(*) > 100)")
items("n_having_sum", "orders", "o_custkey: &: o_orderstatus: &: (avg(o_totalprice:) > 200000)", "(o_custkey, o_orderstatus) IN (SELECT (o_custkey, o_orderstatus) FROM orders GROUP BY o_custkey, o_orderstatus HAVING avg(o_totalprice) > 200000)")
items("n_having_context", "orders", "(o_orderpriority:5-LOW & o_custkey:) &: (count() > 2)", "o_orderpriority = '5-LOW' AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY 1 HAVING count(*) > 2)")
text("n_dup_key", "orders", "o_orderstatus: &: o_orderpriority: &: o_orderstatus: &: count()", "SELECT o_orderstatus AS key0, o_orderpriority AS key1, CAST(count(*) AS DOUBLE) AS nvalue, count(*) AS item_count FROM orders GROUP BY 1, 2")
text("a_text", "nation", "n_name: + n_name:", "SELECT n_name || ', ' || n_name AS key0, count(*) AS item_count FROM nation GROUP BY 1")
text("a_text_joined", "nation", 'n_name: * "!"', "SELECT n_name || '!' AS key0, count(*) AS item_count FROM nation GROUP BY 1")
items("a_fold", "orders", "o_totalprice: :> (100000 + 7 / 2 * 1000)", "o_totalprice > 103000")
text("g_types", "orders", "count(type:)", "SELECT 4 + count(*) AS value, 'integer' AS bitical_type FROM (DESCRIBE orders)")
text("g_defs", "orders", "count(type:o_order*)", "SELECT count(*) AS value, 'integer' AS bitical_type FROM (DESCRIBE orders) WHERE column_name LIKE 'o\\_order%' ESCAPE '\\'")
text("m_type", "orders", "type:o_order*", "SELECT column_name AS name FROM (DESCRIBE orders) WHERE column_name LIKE 'o\\_order%' ESCAPE '\\'", columns=("name",))
text("m_type_order", "orders", "type:o_*", "SELECT column_name AS name FROM (DESCRIBE orders) ORDER BY 1 LIMIT 3", columns=("name",), n=3)
text("m_or_items", "orders", "type:o_order* | o_totalprice: :> 400000", "SELECT CAST(NULL AS BIGINT) AS item_id, column_name AS name, 'type' AS item_kind FROM (DESCRIBE orders) WHERE column_name LIKE 'o\\_order%' ESCAPE '\\' UNION ALL SELECT o_orderkey, NULL, 'orders' FROM orders WHERE o_totalprice > 400000", columns=("item_id", "name", "item_kind"))
items("e_eval", "orders", "q(o_custkey: & o_totalprice: :> 300000) & o_orderpriority:5-LOW", "o_orderpriority = '5-LOW' AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
items("e_eval_items", "orders", "q(o_totalprice: :> 20000) - o_orderstatus:F", "o_totalprice > 20000 AND o_orderstatus <> 'F'")
items("e_eval_keys", "orders", "q((o_custkey: & o_totalprice: :> 300000) &: o_orderstatus: &: count())", "(o_custkey, o_orderstatus) IN (SELECT (o_custkey, o_orderstatus) FROM orders WHERE o_totalprice > 300000)")
items("e_eval_scalar", "orders", "o_totalprice: :> q(avg(o_totalprice:))", "o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
tagged("e_eval_long", "q(grade: & o_totalprice: :> 300000)", f"SELECT DISTINCT i AS item_id FROM {_GRADES} WHERE g IN (SELECT g FROM {_GRADES} JOIN orders ON o_orderkey = i WHERE o_totalprice > 300000)")


def refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which query texts are errors: aggregates of single values, sets of values, comparisons of what has no order, and more."""
    e, out = Engine(catalog(spark, sf_dir, "orders")), []
    for q, *_ in _TEXTS:
        try:
            e.query(q)
            out.append((q, False))
        except QueryError:
            out.append((q, True))
    return spark.createDataFrame(out, "query string, refused boolean")


_TEXTS = (
    ("count(count())", True), ("sum(max(o_totalprice:))", True), ("count() & o_orderstatus:F", True), ("o_orderstatus:F - max(o_totalprice:)", True), ("(o_custkey: &: count()) :> o_totalprice:", True),
    ("o_orderstatus: :> [ab]*", True), ("o_totalprice:cheap", True), ("1 / 0", True), ("(o_orderstatus: - 1) :> 2", True), ("count(o_custkey:)", False), ("o_orderstatus:F & o_custkey:", False), ("1 / 2", False), ("sum(o_custkey: &: count())", False),
)
QUERIES["x_refused"] = Query(refused, "SELECT * FROM (VALUES " + ", ".join("('{}', {})".format(q.replace("'", "''"), str(r).lower()) for q, r in _TEXTS) + ") AS t(query, refused)")


# --- Hooks -----------------------------------------------------------------------------------------------------------


def hooked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types with hooks: a label rewritten, a macro, a macro projection, and a condition that comes with a match."""
    c = catalog(spark, sf_dir, "orders")
    c = c.register(
        replace(c.defs["o_orderstatus"], interpret=str.upper), TagDef("dear", expand=lambda label: f"o_totalprice: :> {label}000"), TagDef("status", expand_projection="o_orderstatus: & o_totalprice: :> 200000"),
        TagDef("urgent", "string", "o_orderpriority", implies="o_orderstatus:o"),
    )
    e = Engine(c)
    one = lambda q: e.query(q).df.select(F.lit(q).alias("query"), F.col("item_id").cast("string").alias("found"))
    groups = e.query("status: &: count()").df.select(F.lit("status: &: count()").alias("query"), F.concat_ws(" ", "key0", F.col("item_count").cast("string")).alias("found"))
    return one("o_orderstatus:f").unionByName(one("dear:250")).unionByName(one("urgent:1-URGENT")).unionByName(groups)


QUERIES["u_hooks"] = Query(hooked, "SELECT 'o_orderstatus:f' AS query, CAST(o_orderkey AS VARCHAR) AS found FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'dear:250', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_totalprice > 250000 UNION ALL SELECT 'urgent:1-URGENT', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' UNION ALL SELECT 'status: &: count()', o_orderstatus || ' ' || count(*) FROM orders WHERE o_totalprice > 200000 GROUP BY o_orderstatus")


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags that an extract hook computes for each file."""
    return extract(part_files(spark, sf_dir), [TagDef("mime", extract=mimetype)]).select("item_id", "type", "label_str")


QUERIES["s_extract"] = Query(extracted, f"SELECT {_ID} AS item_id, 'mime' AS type, CASE {_EXT} WHEN 'rs' THEN 'text/x-rust' WHEN 'txt' THEN 'text/plain' WHEN 'jpg' THEN 'image/jpeg' END AS label_str FROM part WHERE p_partkey % 10 <> 0")


# --- Stored items, edits, scans --------------------------------------------------------------------------------------


def stored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as notes: item_id, rank, name, item_kind, content."""
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("item_id"), F.col("n_regionkey").cast("long").alias("rank"), F.col("n_name").alias("name"), F.lit("note").alias("item_kind"), F.when(F.col("n_regionkey") > 1, F.lit("text")).alias("content"))


def all_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long view of files, stored items and removed files, with user tags on all of them: rows, items and ranks by type and kind."""
    files = part_files(spark, sf_dir).where("item_id % 13 <> 0")
    lost = part_files(spark, sf_dir).where("item_id % 13 = 0").withColumn("removed_file_at", F.lit(5).cast("long"))
    removed = lost.select("item_id", "rank", "path", "size", "mtime", "is_dir", "removed_file_at")
    ids = files.select("item_id").where("item_id % 2 = 0").unionByName(removed.select("item_id")).unionByName(stored_items(spark, sf_dir).select("item_id")).unionByName(spark.range(1000, 1010).toDF("item_id"))
    tags = ids.select("item_id", F.lit("mood").alias("type"), F.lit("calm").alias("label_str"), F.lit(None).cast("long").alias("label_int"), F.lit(None).cast("double").alias("label_double"), F.lit(None).cast("boolean").alias("label_bool"))
    rank = tags.where("item_id < 3").withColumn("type", F.lit("rank")).withColumn("label_str", F.lit(None).cast("string")).withColumn("label_int", F.lit(50).cast("long"))
    view = oneview(files, [TagDef("size", "integer", "size")], tags.unionByName(rank), stored_items(spark, sf_dir), removed)
    return view.groupBy("type", "item_kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("item_id").alias("items"), F.sum("rank").alias("ranks"))


_LOST = f"({_ID}) % 13 = 0"
_RANKED = "CASE WHEN n_nationkey < 3 THEN 50 ELSE n_regionkey END"
QUERIES["s_parts"] = Query(all_parts, "SELECT type, item_kind, count(*) AS n, count(DISTINCT i) AS items, CAST(sum(r) AS BIGINT) AS ranks FROM (" + " UNION ALL ".join([
    f"SELECT 'size' AS type, 'file' AS item_kind, {_ID} AS i, 0 AS r FROM part WHERE NOT {_LOST}",
    *(f"SELECT 'removed_file_{c}', 'file', {_ID}, 0 FROM part WHERE {_LOST}" for c in ("path", "size", "mtime", "is_dir", "at")),
    *(f"SELECT '{c}', 'note', n_nationkey, {_RANKED} FROM nation" for c in ("name", "item_kind", "mood")),
    f"SELECT 'content', 'note', n_nationkey, {_RANKED} FROM nation WHERE n_regionkey > 1",
    "SELECT 'rank', 'note', n_nationkey, 50 FROM nation WHERE n_nationkey < 3",
    f"SELECT 'mood', 'file', {_ID}, 0 FROM part WHERE NOT {_LOST} AND ({_ID}) % 2 = 0", f"SELECT 'mood', 'file', {_ID}, 0 FROM part WHERE {_LOST}",
    "SELECT 'mood', 'volatile', i, 0 FROM range(1000, 1010) t(i)",
]) + ") GROUP BY 1, 2")


def saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New notes beside stored ones: their ids go on without gaps; then ranks are set and some items deleted with their tags."""
    refs = stored_items(spark, sf_dir)
    new = read(spark, sf_dir, "customer").select(F.lit(0).cast("long").alias("rank"), F.col("c_name").alias("name"), F.lit("note").alias("item_kind"), F.lit(None).cast("string").alias("content"))
    both = E.store_items(refs, allocate(new, refs, 0, ["name"]).select(*refs.columns))
    both = E.set_rank(both, both.where("name = 'FRANCE' OR item_id = 30").select("item_id"), 9)
    tags = both.select("item_id", F.lit("t").alias("type"), F.col("name").alias("label_str"), *(F.lit(None).cast(t).alias(c) for c, t in (("label_int", "long"), ("label_double", "double"), ("label_bool", "boolean"))))
    left, left_tags = E.delete_items(both, tags, both.where("item_id % 4 = 1").select("item_id"))
    return left.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("item_id").alias("ids"), F.min("item_id").alias("least"), F.max("item_id").alias("most"), F.sum("rank").alias("ranks")).crossJoin(left_tags.agg(F.count(F.lit(1)).alias("tags")))


QUERIES["ed_items"] = Query(saved, "WITH n AS (SELECT (SELECT count(*) FROM customer) + 25 AS m) SELECT count(*) AS n, count(*) AS ids, min(i) AS least, max(i) AS most, CAST(sum(CASE WHEN i = 30 THEN 9 WHEN i < 25 THEN (SELECT CASE n_name WHEN 'FRANCE' THEN 9 ELSE n_regionkey END FROM nation WHERE n_nationkey = i) ELSE 0 END) AS BIGINT) AS ranks, count(*) AS tags FROM n, range(0, (SELECT m FROM n)) t(i) WHERE i % 4 <> 1")


def replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A type with the replace strategy loses its former labels where it gets new ones; others are added to."""
    c = catalog(spark, sf_dir, "orders").register(TagDef("score", "integer", strategy="replace"))
    hits = Engine(c).query("o_totalprice: :> 200000").df
    tags = E.tag(user_tags(spark, sf_dir), E.new_tags(hits, E.parse_edit("score:77 grade:dear"), c), c)
    return tags.where("type IN ('score', 'grade')").select("item_id", "type", F.coalesce("label_str", F.col("label_int").cast("string")).alias("label"))


QUERIES["ed_replace"] = Query(replaced, f"SELECT i AS item_id, 'grade' AS type, g AS label FROM {_GRADES} UNION ALL SELECT o_orderkey, 'grade', 'dear' FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT o_orderkey, 'score', '77' FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT o_orderkey, 'score', CAST(o_orderkey % 10 AS VARCHAR) FROM orders WHERE o_orderkey % 3 = 0 AND o_totalprice <= 200000")


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that moved and have two hard links now: the least path keeps the id, the other link is new; none is given twice."""
    files = part_files(spark, sf_dir).drop("item_kind")
    there = files.where("item_id % 3 <> 0")
    at = lambda d: path_attributes(files.where("item_id % 3 = 0").drop("filename", "parentdir", "stem", "extension").withColumn("path", F.concat(F.lit(d), F.substring_index("path", "/", -1))))
    scan = there.unionByName(at("/a/")).unionByName(at("/b/")).drop("item_id", "rank")
    after = I.apply(files, I.diff(scan, files))
    known = after.join(files.select("item_id"), "item_id", "left_semi").select("path", "item_id")
    return known.unionByName(after.join(files.select("item_id"), "item_id", "left_anti").select("path", F.lit(-1).cast("long").alias("item_id")))


_NAME = f"'p' || p_partkey || coalesce('.' || CASE {_EXT} WHEN 'jpg' THEN 'JPG' ELSE {_EXT} END, '')"
QUERIES["i_links"] = Query(linked, f"SELECT CASE WHEN ({_ID}) % 3 = 0 THEN '/a' ELSE {_DIR} END || '/' || {_NAME} AS path, {_ID} AS item_id FROM part UNION ALL SELECT '/b/' || {_NAME}, -1 FROM part WHERE ({_ID}) % 3 = 0")


def forgotten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that go, are remembered if tagged, and come back as themselves, while a new file in between gets an id of its own."""
    files = part_files(spark, sf_dir).drop("item_kind")
    gone = F.expr("item_id % 5 = 0")
    tags = files.where("item_id % 2 = 0").select("item_id", F.lit("t").alias("type"))
    removed = spark.createDataFrame([], "item_id long, rank long, file_id string, scan_hash long, basename_scan_hash long, path string, size long, mtime long, is_dir boolean, removed_file_at long")
    d = I.diff(files.where(~gone).drop("item_id", "rank"), files, removed)
    lost = I.record_removed(files, d.deleted, tags, removed, 1)
    between = I.apply(files, d, lost)
    back = files.drop("item_id", "rank")
    d = I.diff(back, between, lost)
    after = I.apply(between, d, lost)
    same = after.select("path", "item_id").join(files.select("path", F.col("item_id").alias("was")), "path")
    return same.select("path", (F.col("item_id") == F.col("was")).alias("same"))


QUERIES["i_returned"] = Query(forgotten, f"SELECT {_DIR} || '/' || {_NAME} AS path, ({_ID}) % 5 <> 0 OR ({_ID}) % 2 = 0 AS same FROM part")


# --- Tables and kept results -----------------------------------------------------------------------------------------


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is empty at first and written twice: its last version, with what was noted about it."""
    path = f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}"
    one = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    before = read_or_empty(spark, path, "n_nationkey long, n_name string").count()
    write_atomic(one, path, {"by": "first"})
    write_atomic(read_or_empty(spark, path, one.schema).where("n_nationkey > 3"), path, {"by": "second"})
    return read_or_empty(spark, path, one.schema).select("*", F.lit(before).alias("before"), F.lit(read_metadata(spark, path)["by"]).alias("written"))


QUERIES["k_versions"] = Query(versions, "SELECT n_nationkey, n_name, 0 AS before, 'second' AS written FROM nation WHERE n_nationkey > 3")


def laid_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags in ranges of (type, labels): a range a partition, so a type's labels lie in few of them, and each is sorted."""
    tags = tag_layout(user_tags(spark, sf_dir), 8).withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id())
    by = tags.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("type", "label_int", "label_str")).alias("lo"), F.max(F.struct("type", "label_int", "label_str")).alias("hi"))
    before = F.lag("hi").over(Window.orderBy("part"))  # one row a partition
    return by.withColumn("before", before).agg(F.sum("n").alias("n"), F.count(F.when(F.col("before") > F.col("lo"), 1)).alias("overlaps"))


QUERIES["k_layout"] = Query(laid_out, "SELECT CAST(sum(n) AS BIGINT) AS n, 0 AS overlaps FROM (SELECT count(*) FILTER (o_orderpriority = '1-URGENT') + count(*) FILTER (o_orderkey % 2 = 0) + count(*) FILTER (o_orderkey % 100 = 0) + count(*) FILTER (o_orderkey % 3 = 0) AS n FROM orders)")


def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a kept result."""
    cache = ResultCache(spark, f"{shared_folder(spark)}/results-{uuid.uuid4().hex}")
    e = Engine(catalog(spark, sf_dir, "orders"))
    order = (("o_totalprice", True),)
    cache.page(e, "o_orderstatus:F", 30, 0, order)
    return cache.page(None, "o_orderstatus:F", 30, 30, order).df.select("item_id")


QUERIES["k_pages"] = Query(paged, "SELECT o_orderkey AS item_id FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 30 OFFSET 30")
