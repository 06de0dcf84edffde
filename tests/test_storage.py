"""Storage, edits, incremental indexing, sources, cache and streaming."""

import os

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagloom.functions import display
from tagloom.functions.ids import allocate, origin_of, shown_id
from tagloom.operators import edit as E
from tagloom.operators import incremental as I
from tagloom.operators.merge import current, key_replace, read_metadata, read_or_empty, tag_layout, write_atomic
from tagloom.operators.oneview import long_catalog, oneview, prefer
from tagloom.plans.catalog import TAG_COLUMNS, TagDef
from tagloom.plans.compiler import Engine
from tagloom.plans.literals import BLOCK, glob_regex
from tagloom.plans.syntax import QueryError
from tagloom.sources.cache import ResultCache
from tagloom.sources.files import extract, mimetype, of_file, scan_tree
from tagloom.streaming.watch import watch

from .helpers import names, tree

SCAN = "path string, parentdir string, filename string, stem string, extension string, file_id string, is_dir boolean, size long, mtime long"
FILES = "item_id long, rank long, " + SCAN


def scan(spark, rows):
    out = []
    for path, file_id, size, mtime in rows:
        parent, _, name = path.rpartition("/")
        out.append((path, parent, name, name, None, file_id, False, size, mtime))
    return spark.createDataFrame(out, SCAN)


def test_incremental_flow(spark):
    empty = spark.createDataFrame([], FILES)
    one = scan(spark, [("r/a", "f1", 1, 1), ("r/b", "f2", 2, 1), ("r/c", "f3", 3, 1), ("q/z", "f9", 1, 1)])
    files = I.apply(empty, I.diff(one, empty))
    ids = {r.path: r.item_id for r in files.collect()}
    assert sorted(ids.values()) == [8 * BLOCK + k for k in range(4)]
    # b grows, c moves, a second link of f1 appears, d is new, a goes.
    two = scan(spark, [("r/b", "f2", 5, 2), ("r/sub/c", "f3", 3, 1), ("r/d", "f4", 4, 4), ("r/b2", "f2", 5, 2)])
    d = I.diff(two, files, roots=["r"])
    assert {r.path for r in d.changed.collect()} == {"r/b"} and {r.path for r in d.moved.collect()} == {"r/sub/c"}
    assert {r.path for r in d.new.collect()} == {"r/d", "r/b2"} and [r.item_id for r in d.deleted.collect()] == [ids["r/a"]]
    tags = spark.createDataFrame([(ids["r/a"], "t", "x", None, None, None)], TAG_COLUMNS)
    removed = I.with_hashes(files.limit(0)).select("item_id", "rank", "file_id", "scan_hash", "basename_scan_hash", "path", "size", "mtime", "is_dir").withColumn("removed_file_at", F.lit(0).cast("long"))
    removed = I.record_removed(files, d.deleted, tags, removed, 99)
    assert [(r.path, r.removed_file_at) for r in removed.collect()] == [("r/a", 99)]
    files2 = I.apply(files, d, removed)
    after = {r.path: r.item_id for r in files2.collect()}
    assert after["r/b"] == ids["r/b"] and after["r/sub/c"] == ids["r/c"] and after["q/z"] == ids["q/z"] and len(set(after.values())) == 5
    # a comes back elsewhere with its id.
    three = scan(spark, [("r/b", "f2", 5, 2), ("r/sub/c", "f3", 3, 1), ("r/d", "f4", 4, 4), ("r/b2", "f2", 5, 2), ("r/new/a", "f77", 1, 1)])
    d3 = I.diff(three, files2, removed, ["r"])
    assert [(r.path, r.item_id) for r in d3.returned.collect()] == [("r/new/a", ids["r/a"])]
    assert d3.live.count() == 4 and d3.deleted.count() == 0


def test_merge_and_atomic_tables(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string")
    new = spark.createDataFrame([(2, "B"), (2, "BB"), (4, "D")], "k long, v string")
    assert sorted(map(tuple, key_replace(old, new, "k", F.col("v") != "c").collect())) == [(1, "a"), (2, "B"), (2, "BB"), (4, "D")]
    path = f"file://{tmp_path}/t"
    assert read_or_empty(spark, path, "k long, v string").count() == 0 and read_metadata(spark, path) == {}
    write_atomic(old, path, {"by": 1})
    first = current(spark, path)
    write_atomic(key_replace(spark.read.parquet(first), new, "k"), path, {"by": 2})
    read = lambda: spark.read.parquet(current(spark, path))
    assert read().count() == 5 and read_metadata(spark, path) == {"by": 2}
    assert spark.read.parquet(first).count() == 3  # who reads the version before is not disturbed
    os.mkdir(tmp_path / "t/_tmp-left")  # a writer that died leaves the table as it is
    assert read().count() == 5
    write_atomic(old, path)
    assert read().count() == 3 and read_metadata(spark, path) == {} and first.rpartition("/")[2] not in os.listdir(tmp_path / "t")
    tags = spark.createDataFrame([(k, f"t{k % 3}", str(k), None, None, None) for k in range(90)], TAG_COLUMNS)
    assert tag_layout(tags, 3).rdd.getNumPartitions() == 3 and tag_layout(tags).count() == 90


def test_ids(spark):
    rows = spark.createDataFrame([(f"p{k}",) for k in range(500)], "path string")
    used = spark.createDataFrame([(8 * BLOCK + 41,), (7,)], "item_id long")
    got = sorted(r.item_id for r in allocate(rows, used, 8, ["path"]).collect())
    assert got == [8 * BLOCK + 42 + k for k in range(500)]
    df = spark.createDataFrame([(3,), (8 * BLOCK + 7,), (16 * BLOCK,), (-BLOCK + 10,)], "i long")
    assert [tuple(r) for r in df.select(origin_of(F.col("i")), shown_id(F.col("i"))).collect()] == [("user", "User(3)"), ("file", "File(7)"), ("plugin", "Plg(0)"), ("builtin", "Sys(10)")]


def test_view_and_both_mappings(spark):
    e = tree(spark, {"d/a.txt": 5, "d/b.rs": 7, "x/c.rs": 9}, {"d/a.txt": [("grade", "x"), ("rank", 5), ("name", "Alpha")], "d/b.rs": [("grade", "x"), ("grade", "y")]})
    defs = [d for d in e.catalog.defs.values() if d.column and d.name != "filename_of_directory"]
    refs = spark.createDataFrame([(1, 2, "note one", "note", "text")], "item_id long, rank long, name string, item_kind string, content string")
    removed = spark.createDataFrame([(8 * BLOCK + 99, 0, "gone", 3, 4, False, 5)], "item_id long, rank long, path string, size long, mtime long, is_dir boolean, removed_file_at long")
    extra = spark.createDataFrame([(12345, "t", None, None, 1.5, None)], TAG_COLUMNS)
    view = oneview(e.catalog.items, defs, e.catalog.tags, refs, removed, ((extra, "builtin"),))
    rows = view.collect()
    by = {(e.names.get(r.item_id, r.item_id), r.type): r for r in rows}
    assert by["d/a.txt", "size"].rank == 5 and by["d/b.rs", "size"].rank == 0 and by["d/a.txt", "size"].tag == "size:5"
    assert by[1, "name"].origin == "user" and by[1, "content"].tag == "content:text" and by[1, "name"].rank == 2
    assert by[8 * BLOCK + 99, "removed_file_path"].item_kind == "file" and by[12345, "t"].item_kind == "volatile" and by[12345, "t"].tag == "t:1.5"
    named = {e.names.get(r.item_id): r.label_str for r in prefer(view, "name", "filename").collect()}
    assert named["d/a.txt"] == "Alpha" and named["d/b.rs"] == "b.rs"
    # The same queries over columns and over rows.
    other = Engine(long_catalog(e.catalog))
    for q in ("extension:rs", "size: :> 5 & is_dir:false", "extension: &: sum(size:)", "parentdir: &: extension: &: count()", "extension: &: (sum(size:) > 10)", "count(extension:)", "(size: * 2) :> 10", "grade: & extension:rs", "size: := max(size:)", "extension: -: stem:", "*:7", "extension: | grade:"):
        assert sorted(map(str, e.query(q).df.collect())) == sorted(map(str, other.query(q).df.collect())), q


def test_edits(spark):
    e = tree(spark, {"IMG_01_a.jpg": 1, "IMG_02_b.jpg": 1, "doc.txt": 1}, {"doc.txt": [("t", "old"), ("name", "N"), ("v", "7"), ("v", "x")]}, dirs=False)
    c, tags = e.catalog, e.catalog.tags
    hit = e.query("stem:IMG_*_*").df
    caps = E.captures(c.items.join(hit.select("item_id"), "item_id", "left_semi").select("item_id", F.col("stem").alias("value")), "IMG_*_*")
    tags = E.tag(tags, E.new_tags(hit, E.parse_edit('nr:{1} | mark:"x {2}"'), c, caps), c)
    got = {(e.names[r.item_id], r.type, r.label_str or r.label_int) for r in tags.collect()}
    assert {("IMG_01_a.jpg", "nr", 1), ("IMG_02_b.jpg", "mark", "x b")} <= got
    doc = e.query("stem:doc").df
    tags = E.tag(tags, E.new_tags(doc, E.parse_edit("name:New t:more"), c), c)
    assert {r.label_str for r in tags.where("type = 'name'").collect()} == {"New"} and tags.where("type = 't'").count() == 2
    tags = E.untag(tags, doc, E.parse_edit("t:o*"))
    assert [r.label_str for r in tags.where("type = 't'").collect()] == ["more"]
    with pytest.raises(QueryError, match="x"):
        E.cast_type(tags, "v", "integer")
    assert {r.label_int for r in E.cast_type(tags.where("label_str <> 'x' OR label_str IS NULL"), "v", "integer").where("type = 'v'").collect()} == {7}
    assert E.untag(tags, doc, E.parse_edit("item_id:")).join(doc, "item_id").count() == 0
    for bad in ("", "size:1", "t:", "t:{1}", "plain"):
        with pytest.raises(QueryError):
            E.new_tags(doc, E.parse_edit(bad), c).collect()
    refs = spark.createDataFrame([(1, 0, "a", "note", "x"), (2, 0, "b", "note", "y")], "item_id long, rank long, name string, item_kind string, content string")
    one = refs.where("item_id = 1")
    left, _ = E.delete_items(refs, tags, one)
    assert [r.item_id for r in left.collect()] == [2] and E.set_rank(refs, one, 9).where("rank = 9").count() == 1
    assert E.store_items(refs, one.withColumn("content", F.lit("z"))).where("content = 'z'").count() == 1


@given(st.text(alphabet="ab*?[]!-^x\\", max_size=6), st.text(alphabet="abx-^]!", max_size=4))
@settings(max_examples=300, deadline=None)
def test_globs_agree_with_sql(pattern, text):
    import re

    if pattern.endswith("\\") or "[" in pattern and ("]" not in pattern or re.search(r"\[!?\]|\[[^\]]*[-\\!]", pattern)):
        return
    want = duckdb.execute("SELECT ? GLOB ?", [text, pattern]).fetchone()[0]
    assert bool(re.match(glob_regex(pattern).replace(r"\z", r"\Z"), text)) == want


def test_scan_extract_and_definitions(spark, tmp_path):
    for name in ("a.TXT", "sub/b.rs", "sub/deep/.hidden", "skip/x"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    df = scan_tree(spark, [str(tmp_path)], [str(tmp_path / "skip")])
    rows = {os.path.relpath(r.path, tmp_path): r for r in df.collect()}
    assert set(rows) == {".", "a.TXT", "sub", "sub/b.rs", "sub/deep", "sub/deep/.hidden"}
    assert rows["a.TXT"].extension == "txt" and rows["a.TXT"].stem == "a" and rows["sub/deep/.hidden"].extension is None and rows["sub"].is_dir
    assert rows["sub/b.rs"].parentdir == str(tmp_path / "sub") and rows["sub/b.rs"].size == 8
    tags = extract(df.withColumn("item_id", F.xxhash64("path")), [TagDef("mime", extract=mimetype)])
    assert {r.label_str for r in tags.collect()} == {"text/plain", "text/x-rust", "application/octet-stream"}
    e = tree(spark, {"a.rs": 1}, {"a.rs": [("mood", "good")]}, dirs=False)
    stored = spark.createDataFrame([(5, 3, "mood", "type")], "item_id long, rank long, name string, item_kind string")
    from dataclasses import replace

    engine = Engine(replace(e.catalog, definitions=stored))
    got = {r.name: r.item_id for r in engine.query("type:*").df.collect()}
    assert got["mood"] == 5 and got["size"] is None
    assert [r.name for r in engine.query("tag:'mood:g*'").df.collect()] == ["mood:good"]
    assert engine.query("count(type:moo*)").df.head().value == 1
    assert [r.name for r in engine.query("type:s* | type:mood", n=3).df.collect()][0] in ("size", "mood")


def test_hooks(spark):
    big = TagDef("big", expand=lambda label: f"size: :> {label}")
    kind = TagDef("kind", "string", "extension", interpret=str.lower, implies="is_dir:false")
    e = tree(spark, {"d/a.rs": 5, "d/b.txt": 50}, defs=(big, kind))
    assert names(e, "big:10") == {"d/b.txt"} and names(e, "kind:RS") == {"d/a.rs"}


def test_cache_and_watch(spark, tmp_path):
    e = tree(spark, {"a.rs": 1, "b.rs": 2}, dirs=False)
    cache = ResultCache(spark, f"file://{tmp_path}/cache", cap=1)
    assert cache.get(e, "extension:rs").count() == 2
    assert cache.get(None, "extension:rs").count() == 2  # from the store
    assert cache.get(e, "extension: &: sum(size:)").head().nvalue == 3
    assert len(os.listdir(tmp_path / "cache")) == 1
    cache.clear()
    scans, table = f"file://{tmp_path}/scans", f"file://{tmp_path}/files"
    one = scan(spark, [("r/a", "f1", 1, 1), ("r/b", "f2", 2, 1)])
    one.coalesce(1).write.mode("append").parquet(scans)
    gone = f"file://{tmp_path}/gone"
    run = lambda: watch(spark, scans, SCAN, table, FILES, f"file://{tmp_path}/cp", gone).awaitTermination(120)
    now = lambda: {r.path: (r.item_id, r.size) for r in spark.read.parquet(current(spark, table)).collect()}
    assert run()
    first = now()
    scan(spark, [("r/b", "f2", 9, 3), ("r/c", "f3", 3, 3)]).coalesce(1).write.mode("append").parquet(scans)
    assert run()
    second = now()
    assert set(second) == {"r/b", "r/c"} and second["r/b"] == (first["r/b"][0], 9)
    # The id of a deleted file is not given to another one, and it comes back with the file.
    assert second["r/c"][0] not in {i for i, _ in first.values()}
    scan(spark, [("r/b", "f2", 9, 3), ("r/a", "f1", 1, 1), ("r/d", "f4", 4, 4)]).coalesce(1).write.mode("append").parquet(scans)
    assert run()
    third = now()
    assert third["r/a"] == first["r/a"] and third["r/d"][0] not in {i for i, _ in (*first.values(), *second.values())}
    assert [r.path for r in spark.read.parquet(current(spark, gone)).collect()] == ["r/c"]


def test_hard_links_share_no_id(spark):
    files = scan(spark, [("c/x", "f1", 5, 1)]).withColumn("item_id", F.lit(8 * BLOCK).cast("long")).withColumn("rank", F.lit(0).cast("long"))
    now = scan(spark, [("a/x", "f1", 5, 1), ("b/x", "f1", 5, 1)])
    d = I.diff(now, files)
    after = {r.path: r.item_id for r in I.apply(files, d).collect()}
    assert after["a/x"] == 8 * BLOCK and len(set(after.values())) == 2 and d.deleted.count() == 0


def test_scans_leave_out_what_is_ignored(spark, tmp_path):
    root = tmp_path / "repo"
    for name in ("a.rs", "a.log", "keep.log", "build/x.o", "sub/build/y.o", "sub/a.log", "sub/deep/z.tmp", "sub/deep/z.rs", ".hidden", "top/only.txt", "sub/only.txt", "doc/a/b.pdf"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)
    (root / ".gitignore").write_text("# logs\n*.log\n!keep.log\nbuild/\n/top/*.txt\ndoc/**/*.pdf\n")
    (root / "sub/.gitignore").write_text("*.[to]mp\n")
    seen = lambda at: {r.path[len(str(root)) + 1 :] for r in scan_tree(spark, [str(at)]).where("NOT is_dir").collect()}
    outside = seen(root)
    assert {"a.log", "build/x.o", "top/only.txt"} <= outside  # not a repository: these files have no meaning
    (root / ".git").mkdir()
    assert seen(root) == {"a.rs", "keep.log", "sub/deep/z.rs", ".hidden", "sub/only.txt", ".gitignore", "sub/.gitignore"}
    assert seen(root / "sub") == {"sub/deep/z.rs", "sub/only.txt", "sub/.gitignore"}  # rules from above hold, too
    (root / "sub/.ignore").write_text("only.*\n")
    assert "sub/only.txt" not in seen(root)
    many = tmp_path / "many"
    for k in range(100):
        (many / f"d{k}/e").mkdir(parents=True)
        (many / f"d{k}/e/f").write_text("x")
    df = scan_tree(spark, [str(many)])
    assert df.rdd.getNumPartitions() > 64 and df.count() == 301


def test_display():
    assert [display.size(n) for n in (0, 1023, 1024, 1536, 5 << 30)] == ["0B", "1023B", "1.00KB", "1.50KB", "5.00GB"]
    assert display.value(None) == "NULL" and display.value(3.0) == "3" and display.value(0, TagDef("t", "integer", date=True), "iso") == "1970-01-01T00:00:00Z"
    assert display.table([{"a": 1, "b": "xx"}], ["a", "b"]) == "a  b\n1  xx"


def test_labels_read_from_files(spark, tmp_path):
    for name, text in (("a.txt", "\nfirst\nsecond\n"), ("b.txt", ""), ("c.txt", "only")):
        (tmp_path / name).write_text(text)
    files = scan_tree(spark, [str(tmp_path)]).withColumn("item_id", F.monotonically_increasing_id())
    lost = files.where("filename = 'c.txt'").withColumn("path", F.lit("/no/such/file"))
    rows = extract(files.unionByName(lost), [TagDef("line", extract=of_file(lambda p: open(p).read().split("\n"))), TagDef("length", "integer", extract=of_file(lambda p: len(open(p).read()), "integer"))])
    got = sorted((r.type, r.label_str or r.label_int or 0) for r in rows.collect())
    assert got == [("length", 0), ("length", 4), ("length", 14), ("line", "first"), ("line", "only")]
