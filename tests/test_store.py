import os

import pytest
from pyspark.sql import functions as F

from tagloom.__main__ import main
from tagloom.plans.catalog import TagDef
from tagloom.plans.syntax import QueryError
from tagloom.sources.files import mimetype
from tagloom.store import Store


def test_a_life_of_a_store(spark, tmp_path, capsys):
    root = tmp_path / "files"
    for name in ("IMG_1.jpg", "IMG_2.jpg", "sub/doc.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)
    s = Store(spark, f"file://{tmp_path}/store", (TagDef("mime", extract=mimetype),))
    assert s.index([str(root)])["new"] == 5
    found = lambda q: {os.path.basename(r.path or "") for r in s.catalog().items.join(s.search(q, 0).df.select("item_id"), "item_id").collect()}
    assert found("extension:jpg") == {"IMG_1.jpg", "IMG_2.jpg"} and found("name:doc.txt") == {"doc.txt"} and found("mime:text/plain") == {"doc.txt"}
    s.tag("stem:IMG_*", "nr:{1} kind:photo")
    assert found("nr:2") == {"IMG_2.jpg"} and found("kind:photo & nr: :< 2") == {"IMG_1.jpg"}
    s.tag("stem:IMG_* & extension:?pg", "both:{2}-{1}")  # wildcards are numbered through all patterns
    assert found("both:j-2") == {"IMG_2.jpg"}
    s.untag("both:*", "both:")
    s.tag("stem:doc", "name:Paper rank:9 nr:x")
    assert found("name:Paper") == {"doc.txt"} and found("name:doc.txt") == set()
    assert s.search("*:*", 1).df.head().rank == 9
    with pytest.raises(QueryError, match="x"):
        s.set_type("nr", "integer")
    s.untag("stem:doc", "nr:")
    s.set_type("nr", "integer")
    assert s.search("sum(nr:)").df.head().value == 3
    note = s.note("todo", "buy milk")
    assert note == 0 and [r.item_id for r in s.search("content:*milk*").df.collect()] == [0]
    s.tag("type:kind", "about:pictures")
    assert [r.name for r in s.search("type:kin*").df.collect()] == ["kind"]
    s.untag("item_kind:note", "item_id:")
    assert s.search("content:*milk*").df.count() == 0
    # A tagged file that goes is remembered, and comes back as itself.
    text, when = (root / "IMG_2.jpg").read_text(), os.stat(root / "IMG_2.jpg").st_mtime
    os.remove(root / "IMG_2.jpg")
    (root / "sub/doc.txt").rename(root / "doc.txt")
    assert {k: v for k, v in s.index([str(root)]).items() if k in ("moved", "deleted")} == {"moved": 1, "deleted": 1}
    assert s.search("removed_file:true").df.count() == 1 and found("name:Paper") == {"doc.txt"}
    (root / "IMG_2.jpg").write_text(text)
    os.utime(root / "IMG_2.jpg", (when, when))
    assert s.index([str(root)])["returned"] == 1
    assert found("nr:2") == {"IMG_2.jpg"} and s.search("removed_file:true").df.count() == 0
    assert main(["--store", s.folder, "search", "extension:jpg", "-n", "1"], spark) == 0
    assert "there is more" in capsys.readouterr().out
    assert main(["--store", s.folder, "search", "size: > 1"], spark) == 1
    assert main(["--store", s.folder, "index", str(root), "--dry-run"], spark) == 0


def test_pages_come_from_the_kept_result(spark, tmp_path):
    root = tmp_path / "files"
    root.mkdir()
    for k in range(9):
        (root / f"f{k}.txt").write_text("x" * (k + 1) * 600)
    s = Store(spark, f"file://{tmp_path}/store")
    s.index([str(root)])
    sizes = lambda offset: [r["item_id"] for r in s.search("extension:txt", 4, offset, (("size", True),)).df.collect()]
    every = sizes(0) + sizes(4) + sizes(8)
    by = {r.item_id: r.size for r in s.read("files").collect()}
    assert [by[i] for i in every] == sorted((by[i] for i in every), reverse=True) and len(every) == 9
    assert len(os.listdir(tmp_path / "store/cache")) == 1
    s.tag("stem:f1", "a:b")  # a change clears what is kept
    assert not (tmp_path / "store/cache").exists()
    found = s.search("extension: &: sum(size:)", 5)
    assert s.shown(found, found.df.collect(), found.df.columns, "groups") == "txt: 26.37KB (9)"
    assert s.shown(found, found.df.collect(), found.df.columns, "groups", "raw") == "txt: 27000 (9)"
    assert s.shown(found, found.df.collect(), found.df.columns, "short") == "txt"
    found = s.search("stem:f[12]", 5)
    assert sorted(s.shown(found, found.df.collect(), found.df.columns, "short").split("\n")) == [str(root / "f1.txt"), str(root / "f2.txt")]


def test_labels_of_paths_move_files(spark, tmp_path):
    root = tmp_path / "files"
    (root / "old").mkdir(parents=True)
    for name in ("a.txt", "b.txt", "c.md"):
        (root / "old" / name).write_text(name)
    os.link(root / "old/c.md", root / "old/d.md")
    s = Store(spark, f"file://{tmp_path}/store")
    s.index([str(root)])
    listed = lambda at: sorted(os.listdir(root / at))
    before = {r.path: r.item_id for r in s.read("files").collect()}
    plan = s.tag("extension:txt", f'parentdir:"{root}/new"', dry=True)
    assert {r["target"] for r in plan} == {str(root / "new/a.txt"), str(root / "new/b.txt")} and not (root / "new").exists()
    s.tag("extension:txt", f'parentdir:"{root}/new"')
    after = {r.path: r.item_id for r in s.read("files").collect()}
    assert listed("new") == ["a.txt", "b.txt"] and after[str(root / "new/a.txt")] == before[str(root / "old/a.txt")]
    assert s.index([str(root)])["moved"] == 0  # the stored files know
    with pytest.raises(QueryError, match="several files"):
        s.tag("extension:txt", "stem:same")
    s.tag("extension:txt", "stem:same", conflict="skip")
    assert listed("new") in (["a.txt", "same.txt"], ["b.txt", "same.txt"])  # the first by id has moved
    s.tag("extension:txt", "stem:same", conflict="serial")
    assert listed("new") == ["same.txt", "same_1.txt"]
    with pytest.raises(QueryError, match="hard links"):
        s.tag("stem:c", "stem:e")
    s.tag("stem:c", "stem:e", hardlink="all")
    assert listed("old") == ["d.md", "e.md"]
    with pytest.raises(QueryError, match="several targets"):
        s.tag("stem:e", "stem:f stem:g", hardlink="all")
    s.tag("stem:e", "stem:f stem:g", conflict="first", hardlink="all")
    assert listed("old") == ["d.md", "f.md"]
    s.tag("stem:same", "mtime:1000")
    assert os.stat(root / "new/same.txt").st_mtime == 1000 and s.read("files").where("mtime = 1000").count() == 1
    n = s.note("todo", "one")
    s.tag("name:todo", "content:two")
    assert s.search("content:two").df.head().item_id == n and s.search("content:one").df.count() == 0


def test_hooks_of_a_type(spark, tmp_path):
    root = tmp_path / "files"
    root.mkdir()
    for name in ("a.txt", "bb.txt", "ccc.md"):
        (root / name).write_text(name * 300)
    letters = lambda values, pattern: values.where(F.length("value") == len(pattern)).select("item_id", F.split("value", "").alias("captures"))
    title = TagDef("title", "string", read="stem", capture=letters)
    big = TagDef("big", rewrite=lambda op, text: f"size: :{op} {text}KB" if text.isdigit() else None)
    s = Store(spark, f"file://{tmp_path}/store", (title, big))
    s.index([str(root)])
    found = lambda q: {os.path.basename(r.path) for r in s.catalog().items.join(s.search(q, 0).df.select("item_id"), "item_id").collect()}
    assert found("big: :> 1") == {"a.txt", "bb.txt", "ccc.md"} - {p for p in ("a.txt", "bb.txt", "ccc.md") if len(p) * 300 <= 1024}
    s.tag("stem:a", "title:Alpha")
    assert found("title:Alpha") == {"a.txt"} and found("title:bb") == {"bb.txt"} and found("title:a") == set()
    s.tag("title:??", "first:{1} last:{2}")
    assert found("first:b & last:b") == {"bb.txt"}
