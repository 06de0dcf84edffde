"""End-to-end cases over small file trees."""

from datetime import UTC, datetime

import pytest

from tagloom.functions import display
from tagloom.plans.catalog import TagDef
from tagloom.plans.syntax import QueryError

from .helpers import groups, names, number, tree, value


def at(*x):
    return int(datetime(*x, tzinfo=UTC).timestamp())


#: A choir's archive: scores, recordings and lists, in folders by concert.
ARCHIVE = {"advent/alto.ogg": 310, "advent/bass.ogg": 290, "advent/score.pdf": 45, "easter/alto.ogg": 120, "easter/score.pdf": 60, "easter/seats.csv": 4, "hall/plan.pdf": 80}


def test_counts_by_folder(spark):
    e = tree(spark, ARCHIVE)
    assert groups(e, "parentdir: &: count(extension:ogg)") == {"advent": 2, "easter": 1}  # no group without one
    assert groups(e, "parentdir: &: count(extension:)") == {"advent": 2, "easter": 3, "hall": 1}  # distinct labels
    flat = tree(spark, ARCHIVE, dirs=False)
    assert value(flat, "sum(parentdir: &: count())") == len(ARCHIVE)
    mixed = groups(flat, "(parentdir: &: count()) + (extension: &: count())")
    assert mixed == {("advent", "ogg"): 6, ("advent", "pdf"): 6, ("easter", "ogg"): 6, ("easter", "pdf"): 6, ("easter", "csv"): 4, ("hall", "pdf"): 4}


def test_aggregates_by_group(spark):
    e = tree(spark, ARCHIVE)
    for fn, want in (("sum", 645), ("avg", 215), ("max", 310), ("min", 45)):
        assert groups(e, f"parentdir: &: {fn}(size:)")["advent"] == want
    assert groups(e, "extension: &: sum(size:)") == {"ogg": 720, "pdf": 185, "csv": 4}
    assert names(e, "extension: &: (sum(size:) < 200)") == {"advent/score.pdf", "easter/score.pdf", "hall/plan.pdf", "easter/seats.csv"}
    assert groups(e, "stem:alto & parentdir: &: sum(size:)") == {"advent": 310, "easter": 120}
    assert display.value(5632.0, TagDef("size", size=True)) == "5.50KB"


def test_levels(spark):
    e = tree(spark, ARCHIVE)
    assert groups(e, "parentdir: &: extension: &: sum(size:)") == {("advent", "ogg"): 600, ("advent", "pdf"): 45, ("easter", "ogg"): 120, ("easter", "pdf"): 60, ("easter", "csv"): 4, ("hall", "pdf"): 80}
    assert names(e, "parentdir: &: extension: &: (sum(size:) > 70)") == {"advent/alto.ogg", "advent/bass.ogg", "easter/alto.ogg", "hall/plan.pdf"}
    assert groups(e, "parentdir: &: extension: &: sum(size: :> 300 & size:)") == {("advent", "ogg"): 310}
    assert groups(tree(spark, ARCHIVE, dirs=False), "sum(parentdir: &: size:)") == {"advent": 645, "easter": 184, "hall": 80}
    assert value(e, "sum(sum(parentdir: &: extension: &: size:))") == sum(ARCHIVE.values())


def test_aggregates_over_groups(spark):
    e = tree(spark, ARCHIVE)
    assert value(e, "count(parentdir: &: (count(extension:ogg) > 1))") == 1
    assert value(e, "sum(extension: &: (count(extension:pdf) > 2))") == 3
    assert value(e, "50 - count(parentdir: &: (sum(size:) > 150))") == 48
    share = "((parentdir: &: count(extension:ogg)) / (parentdir: &: count())) :>= 0.5"
    assert {x.split("/")[0] for x in names(tree(spark, ARCHIVE, dirs=False), share)} == {"advent"}


def test_item_arithmetic(spark):
    seats = {"hall/plan.pdf": [("rows", 12), ("chairs", 9)], "easter/score.pdf": [("rows", 4), ("chairs", 27)], "easter/seats.csv": [("rows", 3), ("chairs", 8)]}
    e = tree(spark, ARCHIVE, seats, defs=(number("rows"), number("chairs")))
    assert groups(e, "parentdir: &: (rows: * chairs:)", "item_count") == {("hall", 108.0): 1, ("easter", 108.0): 1, ("easter", 24.0): 1}
    assert value(e, "sum(rows: * chairs:)") == 240 and value(e, "max(chairs: - rows:)") == 23
    e = tree(spark, ARCHIVE, dirs=False)
    assert names(e, "(size: + 10) :> 300") == {"advent/alto.ogg"}
    assert names(e, "60 :< size: :<= 120") == {"easter/alto.ogg", "hall/plan.pdf"}


def test_label_sets(spark):
    def people(**tags):
        return tree(spark, dict.fromkeys(tags, 1), {k: list(v) for k, v in tags.items()}, dirs=False)

    e = people(ida=[("sings", "bass"), ("plays", "viola")], jon=[("sings", "viola")], kim=[("plays", "harp")])
    assert groups(e, "sings: & plays:", "item_count") == {"viola": 2}  # all who carry the common label
    assert groups(e, "sings: | plays:", "item_count") == {"bass": 1, "viola": 2, "harp": 1}
    assert groups(e, "plays: -: sings:", "item_count") == {"harp": 1}
    e = people(ida=[("town", "Ulm"), ("voice", "1"), ("year", "90")], jon=[("town", "Ulm"), ("voice", "2")], kim=[("town", "Bonn"), ("year", "91")])
    assert groups(e, "(town: &: voice:) & (town: &: year:)", "item_count") == {"Ulm": 2}
    assert names(e, "(town: &: voice:) | (town: &: year:)") == {"ida", "jon", "kim"}
    assert groups(e, "(town: &: voice:) -: year:", "item_count") == {("Ulm", "2"): 1}
    assert groups(tree(spark, ARCHIVE, dirs=False), "extension: & size:", "item_count") == {}  # no text is a number
    e = tree(spark, {"ida": 1, "jon": 1}, {"ida": [("row", "7")], "jon": [("seat", 7)]}, dirs=False, defs=(number("seat"),))
    assert groups(e, "row: & seat:", "item_count") == {}


def test_counts_and_text_sums(spark):
    e = tree(spark, ARCHIVE, dirs=False)
    assert value(e, "count(extension:)") == 3 and value(e, "count(extension:pdf)") == 3
    assert value(e, "sum(stem:)") == "alto, alto, bass, plan, score, score, seats"
    assert value(e, "avg(nobody) == avg(nobody)") is None and value(e, "max(nobody)") is None and value(e, "count(nobody)") == 0
    assert value(e, "count() - 3") == 4 and value(e, "4 + 5") == 9 and value(e, "(11 / 4) == 2") is True


@pytest.mark.parametrize(("query", "want"), [
    ("size: :>= 3KB", "cde"), ("size: :< 2MB & size: :> 0B", "bcd"), ("size: := 3KiB", "c"), ("size: :<= 2.5MB", "abcde"), ("size: :> 2.25MiB", "e"), ("size: :> 700KB & size: :< 40MB", "de"), ("size: :^= 0B", "bcde"),
    ("size: := 1m", "d"), ("size: := 3k", "c"), ('size: :< "1MB"', "abc"), ("size:*.5MB", "e"), ("size:2.*MB", "e"), ("size:>1GB", ""), ("size:700", "b"),
])
def test_sizes(spark, query, want):
    e = tree(spark, {"a": 0, "b": 700, "c": 3 << 10, "d": 1 << 20, "e": 5 << 19}, dirs=False)
    assert names(e, query) == set(want)


def test_dates(spark):
    e = tree(spark, {"leap": 1, "plain": 1, "late": 1}, mtimes={"leap": at(2020, 2, 29, 6), "plain": at(2023, 2, 28, 18, 45), "late": at(2024, 4, 30, 6, 15)}, dirs=False)
    assert names(e, "mtime:*-02-*") == {"leap", "plain"} and names(e, "mtime:*-02-29") == {"leap"}
    assert names(e, "mtime:2023") == {"plain"} and names(e, "mtime: :> 2023-02") == {"late"}
    assert names(e, "mtime: :^ 2023-02-28") == {"leap", "late"}
    assert names(e, 'mtime:"06:*"') == {"leap", "late"} and names(e, "mtime: :< *-04-*") == {"leap", "plain"}
    assert names(e, 'mtime: :>= "60d ago"') == {"late"}
    with pytest.raises(QueryError):
        names(e, "mtime:2023-02-29")
    with pytest.raises(QueryError):
        names(e, "size:heavy")


def test_typed_values(spark):
    e = tree(spark, dict.fromkeys(("whole", "text", "real", "low", "half"), 1), {"whole": [("mark", 7)], "text": [("mark", "7")], "real": [("mark", 7.0)], "low": [("tempo", 2)], "half": [("tempo", 2.5)]}, dirs=False)
    assert names(e, "mark: := 7") == {"whole"} and names(e, 'mark: := "7"') == {"text"} and names(e, "mark: := 7.0") == {"real"}
    assert names(e, "tempo: :> 1") == {"low", "half"} and names(e, "tempo: :> 2") == {"half"}
    assert names(e, "mark:*") == {"whole", "text", "real"} and names(e, "mark: :^ *") == set()
    assert names(e, "m*:7 | tempo:2") == {"whole", "low"} and names(e, "*:7") == {"whole"}
    with pytest.raises(QueryError):
        names(e, "mark: :> a*")


def test_boolean_search(spark):
    e = tree(spark, {"docs/report.pdf": 5, "docs/notes.txt": 3, "src/main.rs": 7, "src/lib.rs": 9, "src/a[1].txt": 2, "img/cat.PNG": 4, "img/dog.jpg": 4})
    for query, n in (("extension:rs", 2), ("extension:.RS", 2), ("extension:rs | extension:txt", 4), ("parentdir:src - extension:rs", 1), ("is_dir:true", 3), ("is_dir:*", 10), ("is_dir:t*", 3), ("is_dir: :^ true", 7), ("directory:src", 1), ("directory:*", 3), ("filename:*.txt", 2), ("filename:?og.jpg", 1), ("filename:[nr]*", 2), ("filename:[!nr]*", 5), ("filename:a\\[1\\].txt", 1), ("stem:a & stem:b", 0), ("extension:png", 1), ("(extension:rs | extension:txt) & parentdir:src", 3), ("size:>4 & is_dir:false", 3), ("path:src/*", 3), ("item_kind:file", 10), ("extension: :^ rs & is_dir:false", 5)):
        assert len(names(e, query)) == n, query


def test_eval(spark):
    e = tree(spark, {"a.rs": 1, "b.rs": 1, "c.txt": 1}, {"a.rs": [("project", "x")], "b.rs": [("project", "y")], "c.txt": [("project", "x")]}, dirs=False)
    assert names(e, "q(project:x) & extension:rs") == {"a.rs"}
    assert names(e, "q(project:) & extension:rs") == {"a.rs", "b.rs"}
    assert names(e, "q(extension:none) & extension:rs") == set()
    assert names(e, "size: :<= max(size:)") == {"a.rs", "b.rs", "c.txt"}


def test_groups_by_pattern_and_members(spark):
    e = tree(spark, {"IMG_1.jpg": 1, "IMG_2.jpg": 1, "doc.txt": 1}, dirs=False)
    assert groups(e, "filename:*_: &: count()") == {"IMG_": 2}
    (row,) = [r for r in e.query("extension:", members=True).df.collect() if r.key0 == "jpg"]
    assert [e.names[i] for i in row.members] == ["IMG_2.jpg", "IMG_1.jpg"]
    with pytest.raises(QueryError):
        e.query("size:1*: &: count()").df.collect()


def test_multi_valued_tags(spark):
    e = tree(spark, {"a": 10, "b": 20}, {"a": [("t", "x"), ("t", "y"), ("v", 1), ("v", 5)], "b": [("t", "y"), ("v", 2)]}, dirs=False, defs=(number("v"),))
    assert groups(e, "t:", "item_count") == {"x": 1, "y": 2}
    assert groups(e, "t: &: sum(size:)") == {"x": 10, "y": 30}
    assert groups(e, "t: &: sum(v:)") == {"x": 1, "y": 3}
    assert groups(e, "t: &: extension:", "item_count") == {}
    assert value(e, "count(t:)") == 2 and value(e, "sum(v:)") == 3
    assert names(e, "(v: * 2) :>= 10") == {"a"}


@pytest.mark.parametrize("query", ["count(count())", "sum(count())", "count() & extension:rs", "size: > 100", "extension:rs &extension:txt", "(1 + 2) &: count()", "size: + extension:", "sum()", "(a:1", "a:1 |", "extension: &: count() &: size:", "1 / 0", "extension: :> r*"])
def test_errors(spark, query):
    e = tree(spark, {"a.rs": 1}, dirs=False)
    with pytest.raises(QueryError):
        e.query(query).df.collect()


def test_order_and_pages(spark):
    e = tree(spark, {"a.rs": 3, "b.rs": 1, "c.rs": 2}, dirs=False)
    rows, more = e.page("extension:rs", 2, order=(("size", False),))
    assert [e.names[r.item_id] for r in rows] == ["b.rs", "c.rs"] and more
    rows, more = e.page("extension:rs", 2, 2)
    assert [e.names[r.item_id] for r in rows] == ["a.rs"] and not more
