import re
from html import unescape

import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st

from tagloom.llm import html_text as h


def page(k, body, more=""):
    return f'<!DOCTYPE html><html><head><title>T{k}</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header><h2>Site</h2></header><nav><ul><li><a href="/x">Home</a></li></ul></nav><div class="ad">Buy {k}</div>{body}<aside>side {k}</aside><div id="comments"><p>nice {k}</p></div><form><label>Mail</label><input value=1></form>{more}<footer>&copy; us</footer></body></html>'


def test_article_only():
    group = [page(k, f"<article><h1>Head {k}</h1><p><b>One &amp; two<br>three  <i>{k}</i><p>Last &lt;p&gt; line<ul><li>a</li><li>b</li></ul></article>") for k in range(5)]
    want = [f"Head {k}\n\nOne & two three {k}\n\nLast <p> line\n\na\n\nb" for k in range(5)]
    assert h.extract(group) == want
    assert [h.extract([x])[0] for x in group] == want
    assert h.extract([group[0]] * 4) == [want[0]] * 4


def test_template_drops_repeated_slots_without_an_article():
    group = [page(k, f'<div class="c1"><p>Words of page {k} and {"more " * k}</p></div><div class="c2"><p>All about this site</p></div>') for k in range(6)]
    assert h.extract(group) == [f"Words of page {k} and {'more ' * k}".strip() for k in range(6)]


def test_classes_nest_and_must_keep_order():
    pages = ["<a> x <l> 1 </l> <l> 2 </l> </a>".split(), "<a> y <l> 3 </l> </a>".split(), "<a> z z <l> 4 </l> <l> 6 </l> <l> 5 </l> </a>".split()]
    root = h.template(pages)
    assert root.tokens == ["<a>", "</a>"]
    assert [c.tokens for c in root.nested[1]] == [["<l>", "</l>"]]
    assert h.template([["<a>", "w", "</a>"], ["<a>", "</a>", "w"]]).tokens in (["<a>", "</a>"], ["<a>", "w"])


@given(st.text(alphabet="<>/!-pabdiv\"'= &;scriptxe", max_size=80))
@settings(max_examples=300, deadline=None)
def test_any_markup(html):
    h.extract([html, html + "x", html + "<p>y"])


def test_given_pages_against_a_plain_reading(spark):
    path = "/root/testdata/sf0.001/pages.parquet"
    rows = pq.read_table(path).to_pylist()
    got = {r.page_id: r for r in h.op9_html_text(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows)
    for r in rows:
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>|<br>", lambda m: " " if m[0] == "<br>" else "", body))
        want = "\n\n".join(x for x in (" ".join(unescape(p).split()) for p in parts) if x)
        assert got[r["page_id"]].text == want and got[r["page_id"]].n_chars == len(want)


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None, "<p>a", 1), (2, "http://h/x", None, 1), (2, "http://h/x", None, 1), (3, "http://h/y", "", 1), (None, "h", "<b>x" * 20000, 1)], "page_id long, url string, html string, text int")
    assert sorted((r.page_id or 0, r.text[:3], r.n_chars) for r in h.main_texts(df).collect()) == [(0, "xxx", 20000), (1, "a", 1), (2, "", 0), (2, "", 0), (3, "", 0)]
    assert h.main_texts(df.limit(0)).count() == 0


def story(k, more=""):
    return f"<article><h1>Head {k}</h1><p>Words {k} of {k * 7}</p><p>More of {k}</p>{'<p>Long</p>' * (k % 3)}<div class='z9'>Write to us at any time</div><p>End {k}</p>{more}</article>"


def test_repeated_slots_in_an_article():
    got = h.extract([page(k, story(k)) for k in range(5)])
    assert not any("Write to us" in x for x in got)
    assert got[1] == "Head 1\n\nWords 1 of 7\n\nMore of 1\n\nLong\n\nEnd 1"


def test_repeated_records_of_a_nested_class():
    body = lambda k: "".join(f"<li>{x}</li>" for x in [f"one {k}", *["and"] * (k % 2), "Order our paper", *(f"two {k} {j}" for j in range(k))])
    group = [f"<html><body><main><h1>Head {k}</h1><ul>{body(k)}</ul></main></body></html>" for k in range(5)]
    assert h.template([h.runs_of(h.events(x))[0] for x in group]).nested[6][0].tokens == ["<li >", "</li >"]
    got = h.extract(group)
    assert got[2] == "Head 2\n\none 2\n\ntwo 2 0\n\ntwo 2 1" and "and" in got[1]


def test_odd_pages_do_not_undo_the_template():
    group = [page(k, f'<div class="c1"><p>Words of page {k} and {"more " * k}</p></div><div class="c2"><p>All about this site</p></div>') for k in range(6)]
    want = h.extract(group)
    assert not any("All about" in x for x in want)
    odd = ["", "<html><body><h1>Not found</h1></body></html>", "<table><tr><td>Old layout</table>"]
    for more in ([odd[0]], odd[1:2], odd):
        got = h.extract([*group[:3], *more, *group[3:]])
        assert got[:3] + got[3 + len(more) :] == want
    assert h.extract([*group, *odd])[-3:] == ["", "Not found", "Old layout"]


def test_every_page_of_a_host_has_one_template(spark):
    text = lambda k: f"Words of page {k} and{' more' * (k % 7)}"
    html = lambda k: f'<html><body><div class="c1"><p>{text(k)}</p></div><div class="c2"><p>All about this site</p></div></body></html>'
    rows = [(k, f"http://h/{k}", html(k)) for k in range(49)] + [(100, "http://h/x", None), (101, "http://h/y", "<p>Not found"), (200, "http://other/", html(0)), (300, None, html(1))]
    for parts in (1, 7, 211):
        df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
        got = {r.page_id: r.text for r in h.main_texts(df).collect()}
        assert len(got) == len(rows) and [got[k] for k in range(49)] == [text(k) for k in range(49)]
        assert (got[100], got[101], got[200]) == ("", "Not found", text(0) + "\n\nAll about this site")
        assert list(got.values()).count("Not found") == 1 and got == dict(zip([r[0] for r in rows], h.extract([r[2] or "" for r in rows[:51]]) + h.extract([rows[51][2]]) + h.extract([rows[52][2]]), strict=True))


def test_words_of_class_names_inside_an_article():
    inside = "<article><h1>Market</h1><div class='share-of-market'><p>share prices rose</p></div><div class='social-share-box'>Share this</div><p hidden>kept</p><p style='display:none'>kept, too</p><div class='ad'>Buy</div><ul id='comments-list'><li>nice</li></ul><p class='formal'>End</p></article>"
    assert h.extract([f"<html><body><div class='share-of-market'>Outside</div>{inside}</body></html>"]) == ["Market\n\nshare prices rose\n\nkept\n\nkept, too\n\nEnd"]


def test_meaningless_class_names_and_no_semantic_tags():
    """Only what varies tells the article from the rest; every page is like a brute-force reading of what stands on all pages."""
    bodies = [[f"Title {k}", *[f"Line {k} {j} of the story" for j in range(1 + k % 4)]] for k in range(9)]
    menu, foot = ["Home", "News", "All topics"], ["Imprint", "Made by us"]
    html = ["<html><body><div class='x1'>" + "".join(f"<div class='q'>{m}</div>" for m in menu) + f"</div><div class='x2'><div class='t'>{b[0]}</div>" + "".join(f"<div class='u'>{x}</div>" for x in b[1:]) + "</div><div class='x3'>" + "".join(f"<div class='v'>{x}</div>" for x in foot) + "</div></body></html>" for b in bodies]
    everywhere = set.intersection(*(set(re.findall(r">([^<>]+)<", x)) for x in html))
    assert everywhere == {*menu, *foot}
    assert h.extract(html) == ["\n\n".join(x for x in re.findall(r">([^<>]+)<", page) if x not in everywhere) for page in html]
