import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tagloom.llm import decontaminate as d


@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=12), min_size=1, max_size=8), st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=4), min_size=1, max_size=8))
@settings(deadline=None)
def test_fm_index_finds_every_occurrence(runs, phrases):
    text = np.array([x for r in runs for x in [*r, 0]])
    assert d.suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: ([(x > 0, x) if x else (False, i + k) for k, x in enumerate(text[i:].tolist())]))
    lengths = np.array([len(p) for p in phrases])
    index = d.FMIndex(text, step=3)
    low, high = index.search(np.concatenate(phrases), np.cumsum(lengths) - lengths, lengths)
    for k, p in enumerate(phrases):
        want = [i for i in range(len(text) - len(p) + 1) if text[i : i + len(p)].tolist() == p]
        assert sorted(index.locate(np.arange(low[k], high[k])).tolist()) == want


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            q = words(t)
            for p in [q[i : i + 13] for i in range(max(1, len(q) - 12))] if q else []:
                for i in range(len(w) - len(p) + 1):
                    if w[i : i + len(p)] == p:
                        hit |= set(range(i, i + len(p)))
                        found.add(str(item))
        out.append((doc_id, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    vocab = ["a", "b", "é", "x1", "to"]
    some = lambda n: " ".join(rng.choice(vocab, n))
    items = [(k, some(20)) for k in range(4)] + [(9, "Short One"), (9, "to be or"), (10, None), (11, " ,"), (12, "only")]
    items.append((13, items[0][1]))
    docs = [(k, some(40) + " zz " + items[k % 4][1][: 5 * k] + ". SHORT, one!" * (k % 2) + some(200)) for k in range(12)]
    docs += [(50, None), (51, ""), (52, items[1][1]), (52, items[1][1]), (53, "q " * 5000 + "only"), (None, "short one"), (54, "to to be-or"), (55, "to"), (56, "be or")]
    df = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, __x int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1_000_000, 10):
        got = d.contaminated(df, bench, block).collect()
        assert sorted(((r.doc_id, r["__n_words"], r["__n_hit"], list(r["__items"]), r["__contaminated"]) for r in got), key=str) == brute(docs, items)
    assert len(list(d.phrase_blocks(bench, 10))) > 2
    assert d.contaminated(df, bench.limit(0)).where("__contaminated").count() == 0
    assert d.drop_contaminated(df.limit(0), bench).count() == 0


def test_items_without_an_id_count_as_hits(spark):
    docs = spark.createDataFrame([(1, "some words of a passage"), (2, "short one here"), (3, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "of a passage"), (None, None), (7, "Short one"), (None, "short one here")], "item_id long, text string")
    for block in (1_000_000, 2):
        got = {r.doc_id: (r["__n_hit"], list(r["__items"]), r["__contaminated"]) for r in d.contaminated(docs, bench, block).collect()}
        assert got == {1: (3, [], True), 2: (3, ["7"], True), 3: (0, [], False)}
    assert [r.doc_id for r in d.drop_contaminated(docs, bench).collect()] == [3]


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "some words of a passage", 5, "s", 7, "i"), (2, "clean", 6, "t", 8, None)], "doc_id long, text string, __n_hit int, __spans string, c0 int, __items string")
    bench = spark.createDataFrame([(1, "of a passage")], "item_id long, text string")
    assert [tuple(r) for r in d.drop_contaminated(docs, bench).collect()] == [(2, "clean", 6, "t", 8, None)]
    got = d.contaminated(docs, bench)
    assert got.columns[:6] == docs.columns
    assert {(r["__n_hit"], r["__n_hit_"], tuple(r["__items_"])) for r in got.collect()} == {(5, 3, ("1",)), (6, 0, ())}


def test_shards_of_one_text_and_of_many(spark, monkeypatch):
    rng = np.random.default_rng(2)
    docs = [(k, " ".join(rng.choice(["a", "b", "c"], int(rng.integers(0, 60))))) for k in range(40)]
    items = [(1, docs[3][1]), (2, "a b c a"), (3, "c")]
    phrases = d.Phrases([(str(k), t) for k, t in items])
    want = {(k, n, h, tuple(i)) for k, n, h, i, _ in brute(docs, items)}
    for size in (1, 200, 1 << 20):
        got = set()
        for a in range(0, len(docs), size):
            n, spans, found = d.find(*d.text_bytes(d.pa.array([t for _, t in docs[a : a + size]])), phrases)
            got |= {(docs[a + k][0], int(n[k]), sum(y - x for x, y in spans[k]), tuple(phrases.items[i] for i in found[k])) for k in range(len(n))}
        assert got == want
