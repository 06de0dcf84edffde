import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tagloom.llm import ngram_join as j


def brute(docs):
    import re

    sets = []
    for _, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for k in range(i):
            same = len(a & sets[k])
            if a and 100 * same >= 80 * (len(a) + len(sets[k]) - same):
                up[root(i)] = root(k)
    least = {}
    for i, (doc, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted((doc, len(sets[i]), least[root(i)]) for i, (doc, _) in enumerate(docs))


def edited(rng, words, k):
    words = list(words)
    for _ in range(k):
        i = int(rng.integers(0, len(words)))
        what = rng.integers(3)
        if what == 0:
            words[i] = f"e{rng.integers(1e6)}"
        elif what == 1:
            del words[i : i + (len(words) > 1)]
        else:
            words.insert(i, f"i{rng.integers(5)}")
    return words


@given(st.integers(1, 400), st.integers(0, 99), st.integers(0, 2**32))
@settings(max_examples=200, deadline=None)
def test_similar_sets_share_what_they_must(n, share, seed):
    rng = np.random.default_rng(seed)
    pool = rng.integers(0, 2**63, 2 * n + 2, dtype=np.uint64)
    a = np.unique(pool[:n])
    size = max(1, int(n * (0.78 + 0.5 * share / 100)))
    shift = int(rng.integers(0, max(1, n // 8) + 1))
    b = np.unique(pool[shift : shift + size])
    same = len(np.intersect1d(a, b))
    if 100 * same < 80 * (len(a) + len(b) - same):
        return
    common = set(j.instances(len(a))) & set(j.instances(len(b)))
    assert common
    for i in common:
        p = j.parts(i, max(j.level_of(a, i), j.level_of(b, i)))
        u, v = (set(j.signatures(s, i, p)[: j.shown(len(s))].tolist()) for s in (a, b))
        assert len(u & v) >= j.need(min(len(a), len(b)))


def test_need_never_falls():
    got = [j.need(n) for n in range(1, 3000)]
    assert got == sorted(got) and got[0] == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    docs = []
    passage = [f"p{k}" for k in range(30)]
    for f in range(6):
        base = [f"w{rng.integers(400)}" for _ in range(int(rng.choice([8, 20, 60, 150, 300])))] + (passage if f % 2 else [])
        for _ in range(35):
            words = edited(rng, base, int(rng.integers(0, 1 + len(base) // 12)))
            docs.append(" ".join(words))
            if rng.random() < 0.2:  # a chain away from the base
                for _ in range(4):
                    words = edited(rng, words, max(1, len(base) // 60))
                    docs.append(" ".join(words))
    docs += ["a b c", "A\tb  C", "a b", None, "", " \n", "one", "x " * 3000, "x " * 2000, " ".join(passage)]
    docs = [(int(i), d) for i, d in zip(rng.permutation(len(docs)), docs, strict=True)]
    df = spark.createDataFrame([(*r, "k") for r in docs], "doc_id long, text string, node string")
    assert sorted(tuple(r) for r in j.near_duplicates(df).collect()) == brute(docs)
    stay = {r.doc_id for r in j.one_of_each(df).collect()}
    assert stay == {a for a, n, c in brute(docs) if n == 0 or a == c}


def test_empty(spark):
    assert j.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_without_a_doc_id_link_and_one_of_each_stays(spark):
    words = [f"w{k}" for k in range(200)]
    text = lambda k: " ".join([*(f"x{i}" for i in range(k)), *words[k:]])
    rows = [(1, text(0)), (None, text(15)), (None, text(15)), (3, text(30)), (7, "other text " * 9), (7, text(1)), (None, "only here one"), (None, "only here one"), (None, " "), (8, ""), (9, "twice the same"), (9, "twice the same")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, j.near_duplicates(df).where("doc_id IS NULL OR doc_id IN (1, 3)").collect()), key=str)
    assert got == sorted([(1, 196, 1), (3, 196, 1), (None, 196, 1), (None, 196, 1), (None, 1, None), (None, 1, None), (None, 0, None)], key=str)
    stay = sorted(map(tuple, j.one_of_each(df).collect()), key=str)
    assert stay == sorted([(1, text(0)), (7, "other text " * 9), (None, "only here one"), (None, " "), (8, ""), (9, "twice the same")], key=str)


def test_clashing_columns_hot_signatures_and_large_families(spark, monkeypatch):
    for name, value in (("HOT", 2), ("FAMILY", 3), ("SEEN", 4), ("ROWS", 60)):
        monkeypatch.setattr(j, name, value)
    rng = np.random.default_rng(9)
    base, passage = [f"w{k}" for k in range(120)], [f"p{k}" for k in range(80)]
    texts = [" ".join(edited(rng, base, int(rng.integers(0, 6)))) for _ in range(30)]
    texts += [" ".join([*passage, *(f"u{k}x{i}" for i in range(12 + k))]) for k in range(25)]
    docs = list(enumerate([*texts, *texts[:10], None, "", "a b"]))
    df = spark.createDataFrame([(*r, 1, "h", 2, 3, "root") for r in docs], "doc_id long, text string, id int, h string, n int, __id int, root string")
    want = brute(docs)
    assert sorted(tuple(r) for r in j.near_duplicates(df).collect()) == want
    one = j.one_of_each(df)
    assert one.columns == df.columns
    assert {r.doc_id for r in one.collect()} == {a for a, n, c in want if n == 0 or a == c}


@given(st.integers(0, 2**32))
@settings(max_examples=100, deadline=None)
def test_the_rarest_shared_signature_is_left(seed):
    rng = np.random.default_rng(seed)
    frequency = rng.zipf(1.3, 60)
    n = int(rng.integers(4, 60))
    need = j.need(-(-4 * n // 5))
    shared = rng.choice(60, min(60, need), replace=False)
    sides = [np.union1d(shared, rng.choice(60, int(rng.integers(0, 20)))) for _ in range(2)]
    left = [set(sorted(s.tolist(), key=lambda k: (-frequency[k], k))[need - 1 :]) for s in sides]
    assert left[0] & left[1]
