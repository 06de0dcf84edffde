from collections import defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa

from tagloom.llm import mixing as m


def water(budget, children):
    """children: name -> (weight, cap). Plain filling: deal by weight, take out who is full, again."""
    got, open_ = {k: 0 for k in children}, {k for k, (w, _) in children.items() if w > 0}
    while open_:
        left = budget - sum(got.values())
        total = sum(children[k][0] for k in open_)
        full = {k for k in open_ if children[k][1] <= Fraction(children[k][0] * left, total)}
        if not full:
            return got | {k: children[k][0] * left // total for k in open_}
        got |= {k: children[k][1] for k in full}
        open_ -= full
    return got


def test_budgets_against_plain_filling(spark):
    rng = np.random.default_rng(3)
    leaves = {(f"d{a}", l, f"s{c}"): int(rng.integers(0, 10 ** rng.integers(1, 9))) for a in range(3) for l in ("en", "de", "xx") for c in range(4)}
    df = spark.createDataFrame([(*k, v) for k, v in leaves.items()], "__domain string, __lang string, __source string, tokens long")
    weights = {"__domain": "CASE __domain WHEN 'd0' THEN 5 ELSE 2 END", "__lang": m.WEIGHTS["__lang"], "__source": "CASE __source WHEN 's0' THEN 0 WHEN 's1' THEN 7 ELSE 1 END"}
    w = lambda level, x: {"d0": 5}.get(x, 2) if level == 0 else {"en": 4, "de": 2}.get(x, 1) if level == 1 else {"s0": 0, "s1": 7}.get(x, 1)
    for percent in (10, 60, 150):
        want, now = {}, {(): sum(leaves.values()) * percent // 100}
        for level in range(3):
            after = {}
            for parent, budget in now.items():
                kids = defaultdict(int)
                for k, v in leaves.items():
                    if k[:level] == parent:
                        kids[k[level]] += 2 * v
                after |= {(*parent, x): b for x, b in water(budget, {x: (w(level, x), c) for x, c in kids.items()}).items()}
            now = after
        got = {(r["__domain"], r["__lang"], r["__source"]): r["budget"] for r in m.budgets(df, percent, 2, weights).collect()}
        assert got == now, percent


def test_selection_against_sql_and_its_prefixes(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k), "w " * int(rng.integers(0, 60)), str(rng.choice(["en", "de", "fr", "es"])), "src0" if rng.random() < 0.5 else f"src{rng.integers(9)}") for k in range(900)]
    rows += [(900, None, None, None), (901, "a b", None, "src1"), (901, "a b", None, "src1"), (None, "x y z", "en", "src0")]
    documents = pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate((("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string())))})
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.sql(m.ORACLE_SQL["op7_mixing"]).fetchall()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = m.mix(df).select("doc_id", "__domain", "__lang", "__source", "__n_tokens", "__copies").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert {r["__copies"] for r in got} == {1, 2}
    once = m.select_mixture(df)
    assert once.columns == df.columns and once.count() <= len(rows)
    assert m.mix(df.limit(0)).count() == 0 and m.mix(df.where("text IS NULL")).count() == 0


def test_clashing_columns_and_a_very_long_text(spark):
    rows = [(k, "w " * (1 + k), "en", f"s{k % 3}", f"d{k}", 5, "a", 1) for k in range(60)] + [(60, "x " * 400_000, "de", "s0", "d", 5, "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, __domain string, __key int, row string, __copies int")
    once = m.select_mixture(df)
    assert once.columns == df.columns
    got = {r["doc_id"]: r for r in once.collect()}
    assert got and all(tuple(r) == rows[k] for k, r in got.items())
    plain = m.select_mixture(df.select("doc_id", "text", "lang", "source"))
    assert {r["doc_id"] for r in plain.collect()} == got.keys()
    more = m.mix(df)
    assert more.columns[:8] == df.columns and {r["__domain_"] for r in more.collect()} <= {f"domain{k}" for k in range(4)}


def test_documents_without_tokens_at_the_edge(spark):
    # The prefix ends where a bucket does; the next ones' documents without tokens come with it only up to the end.
    rows = [(k, "" if k % 3 else "a b", "en", "s") for k in range(300)]
    con = duckdb.connect()
    con.register("documents", pa.table({n: pa.array([r[k] for r in rows]) for k, n in enumerate(("doc_id", "text", "lang", "source"))}))
    want = sorted(r[0] for r in con.sql(m.ORACLE_SQL["op7_mixing"]).fetchall())
    got = m.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert sorted(r["doc_id"] for r in got.collect()) == want
