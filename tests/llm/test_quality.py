import re

import numpy as np
import pyarrow as pa

from tagloom.llm import quality as q
from tagloom.llm.common import text_bytes, word_hashes


def test_gradient_against_differences():
    rng = np.random.default_rng(4)
    bags = [(np.unique(rng.integers(0, 40, 6)).astype(np.int32),) for _ in range(30)] + [(np.zeros(0, np.int32),)]
    bags = [(i, rng.random(len(i)).astype(np.float32)) for (i,) in bags]
    problem = q.Problem(bags, rng.integers(0, q.GRADES, len(bags)), rng.random(len(bags)) + 0.1)
    p = rng.normal(0, 0.01, len(problem.used) + q.GRADES - 1)
    _, g = problem.loss(p)
    for k in range(len(p)):
        step = np.zeros_like(p)
        step[k] = 1e-5
        assert abs((problem.loss(p + step)[0] - problem.loss(p - step)[0]) / 2e-5 - g[k]) < 1e-4


def hashed(words):
    data, offsets = text_bytes(pa.array(words, pa.large_binary()))
    return word_hashes(data, offsets[:-1], offsets[1:])


def brute(text, model):
    """The tail probabilities of a text, feature by feature."""
    raw = (text or "").encode()
    words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", raw)
    marks = re.findall(rb"[!-/:-@\[-`{-~]+", raw)
    feature = [int(h >> np.uint64(46)) for h in hashed([w.lower() for w in words])]
    feature += [int((h + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)) for h in hashed([w.lower()[:6] for w in words])]
    feature += [int((h + np.uint64(12345)) >> np.uint64(46)) for h in hashed(marks)]
    feature += [7] * sum(bool(re.fullmatch(rb"[A-Z]{3,}", w)) for w in words)
    s = q.SCALE * sum(float(model.weights[k]) for k in feature) / max(1, len(feature))
    return [1 / (1 + np.exp(c - s)) for c in model.cuts]


def test_query_against_brute_force_with_clashing_columns(spark):
    rng = np.random.default_rng(6)
    texts = ["GOOD words, and more.", "BAD!!! stuff", "é ok 12 x", "", None, "a " * 30_000, "GOOD words, and more."]
    rows = [(k, texts[k % len(texts)], "user", 7) for k in range(21)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __keep string, c1 int")
    model = q.Model(rng.normal(0, 0.2, q.BUCKETS).astype(np.float32), 0.0, np.array([-0.4, 0.3]))
    got = {r.doc_id: r for r in q.score(df, model).collect()}
    with np.errstate(over="ignore"):
        want = {k: brute(t, model) for k, t, *_ in rows}
    for k, t, *_ in rows:
        assert np.allclose((got[k].p_not_toxic, got[k].p_good), want[k], atol=1e-5)
        assert abs(got[k].expected_grade - sum(want[k])) < 1e-5 and got[k].keep == (bool(t) and want[k][1] >= q.CUT)
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    kept = q.select_quality(df, labels)
    assert kept.columns == df.columns and all(tuple(r) in rows for r in kept.collect())
    assert q.select_quality(df, labels.limit(0)).count() == len(rows)
