import zlib

import numpy as np
import pyarrow as pa

from tagloom.llm import language_id as g
from tagloom.llm.common import table, text_bytes


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = g.predict(docs, g.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_sums_are_those_of_whole_texts():
    texts = ["Hello there", "", "a", "ab", "été là-bas " * 9, "x" * 300]
    rng = np.random.default_rng(0)
    model = g.Model(["a", "b"], np.concatenate([rng.normal(size=(2, g.BUCKETS)), np.zeros((2, 1))], axis=1).astype(np.float32), np.zeros(2))
    want = []
    for t in texts:
        found, share = g.bag(np.frombuffer(t.encode(), np.uint8))
        want.append(share @ model.logits[:, found].T if len(found) else np.zeros(2))
    for size in (7, 64, 1 << 20):
        g.SLICE = size
        assert np.allclose(model.sums(*text_bytes(pa.array(texts))), want, atol=1e-5)
    g.SLICE = 1 << 20


def test_edges(spark):
    rows = [(k, f"the cat number {k} sat on it", "en") for k in range(40)] + [(k, f"le chat numéro {k} est là", "fr") for k in range(40, 80)]
    rows += [(90, None, "en"), (91, "123 !!", None), (92, "", "fr"), (93, "ñ", None), (None, "the cat", "en"), (94, "le chat " * 50000, None)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in g.predict(df, g.fit(df)).collect()}
    assert [got[k].lang_pred for k in (90, 91, 92)] == ["und"] * 3 and got[90].score == 0
    assert got[93].lang_pred in ("en", "fr") and got[94].lang_pred == "fr" and got[None].held_out is False
    assert g.fit(df.where("lang IS NULL")) is None
    assert {r.lang_pred for r in g.predict(df, None).collect()} == {"und"}
    assert g.predict(df.limit(0), None).count() == 0


def test_query_against_brute_force(spark):
    """Every n-gram of every text, one by one."""
    rng = np.random.default_rng(3)
    model = g.Model(["de", "en", "fr"], np.concatenate([rng.normal(size=(3, g.BUCKETS)), np.zeros((3, 1))], axis=1).astype(np.float32), rng.normal(size=3), 0.7, 0.5)
    texts = [None, "", "a", "Où est-il?", "THE END", "123", "x", "the end " * 300, "ß"]
    df = spark.createDataFrame([(k, texts[k % len(texts)], "en", "s") for k in range(2 * len(texts))], "doc_id long, text string, lang string, lang_pred string")
    for r in g.predict(df, model).collect():
        raw = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in texts[r.doc_id % len(texts)] or "").encode()
        grams = [raw[i : i + k] for k in g.ORDERS for i in range(len(raw) - k + 1)]
        z = model.bias + sum((model.logits[:, g.buckets(np.frombuffer(x, np.uint8), len(x))[0]] for x in grams), np.zeros(3)) / max(1, len(grams))
        p = np.exp(z / 0.7 - (z / 0.7).max())
        p /= p.sum()
        letters = any(c.isalpha() for c in texts[r.doc_id % len(texts)] or "")
        assert r.lang_pred == (model.langs[int(p.argmax())] if letters else "und")
        assert abs(r.score - (p.max() if letters else 0)) < 1e-5 and r.accepted == (letters and r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
