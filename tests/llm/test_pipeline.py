import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tagloom.llm import quality
from tagloom.llm.common import table

from .test_decontaminate import brute as hits
from .test_ngram_join import brute as near


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = corpus_pipeline.materialize(stage(spark, docs, sf), name)
        after = docs.collect()
        if name != "tokens":
            assert docs.columns == columns
            assert all(before[r.doc_id] == r for r in after) and len({r.doc_id for r in after}) == len(after)
        kept.append(len(after))
        ids = {r.doc_id for r in after}
        if name == "quality":
            grades = {r["doc_id"]: r["quality"] * (1 - r["toxic"]) for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
            right = [(k in ids) == bool(g) for k, g in grades.items() if k in before]
            assert np.mean(right) > 0.95
        elif name == "near_copies":
            assert ids == {a for a, n, c in near([(k, r.text) for k, r in before.items()]) if n == 0 or a == c}
        elif name == "decontaminate":
            items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{sf}/benchmark.parquet").to_pylist()]
            assert ids == {x[0] for x in hits([(k, r.text) for k, r in before.items()], items) if not x[4]}
        elif name == "mixing":
            words = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rows)
            assert 0.6 * words(before.values()) < words(after) <= 0.8 * words(before.values())
        else:
            t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            got, start = {r.doc_id: r for r in after}, 0
            for k in sorted(before):
                x = np.array([*t.encode(before[k].text, add_special_tokens=False).ids, 0], "<u4")
                assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(x), zlib.crc32(x.tobytes()))
                start += len(x)
    assert kept[0] > kept[1] and kept[3] == kept[4] > 0


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality.fit(docs, labels.where("doc_id % 5 <> 0"))
    rows = quality.score(docs, model).join(quality.grade(labels.where("doc_id % 5 = 0")), "doc_id").collect()
    good = [r.keep for r in rows if r.grade == 2]
    low, toxic = ([not r.keep for r in rows if r.grade == k] for k in (1, 0))
    assert np.mean(good) > 0.98 and np.mean(toxic) > 0.95 and np.mean(low) > 0.7
    assert list(model.cuts) == sorted(model.cuts)


def test_classifier_edges(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 2), (2, "x " * 50000, 2), (None, "a", 3)], "doc_id long, text string, keep int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit(df, none) is None and quality.select_quality(df, none).count() == 4
    some = spark.createDataFrame([(2, 1, 0), (1, 0, 0), (1, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = quality.score(df, quality.fit(df, some))
    assert got.count() == 4 and quality.select_quality(df, some).columns == df.columns
    assert got.where("doc_id = 1 AND keep").count() == 0
    assert quality.score(df.limit(0), None).count() == 0
