"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A text is its UTF-8 bytes with A-Z lowered; its subwords are all byte n-grams of ORDERS, hashed into BUCKETS embeddings.  The mean
embedding goes through a linear softmax.  Embeddings and softmax are trained together by mini-batch SGD on a sample of at most
about SAMPLE texts a language; for prediction they are folded into one table of logits by bucket, so a text's logits are sums of
table rows over all its n-grams.  A fifth of the sample, kept out of training, fits a temperature and the lowest score at which
accepted predictions are right TARGET of the time (``accepted``: calibrated rejection).

The number of languages is taken to be small (one weight column each).  Texts without a letter, and null ones, are ``und`` with
score 0.  Null languages are never learned from; rows without any language to learn are all ``und``.  Repeated rows each get a
prediction; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, prepare, table, text_bytes, tidied, tidy

ORDERS, BUCKETS, DIM = (2, 3, 4), 1 << 16, 16
#: Bounds of the training sample: texts a language, and in all. A bag has at most BUCKETS entries, whatever its text's length.
SAMPLE, TOTAL = 1200, 24_000
EPOCHS, BATCH, RATE = 6, 32, 2.0
TARGET = 0.995
SLICE = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[97:123] = True
_SALT = mix(np.arange(1, 8, dtype=np.uint64))


def buckets(data: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each byte; len(data) - order + 1 of them."""
    n = len(data) - order + 1
    if n <= 0:
        return np.zeros(0, np.int32)
    packed = np.zeros(n, np.uint32)
    for k in range(order):
        packed = (packed << np.uint32(8)) | data[k : k + n]
    with np.errstate(over="ignore"):
        packed = (packed ^ np.uint32(_SALT[order] & np.uint64(0xFFFFFFFF))) * np.uint32(2654435761)
    return ((packed ^ (packed >> np.uint32(15))) & np.uint32(BUCKETS - 1)).astype(np.int32)


def bag(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text's bytes and their shares; a slice of the text at a time."""
    counts = np.zeros(BUCKETS, np.int64)
    reach = max(ORDERS) - 1
    for a in range(0, len(data), SLICE):
        low = _LOWER[data[a : a + SLICE + reach]]
        for k in ORDERS:
            counts += np.bincount(buckets(low, k)[:SLICE], minlength=BUCKETS)
    found = np.flatnonzero(counts)
    return found, (counts[found] / max(1, counts.sum())).astype(np.float32)


@dataclass
class Model:
    langs: list[str]
    logits: np.ndarray  # (languages, BUCKETS + 1); the last bucket counts for nothing
    bias: np.ndarray
    temperature: float = 1.0
    accept: float = 0.0

    def sums(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean logits of every text, from all of its n-grams."""
        total = np.zeros((len(offsets) - 1, len(self.langs)))
        data = _LOWER[data]
        reach = max(ORDERS) - 1
        for a in range(0, len(data), SLICE):
            b = min(len(data), a + SLICE)
            first, last = np.searchsorted(offsets, a, side="right") - 1, np.searchsorted(offsets, b, side="left")
            starts = np.maximum(offsets[first:last], a) - a
            keep = np.flatnonzero(np.diff(np.append(starts, b - a)) > 0)
            ends = offsets[first + 1 : last + 1]
            for order in ORDERS:
                idx = np.full(b - a, BUCKETS, np.int32)
                got = buckets(data[a : min(len(data), b + reach)], order)[: b - a]
                idx[: len(got)] = got
                for k in range(1, order):  # n-grams that would cross a text's end
                    cut = ends - k - a
                    idx[cut[(cut >= 0) & (cut < b - a)]] = BUCKETS
                for lang in range(len(self.langs)):
                    total[first + keep, lang] += np.add.reduceat(self.logits[lang][idx], starts[keep], dtype=np.float64)
        n = np.diff(offsets)
        grams = sum(np.maximum(n - k + 1, 0) for k in ORDERS)
        return total / np.maximum(grams, 1)[:, None] + self.bias

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return _softmax(self.sums(data, offsets) / self.temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(bags: list[tuple[np.ndarray, np.ndarray]], langs: list[str], seed: int = 0) -> Model | None:
    """Fit embeddings and softmax by SGD on four fifths of the bags, temperature and rejection on the rest."""
    names = sorted(set(langs))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    y = np.array([names.index(x) for x in langs])
    order = rng.permutation(len(bags))
    held, learn = order[: len(order) // 5], order[len(order) // 5 :]
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    w, b = rng.normal(0, 0.1, (DIM, len(names))).astype(np.float32), np.zeros(len(names), np.float32)
    steps = max(1, EPOCHS * -(-len(learn) // BATCH))
    step = 0
    for _ in range(EPOCHS):
        rng.shuffle(learn)
        for a in range(0, len(learn), BATCH):
            rows = learn[a : a + BATCH]
            rate = RATE * (1 - step / steps) + 0.01
            step += 1
            mean = np.stack([bags[i][1] @ emb[bags[i][0]] for i in rows])
            err = _softmax(mean @ w + b).astype(np.float32)
            err[np.arange(len(rows)), y[rows]] -= 1
            back = err @ w.T
            w -= rate * mean.T @ err / len(rows)
            b -= rate * 0.1 * err.mean(axis=0)
            for i, g in zip(rows, back, strict=True):  # a text's own buckets: the step is scaled by their number
                emb[bags[i][0]] -= (rate * 30) * bags[i][1][:, None] * g
    model = Model(names, np.concatenate([emb @ w, np.zeros((1, len(names)), np.float32)]).T.copy(), b)
    if len(held):
        z = np.stack([bags[i][1] @ model.logits[:, bags[i][0]].T + b for i in held])
        loss = lambda t: -np.log(_softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean()
        model.temperature = float(min(np.geomspace(0.05, 5, 60), key=loss))
        p = _softmax(z / model.temperature)
        top, right = p.max(axis=1), p.argmax(axis=1) == y[held]
        down = np.argsort(-top)
        good = np.flatnonzero(np.cumsum(right[down]) / np.arange(1, len(down) + 1) >= TARGET)
        model.accept = float(top[down[good[-1]]]) if len(good) else 1.0
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame) -> Model | None:
    """Train on a sample, by hash of doc_id, of at most about SAMPLE texts a language and TOTAL in all."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row a language
    if not counts:
        return None
    most = min(SAMPLE, max(1, TOTAL // len(counts)))
    share = F.create_map(*(F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, most / n))))
    picked = known.where(F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)

    @tidied
    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            found = [bag(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            columns = [batch.column(0), pa.array([x.astype("<u2").tobytes() for x, _ in found], pa.binary()), pa.array([y.astype("<f4").tobytes() for _, y in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "idx", "share"])

    prepare(docs.sparkSession)
    rows = picked.select("lang", "text").mapInArrow(bags, "lang string, idx binary, share binary").toPandas().sort_values(["idx", "share", "lang"], kind="stable")
    model = train([(np.frombuffer(i, "<u2").astype(np.int64), np.frombuffer(x, "<f4")) for i, x in zip(rows["idx"], rows["share"], strict=True)], list(rows["lang"]))
    del rows
    tidy()
    return model


PREDICTION = "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean"


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            n = batch.num_rows
            lang, score, accepted = ["und"] * n, np.zeros(n), np.zeros(n, bool)
            if model and n:
                p = model.scores(data, offsets)
                hits = np.concatenate([[0], np.cumsum(_ASCII_LETTER[_LOWER[data]])])[offsets]
                letters = np.diff(hits) > 0
                for i in np.flatnonzero(~letters & (np.diff(offsets) > 0)):
                    letters[i] = any(c.isalpha() for c in bytes(data[offsets[i] : offsets[i + 1]]).decode())
                best = p.argmax(axis=1)
                lang = [model.langs[k] if ok else "und" for k, ok in zip(best, letters, strict=True)]
                score = np.where(letters, p.max(axis=1), 0.0)
                accepted = letters & (score >= model.accept)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(lang, pa.string()), pa.array(score), pa.array(accepted)], names=["doc_id", "held_out", "lang_pred", "score", "accepted"])

    prepare(docs.sparkSession)
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, PREDICTION)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
