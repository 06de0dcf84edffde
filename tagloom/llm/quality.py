"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades: 0 toxic, 1 low quality, 2 good.  One weight vector over hashed text features gives a score s, and ordered thresholds give
P(grade <= k) = sigmoid(t[k] - s); so all thresholds share the weights.  Features of a text are the shares of its words, of
their first six bytes, of runs of punctuation, and of words in capitals.  ``expected_grade`` is the sum of the tail
probabilities; ``p_good`` is the tail probability P(grade >= 2) used for selection.

The model is fitted on at most about SAMPLE labelled texts a grade, drawn by a hash of doc_id and weighted back to the grades'
counts.  Fitting is full-batch Adam in numpy, so equal samples give equal models.

Edge cases: a doc with several labels takes the lowest grade; a label without quality and toxicity is ignored; without labels
nothing is rejected (null grade).  Null and empty texts have no features and get the bias alone, and are rejected.  Repeated rows
each get a score; extra columns stay, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table, text_bytes, tidied, tidy, word_hashes, word_spans

GRADES, GOOD = 3, 2
BUCKETS = 1 << 18
SAMPLE, STEPS, RATE, RIDGE, SCALE = 2000, 200, 0.1, 1e-4, 60.0
CUT = 0.5
PASS = 500_000  # features at a time in fitting
SLICE = 2 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_MARK = ~_WORD
_MARK[[*range(33), 127]] = False
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text number and bucket of every feature occurrence."""
    starts, ends, _ = word_spans(data, offsets, _WORD)
    low = _LOWER[data]
    text = np.searchsorted(offsets, starts, side="right") - 1
    whole = word_hashes(low, starts, ends)
    front = word_hashes(low, starts, np.minimum(ends, starts + 6))
    capitals = np.concatenate([[0], np.cumsum(_UPPER[data])])
    loud = (capitals[ends] - capitals[starts] == ends - starts) & (ends - starts > 2)
    m_starts, m_ends, _ = word_spans(data, offsets, _MARK)
    marks = word_hashes(data, m_starts, m_ends)
    bucket = np.concatenate([whole, front + np.uint64(0x9E3779B97F4A7C15), marks + np.uint64(12345)]) >> np.uint64(46)
    rows = np.concatenate([text, text, np.searchsorted(offsets, m_starts, side="right") - 1, text[loud]])
    return rows, np.concatenate([bucket.astype(np.int64), np.full(int(loud.sum()), 7)])


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    cuts: np.ndarray  # ordered thresholds, GRADES - 1

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. GRADES - 1."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - score[:, None], -60, 60)))

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.full(len(offsets) - 1, self.bias)
        a = 0
        while a < len(offsets) - 1:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE, side="right")) - 1)
            rows, idx = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            n = np.bincount(rows, minlength=b - a)
            out[a:b] += SCALE * np.bincount(rows, self.weights[idx], minlength=b - a) / np.maximum(n, 1)
            a = b
        return out


@dataclass
class Problem:
    """The weighted likelihood of the cumulative-link model on bags (distinct buckets and shares) of texts.

    Parameters are the weights of the buckets in use, the first threshold and the logarithms of the gaps to the next ones.
    The score has no bias of its own: thresholds hold it.
    """

    bags: list[tuple[np.ndarray, np.ndarray]]
    grades: np.ndarray
    weight: np.ndarray

    def __post_init__(self):
        sizes = np.array([len(x[0]) for x in self.bags], np.int64)
        idx = np.concatenate([np.zeros(0, np.int32), *(x[0] for x in self.bags)])
        val = np.concatenate([np.zeros(0, np.float32), *(x[1] for x in self.bags)]).astype(np.float32) * np.float32(SCALE)
        self.used = np.flatnonzero(np.bincount(idx, minlength=BUCKETS))
        place = np.zeros(BUCKETS, np.int32)
        place[self.used] = np.arange(len(self.used))
        idx = place[idx]
        at = np.concatenate([[0], np.cumsum(sizes)])
        # Blocks of texts keep what is computed for each feature small.
        cut = np.unique(np.searchsorted(at, np.arange(0, at[-1] + PASS, PASS)).clip(0, len(self.bags)))
        self.blocks = [(a, b, idx[at[a] : at[b]], val[at[a] : at[b]], np.repeat(np.arange(b - a), sizes[a:b]).astype(np.int32)) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        self.weight = self.weight / self.weight.sum()

    def cuts(self, p: np.ndarray) -> np.ndarray:
        m = len(self.used)
        return p[m] + np.concatenate([[0], np.cumsum(np.exp(p[m + 1 :]))])

    def loss(self, p: np.ndarray) -> tuple[float, np.ndarray]:
        """The negative log-likelihood with ridge, and its gradient."""
        m, grades, weight = len(self.used), self.grades, self.weight
        s = np.concatenate([np.bincount(row, v * p[i], minlength=b - a) for a, b, i, v, row in self.blocks] or [np.zeros(0)])
        s = np.concatenate([s, np.zeros(len(grades) - len(s))])  # texts at the end without a feature
        gaps, cuts = np.exp(p[m + 1 :]), self.cuts(p)
        upper = 1 / (1 + np.exp(-np.clip(np.append(cuts, np.inf)[grades] - s, -40, 40)))
        lower = 1 / (1 + np.exp(-np.clip(np.insert(cuts, 0, -np.inf)[grades] - s, -40, 40)))
        like = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper), lower * (1 - lower)
        du[grades == GRADES - 1] = 0
        dl[grades == 0] = 0
        g_s = weight * (du - dl) / like
        g_cut = np.zeros(GRADES)
        np.add.at(g_cut, grades, -weight * du / like)
        np.add.at(g_cut, grades - 1, weight * dl / like)
        g_cut = g_cut[: GRADES - 1]
        g_w = RIDGE * p[:m] + sum(np.bincount(i, v * g_s[a:b][row], minlength=m) for a, b, i, v, row in self.blocks)
        g = np.concatenate([g_w, [g_cut.sum()], [gaps[k] * g_cut[k + 1 :].sum() for k in range(GRADES - 2)]])
        return float(-(weight * np.log(like)).sum() + RIDGE / 2 * (p[:m] ** 2).sum()), g


def train(bags: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, weight: np.ndarray) -> Model:
    """Fit by full-batch Adam; the gradient is taken in blocks of about PASS features."""
    problem = Problem(bags, grades, weight)
    m_w = len(problem.used)
    p = np.zeros(m_w + GRADES - 1)
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, STEPS + 1):
        _, g = problem.loss(p)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    weights = np.zeros(BUCKETS)
    weights[problem.used] = p[:m_w]
    return Model(weights.astype(np.float32), 0.0, problem.cuts(p))


def grade(labels: DataFrame) -> DataFrame:
    """doc_id, grade: the lowest grade of each labelled document."""
    g = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", g.alias("grade")).where("grade IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on a bounded sample of labelled texts; what reaches the driver are their hashed features."""
    graded = grade(labels)
    counts = {r["grade"]: r["count"] for r in graded.groupBy("grade").count().collect()}
    if not counts:
        return None
    share = F.create_map(*(F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, SAMPLE / n))))
    sample = graded.where(F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1_000_000)) < share[F.col("grade")] * 1_000_000)

    @tidied
    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            out = []
            for i in range(batch.num_rows):
                _, idx = features(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))
                found, n = np.unique(idx, return_counts=True)
                out.append((found.astype("<i4").tobytes(), (n / max(1, n.sum())).astype("<f4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], names=["doc_id", "grade", "idx", "val"])

    prepare(docs.sparkSession)
    # The sample has at most about SAMPLE rows a grade, whatever the input: small enough to broadcast.
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "grade", "text")
    rows = texts.mapInArrow(bags, "doc_id long, grade int, idx binary, val binary").toPandas().sort_values(["doc_id", "idx"], kind="stable")
    if not len(rows):
        return None
    grades = rows["grade"].to_numpy(int)
    bags_ = [(np.frombuffer(a, "<i4"), np.frombuffer(b, "<f4")) for a, b in zip(rows["idx"], rows["val"], strict=True)]
    del rows
    n = np.bincount(grades, minlength=GRADES)
    weight = np.array([counts.get(k, 0) / max(1, n[k]) for k in range(GRADES)])[grades]
    model = train(bags_, grades, weight)
    del bags_
    tidy()
    return model


SCORED = {"expected_grade": "double", "p_not_toxic": "double", "p_good": "double", "keep": "boolean"}


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """Columns c0, c1, ... of docs, then those of SCORED, as c-columns too."""
    prepare(docs.sparkSession)
    at, n_old = docs.columns.index("text"), len(docs.columns)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if model is None:
                new = [pa.nulls(n, pa.float64())] * 3 + [pa.array([True] * n)]
            else:
                data, offsets = text_bytes(batch.column(at))
                tails = model.tails(model.scores(data, offsets))
                new = [pa.array(tails.sum(axis=1)), pa.array(tails[:, 0]), pa.array(tails[:, GOOD - 1]), pa.array((tails[:, GOOD - 1] >= CUT) & (np.diff(offsets) > 0))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[f"c{k}" for k in range(n_old + 4)])

    kinds = [*(f.dataType.simpleString() for f in docs.schema), *SCORED.values()]
    return docs.toDF(*(f"c{k}" for k in range(n_old))).mapInArrow(run, ", ".join(f"c{k} {t}" for k, t in enumerate(kinds)))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and the columns of SCORED for every row."""
    found = scored(docs.select(F.col("doc_id").cast("long"), "text"), model)
    return found.select("c0", *(f"c{k + 2}" for k in range(len(SCORED)))).toDF("doc_id", *SCORED)


def select_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier keeps, with their own columns."""
    n = len(docs.columns)
    return scored(docs, fit(docs, labels)).where(f"c{n + 3}").select(*(f"c{k}" for k in range(n))).toDF(*docs.columns)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score(docs, fit(docs, labels))
